"""Helpers shared by the training-text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lowrank import kept as settled  # noqa: F401  the operators take both from here
from ..operators.lowrank import shared as shared_dir  # noqa: F401

#: What separates words where white space does.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each behind as many underscores as it takes not to meet a column of df or one another."""
    return apart(names, *df.columns)


def apart(columns: Sequence[str], *taken: str) -> list[str]:
    """The columns' names, each behind as many underscores as it takes not to meet one of `taken` or one another."""
    used, out = {c.lower() for c in taken}, []
    for n in columns:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart: the id, which may be null or repeated, and two 64-bit hashes of the text."""
    text = named(text_col).cast("string")
    return F.struct(named(id_col).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def by_row(docs: DataFrame, found: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """docs joined to found by its column `row`, a row_key(); and the names under which found's other columns stand there.

    Null ids are equal here.  As the key holds the text's hashes, rows without an id, or of one id, spread over all tasks.
    """
    extra = [c for c in found.columns if c != "row"]
    i, a, b, *new = fresh(docs, "row_id", "row_a", "row_b", *extra)
    right = found.select(F.col("row.id").alias(i), F.col("row.a").alias(a), F.col("row.b").alias(b), *(named(c).alias(n) for c, n in zip(extra, new, strict=True)))
    text = named(text_col).cast("string")
    same = named(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(a)) & (F.xxhash64(F.lit(1), text) == F.col(b))
    return docs.join(right, same, how).drop(i, a, b), new


def lower_latin(text: Column) -> Column:
    """Lower-case text so that A-Z become a-z and no other character becomes one of them.

    For matching against ASCII words only: letters beyond ASCII may change into others beyond ASCII.  (translate() would
    leave them alone, but takes four times as long.)
    """
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))


def space_words(text: Column) -> Column:
    """Words between white space; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def train_row(doc_id: Column) -> Column:
    """True where labels may be learnt from: crc32 of the id as text is not divisible by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def salted_lookup(rows: DataFrame, key: str, values: DataFrame, salts: int = 32) -> DataFrame:
    """Left join rows to values (unique by key); a key that many rows hold is dealt over `salts` tasks."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    right = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def counted_lookup(rows: DataFrame, key: str, values: DataFrame, count: str, total: int, share: int = 10_000) -> DataFrame:
    """Left join rows to values (unique by key), whose column `count` says how many of the `total` rows hold the key.

    Keys of more than one row in `share` are broadcast, at most `share` of them; the others are shuffled, with no key large.
    """
    heavy = values.filter(F.col(count) * share > total)
    common = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(values, key, "left")
    return common.unionByName(rest)


def held_out(doc_id: Column) -> Column:
    """The other rows: never learnt from.  A null id is one of them."""
    return F.coalesce(~train_row(doc_id), F.lit(True))


def known_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of the rows that labels may be learnt from: 0 or 1, an id once, with its larger label."""
    known = labels.select(named(id_col).alias("doc_id"), named(label_col).cast("int").alias("label")).filter(train_row(F.col("doc_id")) & F.col("label").isin(0, 1))
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def few_texts(docs: DataFrame, most: int, seed: int, among: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of at most `most` training rows, the smallest by a hash of id and text; of the ids in `among` (doc_id), if given.

    Rows that repeat id and text count once, an id with several texts once for each; a null text is empty.  Ids and hashes are
    sorted first, so only rows that are taken send their texts; at most `most` pairs of them are broadcast.
    """
    rows = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text")).filter(train_row(F.col("doc_id")))
    rows = rows.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "text"))
    narrow = rows.select("doc_id", "_order")
    if among is not None:
        narrow = narrow.join(among.select("doc_id").distinct(), "doc_id", "left_semi")
    taken = narrow.distinct().orderBy("_order", "doc_id").limit(most)
    return rows.join(F.broadcast(taken), ["doc_id", "_order"]).dropDuplicates(["doc_id", "_order"]).select("doc_id", "text")


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label): few_texts() of either class, of known_labels()."""
    known = known_labels(labels, label_col, id_col)
    each = [few_texts(docs, per_class, 11, known.filter(F.col("label") == v), id_col, text_col).withColumn("label", F.lit(v)) for v in (0, 1)]
    return each[0].unionByName(each[1])


def logistic_curve(x, y, steps: int = 50) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a x + b))) for labels y by Newton's method, with Platt's smoothed targets."""
    import numpy as np

    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    yes, no = y.sum(), (1 - y).sum()
    if not yes or not no:
        return 0.0, float(np.log((yes + 1) / (no + 1)))
    t = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    scale, shift = max(x.std(), 1e-9), x.mean()
    z, a, b = (x - shift) / scale, 0.0, float(np.log((yes + 1) / (no + 1)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        h = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * z).sum() + 1e-3 * a, (p - t).sum()])
        m = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        a, b = a - float(np.clip(step[0], -4, 4)), b - float(np.clip(step[1], -4, 4))
    return a / scale, b - a * shift / scale
