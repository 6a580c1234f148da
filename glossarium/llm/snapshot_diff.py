"""Difference of two snapshots of a table as a signed multiset, with rekeyed rows.

Rows of the earlier snapshot count +1, those of the later one -1.  Equal rows (key and compared columns) are summed, which
cancels what did not change.  What is left is consolidated by key: an earlier and a later row of one key are an update.  What is
then left is consolidated by content: rows of equal content, the earlier ones and the later ones numbered by key, pair by number
and are rekeys.  The rest was deleted or inserted.

Columns are compared by 128 bits of their SHA-256, so no text is shuffled unless it is carried.  Keys and contents of any number
of rows are numbered in many tasks (ranks.py) and paired by group and number; nothing is gathered in one task or on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apart, named, settled
from .ranks import copied, ranked

#: Bytes of a column's digest.
DIGEST = 16
_ATOMS = ("string", "bigint", "int", "smallint", "tinyint", "boolean", "date", "double", "float")


def _digest(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    atom = kind in _ATOMS or kind.startswith(("decimal", "timestamp"))
    text = named(column) if kind == "binary" else named(column).cast("string") if atom else F.to_json(F.struct(named(column).alias("v")))
    return F.when(named(column).isNotNull(), F.substring(F.unhex(F.sha2(text, 256)), 1, DIGEST)).otherwise(F.lit(b""))


def _side(df: DataFrame, later: bool, key: str, columns: Sequence[str], carry: Sequence[str]) -> DataFrame:
    kept = F.struct(*(named(c).alias(f"c{k}") for k, c in enumerate(carry)), F.lit(True).alias("is"))
    digests = (_digest(df, c).alias(f"d{k}") for k, c in enumerate(columns))
    return df.select(named(key).alias("key"), *digests, F.lit(int(later)).alias("later"), (kept if later else F.lit(None)).alias("kept"))


def _paired(rows: DataFrame, group: Column, order: list[str], width: int, name: str) -> DataFrame:
    """(a, b): the i-th earlier and the i-th later row of every group, null where there is none; a row counts n times."""
    row = [f"d{k}" for k in range(width)]
    placed = ranked(rows.withColumn("grp", group), ["grp", "later"], order, f"{name}-ranks", "n")
    each = copied(placed, "n", "copy").withColumn("rank", F.col("rank") + F.col("copy"))
    side = lambda later, *more: F.max(F.when(F.col("later") == later, F.struct("key", *row, *more)))
    pairs = each.groupBy("grp", "rank").agg(side(0).alias("a"), side(1, "kept").alias("b"))
    return settled(pairs.select("a", "b"), name)


def diff(earlier: DataFrame, later: DataFrame, key: str = "doc_id", content: Sequence[str] = ("text",), columns: Sequence[str] = ("text", "lang", "source"), carry: Sequence[str] | None = None) -> DataFrame:
    """key, old_key, op, changed and the columns `carry` of the later row (those compared, unless given), a row for each pair or
    unpaired row.

    op: same, update (equal keys), rekey (equal content), insert, delete; changed: the names, comma-joined, of the columns in which
    a pair differs.  key is the later row's, for a deleted row the earlier one's; old_key the earlier row's, null for inserted ones.
    `content` are some of `columns`.  Nulls equal only nulls, in keys as well.  Of rows that share a key, equal ones pair first, the
    rest in the order of their digests; of rows that share a content, the i-th smallest earlier key (nulls first) pairs with the
    i-th smallest later one, and equal keys by their digests.  Repeated rows count as often as they stand there.  Of later rows that
    are equal in key and columns but not in `carry`, the largest values stand for all.  Columns that are not named are not read.
    Carried columns that are called like one of the result's get underscores in front.  Empty tables delete or insert everything.
    """
    carry, width = list(columns if carry is None else carry), len(columns)
    row, spread = [f"d{k}" for k in range(width)], [f"c{k}" for k in range(len(carry))]
    both = _side(earlier, False, key, columns, carry)
    both = both.withColumn("kept", F.lit(None).cast(_side(later, True, key, columns, carry).schema["kept"].dataType)).unionByName(_side(later, True, key, columns, carry))
    sums = settled(both.groupBy("key", *row).agg(F.count_if(F.col("later") == 0).alias("n0"), F.count_if(F.col("later") == 1).alias("n1"), F.max("kept").alias("kept")), "sums")
    fields = F.struct("key", *row)
    same = copied(sums.withColumn("n", F.least("n0", "n1")), "n", "copy").select(fields.alias("a"), F.struct("key", *row, "kept").alias("b"), F.lit("same").alias("op"))
    residue = sums.withColumn("n", F.abs(F.col("n0") - F.col("n1"))).filter("n > 0").withColumn("later", (F.col("n1") > F.col("n0")).cast("int"))
    # a group is named by a text that is not null
    by_key = _paired(residue.select("key", *row, "later", "kept", "n"), F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("")), row, width, "by_key")
    update = by_key.filter("a is not null and b is not null").withColumn("op", F.lit("update"))
    alone = by_key.filter("a is null or b is null")
    left = alone.select("*", F.col("a").isNull().cast("int").alias("later"), F.coalesce(F.col("a"), F.struct("b.key", *(f"b.{c}" for c in row))).alias("r"))
    rest = left.select("r.*", "later", F.col("b.kept").alias("kept")).groupBy("key", *row, "later").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    same_content = F.concat_ws(",", *(F.hex(f"d{list(columns).index(c)}") for c in content))
    by_content = _paired(rest, same_content, ["key", *row], width, "by_content")
    rekey = by_content.withColumn("op", F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").otherwise("rekey"))
    found = same.unionByName(update).unionByName(rekey)
    differs = [F.when(F.col(f"a.{d}") != F.col(f"b.{d}"), c) for d, c in zip(row, columns, strict=True)]
    return found.select(
        F.when(F.col("b").isNull(), F.col("a.key")).otherwise(F.col("b.key")).alias("key"), F.col("a.key").alias("old_key"), "op",
        F.concat_ws(",", *differs).alias("changed"), *(F.col(f"b.kept.{s}").alias(c) for s, c in zip(spread, apart(carry, "key", "old_key", "op", "changed"), strict=True)),
    )
