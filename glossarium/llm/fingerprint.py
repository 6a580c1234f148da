"""One-permutation MinHash fingerprints (DataFrame functions only).

A text's distinct 5-word shingles are hashed once; the high bits of a hash name one of 256 bins and each bin keeps its
smallest hash.  A bin that stays empty borrows from another by optimal densification: it tries bins in an order of its own,
the same for every text, until it meets one that is not empty.  The low-order byte of each bin is stored; since unlike bins
agree in it once in 256 times, likeness is (share of equal bytes - 1/256) / (1 - 1/256).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES

SHINGLE, BIN_BITS, BYTE = 5, 8, 255
BINS = 1 << BIN_BITS
#: Bits of a hash below its bin; tries by a fixed order before the general rule; documents of an id range.
LOW, TRIES, RANGE = 63 - BIN_BITS, 12, 4000
#: Id ranges at most: their starts are a literal of the plan, half a megabyte; starts that are looked at together.
RANGES, SPAN = 1 << 16, 256


def with_bins(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add array column `out`: the stored byte of each bin, or an empty array for a text without words (or null)."""
    c = lambda s: f"_{out}_{s}"
    words, size, hashes, order, dense, full = (c(s) for s in ("words", "size", "hashes", "order", "dense", "full"))
    gram = ", ".join(f"`{words}`[i + {j}]" if j else f"`{words}`[i]" for j in range(SHINGLE))
    last = f"(shiftleft(bigint(b), {LOW}) + {(1 << LOW) - 1}L)"
    probe = ", ".join(f"if(`{dense}`[int(xxhash64(b, {t}) & {BINS - 1})] = {last.replace('bigint(b)', f'(xxhash64(b, {t}) & {BINS - 1}L)')}, null, `{dense}`[int(xxhash64(b, {t}) & {BINS - 1})])" for t in range(TRIES))
    rest = f"array_min(transform(`{c('live')}`, x -> struct(xxhash64(b, shiftright(x, {LOW})) as rank, x as x))).x"
    df = df.withColumn(words, F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SPACES), "")).withColumn(size, F.size(words))
    df = df.withColumn(hashes, F.expr(f"case when `{size}` = 0 then array() when `{size}` < {SHINGLE} then array(xxhash64(concat_ws(' ', `{words}`)) & {(1 << 63) - 1}L) else transform(sequence(0, `{size}` - {SHINGLE}), i -> xxhash64({gram}) & {(1 << 63) - 1}L) end"))
    # a mark behind the last place of each bin makes sure that every bin is met, in order
    df = df.withColumn(order, F.expr(f"sort_array(concat(`{hashes}`, transform(sequence(0, {BINS - 1}), b -> {last})))"))
    df = df.withColumn(dense, F.expr(f"filter(`{order}`, (x, i) -> i = 0 or shiftright(x, {LOW}) <> shiftright(`{order}`[i - 1], {LOW}))"))
    df = df.withColumn(c("live"), F.expr(f"filter(`{dense}`, (x, b) -> x <> {last})")).withColumn(c("count"), F.size(c("live")))
    df = df.withColumn(full, F.expr(f"case when `{c('count')}` = 0 then array() else transform(`{dense}`, (x, b) -> if(x = {last}, coalesce({probe}, {rest}), x)) end"))
    df = df.withColumn(out, F.expr(f"transform(`{full}`, x -> int(x & {BYTE}))"))
    return df.drop(words, size, hashes, order, dense, full, c("live"), c("count"))


def packed(bins: Column) -> Column:
    """The bytes as lower-case hexadecimal text, two digits a bin."""
    return F.lower(F.array_join(F.transform(bins, lambda x: F.right(F.hex(x + 256), F.lit(2))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance, 0 to 1: 1 for two empty fingerprints, 0 for an empty and another (or a missing) one."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 1 / (BYTE + 1)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == BINS) & (F.size(b) == BINS), F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))).otherwise(0.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every text; equal texts (up to case and white space) have equal fingerprints."""
    bins = with_bins(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "bins")
    return bins.select("doc_id", packed(F.col("bins")).alias("fingerprint"))


def _with_next(docs: DataFrame) -> DataFrame:
    """Each document with the text of the next by doc_id (the first follows the last) and its place in the order of its range.

    Documents are dealt by id range; a range's first document is also sent, as a guest, to the end of the range before it, so
    texts move once and no task sees more than a range.  Rows with one id stand in the order of their texts.  A row without an
    id has no place in that order: it is its own next, and such rows are dealt by their texts' hashes.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = docs.count()
    ranges = min(RANGES, max(4 * parts, math.ceil(n / RANGE)))
    shares = [k / ranges for k in range(1, ranges)]
    low, cuts = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", shares, 100_000)).first() if n else (None, None)
    starts = sorted({x for x in [low, *(cuts or [])] if x is not None}) or [0]
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  folded to one literal
    # the range is the number of starts up to the id: those at every SPAN-th place are counted first, then the SPAN behind
    every, all_starts = literal(starts[::SPAN]), literal(starts)
    upto = lambda xs: F.size(F.filter(xs, lambda s: s <= F.col("doc_id")))
    rough = F.greatest(upto(every) - 1, F.lit(0)) * SPAN
    place = docs.withColumn("rough", rough).withColumn("near", F.slice(all_starts, F.col("rough") + 1, F.lit(SPAN)))
    place = place.withColumn("range", F.greatest(F.col("rough") + upto(F.col("near")) - 1, F.lit(0)))
    place = place.withColumn("guest", F.coalesce(F.array_contains("near", F.col("doc_id")), F.lit(False)))
    here, there = F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(F.pmod(F.col("range") - 1, F.lit(len(starts))).alias("range"), F.lit(True).alias("guest"))
    own = F.struct(F.pmod(F.hash("text"), F.lit(len(starts))).alias("range"), F.lit(False).alias("guest"))
    at = F.when(F.col("doc_id").isNull(), F.array(own)).when(F.col("guest"), F.array(here, there)).otherwise(F.array(here))
    dealt = place.select("doc_id", "text", F.explode_outer(at).alias("at")).select("doc_id", "text", "at.range", "at.guest")
    dealt = dealt.repartition(min(max(parts, len(starts) // 4), len(starts)), "range")
    order = Window.partitionBy("range").orderBy(F.col("doc_id").isNull(), "guest", "doc_id", "text")
    after = F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order))
    return dealt.withColumn("next_text", after).withColumn("place", F.row_number().over(order))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next text, and their likeness.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next document's.  A
    null text is empty; the only document is its own next.  "Next" is by ascending doc_id; rows that share one stand in the
    order of their texts, and each is the next of the one before it, so equal rows come back as often as they are given.  A row
    without a doc_id is its own next.  An empty table gives no rows.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = _with_next(text).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.expr("left(text, n_chars - int(floor(n_chars / 2)))"), F.when(half > 0, F.expr("left(coalesce(next_text, text), int(floor(n_chars / 2)))")).otherwise("")))
    df = df.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("alone", F.col("next_text").isNull())
    df = with_bins(df, "text", "bins").drop("text", "next_text")
    df = with_bins(df, "edited", "edited_bins").drop("edited")
    # the order is the one that gave the next text: its places, which guests have too
    after = F.lead("bins").over(Window.partitionBy("range").orderBy("place"))
    df = df.withColumn("next_bins", F.when(F.col("alone"), F.col("bins")).otherwise(after)).filter("not guest")
    return df.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
