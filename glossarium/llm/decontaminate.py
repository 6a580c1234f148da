"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Numbers, names and units become typed placeholders, so a question with other numbers and other names keeps its template.
Windows of canonical tokens are hashed and joined to the benchmark's.  Hits on one diagonal (place in the document minus place
in the item) belong together; neighbouring diagonals, as inserted or lost words leave them, are one occurrence of the item, and
in it every slot must be filled consistently: each benchmark value stands for one value of the document, and no two for the same.
Windows that contradict this do not count, the others do.  A document is reported with an item when consistent windows cover enough
of the item's windows.  Items without a window that counts, or with none but the
first, are looked for whole as well: all their words as written, but for case and marks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, by_row, named, row_key, settled

#: Tokens of a window, how many of them must be words, and the share of an item's windows that must be met.
WINDOW, FIXED, COVERED = 8, 4, 0.5
#: Share of a benchmark value's places in an occurrence that must agree for it to stand for what they say.
CLEAR = 2 / 3
#: Words of an item that is looked for whole, at least: shorter ones are everyday phrases.
SHORTEST = 3
#: Windows of the benchmark that are broadcast; beyond, the join shuffles.
BROADCAST = 200_000
#: Units that count as such behind a number.
UNITS = "kg g mg t lb lbs oz km m cm mm mi mile miles ft feet inch inches yd l ml litre litres liter liters gallon gallons h hr hrs hour hours min mins minute minutes s sec secs second seconds day days week weeks month months year years dollar dollars euro euros cent cents pound pounds percent degrees mph kmh".split()
#: What canonical() replaces, in turn: marks; words that begin with a digit; capitalised words; units behind a number.
MARKS = "[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+"
NUMBERS, NAMES = ("(^|[\\x20\\x09-\\x0D])" + x + "[^\\x20\\x09-\\x0D]*" for x in ("\\p{N}", "\\p{Lu}\\p{Ll}"))
MEASURES = f"(#n[\\x20\\x09-\\x0D]+)(?:{'|'.join(UNITS)})([\\x20\\x09-\\x0D]|$)"
_SLOT = "in ('#n', '#u', '#p')"


def canonical(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form, raw): the canonical form of every word of the text, and the word as written; null has none.

    #n stands for a word that begins with a digit, #u for a unit behind a number, #p for a capitalised word; other words are
    in lower case.  Marks around and inside words do not count, and words of marks alone are none.
    """
    bare = F.regexp_replace(F.coalesce(named(text_col).cast("string"), F.lit("")), MARKS, "")
    form = F.lower(F.regexp_replace(F.regexp_replace(F.col("bare"), NUMBERS, "$1#n"), NAMES, "$1#p"))
    words = lambda c: F.array_remove(F.split(c, SPACES), "")
    return docs.select(named(id_col).alias("id"), bare.alias("bare")).select("id", words(F.regexp_replace(form, MEASURES, "$1#u$2")).alias("form"), words("bare").alias("raw"))


def _windows(tokens: DataFrame) -> DataFrame:
    """(id, form, raw, windows): the hash of every WINDOW consecutive canonical tokens."""
    df = tokens.withColumn("hashes", F.expr("transform(form, c -> xxhash64(c))"))
    return df.withColumn("windows", F.expr(f"if(size(hashes) < {WINDOW}, array(), transform(sequence(0, size(hashes) - {WINDOW}), i -> xxhash64(slice(hashes, i + 1, {WINDOW}))))"))


def _counts(form: str) -> str:
    return f"size(filter({form}, c -> not c {_SLOT})) >= {FIXED}"


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """window, item_id, place, item_form, item_raw, item_text, in_item (places that count); too many slots do not count.

    A place has up to three forms: the canonical one, that with its names in lower case (for copies in one case), and at the
    start of the item that with the first word alone in lower case (for copies inside a sentence).
    """
    one = canonical(benchmark, item_col, text_col).filter(f"size(form) >= {WINDOW}")
    one = one.select("id", "form", "raw", F.explode(F.expr(f"sequence(0, size(form) - {WINDOW})")).alias("place"))
    one = one.select(F.col("id").alias("item_id"), "place", F.expr(f"slice(form, place + 1, {WINDOW})").alias("form"), F.expr(f"slice(raw, place + 1, {WINDOW})").alias("item_raw")).filter(_counts("form"))
    forms = "array_distinct(array(form, transform(form, (c, j) -> if(c = '#p', lower(item_raw[j]), c)), transform(form, (c, j) -> if(c = '#p' and j = 0 and place = 0, lower(item_raw[j]), c))))"
    each = one.select("item_id", "place", "item_raw", F.explode_outer(F.expr(forms)).alias("item_form")).distinct()
    total = one.groupBy("item_id").agg(F.count_distinct("place").alias("in_item"))
    each = each.join(total.withColumnRenamed("item_id", "of"), F.col("item_id").eqNullSafe(F.col("of"))).drop("of")
    return each.withColumn("window", F.expr("xxhash64(transform(item_form, c -> xxhash64(c)))")).withColumn("item_text", F.concat_ws(" ", "item_form"))


def _whole_key(length: int, at: str) -> str:
    return f"xxhash64(slice(hashes, {at} + 1, {length}))"


def _lower(tokens: DataFrame) -> DataFrame:
    """(id, low, hashes): the words as written, in lower case, and their hashes."""
    return tokens.select("id", F.expr("transform(raw, r -> lower(r))").alias("low")).withColumn("hashes", F.expr("transform(low, r -> xxhash64(r))"))


def benchmark_wholes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """key, item_id, lead, item_low: the words of items that are looked for whole, by a hash of the first `lead` of them."""
    later = f"if(size(form) <= {WINDOW}, false, exists(sequence(1, size(form) - {WINDOW}), i -> {_counts(f'slice(form, i + 1, {WINDOW})')}))"
    items = _lower(canonical(benchmark, item_col, text_col).filter(f"not {later}")).filter(f"size(low) >= {SHORTEST}").withColumn("lead", F.expr(f"least(size(low), {WINDOW})"))
    return items.select(F.expr(_whole_key("lead", "0")).alias("key"), F.col("id").alias("item_id"), "lead", F.col("low").alias("item_low")).distinct()


def _wholes(tokens: DataFrame, known: DataFrame) -> DataFrame | None:
    """(row, item_id) of whole items; None if there are none to look for."""
    leads = sorted(r["lead"] for r in known.select("lead").distinct().collect())  # at most WINDOW numbers
    if not leads:
        return None
    if known.count() <= BROADCAST:
        known = F.broadcast(known)
    each = ", ".join(f"if(size(hashes) < {a}, array(), transform(sequence(0, size(hashes) - {a}), i -> struct(i as pos, {_whole_key(a, 'i')} as key)))" for a in leads)
    at = _lower(tokens).select(F.col("id").alias("row"), "low", F.explode(F.expr(f"flatten(array({each}))")).alias("w")).select("row", "low", "w.pos", "w.key")
    return at.join(known, "key").filter("slice(low, pos + 1, size(item_low)) = item_low").select("row", "item_id").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, n_windows, coverage, changed (some slot differs).

    Null and empty texts contain nothing.  Items of fewer than WINDOW tokens, or without a window of FIXED words, are found in
    exact copies (one window, coverage 1); those of fewer than SHORTEST tokens are never found.  Rows of one doc_id and text
    count as one document, rows that share an item_id (or have none) as one item; other rows of a doc_id, or of none, have
    results of their own.
    """
    return _by_row(docs, benchmark, id_col, text_col).select(F.col("row.id").alias("doc_id"), "item_id", "n_windows", "coverage", "changed")


def _hits(docs: DataFrame, known: DataFrame, few: bool) -> DataFrame:
    """row, item_id, in_item, pos, place and pair of every window of a document that is a window of the benchmark."""
    at = _windows(docs).select(F.col("id").alias("row"), "form", "raw", F.posexplode_outer("windows").alias("pos", "window"))
    if few:  # the arrays of the document go along inside the task; a window's words are cut out of them only for a hit
        own, known = f"concat_ws(' ', slice(form, pos + 1, {WINDOW}))", F.broadcast(known)
        raw = F.expr(f"slice(raw, pos + 1, {WINDOW})")
    else:
        at = at.filter("window is not null").select("row", "pos", "window", F.expr(f"concat_ws(' ', slice(form, pos + 1, {WINDOW}))").alias("own"), F.expr(f"slice(raw, pos + 1, {WINDOW})").alias("raw"))
        own, raw = "own", F.col("raw")
    # no equality, which would become a key of the join and be worked out for every window instead of every hit
    hits = at.join(known, "window").filter(f"startswith({own}, item_text) and length({own}) <= length(item_text)")
    pair = F.struct("item_form", "item_raw", raw.alias("raw"))
    return hits.select("row", "item_id", "in_item", "place", "pos", pair.alias("pair")).groupBy("row", "item_id", "in_item", "pos", "place").agg(F.first("pair").alias("pair"))


def _occurrences(hits: DataFrame) -> DataFrame:
    """Hits with `occurrence`: a place of the document counts on its diagonal of most hits (on ties the least) alone, and
    diagonals less than a window apart are one occurrence."""
    keys = ["row", "item_id"]
    df = hits.repartition(*keys).withColumn("diagonal", F.col("pos") - F.col("place"))
    df = df.withColumn("votes", F.count("*").over(Window.partitionBy(*keys, "diagonal")))
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "pos").orderBy(F.desc("votes"), "diagonal"))).filter("rank = 1")
    order = Window.partitionBy(*keys).orderBy("diagonal")
    df = df.withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) >= WINDOW, F.lit(False)).cast("int"))
    return df.withColumn("occurrence", F.sum("new").over(order))


def _consistent(hits: DataFrame) -> DataFrame:
    """The windows of occurrences that fill their slots as the rest of the occurrence does, with changed (some slot differs).

    A benchmark value stands for what CLEAR of its places in the occurrence say, else for itself if a place says so, else for
    nothing.  Of values that stand for the same, that with more places (then itself, then the smaller one) keeps it.
    """
    window = ["row", "item_id", "occurrence"]
    slots = f"array_distinct(transform(filter(sequence(0, {WINDOW - 1}), j -> pair.item_form[j] {_SLOT}), j -> struct(pair.item_form[j] as kind, pair.item_raw[j] as said, pair.raw[j] as now, pos + j as at)))"
    each = hits.select(*window, "in_item", "pos", "place", F.explode_outer(F.expr(slots)).alias("s")).select(*window, "in_item", "pos", "place", "s.*")
    of = lambda *c: Window.partitionBy(*window, *c)  # noqa: E731  all lie within the partitions of _occurrences()
    # every place of the document speaks once, whatever number of windows it is in
    each = each.withColumn("first", (F.row_number().over(of("kind", "said", "now", "at").orderBy("pos", "place")) == 1).cast("int"))
    each = each.withColumn("votes", F.sum("first").over(of("kind", "said", "now"))).withColumn("all", F.sum("first").over(of("kind", "said")))
    clear, own = F.col("votes") >= CLEAR * F.col("all"), F.col("now") == F.col("said")
    each = each.withColumn("chosen", clear | (own & ~F.max(clear).over(of("kind", "said"))))
    best = F.first("said").over(of("kind", "now").orderBy(F.desc("chosen"), F.desc("votes"), F.desc(own), "said"))
    each = each.withColumn("fits", F.col("kind").isNull() | (F.col("chosen") & (best == F.col("said"))))
    ok = each.groupBy(*window, "in_item", "pos", "place").agg(F.min("fits").alias("fits"), F.max(F.coalesce(~own, F.lit(False))).alias("changed"))
    return ok.filter("fits")


def _by_row(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """matches() with `row`, a row_key(), for doc_id."""
    known = settled(benchmark_windows(benchmark), "windows")
    tokens = canonical(docs.select(row_key(id_col, text_col).alias("row"), named(text_col).alias("text")), "row", "text")
    hits = _occurrences(_hits(tokens, known, known.count() <= BROADCAST))
    found = _consistent(hits).groupBy("row", "item_id", "in_item").agg(F.count_distinct("place").alias("n_windows"), F.max("changed").alias("changed"))
    found = found.withColumn("coverage", F.col("n_windows") / F.col("in_item")).filter(F.col("coverage") >= COVERED).select("row", "item_id", "n_windows", "coverage", "changed")
    wholes = _wholes(tokens, settled(benchmark_wholes(benchmark), "wholes"))
    if wholes is None:
        return found
    both = found.unionByName(wholes.select("row", "item_id", F.lit(1).cast("long").alias("n_windows"), F.lit(1.0).alias("coverage"), F.lit(False).alias("changed")))
    return both.groupBy("row", "item_id").agg(*(F.max(c).alias(c) for c in ("n_windows", "coverage", "changed")))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those that contain a benchmark item; what a row contains is decided by its own text alone.

    Rows without a doc_id, or with another row's, neither remove nor hide one another.  A row that repeats one that is removed
    is removed too.  An empty table, or an empty benchmark, gives docs back.
    """
    dirty = _by_row(docs, benchmark, id_col, text_col).select("row").distinct()
    return by_row(docs, dirty, "left_anti", id_col, text_col)[0]
