"""Quality scores from compression: which of two dictionaries makes a text smaller.

One zstandard dictionary is built from good and one from bad labelled text.  A text is compressed block by block with each;
the normalised difference of the two sizes, (bad - good) / (bad + good), is turned into a score by a logistic curve fitted on
labelled texts that the dictionaries were not built from.  Blocks keep the dictionary's influence the same in long texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import held_out, known_labels, labelled_sample, logistic_curve, named, settled
from .wordhash import slices, texts_of

#: Labelled texts of either class that are sampled; blocks of each class that build a dictionary; its bytes; bytes of a block.
PER_CLASS, BLOCKS, DICTIONARY, BLOCK, LEVEL = 3000, 3000, 65_536, 1024, 3


@dataclass(frozen=True)
class Model:
    """Dictionaries (empty where there was nothing to learn from) and the curve's slope and offset."""

    good: bytes
    bad: bytes
    slope: float
    offset: float


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        for label, raw in zip(b.column(0).to_pylist(), texts_of(b, 1), strict=True):
            own = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(own), pa.int32()), pa.array(own)], ["label", "block"])


def _sizes(good: bytes, bad: bytes):
    """A function from texts to normalised size differences."""
    if not good or not bad:
        return lambda texts: np.zeros(len(texts))
    each = [zstandard.ZstdCompressor(dict_data=(d := zstandard.ZstdCompressionDict(raw)), compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)) for raw in (good, bad)]

    def difference(texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for k, raw in enumerate(texts):
            g, b = (sum(len(c.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for c in each)
            out[k] = (b - g) / max(b + g, 1)
        return out

    return difference


def _score(dictionaries, slope: float, offset: float, keep: list[str]):
    def run(batches):
        difference = _sizes(*dictionaries.value)
        for b in slices(batches):
            x = difference(texts_of(b, 0))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(1 / (1 + np.exp(-np.clip(slope * x + offset, -40, 40)))), *b.columns[1:]], ["difference", "score", *keep])

    return run


def _dictionary(blocks: list[bytes]) -> bytes:
    total = sum(map(len, blocks))
    if len(blocks) < 8 or total < 4096:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, total // 4), blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too uniform to train on: the text itself serves
        return b"".join(blocks)[:DICTIONARY]


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """difference and score (0 to 1) of every whole text beside the columns in `keep`, which must not have those names.

    An empty or null text has difference 0.  Rows are scored one by one, so repeated rows and null ids need no rule.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad))  # of fixed size
    own = [f"c{k}" for k in range(len(keep))]  # names for the way through the workers, where a name must be plain
    data = docs.select(F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"), *(named(c).alias(n) for c, n in zip(keep, own, strict=True)))
    fields = StructType([StructField("difference", DoubleType()), StructField("score", DoubleType()), *data.select(*own).schema])
    found = data.mapInArrow(_score(shared, model.slope, model.offset, own), fields)
    return found.select("difference", "score", *(F.col(n).alias(c) for c, n in zip(keep, own, strict=True)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """Learn from at most per_class training rows of either label: two thirds build the dictionaries, a third the curve.

    Rows that repeat id and text count once; an id with several texts counts with each, within the same bound, and with the larger
    of its labels.  Dictionaries take at most BLOCKS blocks of each label.  The curve's offset is corrected for the labels' shares among all
    labelled training rows.  Without both labels the score is the smoothed share of good rows everywhere.
    """
    sample = settled(labelled_sample(docs, labels, label_col, per_class, id_col, text_col).withColumn("third", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3))), "quality_sample")
    known = known_labels(labels, label_col, id_col).groupBy("label").count().collect()
    share = {0: 1, 1: 1} | {r["label"]: r["count"] for r in known}
    blocks = sample.filter("third > 0").select("label", "text").mapInArrow(_pieces, "label int, block binary").withColumn("_order", F.xxhash64("block"))
    raw = {v: _dictionary([bytes(r["block"]) for r in blocks.filter(F.col("label") == v).orderBy("_order", "block").limit(BLOCKS).select("block").collect()]) for v in (0, 1)}
    seen = score(sample.filter("third = 0"), Model(raw[1], raw[0], 0.0, 0.0), keep=("label",)).collect()
    count = {v: sum(r["label"] == v for r in seen) for v in (0, 1)}
    if not raw[0] or not raw[1] or not count[0] or not count[1]:
        return Model(b"", b"", 0.0, float(np.log(share[1] / share[0])))
    slope, offset = logistic_curve([r["difference"] for r in seen], [r["label"] for r in seen])
    return Model(raw[1], raw[0], slope, offset + float(np.log(share[1] / share[0]) - np.log(count[1] / count[0])))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (score of threshold or more) of every row; an empty table has none.

    A null doc_id is held out.  Of a doc_id with several labels the larger counts; where rows share a doc_id, all their texts do.
    """
    found = score(docs, fit(docs, labels), keep=("doc_id",))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "difference")
