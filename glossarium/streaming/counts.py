"""Running candidate counts over a stream of sentences' arcs (counts are additive, so partial results are exact)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pairs import candidates


def start_candidate_counts(arcs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts (noun, verb, n) of each batch of arcs under `folder`; current_counts() adds them up.

    A batch has a folder of its own, by its number, which is written over if the batch comes again after a stop: every arc counts
    once.  Neither the driver nor a state holds the pairs.
    """

    def write(batch: DataFrame, number: int) -> None:
        candidates(batch).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return arcs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def current_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(noun, verb, n) of all batches that are written."""
    return spark.read.schema("noun string, verb string, n long").parquet(folder).groupBy("noun", "verb").agg(F.sum("n").alias("n"))
