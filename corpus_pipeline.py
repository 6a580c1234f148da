"""The training-corpus pipeline: five stages over `documents`, each written as Parquet and read back before the next.

1. toxicity: documents scored 0.5 or more leave.
2. near_duplicates: of the documents that links join (5-word shingles, Jaccard 0.8), that with the smallest doc_id stays.
3. decontamination: documents that contain a benchmark item leave.
4. secrets: confirmed secrets in a text are replaced by a mark; every document stays.
5. packing: the rest is packed into sequences of 2048 tokens; a row for each piece.

Every stage decides by rows, not by doc_ids: rows without a doc_id, or with another row's, neither remove nor change one another
unless their texts do.  Of rows that repeat one another near_duplicates keeps one, but rows without a doc_id are never duplicates.
Null and empty texts stay in all stages.
Columns beside doc_id, text and n_chars, whatever their names, pass through unread.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossarium.llm import decontaminate, jaccard_join, packing, secrets
from glossarium.llm import toxicity as pu
from glossarium.llm.common import fresh, named, settled, table
from glossarium.llm.queries import tokenizer_path

#: Stages 1 and 4 rest on trained models and stage 5 on a tokenizer, which SQL does not express.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = pu.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "score")
    return pu.score(docs, model, keep=tuple(docs.columns), out_col=score).filter(named(score) < 0.5).select(*map(named, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_redaction), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
