"""The registered queries of the training-text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, jaccard_join, license_scan, merkle, oracle, packing, permutation_index, quality, secrets, snapshot_diff, substring_dedup, toxicity, warc
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op4_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_at", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def later_snapshot(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, source as the next snapshot has them: crc32 of the number modulo 16 says what becomes of a row."""
    kind, key, other = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 16, F.col("doc_id"), -1 - F.col("doc_id")
    keys = F.when(kind == 0, F.array().cast("array<long>")).when(kind.isin(3, 4), F.array(other)).when(kind == 5, F.array(key, other)).otherwise(F.array(key))
    text = F.when(kind == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text"))
    source = F.when(kind == 2, F.col("lang")).when(kind != 4, F.col("source")).when(kind.isNull(), F.col("source"))
    return docs.select(F.explode(keys).alias("doc_id"), text.alias("text"), F.when(kind == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"), source.alias("source"))


def op11_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    said = F.concat_ws("\n", *(F.coalesce(c, F.lit("~")) for c in ("text", "lang", "source")))
    return snapshot_diff.diff(docs, later_snapshot(docs).withColumn("row_sha256", F.sha2(said, 256)), carry=["row_sha256"])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    row = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", capitals, capitals.lower())
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", merkle.leaf([*row, "text"]).alias("leaf"), F.when(tampered, merkle.leaf([*row, lower])).alias("now"))
    found = merkle.manifest(docs).withColumn("folded_root", merkle.fold(F.coalesce("now", "leaf"), F.col("proof")))
    said = F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    return found.select("doc_id", "leaf", "subroot", "root", said.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation_index.search(permutation_index.build(vectors), vectors.filter("vec_id % 20 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_toxicity, op3_jaccard_join, op4_super_kmers, op5_warc_index, op6_minhash_fingerprints, op7_secret_forest, op8_compression_quality, op9_packing, op10_license_diagonals, op11_snapshot_diff, op12_merkle_manifest, op13_permutation_index)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
