"""Evaluation of scored, labelled pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import f1, kappa, ratio
from .lowrank import kept


def confusion(scored: DataFrame) -> DataFrame:
    """(prediction, is_lvc, n)."""
    return scored.groupBy("prediction", "is_lvc").agg(F.count("*").alias("n"))


def measures(scored: DataFrame, truth_size: DataFrame | None = None) -> DataFrame:
    """One row: precision, recall, f1, kappa; with truth_size (one row, nb_tot) also recall and f1 over all of the truth."""
    yes = lambda p, t: F.count_if((F.col("prediction") == p) & (F.col("is_lvc") == t)).cast("double")
    c = scored.agg(yes("YES", "YES").alias("tp"), yes("YES", "NO").alias("fp"), yes("NO", "YES").alias("fn"), yes("NO", "NO").alias("tn"))
    df = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    df = df.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn("kappa", kappa(*(F.col(k) for k in ("tp", "fp", "fn", "tn"))))
    if truth_size is not None:
        df = df.crossJoin(F.broadcast(truth_size)).withColumn("true_recall", ratio(F.col("recall") * (F.col("tp") + F.col("fn")), F.col("nb_tot"))).drop("nb_tot")
        df = df.withColumn("true_f1", f1(F.col("precision"), F.col("true_recall")))
    return df.drop("tp", "fp", "fn", "tn")


def curve(scored: DataFrame, truth_size: DataFrame | None = None) -> DataFrame:
    """(threshold, precision, recall, f1) for every distinct score, used as `score >= threshold`; with truth_size (one row, nb_tot)
    also true_recall and true_f1, over all of the truth.

    Scores are counted first; the running sums then go over range partitions: sums inside each, and the partitions' totals,
    one row each, added up in front, so no task takes all scores.  The ranges are written before they are summed, since a range
    that is made again after a loss could have other bounds.
    """
    points = scored.groupBy(F.col("score").alias("threshold")).agg(F.count_if(F.col("is_lvc") == "YES").alias("tp"), F.count("*").alias("n"))
    spread = kept(points.repartitionByRange(F.desc("threshold")).withColumn("part", F.spark_partition_id()), "curve")
    own = Window.partitionBy("part").orderBy(F.desc("threshold"))
    totals = spread.groupBy("part").agg(F.sum("tp").alias("part_tp"), F.sum("n").alias("part_n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("part_tp").over(ahead), F.lit(0)).alias("tp_before"), F.coalesce(F.sum("part_n").over(ahead), F.lit(0)).alias("n_before"))
    positives = spread.agg(F.sum("tp").alias("positives"))
    df = spread.join(F.broadcast(totals), "part").crossJoin(F.broadcast(positives))  # a row for each partition; one row
    df = df.select("threshold", (F.sum("tp").over(own) + F.col("tp_before")).alias("tp"), (F.sum("n").over(own) + F.col("n_before")).alias("n"), "positives")
    measured = ["threshold", ratio(F.col("tp"), F.col("n")).alias("precision"), ratio(F.col("tp"), F.col("positives")).alias("recall")]
    if truth_size is None:
        return df.select(*measured).withColumn("f1", f1(F.col("precision"), F.col("recall")))
    df = df.crossJoin(F.broadcast(truth_size)).select(*measured, ratio(F.col("tp"), F.col("nb_tot")).alias("true_recall"))
    return df.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn("true_f1", f1(F.col("precision"), F.col("true_recall")))
