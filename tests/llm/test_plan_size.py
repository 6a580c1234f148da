"""Plans of op 7 do not grow with its dictionary."""

from pyspark.sql import functions as F

from glossarium.llm import secrets


def _found(spark):
    rows = [("alphabeta", "alphabeta"), ("alpha-alpha,9", "x alpha-alpha,9"), ("k", "k=k"), ("AlphaGamma12", "AlphaGamma12")]
    return spark.createDataFrame([(v, w, "", "") for v, w in rows], "value string, word string, before string, after string")


def _nodes(df):
    return df._jdf.queryExecution().logical().toJSON().count('"class"')


def test_no_node_a_word(spark):
    words = [f"w{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{chr(97 + k // 676)}" for k in range(2000)]
    few, many = (_nodes(secrets.with_features(_found(spark), own, ["al", "be"])) for own in (words[:10], words))
    assert many == few


def test_covered_and_usual_pairs(spark):
    got = {r["value"]: r for r in secrets.with_features(_found(spark), ["alpha", "gamma"], ["al", "ph"]).select("value", F.round("covered", 6).alias("c"), F.round("usual_pairs", 6).alias("u")).collect()}
    assert (got["alpha-alpha,9"]["c"], got["alpha-alpha,9"]["u"]) == (round(10 / 13, 6), round(4 / 12, 6))  # a word counts as often as it stands
    assert (got["AlphaGamma12"]["c"], got["AlphaGamma12"]["u"]) == (round(10 / 12, 6), round(2 / 11, 6))
    assert (got["alphabeta"]["c"], got["k"]["u"]) == (0, 0)
