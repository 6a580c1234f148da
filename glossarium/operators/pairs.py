"""Noun-verb arcs, candidates, and association and syntax features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .lowrank import kept

MEASURES = ["p", "p_n", "p_v", "dist", "p_obl", "p_subj", "p_obj", "p_other", "p_n_given_v", "p_v_given_n", "v_n", "v_v", "v", "corr", "pmi"]


def arcs(tokens: DataFrame, *sentence: str) -> DataFrame:
    """One row per arc from a noun to the verb that is its head: sentence keys, noun, verb, noun_id, verb_id, deprel.

    Tokens that carry head_lemma, the lemma of the verb that heads them (else null), need no join; a pattern that they carry too is kept.
    """
    keys = list(sentence)
    if "head_lemma" in tokens.columns:
        return tokens.filter("upos = 'NOUN' and head_lemma is not null").select(*keys, F.col("lemma").alias("noun"), F.col("head_lemma").alias("verb"), F.col("id").alias("noun_id"), F.col("head").alias("verb_id"), "deprel", *(["pattern"] if "pattern" in tokens.columns else []))
    n = tokens.filter("upos = 'NOUN'").select(*keys, F.col("lemma").alias("noun"), F.col("id").alias("noun_id"), F.col("head").alias("verb_id"), "deprel")
    v = tokens.filter("upos = 'VERB'").select(*keys, F.col("id").alias("verb_id"), F.col("lemma").alias("verb"))
    return n.join(v, [*keys, "verb_id"]).select(*keys, "noun", "verb", "noun_id", "verb_id", "deprel")


def candidates(pairs: DataFrame) -> DataFrame:
    """(noun, verb, n)."""
    return pairs.groupBy("noun", "verb").agg(F.count("*").alias("n"))


def _counts(pairs: DataFrame) -> DataFrame:
    each = lambda r: F.count_if(F.col("deprel") == r)
    gap = F.abs(F.try_to_number(F.col("noun_id"), F.lit("999999999")) - F.try_to_number(F.col("verb_id"), F.lit("999999999"))) if dict(pairs.dtypes)["noun_id"] == "string" else F.abs(F.col("noun_id") - F.col("verb_id"))
    return pairs.groupBy("noun", "verb").agg(F.count("*").alias("n"), F.sum(gap).cast("double").alias("gaps"), each("obl").alias("obl"), each("nsubj").alias("subj"), each("obj").alias("obj"))


def distances(pairs: DataFrame) -> DataFrame:
    """(noun, verb, dist): mean distance in tokens."""
    return _counts(pairs).select("noun", "verb", (F.col("gaps") / F.col("n")).alias("dist"))


def relations(pairs: DataFrame) -> DataFrame:
    """Shares of the relations obj, obl and nsubj (exact names), and of all others."""
    c = _counts(pairs).select("noun", "verb", *((F.col(k) / F.col("n")).alias(f"p_{k}") for k in ("obj", "obl", "subj")))
    return c.withColumn("p_other", 1 - (F.col("p_obj") + F.col("p_obl") + F.col("p_subj")))


def marginals(cand: DataFrame, side: str) -> DataFrame:
    """(noun, p_n) or (verb, p_v)."""
    total = cand.agg(F.sum("n").alias("total"))
    return cand.groupBy(side).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).select(side, (F.col("n") / F.col("total")).alias(f"p_{side[0]}"))  # one row


def association(pairs: DataFrame) -> DataFrame:
    """(noun, verb) with the fifteen MEASURES.

    One aggregation over the arcs, written, as it is read four times; the marginals are aggregated before they are joined back, so
    that a noun or verb of very many pairs is never gathered in one task.
    """
    c = kept(_counts(pairs), "counts")
    total = c.agg(F.sum("n").alias("total"))
    nouns = c.groupBy("noun").agg(F.sum("n").alias("n_noun"))
    verbs = c.groupBy("verb").agg(F.sum("n").alias("n_verb"))
    df = c.join(nouns, "noun").join(verbs, "verb").crossJoin(F.broadcast(total))  # one row
    df = df.select("noun", "verb", (F.col("n") / F.col("total")).alias("p"), (F.col("n_noun") / F.col("total")).alias("p_n"), (F.col("n_verb") / F.col("total")).alias("p_v"), (F.col("gaps") / F.col("n")).alias("dist"), *((F.col(k) / F.col("n")).alias(f"p_{k}") for k in ("obl", "subj", "obj")))
    p, pn, pv = F.col("p"), F.col("p_n"), F.col("p_v")
    df = df.withColumns({"p_other": 1 - (F.col("p_obj") + F.col("p_obl") + F.col("p_subj")), "p_n_given_v": p / pv, "p_v_given_n": p / pn, "v_n": pn * (1 - pn), "v_v": pv * (1 - pv), "v": p - pn * pv})
    df = df.withColumns({"corr": ratio(F.col("v"), F.sqrt("v_n") * F.sqrt("v_v")), "pmi": F.ln(F.col("p_n_given_v") / pn)})
    return df.select("noun", "verb", *MEASURES).na.fill(0.0)
