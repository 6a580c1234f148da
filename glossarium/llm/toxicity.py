"""Toxicity scores by non-negative positive-unlabelled learning.

A linear model is learnt from confirmed toxic texts (P) and texts of unknown kind (U).  Its features are the presence of words
and word beginnings that are commoner in P than, corrected by the class prior, among negatives.  It minimises the
class-prior-corrected risk
    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])
whose second term, the risk on negatives, is kept from going below zero: when it does, its gradient is reversed.

Features and weights see no text that is labelled clean as such.  Labels 0 serve for two things beside them: the class prior is
the share of confirmed ones among all labels, and the two numbers that turn the model's margin into a score are fitted on labelled
texts of both kinds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import few_texts, held_out, known_labels, labelled_sample, logistic_curve, named, settled
from .wordhash import chunks, slices, texts_of

#: At most so many confirmed and unlabelled texts are fitted on; features kept; lengths in bytes of word beginnings.
POSITIVES, UNLABELLED, FEATURES, PREFIXES = 4000, 12_000, 1024, (4, 5, 6)
#: A feature's least log ratio of its shares in P and among negatives; labelled rows of either class for the last step, the score's curve.
RATE, CURVE = 2.0, 2000


@dataclass(frozen=True)
class Model:
    """Weights of sorted 64-bit feature hashes, a bias, and the class prior."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def _features(words) -> tuple[np.ndarray, np.ndarray]:
    """Feature hash and text number of every word and word beginning."""
    of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    return np.concatenate([words.hash, *(words.prefixes(n) for n in PREFIXES)]), np.tile(of, 1 + len(PREFIXES))


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, feature) once for each text that has it."""
    for b in slices(batches):
        for own, w in chunks(b.column(1).to_pylist(), texts_of(b, 0), True, True):
            f, of = _features(w)
            order = np.lexsort((f, of))
            f, of = f[order], of[order]
            new = np.ones(len(f), dtype=bool)
            new[1:] = (f[1:] != f[:-1]) | (of[1:] != of[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(own, dtype=np.int32)[of[new]]), pa.array(f[new].view(np.int64))], ["positive", "feature"])


def _hits(words, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature number of each known feature that a text has, once."""
    f, of = _features(words)
    table = np.zeros(1 << 20, dtype=bool)
    table[(features >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(f >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(features, f[maybe])
    at[at == len(features)] = 0
    ok = features[at] == f[maybe] if len(features) else np.zeros(0, bool)
    key = np.unique(of[maybe][ok] * max(len(features), 1) + at[ok])
    return key // max(len(features), 1), key % max(len(features), 1)


def _rows(features: np.ndarray):
    def run(batches):
        for b in slices(batches):
            for own, w in chunks(b.column(1).to_pylist(), texts_of(b, 0), True, True):
                text, at = _hits(w, features)
                lists = [x.tolist() for x in np.split(at, np.searchsorted(text, np.arange(1, len(own))))]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["positive", "at"])

    return run


def risk_gradient(margin_p: np.ndarray, margin_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The corrected risk with logistic loss, and the gradient in each margin (reversed part included)."""
    soft = lambda z: np.logaddexp(0, z)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    plus = prior * soft(-margin_p).mean()
    minus = soft(margin_u).mean() - prior * soft(margin_p).mean()
    to_p, to_u = -prior * sig(-margin_p) / len(margin_p), sig(margin_u) / len(margin_u)
    back = prior * sig(margin_p) / len(margin_p)
    if minus >= 0:
        return plus + minus, to_p - back, to_u
    return plus, back, -to_u


def descend(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 3e-4) -> tuple[np.ndarray, float]:
    """Adam on the corrected risk; features are 0 or 1."""
    d = xp.shape[1]
    w = np.zeros(d + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        v32 = w[:d].astype(xp.dtype)  # as the features, which would be copied otherwise
        _, gp, gu = risk_gradient(xp @ v32 + w[-1], xu @ v32 + w[-1], prior)
        g = np.concatenate([gp.astype(xp.dtype) @ xp + gu.astype(xu.dtype) @ xu + ridge * w[:d], [gp.sum() + gu.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:d], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on at most `positives` confirmed and `unlabelled` other texts, taken by a hash of id and text, training rows only.

    Rows that repeat id and text count once; an id with several texts counts with each, within the same bounds.  The larger of
    several labels of an id counts.

    The prior is the share of confirmed rows among the labelled training rows.  Labels 0 serve for it and, after the fit, for
    the curve (two numbers) that turns the model's margin into a score; at most CURVE rows of either class.
    Without any confirmed text the model scores every text with a prior of 0.
    """
    known = known_labels(labels, label_col, id_col)
    n, yes = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("yes")).first()
    prior = yes / n if n else 0.0
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -40.0, 0.0)
    if not yes:
        return none
    prior = min(max(prior, 0.001), 0.95)
    p = few_texts(docs, positives, 11, known.filter("label = 1"), id_col, text_col).select("text", F.lit(1).alias("positive"))
    u = few_texts(docs, unlabelled, 12, None, id_col, text_col).select("text", F.lit(0).alias("positive"))
    sample = settled(p.unionByName(u), "toxicity_sample")
    count = dict(sample.groupBy("positive").count().collect())
    if not count.get(1) or not count.get(0):
        return none
    c = sample.mapInArrow(_present, "positive int, feature long").groupBy("feature").agg(F.sum("positive").alias("p"), F.count("*").alias("all"))
    in_p, in_u = (F.col("p") + 0.5) / count[1], (F.col("all") - F.col("p")) / count[0]
    in_n = F.greatest((in_u - prior * F.col("p") / count[1]) / (1 - prior), F.lit(0.5 / count[0]))  # U less its confirmed kind
    rate = F.log(in_p) - F.log(in_n)
    best = c.filter(f"p >= {max(5, count[1] // 200)}").withColumn("gain", rate * F.sqrt("p")).filter(rate >= RATE).orderBy(F.desc("gain"), "feature").limit(FEATURES).select("feature").collect()
    features = np.sort(np.array([r["feature"] for r in best], dtype=np.int64).view(np.uint64))
    x = {v: np.zeros((count[v], len(features)), dtype=np.float32) for v in (0, 1)}
    at = {0: 0, 1: 0}
    for r in sample.mapInArrow(_rows(features), "positive int, at array<int>").toLocalIterator():
        x[r["positive"]][at[r["positive"]], r["at"]] = 1
        at[r["positive"]] += 1
    weights, bias = descend(x[1], x[0], prior)
    raw = Model(features, weights, bias, prior)
    seen = score(labelled_sample(docs, labels, label_col, CURVE, id_col, text_col), raw, keep=("label",)).collect()
    if len({r["label"] for r in seen}) < 2:
        return raw
    share = {v: sum(r["label"] == v for r in seen) for v in (0, 1)}
    margin = np.log(np.clip([r["score"] for r in seen], 1e-15, 1 - 1e-15)) - np.log1p(-np.clip([r["score"] for r in seen], 1e-15, 1 - 1e-15))
    a, b = logistic_curve(margin, [r["label"] for r in seen])
    b += np.log(prior / (1 - prior)) - np.log(share[1] / share[0])  # the sample's classes are not as common as the corpus'
    return Model(features, weights * a, bias * a + b, prior) if a > 0 else raw


def _score(model: Model, names: list[str]):
    def run(batches):
        for b in slices(batches):
            out = []
            texts = texts_of(b, 1)
            for own, w in chunks(texts, texts, True, True):
                text, at = _hits(w, model.features)
                z = np.bincount(text, weights=model.weights[at] if len(at) else None, minlength=len(own)) + model.bias
                out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0)), *b.columns[2:]], names)

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = (), out_col: str = "score") -> DataFrame:
    """Score (column out_col, 0 to 1; the name must not be among `keep`) of every whole text beside the columns in `keep`.

    A null or empty text has no features and gets the bias' score.  Every row is scored by itself: rows that repeat a doc_id
    or a text, or have no doc_id, each get their row back.
    """
    own = [f"c{k}" for k in range(len(keep))]  # names for the way through the workers, where a name must be plain
    data = docs.select(F.lit(0).alias("row"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"), *(named(c).alias(n) for c, n in zip(keep, own, strict=True)))
    fields = StructType([StructField("row", IntegerType()), StructField("score", DoubleType()), *data.select(*own).schema])
    return data.mapInArrow(_score(model, fields.names), fields).select(F.col("score").alias(out_col), *(F.col(n).alias(c) for c, n in zip(keep, own, strict=True)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score of a half or more) of every row; an empty table has none.

    A null doc_id is held out.  Of a doc_id with several labels the larger counts; where rows share a doc_id, all their texts do.
    """
    return score(docs, fit(docs, labels), keep=("doc_id",)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
