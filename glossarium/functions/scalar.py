"""Scalar functions of the feature tables; all stay in the JVM and none divides by zero under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b, or `otherwise` where b is 0 or either is null."""
    value = F.try_divide(a, b)
    return value if otherwise is None else F.coalesce(value, F.lit(otherwise))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l1(v: Column) -> Column:
    """Sum of absolute values."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def relative(noun: Column, verb: Column) -> Column:
    """noun / (noun + verb), one half where that is undefined."""
    return ratio(noun, noun + verb, 0.5)


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def kappa(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Cohen's kappa of a two-by-two table."""
    n = tp + fp + fn + tn
    seen = ratio(tp + tn, n)
    chance = ratio((tp + fp) * (tp + fn) + (tn + fp) * (tn + fn), n * n)
    return ratio(seen - chance, 1 - chance)
