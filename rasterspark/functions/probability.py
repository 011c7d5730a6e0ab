"""Class scores as arrays: probabilities, winners and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column) -> Column:
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(raised, lambda x: x / _sum(raised))


def sigmoid(logits: Column) -> Column:
    return F.transform(logits, lambda x: 1 / (1 + F.exp(-x)))


def winner(scores: Column) -> Column:
    """Index of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def largest(scores: Column) -> Column:
    return F.array_max(scores)


def certainty(probs: Column) -> Column:
    """1 minus entropy over its maximum, within [0, 1]."""
    entropy = -_sum(F.transform(probs, lambda p: F.least(F.greatest(p, F.lit(1e-10)), F.lit(1.0)) * F.ln(F.least(F.greatest(p, F.lit(1e-10)), F.lit(1.0)))))
    scale = F.when(F.size(probs) > 1, F.ln(F.size(probs).cast("double"))).otherwise(1.0)
    return F.least(F.greatest(1 - entropy / scale, F.lit(0.0)), F.lit(1.0))


def confidence(probs: Column, strategy="max", **options) -> Column:
    """Confidence by name (max or entropy), or by a function of the user's."""
    known = {"max": largest, "entropy": certainty}
    return (known[strategy] if isinstance(strategy, str) else strategy)(probs, **options)
