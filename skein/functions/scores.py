"""Column builders over arrays of logits and over single logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-9


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def softmax(logits: Column) -> Column:
    shifted = F.transform(doubles(logits), lambda x: F.exp(x - F.array_max(logits).cast("double")))
    return F.transform(shifted, lambda e: e / _sum(shifted))


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits).cast("double")
    return top + F.log(_sum(F.transform(doubles(logits), lambda x: F.exp(x - top))))


def entropy(logits: Column) -> Column:
    """Of the softmax, its probabilities floored at 1e-9 inside the logarithm."""
    each = F.transform(doubles(logits), lambda x: x - log_sum_exp(logits))
    return -_sum(F.transform(each, lambda l: F.exp(l) * F.log(F.greatest(F.exp(l), F.lit(FLOOR)))))


def argmax(values: Column) -> Column:
    """Place of the first maximum, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def decided(x: Column, threshold: float = 0.5) -> Column:
    return (sigmoid(x) >= threshold).cast("int")


def rounded(x: Column) -> Column:
    """Half to even, so a probability of exactly 0.5 is 0."""
    return F.bround(sigmoid(x), 0).cast("int")


def hard_entity(logits: Column, max_entropy: float = 0.8) -> Column:
    """Whether the first maximum isn't the last entry (unknown), and the entropy is low."""
    return (argmax(logits) != F.size(logits) - 1) & (entropy(logits) <= max_entropy)


def tag(logits: Column, classes: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, classes)), argmax(logits) + 1)


def weighted_bce(x: Column, y: Column, pos_weight: Column | float = 1.0) -> Column:
    """Binary cross-entropy of a logit, the positive term weighted; stable for large logits."""
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(pos_weight)
    soft = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))  # noqa: E731  log(1 + exp(v))
    return (1 - y) * soft(x) + weight * y * soft(-x)


def smoothed_cross_entropy(logits: Column, target: Column, smoothing: float) -> Column:
    """Cross-entropy where the target holds 1 - smoothing, and smoothing is spread evenly over all classes."""
    norm = log_sum_exp(logits)
    hit = norm - F.element_at(logits, target.cast("int") + 1).cast("double")
    every = norm - _sum(doubles(logits)) / F.size(logits)
    return (1 - smoothing) * hit + smoothing * every


def logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def clamped(p: Column, low: float = 1e-5) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(1 - low), p))


def positive_weight(frequency: Column, cap: float) -> Column:
    """(1 - f) / f, capped."""
    f = clamped(frequency)
    return F.least(F.lit(cap), (1 - f) / f)


def masked(x: Column, position: Column, length: Column) -> Column:
    """x, or -1e9 from `length` on."""
    return F.when(position < length, x).otherwise(F.lit(-1e9))


def ramp(epoch: Column, epochs: int, start: float = 0.1) -> Column:
    """The relation loss's weight: from start to 1 over `epochs`; 1 where there is no ramp."""
    return F.lit(1.0) if not epochs else F.lit(start) + F.lit(1 - start) * F.least(F.lit(1.0), epoch / float(epochs))
