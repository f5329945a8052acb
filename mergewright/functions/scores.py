"""Scalar functions of scores, losses and keyed hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """X16."""
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column, eps: float = 1e-4) -> Column:
    """Log odds of a probability kept away from 0 and 1."""
    q = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))
    return F.log(q / (1.0 - q))


def tempered(p: Column, temperature: float) -> Column:
    """A probability softened by a temperature."""
    return sigmoid(logit(p) / F.lit(temperature))


def bce_with_logits(x: Column, y: Column) -> Column:
    """Binary cross entropy of a logit."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def softplus(x: Column) -> Column:
    """Stable log(1 + exp(x))."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def ranking_hinge(positive: Column, negative: Column, margin: float, temperature: float) -> Column:
    """Soft hinge of a positive and a negative score."""
    return softplus((F.lit(margin) - (positive - negative)) / F.lit(temperature)) * F.lit(temperature)


def soft_distillation(x: Column, teacher: Column, temperature: float) -> Column:
    """Cross entropy of softened logits and teacher, scaled by temperature squared."""
    return bce_with_logits(x / F.lit(temperature), tempered(teacher, temperature)) * F.lit(temperature**2)


def clip(x: Column, low: float, high: float) -> Column:
    """F9."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def symmetric(p: Column, reverse: Column) -> Column:
    """Average of both directions."""
    return (p + reverse) * 0.5


def keyed_hash(*parts: Column | str) -> Column:
    """32-bit number of the md5 of the parts: the same on every engine."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def unit_hash(*parts: Column | str) -> Column:
    """The same as a number in [0, 1)."""
    return keyed_hash(*parts).cast("double") / F.lit(float(2**32))
