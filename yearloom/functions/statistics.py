"""Statistics as column expressions, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def erf(x: Column) -> Column:
    """Error function by Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7."""
    a = F.abs(x)
    t = 1.0 / (1.0 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1.0 - poly * F.exp(-a * a))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal."""
    return 0.5 * (1.0 - erf(z / F.sqrt(F.lit(2.0))))


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope; 0 with fewer than two points or no spread in x."""
    return F.when((F.count(F.when(y.isNotNull() & x.isNotNull(), 1)) < 2) | (F.coalesce(F.var_pop(x), F.lit(0.0)) == 0), 0.0).otherwise(F.coalesce(F.regr_slope(y, x), F.lit(0.0)))


def softmax(logits: Column) -> Column:
    """Shift-stable softmax of an array of numbers; null for null, empty for empty."""
    top = F.array_max(logits)
    exps = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(exps, F.lit(0.0), lambda s, v: s + v)
    return F.transform(exps, lambda v: v / total)


def dot(values: Column, weights: list[float]) -> Column:
    """Weighted sum of an array, position by position."""
    fixed = F.array(*[F.lit(float(w)) for w in weights])
    return F.aggregate(F.zip_with(values, fixed, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)


def argmax(values: Column) -> Column:
    """0-based index of the greatest value; the lowest index wins a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
