"""Column expressions that Spark has no name for."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Acklam's coefficients for the standard normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL = 0.02425


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile to about 1e-9; null outside (0, 1)."""
    q = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    tail = _poly(_C, q) / _poly(_D, q)
    centre = p - 0.5
    r = centre * centre
    middle = _poly(_A, r) * centre / _poly(_B, r)
    inside = F.when(p < _TAIL, tail).when(p > 1 - _TAIL, -tail).otherwise(middle)
    return F.when((p > 0) & (p < 1), inside)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function to about 1e-15.

    Sums phi(x) * x**(2n+1) / (1 * 3 * ... * (2n+1)), whose terms all have one sign.
    """
    x = x.cast("double")
    near = F.least(F.greatest(x, F.lit(-8.0)), F.lit(8.0))
    start = F.struct(near.alias("term"), near.alias("total"))
    step = lambda acc, n: F.struct(
        (acc["term"] * near * near / (2 * n + 1)).alias("term"), (acc["total"] + acc["term"] * near * near / (2 * n + 1)).alias("total")
    )
    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, step, lambda acc: acc["total"])
    return F.when(x <= -8.0, 0.0).when(x >= 8.0, 1.0).otherwise(0.5 + F.exp(-near * near / 2) / math.sqrt(2 * math.pi) * series)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.when(b != 0, b)


def flow_share(amount: Column, volume: Column) -> Column:
    """An amount as a share of the volume it trades in: 0 for nothing, infinite where there is no volume."""
    return F.when(amount == 0, 0.0).when(volume > 0, amount / F.when(volume > 0, volume)).when(volume <= 0, float("inf"))


def observation_time(text: Column) -> Column:
    """A lenient instant: a date means the end of that UTC day, a stamp without a zone is UTC."""
    day = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(day, F.try_to_timestamp(text) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")).otherwise(F.try_to_timestamp(text))


def strict_timestamp(text: Column) -> Column:
    """An instant only where the text carries a zone (Z or an offset); null otherwise."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def age_days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400e6)


def earliest_by(value: Column, ordinal: Column, want: Column) -> Column:
    """`want` where `value` is least; the first by `ordinal` among ties."""
    return F.min_by(want, F.struct(value, ordinal))
