"""Small reusable column expressions (clip, rounding, guarded ratios, metric terms)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip keeping NULL as NULL (``greatest``/``least`` would skip the NULL)."""
    out = c
    if lo is not None:
        out = F.when(out < F.lit(lo), F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > F.lit(hi), F.lit(hi)).otherwise(out)
    return out


def round_half_up(c: Column, digits: int) -> Column:
    """``floor(x*10^d + 0.5) / 10^d`` — the same IEEE steps in every engine."""
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(num: Column, den: Column) -> Column:
    """Double division that yields NULL on a zero denominator (ANSI-safe)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def smape_term(actual: Column, pred: Column) -> Column:
    """|a-p| / ((|a|+|p|)/2), defined as 0 when both are 0."""
    den = (F.abs(actual) + F.abs(pred)) / F.lit(2.0)
    return F.when(den == 0, F.lit(0.0)).otherwise(F.abs(actual - pred) / den)


def to_double(c: Column) -> Column:
    """Lenient numeric coercion: unparsable text becomes NULL, NaN becomes NULL."""
    d = c.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def join_null_safe(left, right, keys, how: str = "inner"):
    """Equi-join in which NULL keys meet; the key columns of ``left`` are kept."""
    side = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(side[f"_r_{k}"])
        cond = one if cond is None else cond & one
    return left.join(side, cond, how).drop(*[f"_r_{k}" for k in keys])
