"""Arithmetic of period features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results for x/0 and 0/0, smoothing terms, and weeks per period in merges.
RATIO_NEW = 1.0
RATIO_NONE = 2.0
SMOOTH_NUMERATOR = 0.001
SMOOTH_DENOMINATOR = 0.01
MEDIUM_LONG_WEIGHTS = (4, 47)
MEDIUM_SHORT_WEIGHTS = (4, 1)


def safe_ratio(short: Column, long: Column) -> Column:
    """short/long, 1 when only the long side is zero, 2 when both are; null counts as zero."""
    a = F.coalesce(short, F.lit(0)).cast("double")
    b = F.coalesce(long, F.lit(0)).cast("double")
    return F.when(b != 0, a / b).when(a != 0, F.lit(RATIO_NEW)).otherwise(F.lit(RATIO_NONE))


def smoothed_ratio(week: Column, year: Column) -> Column:
    return (week + F.lit(SMOOTH_NUMERATOR)) / (year + F.lit(SMOOTH_DENOMINATOR))


def new_in_short(short: Column, long: Column) -> Column:
    """Present in the short period and absent from the long one."""
    return short & ~long


def weighted_period_merge(a: Column, b: Column, wa: float, wb: float) -> Column:
    return (a * F.lit(wa) + b * F.lit(wb)) / F.lit(wa + wb)


def bool_union(a: Column, b: Column) -> Column:
    return a | b


def positive(x: Column) -> Column:
    return x > 0


def log1p_transform(x: Column) -> Column:
    return F.log1p(x)


def rate_to_total(rate: Column, duration: Column) -> Column:
    return rate * duration


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are known; null when either is constant."""
    x, y = x.cast("double"), y.cast("double")
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b))
