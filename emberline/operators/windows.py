"""Rolling, cumulative and ranked computations, and columns scaled over the whole table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.time import week_shift
from emberline.operators.ordering import exact_quantiles, quantiles_wide
from emberline.schemas import QUARTILE_FLAGS
from emberline.session import store

_REGION = ["country", "admin1code"]


def rolling_mean_lagged(df: DataFrame, columns: Sequence[str], width: int, lag: int,
                        calendar: bool = False, by: Sequence[str] = tuple(_REGION)) -> DataFrame:
    """Trailing mean of ``width`` rows per region, zero until full, dated ``lag`` weeks later.

    With ``calendar`` the window is ``width`` calendar weeks instead of rows.  A region has
    one row per week, so a window partition stays small.
    """
    w = Window.partitionBy(*by).orderBy("week_idx")
    w = w.rangeBetween(-(width - 1), 0) if calendar else w.rowsBetween(-(width - 1), 0)

    def mean(c: str) -> Column:
        full = F.count(c).over(w) == width
        return F.when(full, F.avg(c).over(w)).otherwise(F.lit(0.0)).alias(c)

    return df.select(*by, week_shift(F.col("week_idx"), lag).alias("week_idx"), *[mean(c) for c in columns])


def person_period_last(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Last row per key in time order, as a combinable maximum instead of a sort."""
    rest = [c for c in df.columns if c not in key and c != order]
    last = df.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return last.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def cumulative_weekly(weekly: DataFrame, week: str = "week", n: str = "n",
                      by: Sequence[str] = ()) -> DataFrame:
    """Running total of weekly counts.  The input has one row per week, so one task is enough."""
    w = Window.partitionBy(*by).orderBy(week).rowsBetween(Window.unboundedPreceding, 0)
    return weekly.withColumn("cumulative", F.sum(n).over(w))


def best_run_per_setting(runs: DataFrame, settings: Sequence[str], metric: str, tie: str) -> DataFrame:
    """The run with the highest metric per group of settings; the smallest tie key wins."""
    rest = [c for c in runs.columns if c not in settings and c not in (metric, tie)]
    row = F.struct((-F.col(metric)).alias("_worst"), F.col(tie), F.col(metric), *rest)
    best = runs.groupBy(*settings).agg(F.min(row).alias("_r"))
    return best.select(*[F.col(c) if c in settings else F.col(f"_r.{c}").alias(c) for c in runs.columns])


def column_stats(df: DataFrame, columns: Sequence[str], ddof: int) -> dict[str, tuple[float, float]]:
    """Mean and deviation per column: one aggregate, a pair of numbers per column."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = df.agg(*[F.struct(F.avg(c), std(c)) for c in columns]).first()
    return {c: tuple(row[i]) for i, c in enumerate(columns)}


def zscore(df: DataFrame, columns: Sequence[str], ddof: int = 0,
           transform: Mapping[str, Column] | None = None, suffix: str = "") -> DataFrame:
    """(x - mean) / deviation over all rows; a constant column becomes zero.

    The statistics are one aggregate, fitted at once as a scaler is; no window runs over
    everything and the rows are not shuffled.
    """
    values = df.withColumns(dict(transform)) if transform else df
    stats = column_stats(values, columns, ddof)

    def z(c: str) -> Column:
        mean, std = stats[c]
        if not std:
            return F.when(F.col(c).isNotNull(), F.lit(0.0))
        return (F.col(c) - F.lit(mean)) / F.lit(std)

    return values.withColumns({f"{c}{suffix}": z(c) for c in columns})


def quartile_membership(scores: DataFrame, attributes: Sequence[str] = tuple(QUARTILE_FLAGS)) -> DataFrame:
    """Eight booleans: author in the first or in the fourth quartile of each attribute.

    The cut points, two numbers per attribute, are computed at once from the stored scores.
    """
    scores = store(scores.select("author", *attributes), "scores")
    cuts = {
        row["feature"]: row
        for row in exact_quantiles(scores, attributes, {"q1": 0.25, "q3": 0.75}).collect()
    }
    flags: dict[str, Column] = {}
    for a in attributes:
        low, high = QUARTILE_FLAGS[a]
        q = cuts.get(a)
        flags[low] = F.coalesce(F.col(a) <= F.lit(q["q1"] if q else None), F.lit(False))
        flags[high] = F.coalesce(F.col(a) >= F.lit(q["q3"] if q else None), F.lit(False))
    return scores.select("author", *[c.alias(n) for n, c in flags.items()])


def median_impute(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                  percent: Sequence[str] = ()) -> DataFrame:
    """Nulls become the column's median (per group if ``by``); infinite rows go; shares become %.

    A group without any value keeps its nulls.
    """
    if by:
        med = quantiles_wide(df, columns, 0.5, by).withColumnsRenamed({c: f"_m_{c}" for c in columns})
        joined = df.join(med, list(by), "left")
        fill = {c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}
    else:
        med = {row["feature"]: row["q"] for row in exact_quantiles(df, columns, {"q": 0.5}).collect()}
        joined = df
        fill = {c: F.coalesce(F.col(c), F.lit(med.get(c))) for c in columns}
    filled = joined.withColumns(fill).select(*df.columns)
    for c in columns:
        filled = filled.filter(F.col(c).isNull() | (F.abs(c) != float("inf")))
    return filled.withColumns({c: F.col(c) * 100 for c in percent}) if percent else filled
