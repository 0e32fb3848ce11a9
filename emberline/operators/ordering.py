"""Order statistics without putting a whole column or group in one task.

Values are counted first, then cut into buckets along approximate quantiles.  The running
totals of the buckets are a small table; inside a bucket a window does the rest.  The cuts
only balance the work, so the results are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.frames import unpivot_features

BUCKETS = 128


def _with_bucket(counted: DataFrame, by: list[str], order: str, buckets: int,
                 few_groups: bool = False) -> DataFrame:
    """Adds the bucket of each value; ``few_groups`` says that the groups are known to be few."""
    probs = [i / buckets for i in range(1, buckets)]
    cuts = F.percentile_approx(order, probs, 10 * buckets).alias("_cuts")
    if by:
        points_by = counted.groupBy(*by).agg(cuts)
        split = counted.join(F.broadcast(points_by) if few_groups else points_by, by)
        points: Column = F.col("_cuts")
    else:
        split = counted
        points = F.array(*[F.lit(c) for c in counted.agg(cuts).first()[0] or []])
    bucket = F.size(F.filter(points, lambda c: c < F.col(order))).alias("_bucket")
    return split.select(*counted.columns, bucket)


def running_totals(df: DataFrame, by: Sequence[str], order: str, measures: Mapping[str, Column],
                   buckets: int = BUCKETS) -> DataFrame:
    """Per distinct ``order`` value of a group: each measure's sum, and its sum over smaller values.

    The second is named ``before_<measure>``.
    """
    by = list(by)
    counted = df.groupBy(*by, order).agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    split = _with_bucket(counted, by, order, buckets)
    over_buckets = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        split.groupBy(*by, "_bucket")
        .agg(*[F.sum(n).alias(f"_t_{n}") for n in measures])
        .select(
            *by, "_bucket",
            *[F.coalesce(F.sum(f"_t_{n}").over(over_buckets), F.lit(0)).alias(f"_o_{n}") for n in measures],
        )
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return split.join(offsets, [*by, "_bucket"]).select(
        *by, order, *measures,
        *[
            (F.col(f"_o_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"before_{n}")
            for n in measures
        ],
    )


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float],
                    by: Sequence[str] = (), buckets: int = BUCKETS, weight: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles: one row per group and feature, one column per quantile.

    Nulls are left out; a row counts ``weight`` times if given.  Only the buckets that hold a wanted rank reach the inner window.
    """
    by = list(by)
    keys = [*by, "feature"]
    ids = [*by, weight] if weight else by
    long = unpivot_features(df.select(*ids, *columns), ids, columns).filter(F.col("value").isNotNull())
    size = F.sum(weight) if weight else F.count("*")
    counted = long.groupBy(*keys, "value").agg(size.alias("n"))
    # without groups there is one row of cuts, and one of offsets per bucket, for each column
    few = not by
    split = _with_bucket(counted, keys, "value", buckets, few)
    ordered = Window.partitionBy(*keys).orderBy("_bucket")
    sums = split.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_n"))
    offsets = sums.select(
        *keys, "_bucket", "_n",
        (F.sum("_n").over(ordered) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )

    def position(p: float) -> Column:
        return F.lit(p) * (F.col("_total") - 1)

    ranks = [r(position(p)).cast("long") for p in probs.values() for r in (F.floor, F.ceil)]
    wanted = offsets.filter(
        F.exists(F.array(*ranks), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    ).drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("value")
    ranked = split.join(F.broadcast(wanted) if few else wanted, [*keys, "_bucket"]).withColumn(
        "_end", F.col("_before") + F.sum("n").over(inside)
    )

    def at(rank: Column) -> Column:
        here = (rank >= F.col("_end") - F.col("n")) & (rank < F.col("_end"))
        return F.max(F.when(here, F.col("value")))

    aggs = []
    for name, p in probs.items():
        lo, hi = F.floor(position(p)).cast("long"), F.ceil(position(p)).cast("long")
        aggs += [at(lo).alias(f"_lo_{name}"), at(hi).alias(f"_hi_{name}")]
    found = ranked.groupBy(*keys, "_total").agg(*aggs)
    return found.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}")
                + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (position(p) - F.floor(position(p)))
            ).alias(n)
            for n, p in probs.items()
        ],
    )


def quantiles_wide(df: DataFrame, columns: Sequence[str], p: float, by: Sequence[str] = (),
                   weight: str | None = None) -> DataFrame:
    """One quantile of each column, one column each, per group."""
    long = exact_quantiles(df, columns, {"q": p}, by, weight=weight)
    return long.groupBy(*by).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("q"))).alias(c) for c in columns]
    )
