"""Reports of the largest few."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topk_communities(posts: DataFrame, k: int = 1000, column: str = "subreddit") -> DataFrame:
    """The most frequent communities; the name breaks ties."""
    counts = posts.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)


def topk_coefficients(coefs: DataFrame, k: int, column: str = "coef", absolute: bool = True,
                      where: str | None = None) -> DataFrame:
    rows = coefs.filter(where) if where else coefs
    order = F.abs(column) if absolute else F.col(column)
    return rows.orderBy(order.desc(), "feature").limit(k)


def topk_cross_class(coefs: DataFrame, classes: Sequence[str], k: int = 45) -> DataFrame:
    """Features with the largest coefficient over the classes, with the norm over the classes."""
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in classes[1:]), F.col(classes[0]) * F.col(classes[0])))
    rows = coefs.withColumns({"max": F.greatest(*classes), "l2": norm})
    return rows.orderBy(F.desc("max"), "feature").limit(k)


def topk_per_group(df: DataFrame, by: str, value: str, k: int, tie: str) -> DataFrame:
    """The ``k`` largest per group; Spark cuts each task's rows to ``k`` before the exchange."""
    w = Window.partitionBy(by).orderBy(F.desc(value), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def every_nth_row(series: DataFrame, by: str, offset: int, n: int) -> DataFrame:
    """Rows ``offset``, ``offset + n``, ... of a series with one row per date."""
    w = Window.orderBy(by)
    rows = series.withColumn("_r", F.row_number().over(w) - 1)
    return rows.filter((F.col("_r") >= offset) & ((F.col("_r") - offset) % n == 0)).drop("_r")
