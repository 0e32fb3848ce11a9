"""Set operations on keys and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(a: DataFrame, b: DataFrame, tags: tuple[str, str] | None = None,
                  name: str = "source") -> DataFrame:
    """Union by column name; a column one side lacks is null there."""
    if tags:
        a, b = a.withColumn(name, F.lit(tags[0])), b.withColumn(name, F.lit(tags[1]))
    return a.unionByName(b, allowMissingColumns=True)


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys that occur in both."""
    return a.select(key).join(b.select(key), key, "left_semi").distinct()


def except_authors(a: DataFrame, b: DataFrame, key: str = "author") -> DataFrame:
    """Rows of ``a`` whose key does not occur in ``b``."""
    return a.join(b.select(key), key, "left_anti")


def distinct_items(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()
