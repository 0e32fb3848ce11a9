"""Small lookup tables kept as CSV files with a header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Columns and types of the lookup files.
LOOKUPS = {
    "bots": "author string",
    "class_communities": "subreddit string",
    "community_region": "subreddit string, country string, admin1code string, region string",
    "community_scores": "community string, age double, gender double, partisan double, affluence double",
    "population": "region string, population string, admin1code string, country string",
}


def scan_lookup(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A lookup by name; its file size is what lets the planner broadcast it or not."""
    return spark.read.schema(LOOKUPS[name]).option("header", "true").csv(path)


def names_frame(spark: SparkSession, names: Sequence[str], column: str) -> DataFrame:
    """A list held by the caller, as a one-column frame."""
    return spark.createDataFrame([(n,) for n in dict.fromkeys(names)], f"{column} string")
