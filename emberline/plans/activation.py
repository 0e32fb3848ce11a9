"""From raw posts to who activated, when, and where."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.aggregates import first_activation, value_counts
from emberline.operators.filters import filter_community, filter_keywords
from emberline.operators.joins import activation_pair_join

# Fixed value: days between weak and strong activation that still count as one course.
TWO_YEARS = 366 * 2


def weak_and_strong(posts: DataFrame, words: Sequence[str], communities: Sequence[str],
                    time: str = "created_utc") -> tuple[DataFrame, DataFrame]:
    weak = first_activation(filter_keywords(posts, "body", words), time, ["day"])
    strong = first_activation(filter_community(posts, communities), time, ["subreddit", "day"])
    return weak.withColumnRenamed("day", "date"), strong.withColumnRenamed("day", "date")


def activated_authors(posts: DataFrame, words: Sequence[str], communities: Sequence[str],
                      after: str, before: str, time: str = "created_utc") -> DataFrame:
    """Authors strong after weak, both inside the dates and within two years."""
    weak, strong = weak_and_strong(posts, words, communities, time)
    pairs = activation_pair_join(weak, strong)
    return pairs.filter(
        F.col("weak_then_strong")
        & (F.col("date_weak") > F.lit(after).cast("date"))
        & (F.col("date_strong") < F.lit(before).cast("date"))
        & (F.col("diff_days") < TWO_YEARS)
    )


def pipe_activation(posts: DataFrame, words: Sequence[str], communities: Sequence[str],
                    after: str, before: str, time: str = "created_utc") -> DataFrame:
    """Activated authors per community of first strong activation."""
    return value_counts(
        activated_authors(posts, words, communities, after, before, time), ["subreddit"]
    )
