"""Row filters.  Long name lists are joins, so a plan never carries thousands of literals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import NEWS_THEMES, WEAK_KEYWORDS, contains_any


def filter_community(df: DataFrame, names: Sequence[str] | DataFrame, column: str = "subreddit") -> DataFrame:
    """Posts of some communities: a short list becomes a pushed-down IN, a frame a semi join."""
    if isinstance(names, DataFrame):
        return df.join(names.select(F.col(names.columns[0]).alias(column)), column, "left_semi")
    return df.filter(F.col(column).isin(list(names)))


def filter_keywords(df: DataFrame, column: str = "body", words: Sequence[str] = WEAK_KEYWORDS) -> DataFrame:
    """Text that contains any keyword, ignoring case; null text is dropped."""
    return df.filter(F.col(column).isNotNull() & contains_any(F.col(column), words))


def filter_authors(df: DataFrame, authors: DataFrame, column: str = "author") -> DataFrame:
    return df.join(authors.select(column), column, "left_semi")


def exclude_bots(df: DataFrame, bots: DataFrame, column: str = "author") -> DataFrame:
    """Posts whose author is not on the list; a post without author stays."""
    return df.join(bots.select(column), column, "left_anti")


def filter_positive_score(df: DataFrame, minimum: float = 0, column: str = "score") -> DataFrame:
    return df.filter(F.col(column) > minimum)


def theme_filter(df: DataFrame, words: Sequence[str] = NEWS_THEMES, column: str = "V2Themes") -> DataFrame:
    return df.filter(contains_any(F.col(column), words))


def date_window_filter(df: DataFrame, column: str, after, before) -> DataFrame:
    """Strictly between two dates."""
    day = F.col(column)
    return df.filter((day > F.lit(after).cast("date")) & (day < F.lit(before).cast("date")))


def positive_news_filter(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in columns]))


def _any(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c) for c in columns])


def active_only_filter(df: DataFrame, long: Sequence[str], short: Sequence[str]) -> DataFrame:
    """Rows with at least one community in the long and one in the short period."""
    return df.filter(_any(long) & _any(short))


def overlap_split(df: DataFrame, label: str, author: str = "author", keep: bool = True) -> DataFrame:
    """Rows of authors seen with both labels (``keep``), or of all other authors."""
    mixed = (
        df.groupBy(author)
        .agg(F.min(F.col(label).cast("int")).alias("lo"), F.max(F.col(label).cast("int")).alias("hi"))
        .filter(F.col("lo") < F.col("hi"))
        .select(author)
    )
    return df.join(mixed, author, "left_semi" if keep else "left_anti")
