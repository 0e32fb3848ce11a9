"""Regional news of the weeks before, per author."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.time import week_idx
from emberline.operators.aggregates import news_class_day, news_class_week, news_region_day, weekly_median
from emberline.operators.joins import outer_period_merge
from emberline.operators.windows import rolling_mean_lagged
from emberline.schemas import NORM_NEWS
from emberline.session import store

# Fixed values: (weeks of lag, rows averaged) per period.
LAGS = {"short": (1, 1), "medium": (2, 4), "long": (6, 46)}

_REGION = ["country", "admin1code"]


def news_weeks(news: DataFrame, **flags) -> DataFrame:
    """Weekly class totals and shares per region."""
    totals = news.groupBy("day").agg(F.count("*").alias("n"))
    per_day = news_class_day(news, totals, **flags)
    return news_class_week(per_day, news_region_day(news), week_idx(F.col("day")))


def region_exposure(weeks: DataFrame, lags: Mapping[str, tuple[int, int]] = LAGS) -> DataFrame:
    """Share of each class per region and week, for every period."""
    frames = {
        p: rolling_mean_lagged(weeks, NORM_NEWS, width, lag) for p, (lag, width) in lags.items()
    }
    return outer_period_merge(frames, [*_REGION, "week_idx"])


def exposure(regions: DataFrame, author_region: DataFrame, weeks: DataFrame) -> DataFrame:
    """News of the author's region in the given (author, week) rows."""
    located = weeks.join(author_region.select("author", *_REGION), "author")
    return located.join(regions, [*_REGION, "week_idx"]).drop(*_REGION)


def impute_by_week(sample: DataFrame, regions: DataFrame, author_region: DataFrame,
                   keep: Sequence[str] = ()) -> DataFrame:
    """News of the sampled weeks; the week's median over authors where the author has none.

    The median over authors is the median over regions weighted by their authors, so the
    table of all authors and weeks is never built.  A week in which no region with authors
    has news drops its unlocated rows, as an inner merge would.
    """
    columns = [c for c in regions.columns if c not in (*_REGION, "week_idx")]
    crowd = author_region.groupBy(*_REGION).agg(F.count("*").alias("_authors"))
    medians = weekly_median(regions.join(crowd, _REGION), columns, weight="_authors")
    medians = medians.withColumnsRenamed({c: f"_m_{c}" for c in columns}).withColumn("_has", F.lit(True))
    own = (
        sample.select("author", "week_idx", *keep)
        .join(author_region.select("author", *_REGION), "author", "left")
        .join(regions, [*_REGION, "week_idx"], "left")
    )
    known = F.col(columns[0]).isNotNull()
    merged = own.join(medians, "week_idx", "left").filter(known | F.col("_has"))
    return merged.select(
        "author", "week_idx", *keep,
        *[F.when(known, F.col(c)).otherwise(F.col(f"_m_{c}")).alias(c) for c in columns],
    )


def pipe_news_exposure(news: DataFrame, author_region: DataFrame, sample: DataFrame,
                       lags: Mapping[str, tuple[int, int]] = LAGS, keep: Sequence[str] = (),
                       **flags) -> DataFrame:
    """News features per sampled author week.

    The regional table, a row per region and week, is written once: it is read for the
    medians and for the match, and its known size lets both be broadcast joins.
    """
    regions = store(region_exposure(news_weeks(news, **flags), lags), "news-regions")
    return impute_by_week(sample, regions, author_region, keep)
