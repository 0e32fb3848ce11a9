"""The author-by-week table with activity and interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.time import month_start, person_period_duration, week_idx, week_spine
from emberline.operators.aggregates import weekly_activity
from emberline.operators.interactions import (
    active_items,
    active_posts,
    interaction_counts,
    interaction_features,
    interaction_join,
)
from emberline.operators.joins import left_feature_merge
from emberline.schemas import PAIRINGS
from emberline.session import store

# Days before the weak date, after it, and after the strong date.
DAYS_BEFORE_WEAK = 366
DAYS_AFTER_WEAK = 366 * 2
DAYS_AFTER_STRONG = 7

_KEY = ["author", "week_idx"]


def author_weeks(authors: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One row per author and week, with its length and whether activation falls in it.

    The author table has one row per author and a week one Sunday, so no row has to be
    chosen among several.  ``seen`` has the list ``observed`` of the weeks to keep per author; it is
    joined to the authors, so no week is shuffled to be dropped.
    """
    if seen is not None:
        authors = authors.join(seen, "author")
    dated = authors.withColumns({
        "date_start": F.date_sub("date_weak", DAYS_BEFORE_WEAK),
        "date_end": F.least(
            F.date_add("date_strong", DAYS_AFTER_STRONG), F.date_add("date_weak", DAYS_AFTER_WEAK)
        ),
    })
    spine = week_spine(dated, "date_start", "date_end")
    if seen is not None:
        spine = spine.filter(F.array_contains("observed", week_idx(F.col("sunday"))))
    return spine.select(
        "author",
        week_idx(F.col("sunday")).alias("week_idx"),
        "sunday", "active", "date_weak", "date_strong",
        person_period_duration(F.col("sunday"), F.col("date_start"), F.col("date_end")).alias("duration"),
        (week_idx(F.col("sunday")) == week_idx(F.col("date_strong"))).alias("activation"),
    )


def observed_weeks(posts: DataFrame) -> DataFrame:
    """(author, observed): the weeks touched by a month in which the author commented."""
    comments = posts.filter(F.col("kind") == "RC").withColumn("month", month_start(F.col("day")))
    # lists bounded by the calendar: at most six weeks per month, whatever the number of posts
    months = comments.groupBy("author").agg(F.collect_set("month").alias("_months"))
    month_weeks = F.broadcast(comments.groupBy("month").agg(F.collect_set("week_idx").alias("_weeks")))
    return months.select("author", F.explode("_months").alias("month")).join(month_weeks, "month").groupBy(
        "author").agg(F.array_distinct(F.flatten(F.collect_list("_weeks"))).alias("observed"))


def pipe_person_period(posts: DataFrame, authors: DataFrame, extra: Sequence[DataFrame] = (),
                       observed_only: bool = True) -> DataFrame:
    """Author weeks with weekly activity (and ``extra`` weekly features), zero where absent.

    ``posts`` has week_idx and one row per id.
    """
    weeks = author_weeks(authors, observed_weeks(posts) if observed_only else None)
    return left_feature_merge(weeks, [*extra, weekly_activity(posts)], _KEY)


def pipe_interactions(window: DataFrame, history: DataFrame, subreddit_class: str, own: Sequence[str],
                      pairings: Sequence[str] = tuple(PAIRINGS)) -> DataFrame:
    """Interaction features per (author, week): four pairings, pairs and distinct authors.

    ``window`` are posts of all studied authors with week_idx; ``history`` are the posts of
    active authors after activation with their class.  The counts read the join once.
    """
    items = store(active_items(active_posts(history, subreddit_class, own), pairings), "active-items")
    met = interaction_join(window, items, pairings)
    return interaction_features(interaction_counts(met, items), pairings)
