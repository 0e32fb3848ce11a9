"""Joins of posts, author tables and feature frames.

None hints a broadcast.  A stored lookup is broadcast by Spark when its size allows it, and
a hot author or community is split by the adaptive skew join.  The lag join hints a merge: Spark
takes its lagged rows to be as few as the sample's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import parse_population
from emberline.functions.time import cohort_window, month_start, quarter_idx

# Fixed value: text of a vocabulary entry nobody wrote in.
NO_AUTHORS = "-- NO  AUTHORS --"


def history_broadcast_join(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Posts of the listed authors, carrying the author columns; k classes give k copies."""
    return posts.join(authors, "author", "inner")


def between_days(posts: DataFrame, day: str, authors: DataFrame, low: Column, high: Column | None = None) -> DataFrame:
    """Posts from the least ``low`` to the greatest ``high`` (exclusive) of the author table.

    Both ends are literals, so they reach the scan, and its folders where posts are kept by
    ``month``.  The author table is read for them: store it if it is costly.
    """
    ends = authors.agg(F.min(low).alias("low"), F.max(low if high is None else high).alias("high")).first()
    limits = {"low": ends["low"], "high": None if high is None else ends["high"]}
    for end, limit in limits.items():
        if limit is None:
            continue
        posts = posts.filter(F.col(day) >= F.lit(limit) if end == "low" else F.col(day) < F.lit(limit))
        if "month" in posts.columns:
            label = limit.strftime("%Y-%m")
            posts = posts.filter(F.col("month") >= label if end == "low" else F.col("month") <= label)
    return posts


def cohort_window_history(posts: DataFrame, authors: DataFrame, day: str = "day") -> DataFrame:
    """Posts written inside the 39-month window of any cohort their author belongs to.

    A semi join: an author listed twice does not multiply posts.
    """
    win = authors.select(F.col("author").alias("_a"), cohort_window(F.col("cohort")).alias("_w"))
    inside = (F.col(day) >= F.col("_w.start")) & (F.col(day) < F.col("_w.end"))
    posts = between_days(posts, day, win, F.col("_w.start"), F.col("_w.end"))
    return posts.join(win, (F.col("author") == F.col("_a")) & inside, "left_semi")


def pre_activation_history(posts: DataFrame, first: DataFrame, months: int = 24,
                           day: str = "day", date: str = "date") -> DataFrame:
    """Posts of the ``months`` calendar months before each author's activation month."""
    act = first.select("author", month_start(F.col(date)).alias("activation_month"))
    month = month_start(F.col(day))
    inside = (month >= F.add_months("activation_month", -months)) & (month < F.col("activation_month"))
    posts = between_days(posts, day, act, F.add_months("activation_month", -months), F.col("activation_month"))
    return posts.join(act, "author").filter(inside)


def post_activation_history(posts: DataFrame, first: DataFrame, day: str = "day",
                            date: str = "date") -> DataFrame:
    """Posts from each author's activation month on."""
    act = first.select("author", month_start(F.col(date)).alias("activation_month"))
    posts = between_days(posts, day, act, F.col("activation_month"))
    return posts.join(act, "author").filter(month_start(F.col(day)) >= F.col("activation_month"))


def weak_cohort_window(posts: DataFrame, activations: DataFrame, before: int = 8, after: int = 5,
                       day: str = "day", date: str = "date",
                       bounds: tuple[int, int] | None = None) -> DataFrame:
    """Posts in quarter q by authors activated in quarters ``q-before .. q+after-1``.

    ``bounds`` limits the activation quarters to ``first <= q < last``.
    """
    act = activations.select(F.col("author").alias("_a"), quarter_idx(F.col(date)).alias("_q"))
    if bounds is not None:
        act = act.filter((F.col("_q") >= bounds[0]) & (F.col("_q") < bounds[1]))
    first = F.make_date(F.floor((F.col("_q") - 1) / 4).cast("int"), (F.pmod(F.col("_q") - 1, F.lit(4)) * 3 + 1).cast("int"), F.lit(1))
    # quarters q - after + 1 .. q + before of the posts can be near
    posts = between_days(
        posts, day, act, F.add_months(first, 3 * (1 - after)), F.add_months(first, 3 * (before + 1)))
    q = quarter_idx(F.col(day))
    near = (F.col("_q") >= q - before) & (F.col("_q") < q + after)
    return posts.join(act, (F.col("author") == F.col("_a")) & near, "left_semi")


def geo_join(posts: DataFrame, geo: DataFrame, authors: DataFrame) -> DataFrame:
    """Posts of listed authors in located communities, with the region."""
    return posts.join(geo, "subreddit").join(authors.select("author"), "author", "left_semi")


def _days_between(df: DataFrame, start: str, end: str) -> Column:
    if dict(df.dtypes)[start] == "date":
        return F.datediff(end, start).cast("double")
    return F.timestamp_diff("SECOND", F.col(start), F.col(end)) / 86400


def activation_pair_join(weak: DataFrame, strong: DataFrame) -> DataFrame:
    """Weak and strong activation of the same author, their distance in days and order."""
    pairs = weak.withColumnRenamed("date", "date_weak").join(
        strong.withColumnRenamed("date", "date_strong"), "author"
    )
    return pairs.withColumns({
        "diff_days": _days_between(pairs, "date_weak", "date_strong"),
        "weak_then_strong": F.col("date_strong") > F.col("date_weak"),
        "simultaneous": F.col("date_strong") == F.col("date_weak"),
    })


def left_feature_merge(base: DataFrame, features: Sequence[DataFrame], key: Sequence[str],
                       fill=0) -> DataFrame:
    """Left joins on one key; absent features become ``fill``.

    All joins share the key, so the base is exchanged once and stays partitioned.
    """
    out = reduce(lambda a, b: a.join(b, list(key), "left"), features, base)
    added = [c for f in features for c in f.columns if c not in key]
    return out.fillna(fill, subset=added)


def outer_period_merge(frames: Mapping[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """Full outer join of one frame per period, features suffixed with the period."""
    named = [
        f.withColumnsRenamed({c: f"{c}_{p}" for c in f.columns if c not in key})
        for p, f in frames.items()
    ]
    return reduce(lambda a, b: a.join(b, list(key), "full_outer"), named)


def inner_reduce_merge(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Inner joins on one key: a key missing in any frame disappears."""
    return reduce(lambda a, b: a.join(b, list(key)), frames)


def vocab_right_join(df: DataFrame, vocab: DataFrame, key: str,
                     sentinel: str = NO_AUTHORS) -> DataFrame:
    """Keep every word of the vocabulary; text columns without a row get a sentinel."""
    out = df.join(vocab, key, "right")
    text = [c for c, t in out.dtypes if t == "string" and c != key]
    return out.fillna(sentinel, subset=text)


def lag_week_join(sample: DataFrame, facts: DataFrame, windows: Mapping[str, tuple[int, int]],
                  week: str = "week_idx") -> DataFrame:
    """Facts of the weeks before each sample row, tagged with their period.

    A window (start, end) covers the weeks ``week-start+1 .. week-end``.  The few lags of
    all periods are exploded together, so one join on (author, week) serves them all.  It is a merge
    join: Spark's estimate of the exploded rows leaves out their number of lags, so a sample whose
    file is below the broadcast limit would send all its lagged rows through the driver.
    """
    lags = [(p, lag) for p, (start, end) in windows.items() for lag in range(end, start)]
    lag_rows = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for p, n in lags])
    spread = sample.select("author", week, F.explode(lag_rows).alias("_lag")).select(
        "author", week, F.col("_lag.p").alias("period"), (F.col(week) - F.col("_lag.n")).alias("_then")
    )
    return spread.hint("merge").join(facts.withColumnRenamed(week, "_then"), ["author", "_then"]).drop("_then")


def population_join(users: DataFrame, population: DataFrame) -> DataFrame:
    """Located users per region next to the real population."""
    counted = users.groupBy("country", "admin1code").agg(F.count("author").alias("users"))
    real = population.select(
        "country", "admin1code", "region", parse_population(F.col("population")).alias("population")
    )
    return counted.join(real, ["country", "admin1code"])
