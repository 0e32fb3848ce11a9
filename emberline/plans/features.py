"""The point-in-time feature table, its variants, and the design matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.numeric import (
    MEDIUM_LONG_WEIGHTS,
    MEDIUM_SHORT_WEIGHTS,
    bool_union,
    log1p_transform,
    safe_ratio,
    weighted_period_merge,
)
from emberline.operators.aggregates import (
    community_popularity,
    lag_mean,
    participation_score,
)
from emberline.operators.filters import positive_news_filter
from emberline.operators.joins import lag_week_join, left_feature_merge
from emberline.operators.sampling import balance_classes
from emberline.operators.topk import topk_communities
from emberline.operators.windows import zscore
from emberline.session import store

# Fixed values: (exclusive start, end) of the lags of each period, in weeks back.
WINDOWS = {"short": (2, 1), "medium": (6, 2), "long": (53, 6)}

_KEY = ["author", "week_idx"]


def activity_windows(sample: DataFrame, activity: DataFrame, features: Sequence[str],
                     windows: Mapping[str, tuple[int, int]] = WINDOWS) -> DataFrame:
    """Mean weekly activity in each period."""
    facts = activity.select(*_KEY, *features)
    return lag_mean(lag_week_join(sample, facts, windows), features, list(windows))


def vocabulary(posts: DataFrame, k: int = 1000) -> DataFrame:
    """The ``k`` most frequent communities, numbered from 0 by frequency."""
    top = topk_communities(posts, k)
    # k rows at most
    place = F.row_number().over(Window.orderBy(F.desc("n"), "subreddit")) - 1
    return top.select("subreddit", place.cast("int").alias("community"))


def participation_windows(sample: DataFrame, participation: DataFrame, vocab: DataFrame,
                          windows: Mapping[str, tuple[int, int]] = WINDOWS) -> DataFrame:
    """Communities written in per period, as sorted lists of their numbers in the vocabulary.

    A row lists what it has instead of a column per community and period, so neither the plan nor
    the row grows with the vocabulary; ``participation`` is distinct per week.
    """
    numbered = participation.join(vocab, "subreddit").select(*_KEY, "community")
    lagged = lag_week_join(sample, numbered, windows)
    return lagged.groupBy(*_KEY).agg(*[
        F.sort_array(F.collect_set(F.when(F.col("period") == p, F.col("community")))).alias(f"communities_{p}")
        for p in windows
    ])


def drop_duplicate_rows(table: DataFrame, digits: int = 9) -> DataFrame:
    """One row of those that agree in everything but author and week: the one with the smallest key.

    Doubles agree when they do to ``digits`` digits, whatever the order they were summed in.
    """
    rest = [c for c in table.columns if c not in _KEY]
    same = [F.round(c, digits).alias(f"_{i}") if t == "double" else F.col(c).alias(f"_{i}")
            for i, (c, t) in enumerate((c, t) for c, t in table.dtypes if c not in _KEY)]
    first = table.groupBy(*same).agg(F.min(F.struct(*_KEY, *rest)).alias("_r"))
    return first.select(*[F.col(f"_r.{c}").alias(c) for c in table.columns])


def pipe_feature_table(sample: DataFrame, news: DataFrame, activity: DataFrame, features: Sequence[str],
                       participation: DataFrame, vocab: DataFrame, quartiles: DataFrame,
                       norm_news: Sequence[str], windows: Mapping[str, tuple[int, int]] = WINDOWS,
                       seed: int | str | None = None) -> DataFrame:
    """Sampled author weeks with news, lagged activity and participation, quartiles and ratios.

    The ratio of participation lists the communities new in the short period.  Rows that agree in
    everything but their key count once.

    ``sample`` has activation and duration; ``news`` one row per sampled author week that
    keeps news.  ``seed`` balances the classes.
    """
    short, long = "short", "long"
    # a merge join, as the lag join: in a broadcast, a sample can take twenty times the size of its file
    base = sample.select(*_KEY, "activation", "duration").hint("merge").join(news, _KEY)
    base = base.fillna(0.0, subset=[c for c in news.columns if c not in _KEY])
    base = positive_news_filter(base, [f"{c}_{long}" for c in norm_news])
    table = left_feature_merge(base, [activity_windows(sample, activity, features, windows)], _KEY, 0.0)
    lists = [f"communities_{p}" for p in windows]
    none = F.array().cast("array<int>")
    table = table.join(participation_windows(sample, participation, vocab, windows), _KEY, "left").withColumns(
        {c: F.coalesce(c, none) for c in lists})
    flags = [c for c in quartiles.columns if c != "author"]
    table = table.join(quartiles, "author", "left").fillna(False, subset=flags)
    ratios: dict[str, Column] = {
        f"{c}_short_long_ratio": safe_ratio(F.col(f"{c}_{short}"), F.col(f"{c}_{long}"))
        for c in [*norm_news, *features]
    }
    ratios["communities_short_long_ratio"] = F.array_except(f"communities_{short}", f"communities_{long}")
    table = drop_duplicate_rows(table.withColumns(ratios))
    if seed is None:
        return table
    # counted and then drawn from: write the table once instead of computing it twice
    keyed = store(table, "features").withColumn("_key", F.concat_ws("@", "author", F.col("week_idx").cast("string")))
    return balance_classes(keyed, "activation", seed, "_key").drop("_key")


def pipe_period_robustness(table: DataFrame, mode: str, norm_news: Sequence[str], control: Sequence[str],
                           interaction: Sequence[str]) -> DataFrame:
    """The table with medium merged into long (``longmedium``) or into short (``shortmedium``)."""
    numeric = [*norm_news, *control]
    if mode == "longmedium":
        into, other, (wa, wb) = "long", "short", MEDIUM_LONG_WEIGHTS
    elif mode == "shortmedium":
        into, other, (wa, wb) = "short", "long", MEDIUM_SHORT_WEIGHTS
        numeric = [*interaction, *numeric]
    else:
        raise ValueError(mode)
    kept = [f"{c}_{other}" for c in [*interaction, *norm_news, *control]]

    def merged(c: str) -> Column:
        x = weighted_period_merge(F.col(f"{c}_medium"), F.col(f"{c}_{into}"), wa, wb)
        return (x > 0 if mode == "shortmedium" and c in interaction else x).alias(f"{c}_{into}")

    return table.select(
        *_KEY, "activation", *kept,
        *[merged(c) for c in numeric],
        f"communities_{other}",
        F.sort_array(F.array_union("communities_medium", f"communities_{into}")).alias(f"communities_{into}"),
    )


def pipe_design_matrix(table: DataFrame, participation: DataFrame, scores: DataFrame,
                       attributes: Sequence[str], norm_news: Sequence[str], control: Sequence[str],
                       meetings: tuple[str, str]) -> DataFrame:
    """Standardised model input per author week.

    Activity of both periods is z-scored plain and as log(x+1), news plain; participation
    (long form, long period) is scored by the communities' attributes and by their
    log-popularity; the two meeting features become one boolean.
    """
    act = [f"{c}_{p}" for p in ("long", "short") for c in control]
    news = [f"{c}_{p}" for p in ("long", "short") for c in norm_news]
    logs = {f"log_{c}": log1p_transform(F.col(c)) for c in act}
    rows = participation.join(table.select(*_KEY), _KEY, "left_semi")
    scored = participation_score(rows, scores, attributes)
    pop = participation_score(
        rows, community_popularity(rows).select("subreddit", "log_popularity"), ["log_popularity"]
    )
    base = table.select(
        *_KEY, "activation", *act, *news, *[e.alias(n) for n, e in logs.items()],
        bool_union(F.col(meetings[0]) > 0, F.col(meetings[1]) > 0).alias("interaction_short"),
    )
    joined = left_feature_merge(base, [scored, pop], _KEY, 0.0)
    return zscore(joined, [*act, *logs, *news], ddof=0)
