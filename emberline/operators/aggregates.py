"""Grouped summaries of posts, news and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.frames import unpivot_features
from emberline.functions.numeric import pearson
from emberline.functions.text import extract_regions, theme_flags
from emberline.functions.time import month_label, sunday_on_or_after
from emberline.operators.matrices import correlations
from emberline.operators.ordering import exact_quantiles, quantiles_wide
from emberline.operators.windows import zscore
from emberline.schemas import NEWS_CLASSES

_KEY = ["author", "week_idx"]


# ---- activations -------------------------------------------------------------------------

def first_activation(posts: DataFrame, time: str = "created_utc",
                     carry: Sequence[str] = ("subreddit", "day")) -> DataFrame:
    """Earliest post per author; the id breaks ties.

    A minimum over structs combines before the shuffle, so a prolific author sends one row
    per task.
    """
    more = [c for c in carry if c != time]
    best = posts.groupBy("author").agg(F.min(F.struct(time, "id", *more)).alias("b"))
    return best.select("author", *[F.col(f"b.{c}").alias(c) for c in carry])


def activation_month_count(first: DataFrame, kinds: Sequence[str] = ("RC", "RS"),
                           date: str = "day") -> DataFrame:
    """Authors per month and kind of first activation, zeros included."""
    return grid_spine_counts(
        first.withColumn("month", month_label(F.col(date))), ["month"], "kind", kinds
    )


def grid_spine_counts(df: DataFrame, index: Sequence[str], column: str,
                      values: Sequence[str]) -> DataFrame:
    """Counts of a stated category for every index value, zero where the pair is absent.

    One conditional count per category and a reshape; no join builds the grid.
    """
    wide = df.groupBy(*index).agg(
        *[F.count_if(F.col(column) == v).alias(v) for v in values]
    )
    return wide.unpivot(list(index), list(values), column, "n")


def dedup_first(df: DataFrame, key: str, order: Sequence[str],
                nullable: Sequence[str] | None = None, within: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first row by ``order``, and per column the first value not null.

    Columns named in ``nullable`` (default all but key and order) may have nulls in the
    first row and are filled from later ones.  Rows of a key agree in the columns ``within``,
    which are dropped: rows already partitioned by them are not shuffled again.
    """
    kept = [c for c in df.columns if c not in within]
    rest = [c for c in kept if c != key and c not in order]
    holes = [c for c in kept if c in nullable] if nullable is not None else rest
    solid = [c for c in rest if c not in holes]
    place = [F.col(c) for c in order]
    first = [F.min(F.struct(*place, *solid)).alias("_first")]
    filled = [
        F.min(F.when(F.col(c).isNotNull(), F.struct(*place, F.col(c).alias("_v")))).alias(f"_{c}")
        for c in holes if c not in order
    ]
    grouped = df.groupBy(*within, key).agg(*first, *filled)
    return grouped.select(*[
        F.col(c) if c == key
        else F.col(f"_{c}._v").alias(c) if c in holes and c not in order
        else F.col(f"_first.{c}").alias(c)
        for c in kept
    ])


def dedup_author_merge(authors: DataFrame) -> DataFrame:
    """One row per author, with the earliest strong date."""
    return dedup_first(authors, "author", ["date_strong", "date_weak"], nullable=[])


# ---- weekly activity -----------------------------------------------------------------------

def _weekly_measures() -> dict[str, Column]:
    comment = F.col("kind") == "RC"
    # a week has seven days, so distinct days are bits of one integer, not a distinct count
    days = F.bit_or(F.when(comment, F.expr("shiftleft(1, weekday(day))")))
    threads = F.size(F.collect_set(F.when(comment, F.col("parent_id"))))
    replies = F.count(F.when(comment, F.col("parent_id")))
    return {
        "n_comments_author_week": F.count_if(comment),
        "n_submissions_author_week": F.count_if(F.col("kind") == "RS"),
        "n_active_days_author_week": F.coalesce(F.bit_count(days), F.lit(0)).cast("long"),
        "avg_comments_per_thread": F.when(threads > 0, replies / threads),
        "n_different_subreddits": F.size(F.collect_set("subreddit")).cast("long"),
    }


def weekly_activity(posts: DataFrame, measures: Sequence[str] | None = None) -> DataFrame:
    """Activity of an author in a week, all measures in one row.

    The threads and communities of an author in one week are two sets, so one grouping gives all
    measures.  If a set is among them, which combines nothing before a shuffle, the posts are
    partitioned by author and week first; the result stays so for a join on them.
    """
    table = _weekly_measures()
    names = list(measures or table)
    if {"avg_comments_per_thread", "n_different_subreddits"} & set(names):
        posts = posts.repartition(*_KEY)
    return posts.groupBy(*_KEY).agg(*[table[m].alias(m) for m in names])


def weekly_counts(posts: DataFrame) -> DataFrame:
    return weekly_activity(posts, ["n_comments_author_week", "n_submissions_author_week"])


def weekly_active_days(posts: DataFrame) -> DataFrame:
    return weekly_activity(posts.filter(F.col("kind") == "RC"), ["n_active_days_author_week"])


def weekly_avg_per_thread(posts: DataFrame) -> DataFrame:
    replies = posts.filter((F.col("kind") == "RC") & F.col("parent_id").isNotNull())
    return weekly_activity(replies, ["avg_comments_per_thread"])


def weekly_distinct_communities(posts: DataFrame, approximate: bool = False) -> DataFrame:
    if approximate:
        return posts.groupBy(*_KEY).agg(
            F.approx_count_distinct("subreddit").alias("n_different_subreddits")
        )
    return weekly_activity(posts, ["n_different_subreddits"])


def activity_rollup(monthly: DataFrame, features: Sequence[str]) -> DataFrame:
    """Sum per (author, week) of rows a week owes to two months."""
    return monthly.groupBy(*_KEY).agg(*[F.sum(c).alias(c) for c in features])


def lag_mean(lagged: DataFrame, features: Sequence[str], periods: Sequence[str], dedup: bool = True) -> DataFrame:
    """Mean over the lagged weeks that exist, per period; equal weeks count once when ``dedup``.

    One exchange on (author, week) serves the distinct and the means; a group holds at most
    one row per lag.
    """
    rows = lagged.select(*_KEY, "period", *features).repartition(*_KEY)
    if dedup:
        rows = rows.distinct()
    return rows.groupBy(*_KEY).agg(*[
        F.avg(F.when(F.col("period") == p, F.col(c))).alias(f"{c}_{p}") for p in periods for c in features
    ])


def participation_long(lagged: DataFrame) -> DataFrame:
    """Distinct (author, week, period, community): the sparse form."""
    return lagged.select(*_KEY, "period", "subreddit").distinct()


def participation_pivot(long: DataFrame, vocab: Sequence[str], periods: Sequence[str]) -> DataFrame:
    """Boolean column ``r<community>_<period>`` per vocabulary entry; none of the rest is kept."""
    names = [f"r{c}_{p}" for p in periods for c in vocab]
    named = long.filter(F.col("subreddit").isin(list(vocab))).select(
        *_KEY, F.concat(F.lit("r"), "subreddit", F.lit("_"), "period").alias("_name")
    )
    wide = named.groupBy(*_KEY).pivot("_name", names).agg(F.max(F.lit(True)))
    return wide.select(*_KEY, *[F.coalesce(F.col(f"`{c}`"), F.lit(False)).alias(c) for c in names])


def author_community_counts(posts: DataFrame, vocab: Sequence[str]) -> DataFrame:
    return (
        posts.filter(F.col("subreddit").isin(list(vocab)))
        .groupBy("author", "subreddit")
        .agg(F.count("*").alias("n"))
    )


def author_community_matrix(posts: DataFrame, vocab: Sequence[str]) -> DataFrame:
    """Counts per author and community, one column per vocabulary entry in its order."""
    long = author_community_counts(posts, vocab)
    wide = long.groupBy("author").pivot("subreddit", list(vocab)).agg(F.max("n"))
    return wide.fillna(0)


# ---- scores --------------------------------------------------------------------------------

def sociodemo_score(counts: DataFrame, scores: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Average of community scores, weighted by the author's posts there."""
    joined = counts.join(scores.withColumnRenamed("community", "subreddit"), "subreddit")
    return joined.groupBy("author").agg(
        *[(F.sum(F.col("n") * F.col(a)) / F.sum("n")).alias(a) for a in attributes]
    )


def participation_score(long: DataFrame, scores: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Sum of the scores of the communities taken part in."""
    joined = long.join(scores.withColumnRenamed("community", "subreddit"), "subreddit")
    return joined.groupBy(*_KEY).agg(*[F.sum(a).alias(a) for a in attributes])


def community_popularity(long: DataFrame) -> DataFrame:
    """Rows per community, and z-scores of the count and of log(count + 0.1)."""
    counts = long.groupBy("subreddit").agg(F.count("*").alias("n"))
    counts = counts.withColumn("log_n", F.log(F.col("n") + F.lit(0.1)))
    return zscore(
        counts.withColumns({"popularity": F.col("n"), "log_popularity": F.col("log_n")}),
        ["popularity", "log_popularity"],
    ).drop("log_n")


# ---- places --------------------------------------------------------------------------------

def geo_counts(located: DataFrame) -> DataFrame:
    return located.groupBy("author", "country", "admin1code").agg(F.count("*").alias("n"))


def single_region_authors(counts: DataFrame, level: Sequence[str] = ("country", "admin1code")) -> DataFrame:
    """Authors whose located posts fall in one region (or, by ``level``, in one country)."""
    regions = counts.groupBy("author", *level).agg(F.sum("n").alias("n"))
    one = regions.groupBy("author").agg(
        F.count("*").alias("_k"),
        *[F.min(c).alias(c) for c in level],
        F.sum("n").alias("n"),
    )
    return one.filter(F.col("_k") == 1).drop("_k")


# ---- news ----------------------------------------------------------------------------------

def explode_regions(news: DataFrame, locations: str = "V2Locations") -> DataFrame:
    """One row per record and distinct region; records without a region vanish."""
    rows = news.withColumn("_r", F.explode(extract_regions(F.col(locations))))
    return rows.select(*[c for c in news.columns if c != locations], "_r.country", "_r.admin1code")


def news_region_day(news: DataFrame, day: str = "day") -> DataFrame:
    return explode_regions(news.select(day, "V2Locations")).groupBy(day, "country", "admin1code").agg(
        F.count("*").alias("n")
    )


def news_class_day(news: DataFrame, totals: DataFrame, day: str = "day", **flags) -> DataFrame:
    """Count per region, day and flag combination, and its share of all news that day.

    Flags are computed before the explode, so a long theme text is read once and dropped.
    """
    marks = theme_flags(F.col("V2Themes"), **flags)
    rows = explode_regions(news.select(day, "V2Locations", *[c.alias(n) for n, c in marks.items()]))
    counts = rows.groupBy(day, "country", "admin1code", *marks).agg(F.count("*").alias("n"))
    return counts.join(totals.select(day, F.col("n").alias("_all")), day).select(
        *counts.columns, F.try_divide("n", "_all").alias("norm_count")
    )


def news_class_week(class_day: DataFrame, region_day: DataFrame, week: Column,
                    classes: Sequence[str] = NEWS_CLASSES) -> DataFrame:
    """Weekly totals per region and class, all news, and their ratio.

    A region-week appears only if every class has news there, as inner joins of the
    classes would leave it.
    """
    per_class = (
        class_day.withColumn("week_idx", week)
        .groupBy("country", "admin1code", "week_idx")
        .agg(*[F.sum(F.when(F.col(f"is_{c}"), F.col("n"))).alias(f"tot_{c}") for c in classes])
        .na.drop()
    )
    every = (
        region_day.withColumn("week_idx", week)
        .groupBy("country", "admin1code", "week_idx")
        .agg(F.sum("n").alias("tot_news"))
    )
    joined = per_class.join(every, ["country", "admin1code", "week_idx"])
    return joined.withColumns({f"norm_{c}": F.col(f"tot_{c}") / F.col("tot_news") for c in classes})


def theme_token_topk(news: DataFrame, word: str, k: int, separators: str = "[;,]",
                     cut: int = 0, column: str = "V2Themes") -> DataFrame:
    """Most frequent theme tokens that contain a word, optionally without a prefix."""
    tokens = F.filter(F.split(F.col(column), separators), lambda t: t.contains(word))
    rows = news.select(F.explode(tokens).alias("token"))
    if cut:
        rows = rows.withColumn("token", F.substring("token", cut + 1, 2**31 - 1))
    counts = rows.groupBy("token").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "token").limit(k)


# ---- series and tables -----------------------------------------------------------------------

def weekly_time_series(df: DataFrame, date: str, by: str | None = None) -> DataFrame:
    """Rows per Sunday-ending week; without ``by`` weeks in between count zero."""
    keys = ["week"] + ([by] if by else [])
    counts = df.withColumn("week", sunday_on_or_after(F.col(date))).groupBy(*keys).agg(
        F.count("*").alias("n")
    )
    if by:
        return counts
    bounds = counts.agg(F.struct(F.min("week").alias("lo"), F.max("week").alias("hi")).alias("b"))
    weeks = F.sequence("b.lo", "b.hi", F.expr("interval 7 days"))
    return bounds.select(F.explode(weeks).alias("week")).join(counts, "week", "left").select(
        "week", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def value_counts(df: DataFrame, columns: Sequence[str], share: bool = False) -> DataFrame:
    """Frequencies, most frequent first, with their share of all rows if wanted."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    if share:
        total = counts.agg(F.sum("n")).scalar()
        counts = counts.withColumn("share", F.col("n") / total)
    return counts.orderBy(F.desc("n"), *columns)


def weekly_median(df: DataFrame, columns: Sequence[str], week: str = "week_idx",
                  weight: str | None = None) -> DataFrame:
    """Median of each column per week; rows that stand for several count ``weight`` times."""
    return quantiles_wide(df, columns, 0.5, [week], weight)


def group_mean_ratio(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Mean of each feature among positives over its mean among negatives, largest first."""
    pos, neg = F.col(label), ~F.col(label)
    sums = df.agg(
        *[F.avg(F.when(pos, F.col(c))).alias(f"p_{c}") for c in columns],
        *[F.avg(F.when(neg, F.col(c))).alias(f"n_{c}") for c in columns],
    )
    ratios = sums.select(*[F.try_divide(f"p_{c}", f"n_{c}").alias(c) for c in columns])
    return ratios.unpivot([], list(columns), "feature", "ratio").na.drop().orderBy(F.desc("ratio"))


def corr_with_label(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*[pearson(F.col(c), F.col(label)).alias(c) for c in columns])
    return one.unpivot([], list(columns), "feature", "corr").orderBy(F.desc("corr"))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, long form: products of tiles of columns."""
    names = F.array(*[F.lit(c) for c in columns])
    return correlations(df, columns).select(
        F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "corr")


def quality_ratios(df: DataFrame, flags: Sequence[str], entities: Sequence[str]) -> DataFrame:
    """Share of distinct entities that have any flag."""
    labelled = F.coalesce(*[F.when(F.col(f), True) for f in flags], F.lit(False))
    return df.agg(*[
        (F.count_distinct(F.when(labelled, F.col(e))) / F.count_distinct(e)).alias(f"share_{e}")
        for e in entities
    ])


def mean_series_by_label(df: DataFrame, date: str, column: str, label: str) -> DataFrame:
    return df.groupBy(date, label).agg(F.avg(column).alias(f"mean_{column}"))


def group_proportions(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Contingency table whose rows sum to one."""
    return df.groupBy(row).agg(*[
        (F.count_if(F.col(column) == F.lit(v)) / F.count(column)).alias(f"{column}_{v}") for v in values
    ])


def matrix_heatmap(df: DataFrame, row: str, column: str, values: Sequence[str], metric: str,
                   share_positive: bool = False) -> DataFrame:
    """Mean of a metric (or share above zero) by two settings, one column per value."""
    x = (F.col(metric) > 0).cast("double") if share_positive else F.col(metric)
    return df.groupBy(row).agg(
        *[F.avg(F.when(F.col(column) == v, x)).alias(f"{column}_{v}") for v in values]
    )


def hist_1d(df: DataFrame, column: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts in bins of one width; ``bin`` is the left edge divided by the width."""
    bins = F.floor(F.col(column) / F.lit(width)).cast("long").alias("bin")
    return df.filter(F.col(column).isNotNull()).groupBy(*by, bins).agg(F.count("*").alias("n"))


def hist_2d(df: DataFrame, x: str, y: str, nx: int = 20, ny: int = 20) -> DataFrame:
    """Joint counts on a grid of equal cells between the extremes; the last cell is closed."""
    ends = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()

    def cell(c: str, lo, hi, n: int) -> Column:
        if lo is None or lo == hi:
            return F.lit(0).cast("long")
        place = F.floor((F.col(c) - F.lit(lo)) / F.lit(hi - lo) * n)
        return F.least(place, F.lit(n - 1)).cast("long")

    return df.select(x, y).na.drop().groupBy(
        cell(x, ends[0], ends[1], nx).alias("x_bin"), cell(y, ends[2], ends[3], ny).alias("y_bin")
    ).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    """Extremes and quartiles per group."""
    probs = {"lo": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "hi": 1.0}
    return exact_quantiles(df, [column], probs, [by]).drop("feature")


def summary_by(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and sample deviation, one row per group and column."""
    long = unpivot_features(df, list(by), columns, "measure")
    return long.groupBy(*by, "measure").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))




def match_flags(df: DataFrame, column: str, bad: DataFrame, good: DataFrame) -> DataFrame:
    """Two booleans: value on a list of mismatches, value on a list of good matches."""
    out = df
    for name, names in (("mismatch", bad), ("good_match", good)):
        marked = names.select(F.col(names.columns[0]).alias(column)).distinct().withColumn(name, F.lit(True))
        out = out.join(marked, column, "left")
    return out.fillna(False, subset=["mismatch", "good_match"])
