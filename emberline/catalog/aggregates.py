"""Queries for aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.catalog.plans import long_comments, long_posts
from emberline.catalog.registry import query, r, rounded, sunday, wk, z0
from emberline.functions.time import month_label, week_idx
from emberline.operators import aggregates as agg
from emberline.operators import joins as jn
from emberline.operators import windows as win
from emberline.plans.news_exposure import news_weeks
from emberline.schemas import ATTRIBUTES
from emberline.sources import views as v
from emberline.sources.lookups import names_frame

_FLAGS = {"strike": v.NEWS_STRIKE, "substrings": v.NEWS_FLAGS, "separators": "[ ;,]"}
_KEY = ["author", "week_idx"]


@query("first_activation", """
    SELECT author, subreddit, day FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY created_utc, id) AS rn
      FROM posts WHERE subreddit IN ('c3', 'c7')) WHERE rn = 1""")
def _(spark, d):
    p = v.posts_short(spark, d)
    return agg.first_activation(p.filter(F.col("subreddit").isin(v.SHORT_STRONG)))


_FIRST_KIND = """
    (SELECT author, kind, strftime(day, '%Y-%m') AS month FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY day, id) AS rn
      FROM (SELECT author, kind, day, id FROM comments UNION ALL SELECT author, kind, day, id FROM subs)) WHERE rn = 1)"""


@query("activation_month_count", f"""
    SELECT m.month, k.kind, count(f.author) AS n FROM (SELECT DISTINCT month FROM {_FIRST_KIND}) m
    CROSS JOIN (VALUES ('RC'), ('RS')) k(kind) LEFT JOIN {_FIRST_KIND} f ON f.month = m.month AND f.kind = k.kind GROUP BY 1, 2""")
def _(spark, d):
    cols = ["author", "kind", "day", "id"]
    posts = v.comments_long(spark, d).select(*cols).unionByName(v.submissions_long(spark, d).select(*cols))
    return agg.activation_month_count(agg.first_activation(posts, "day", ["day", "kind"]))


@query("grid_spine_counts", """
    SELECT m.link_id, k.body, count(c.id) AS n FROM (SELECT DISTINCT link_id FROM comments) m
    CROSS JOIN (VALUES ('ECONOMY'), ('PROMO'), ('NONE')) k(body)
    LEFT JOIN comments c ON c.link_id = m.link_id AND c.body = k.body GROUP BY 1, 2""")
def _(spark, d):
    return agg.grid_spine_counts(v.comments_long(spark, d), ["link_id"], "body", ["ECONOMY", "PROMO", "NONE"])


@query("dedup_first", "SELECT id, author, subreddit, body, day, link_id, parent_id, score, kind FROM comments1")
def _(spark, d):
    return long_comments(spark, d)


@query("dedup_first_nulls", """
    SELECT id, min(day) AS day, arg_min(author, (day, author, parent_id)) AS author,
      arg_min(link_id, (day, author, parent_id)) FILTER (link_id <> 't3_1') AS link_id,
      arg_min(parent_id, (day, author, parent_id)) AS parent_id FROM comments GROUP BY id""")
def _(spark, d):
    c = v.comments_long(spark, d).select(
        "id", "day", "author", "parent_id", F.when(F.col("link_id") != "t3_1", F.col("link_id")).alias("link_id"))
    return agg.dedup_first(c, "id", ["day", "author", "parent_id"], nullable=["link_id"])


@query("dedup_author_merge", """
    SELECT author, min(date) AS date_strong, min(date) AS date_weak, arg_min(subreddit_class, (date, subreddit_class)) AS subreddit_class
    FROM class_act GROUP BY author""")
def _(spark, d):
    a = v.class_activations_long(spark, d).select(
        "author", F.col("date").alias("date_strong"), F.col("date").alias("date_weak"), "subreddit_class")
    return agg.dedup_author_merge(a)


@query("weekly_counts", "SELECT author, week_idx, n_comments_author_week, n_submissions_author_week FROM activity")
def _(spark, d):
    return agg.weekly_counts(long_posts(spark, d))


@query("weekly_active_days", "SELECT author, week_idx, n_active_days_author_week FROM activity WHERE n_comments_author_week > 0")
def _(spark, d):
    return agg.weekly_active_days(long_posts(spark, d))


@query("weekly_avg_per_thread", f"""
    SELECT author, week_idx, {r('avg(n)')} AS avg_comments_per_thread FROM (
      SELECT author, week_idx, parent_id, count(*) AS n FROM lposts WHERE kind = 'RC' AND parent_id IS NOT NULL GROUP BY 1, 2, 3)
    GROUP BY 1, 2""")
def _(spark, d):
    return rounded(agg.weekly_avg_per_thread(long_posts(spark, d)))


@query("weekly_distinct_communities", "SELECT author, week_idx, n_different_subreddits FROM activity")
def _(spark, d):
    return agg.weekly_distinct_communities(long_posts(spark, d))


@query("activity_rollup", """
    SELECT author, week_idx, CAST(sum(days) AS BIGINT) AS n_active_days_author_week FROM (
      SELECT author, week_idx, date_trunc('month', day) AS m, count(DISTINCT day) AS days FROM lposts WHERE kind = 'RC' GROUP BY 1, 2, 3)
    GROUP BY 1, 2""")
def _(spark, d):
    c = long_posts(spark, d).filter(F.col("kind") == "RC")
    monthly = c.groupBy(*_KEY, month_label(F.col("day")).alias("month")).agg(
        F.count_distinct("day").alias("n_active_days_author_week"))
    return agg.activity_rollup(monthly, ["n_active_days_author_week"])


_FACTS = f"""WITH f AS (SELECT author, {wk('day')} AS week_idx, count(*) FILTER (kind = 'RC') AS a, count(DISTINCT subreddit) AS b
      FROM posts GROUP BY 1, 2)"""


def _short_facts(spark, d):
    return v.posts_short(spark, d).groupBy("author", week_idx(F.col("day")).alias("week_idx")).agg(
        F.count_if(F.col("kind") == "RC").alias("a"), F.count_distinct("subreddit").alias("b"))


@query("lag_mean", _FACTS + f"""
    SELECT author, week_idx, {r('avg(a)')} AS a_medium, {r('avg(b)')} AS b_medium FROM (SELECT DISTINCT s.author, s.week_idx, f.a, f.b
      FROM f s JOIN f ON f.author = s.author AND f.week_idx BETWEEN s.week_idx - 3 AND s.week_idx - 1) GROUP BY 1, 2""")
def _(spark, d):
    facts = _short_facts(spark, d)
    lagged = jn.lag_week_join(facts.select(*_KEY), facts, {"medium": (4, 1)})
    return rounded(agg.lag_mean(lagged, ["a", "b"], ["medium"]))


_COMMUNITIES = [f"c{i}" for i in range(20)] + ["c99"]


@query("participation_pivot", f"""
    WITH f AS (SELECT DISTINCT author, {wk('day')} AS week_idx, subreddit FROM posts), s AS (SELECT DISTINCT author, week_idx FROM f)
    SELECT s.author, s.week_idx, {", ".join(f"bool_or(f.subreddit = '{c}') AS r{c}_medium" for c in _COMMUNITIES)}
    FROM s JOIN f ON f.author = s.author AND f.week_idx BETWEEN s.week_idx - 3 AND s.week_idx - 2 GROUP BY 1, 2""")
def _(spark, d):
    facts = v.posts_short(spark, d).select(
        "author", week_idx(F.col("day")).alias("week_idx"), "subreddit").distinct()
    lagged = jn.lag_week_join(facts.select(*_KEY).distinct(), facts, {"medium": (4, 2)})
    return agg.participation_pivot(agg.participation_long(lagged), _COMMUNITIES, ["medium"])


_BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query("author_community_matrix", "SELECT author, " + ", ".join(
    f"count(*) FILTER (subreddit = '{b}') AS \"{b}\"" for b in _BRANDS) + " FROM comments GROUP BY author")
def _(spark, d):
    return agg.author_community_matrix(v.comments_long(spark, d), _BRANDS)


@query("participation_score", "SELECT author, week_idx, " + ", ".join(f"{r(f'sum({a})')} AS {a}" for a in ATTRIBUTES) + f"""
    FROM (SELECT DISTINCT author, {wk('day')} AS week_idx, subreddit FROM comments) c JOIN scores ON subreddit = community GROUP BY 1, 2""")
def _(spark, d):
    part = v.comments_long(spark, d).select("author", week_idx(F.col("day")).alias("week_idx"), "subreddit").distinct()
    scores = win.zscore(v.community_scores_raw(spark, d), ATTRIBUTES)
    return rounded(agg.participation_score(part, scores, ATTRIBUTES))


@query("community_popularity", f"""
    SELECT subreddit, n, {r(z0('n'))} AS popularity, {r(z0('ln(n + 0.1)'))} AS log_popularity
    FROM (SELECT subreddit, count(*) AS n FROM (SELECT DISTINCT author, subreddit FROM comments) GROUP BY 1)""")
def _(spark, d):
    return rounded(agg.community_popularity(v.comments_long(spark, d).select("author", "subreddit").distinct()))


def _located(spark, d):
    return jn.geo_join(v.comments_long(spark, d).select("author", "subreddit"),
                       v.community_region(spark, d), v.authors_long(spark, d))


@query("geo_counts", "SELECT author, country, admin1code, n FROM geocounts")
def _(spark, d):
    return agg.geo_counts(_located(spark, d))


@query("single_region_authors", "SELECT author, country, admin1code, n FROM oneregion")
def _(spark, d):
    return agg.single_region_authors(agg.geo_counts(_located(spark, d)))


@query("single_country_authors", """
    SELECT author, min(country) AS country, CAST(sum(n) AS BIGINT) AS n FROM geocounts GROUP BY author HAVING count(DISTINCT country) = 1""")
def _(spark, d):
    return agg.single_region_authors(agg.geo_counts(_located(spark, d)), ["country"])


@query("news_region_day", "SELECT day, country, admin1code, count(*) AS n FROM nregions GROUP BY 1, 2, 3")
def _(spark, d):
    return agg.news_region_day(v.news(spark, d))


@query("news_class_day", f"""
    SELECT c.*, {r('n * 1.0 / total')} AS norm_count FROM (SELECT day, country, admin1code, is_strike, is_climate_action, is_climate,
        is_natural_disaster, count(*) AS n FROM nregions GROUP BY ALL) c
    JOIN (SELECT day, count(*) AS total FROM news GROUP BY day) t ON c.day = t.day""")
def _(spark, d):
    news = v.news(spark, d)
    totals = news.groupBy("day").agg(F.count("*").alias("n"))
    return rounded(agg.news_class_day(news, totals, **_FLAGS))


@query("news_class_week", "SELECT country, admin1code, week_idx, tot_climate, tot_climate_action, tot_natural_disaster, tot_news, "
       + ", ".join(f"{r(c)} AS {c}" for c in ("norm_climate", "norm_climate_action", "norm_natural_disaster")) + " FROM nweek")
def _(spark, d):
    return rounded(news_weeks(v.news(spark, d), **_FLAGS))


@query("weekly_time_series", f"""
    WITH w AS (SELECT {sunday('date')} AS week, count(*) AS n FROM weak GROUP BY 1)
    SELECT s.week, coalesce(w.n, 0) AS n FROM (SELECT CAST(unnest(generate_series((SELECT min(week) FROM w), (SELECT max(week) FROM w),
      INTERVAL 7 DAY)) AS DATE) AS week) s LEFT JOIN w ON s.week = w.week""")
def _(spark, d):
    return agg.weekly_time_series(v.weak_long(spark, d), "date")


@query("weekly_time_series_by", f"SELECT {sunday('date')} AS week, subreddit_class, count(*) AS n FROM class_act GROUP BY 1, 2")
def _(spark, d):
    return agg.weekly_time_series(v.class_activations_long(spark, d), "date", "subreddit_class")


@query("value_counts", f"""
    SELECT subreddit, count(*) AS n, {r('count(*) * 1.0 / sum(count(*)) OVER ()')} AS share FROM lposts GROUP BY 1""")
def _(spark, d):
    return rounded(agg.value_counts(long_posts(spark, d), ["subreddit"], share=True))


@query("theme_token_topk", """
    SELECT substr(t, 2) AS token, count(*) AS n FROM (SELECT unnest(string_split_regex(V2Themes, '[ ;,]')) AS t FROM news)
    WHERE contains(t, 'eau') GROUP BY 1 ORDER BY n DESC, token LIMIT 100""")
def _(spark, d):
    return agg.theme_token_topk(v.news(spark, d), "eau", 100, "[ ;,]", cut=1)


@query("weekly_median", f"""
    SELECT {wk('day')} AS week_idx, {r('median(score)')} AS score, {r('median(length(body))')} AS len FROM comments GROUP BY 1""")
def _(spark, d):
    c = v.comments_long(spark, d).select(
        week_idx(F.col("day")).alias("week_idx"), "score", F.length("body").alias("len"))
    return rounded(agg.weekly_median(c, ["score", "len"]))


_DIMS = [f"e{i}" for i in range(1, 65)]


def flat_vectors(spark, d, dims: int = 64):
    """The dimensions of the vectors as columns e1, e2, ..."""
    return v.labelled_vectors(spark, d).select(
        "vec_id", "activation", "label", *[F.col("embedding")[i].alias(f"e{i + 1}") for i in range(dims)])


@query("group_mean_ratio", " UNION ALL ".join(
    f"SELECT 'e{i}' AS feature, {r(f'avg(embedding[{i}]) FILTER (activation) / avg(embedding[{i}]) FILTER (NOT activation)')} AS ratio FROM vectors"
    for i in range(1, 65)))
def _(spark, d):
    return rounded(agg.group_mean_ratio(flat_vectors(spark, d), "activation", _DIMS))


@query("corr_with_label", " UNION ALL ".join(
    f"SELECT 'e{i}' AS feature, {r(f'corr(embedding[{i}], CAST(activation AS INTEGER))')} AS corr FROM vectors" for i in range(1, 65)))
def _(spark, d):
    return rounded(agg.corr_with_label(flat_vectors(spark, d), "activation", _DIMS))


@query("corr_matrix", f"""
    WITH e AS (SELECT vec_id, i, embedding[i] AS x FROM vectors, range(1, 65) t(i))
    SELECT 'e' || a.i AS a, 'e' || b.i AS b, {r('corr(a.x, b.x)')} AS corr FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i""")
def _(spark, d):
    return rounded(agg.corr_matrix(flat_vectors(spark, d), _DIMS))


@query("quality_ratios", f"""
    SELECT {r("count(DISTINCT subreddit) FILTER (subreddit IN ('Brand#8', 'Brand#9', 'Brand#1', 'Brand#4')) * 1.0 / count(DISTINCT subreddit)")} AS share_subreddit,
      {r("count(DISTINCT author) FILTER (subreddit IN ('Brand#8', 'Brand#9', 'Brand#1', 'Brand#4')) * 1.0 / count(DISTINCT author)")} AS share_author
    FROM comments""")
def _(spark, d):
    bad = names_frame(spark, ["Brand#8", "Brand#9"], "subreddit")
    good = names_frame(spark, ["Brand#1", "Brand#4"], "subreddit")
    flags = agg.match_flags(v.comments_long(spark, d).select("author", "subreddit"), "subreddit", bad, good)
    return rounded(agg.quality_ratios(flags, ["mismatch", "good_match"], ["subreddit", "author"]))


@query("hist_1d", "SELECT activation, CAST(floor(embedding[1] / 0.1) AS BIGINT) AS bin, count(*) AS n FROM vectors GROUP BY 1, 2")
def _(spark, d):
    return agg.hist_1d(flat_vectors(spark, d), "e1", 0.1, ["activation"])


@query("hist_1d_days", """
    SELECT CAST(floor(date_diff('day', w.date, s.date) / 30.0) AS BIGINT) AS bin, count(*) AS n
    FROM weak w JOIN strong s ON w.author = s.author WHERE s.date > w.date GROUP BY 1""")
def _(spark, d):
    return agg.hist_1d(v.pairs_long(spark, d).filter("weak_then_strong"), "diff_days", 30)


@query("hist_2d", """
    WITH s AS (SELECT min(accuracy) AS x0, max(accuracy) AS x1, min(key) AS y0, max(key) AS y1 FROM runs)
    SELECT CAST(least(floor((accuracy - x0) / (x1 - x0) * 20), 19) AS BIGINT) AS x_bin,
      CAST(least(floor((key - y0) / CAST(y1 - y0 AS DOUBLE) * 20), 19) AS BIGINT) AS y_bin, count(*) AS n FROM runs, s GROUP BY 1, 2""")
def _(spark, d):
    return agg.hist_2d(v.runs(spark, d), "accuracy", "key")


@query("box_stats", f"""
    SELECT subreddit, min(score) AS lo, {r('quantile_cont(score, 0.25)')} AS q1, {r('median(score)')} AS median,
      {r('quantile_cont(score, 0.75)')} AS q3, max(score) AS hi FROM comments GROUP BY 1""")
def _(spark, d):
    return rounded(agg.box_stats(v.comments_long(spark, d), "score", "subreddit"))


@query("mean_series_by_label", f"""
    SELECT day, kind, {r('avg(score)')} AS mean_score FROM posts GROUP BY 1, 2""")
def _(spark, d):
    return rounded(agg.mean_series_by_label(v.posts_short(spark, d), "day", "score", "kind"))


@query("group_proportions", f"""
    SELECT subreddit, {r("count(*) FILTER (kind = 'RC') * 1.0 / count(*)")} AS "kind_RC", {r("count(*) FILTER (kind = 'RS') * 1.0 / count(*)")} AS "kind_RS"
    FROM posts GROUP BY 1""")
def _(spark, d):
    return rounded(agg.group_proportions(v.posts_short(spark, d), "subreddit", "kind", ["RC", "RS"]))


_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("matrix_heatmap", "SELECT lr, " + ", ".join(
    r(f"avg(accuracy) FILTER (var_opinions = '{p}')", 4) + f' AS "var_opinions_{p}"' for p in _PRIO) + " FROM runs GROUP BY lr")
def _(spark, d):
    return rounded(agg.matrix_heatmap(v.runs(spark, d), "lr", "var_opinions", _PRIO, "accuracy"), 4)


@query("matrix_heatmap_share", "SELECT lr, " + ", ".join(
    r(f"avg(CASE WHEN accuracy > 250000 THEN 1.0 ELSE 0 END) FILTER (var_opinions = '{p}')") + f' AS "var_opinions_{p}"' for p in _PRIO)
    + " FROM runs GROUP BY lr")
def _(spark, d):
    gain = v.runs(spark, d).withColumn("gain", F.col("accuracy") - 250000)
    return rounded(agg.matrix_heatmap(gain, "lr", "var_opinions", _PRIO, "gain", share_positive=True))


@query("thread_replies", """
    SELECT link_id, count(*) AS turns, count(parent_id) AS replies FROM (SELECT 't3_' || conv_id AS link_id,
      CASE WHEN turn > 0 THEN 't1_' || conv_id || '-' || (turn - 1) END AS parent_id FROM conversations) GROUP BY 1""")
def _(spark, d):
    return v.thread_turns(spark, d).groupBy("link_id").agg(
        F.count("*").alias("turns"), F.count("parent_id").alias("replies"))
