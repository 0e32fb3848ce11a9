"""Queries for window functions, sampling and top-k reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.catalog.registry import query, r, rounded, sunday, u01, wk, z0
from emberline.functions.numeric import pearson
from emberline.functions.time import month_label
from emberline.operators import aggregates as agg
from emberline.operators import sampling as smp
from emberline.operators import topk
from emberline.operators import windows as win
from emberline.plans.news_exposure import news_weeks
from emberline.schemas import ATTRIBUTES, NORM_NEWS
from emberline.session import store
from emberline.sources import views as v

_FLAGS = {"strike": v.NEWS_STRIKE, "substrings": v.NEWS_FLAGS, "separators": "[ ;,]"}


def _rolled(width, lag, frame="ROWS"):
    over = f"OVER (PARTITION BY country, admin1code ORDER BY week_idx {frame} BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    cols = ", ".join(
        r(f"CASE WHEN count(*) {over} = {width} THEN avg({c}) {over} ELSE 0 END") + f" AS {c}" for c in NORM_NEWS)
    return f"SELECT country, admin1code, week_idx + {lag} AS week_idx, {cols} FROM nweek"


@query("rolling_mean_lagged", _rolled(4, 2))
def _(spark, d):
    return rounded(win.rolling_mean_lagged(news_weeks(v.news(spark, d), **_FLAGS), NORM_NEWS, 4, 2))


@query("rolling_mean_calendar", _rolled(4, 2, "RANGE"))
def _(spark, d):
    return rounded(win.rolling_mean_lagged(news_weeks(v.news(spark, d), **_FLAGS), NORM_NEWS, 4, 2, calendar=True))


@query("person_period_last", f"""
    SELECT author, {wk('day')} AS week_idx, max(day) AS day, max(subreddit) FILTER (rk = 1) AS subreddit
    FROM (SELECT *, rank() OVER (PARTITION BY author, {wk('day')} ORDER BY day DESC, subreddit DESC) AS rk FROM comments)
    GROUP BY 1, 2""")
def _(spark, d):
    from emberline.functions.time import week_idx

    c = v.comments_long(spark, d).select("author", week_idx(F.col("day")).alias("week_idx"), "day", "subreddit")
    return win.person_period_last(c, ["author", "week_idx"], "day")


@query("cumulative_weekly", f"""
    WITH w AS (SELECT {sunday('date')} AS week, count(*) AS n FROM strong GROUP BY 1),
    s AS (SELECT CAST(unnest(generate_series((SELECT min(week) FROM w), (SELECT max(week) FROM w), INTERVAL 7 DAY)) AS DATE) AS week)
    SELECT s.week, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (ORDER BY s.week) AS BIGINT) AS cumulative
    FROM s LEFT JOIN w ON s.week = w.week""")
def _(spark, d):
    return win.cumulative_weekly(agg.weekly_time_series(v.strong_long(spark, d), "date"))


@query("best_run_per_setting", """
    SELECT run_id, lr, var_opinions, accuracy, key FROM (SELECT *, row_number() OVER (
      PARTITION BY lr, var_opinions ORDER BY accuracy DESC, run_id) AS rn FROM runs) WHERE rn = 1""")
def _(spark, d):
    return win.best_run_per_setting(v.runs(spark, d), ["lr", "var_opinions"], "accuracy", "run_id")


@query("zscore", f"SELECT run_id, {r(z0('accuracy'))} AS accuracy, {r(z0('key'))} AS key FROM runs")
def _(spark, d):
    return rounded(win.zscore(v.runs(spark, d).select("run_id", "accuracy", F.col("key").cast("double").alias("key")),
                              ["accuracy", "key"]))


@query("zscore_sample", f"SELECT run_id, {r('(accuracy - avg(accuracy) OVER ()) / stddev_samp(accuracy) OVER ()')} AS accuracy, 0.0::DOUBLE AS flat FROM runs")
def _(spark, d):
    t = v.runs(spark, d).select("run_id", "accuracy", F.lit(3.0).alias("flat"))
    return rounded(win.zscore(t, ["accuracy", "flat"], ddof=1))


_SOCIO = """
    SELECT author, {} FROM (SELECT c.author, c.subreddit, count(*) AS n FROM comments c GROUP BY 1, 2) c
    JOIN scores s ON c.subreddit = s.community GROUP BY author""".format(
    ", ".join(f"sum(n * {a}) / sum(n) AS {a}" for a in ATTRIBUTES))


def author_scores(spark, d):
    scores = win.zscore(v.community_scores_raw(spark, d), ATTRIBUTES)
    counts = v.comments_long(spark, d).groupBy("author", "subreddit").agg(F.count("*").alias("n"))
    return agg.sociodemo_score(counts, scores, ATTRIBUTES)


@query("sociodemo_score", "WITH q AS (" + _SOCIO + ") SELECT author, " + ", ".join(f"{r(a)} AS {a}" for a in ATTRIBUTES) + " FROM q")
def _(spark, d):
    return rounded(author_scores(spark, d))


def _q(a, p):
    return f"(SELECT quantile_cont({a}, {p}) FROM q)"


QUARTILE_SQL = "WITH q AS (SELECT author, " + ", ".join(f"round({a}, 6) AS {a}" for a in ATTRIBUTES) + f" FROM ({_SOCIO}))" + """
    SELECT author, age <= {0} AS sociodemo_young, age >= {1} AS sociodemo_old, gender <= {2} AS sociodemo_male,
      gender >= {3} AS sociodemo_female, partisan <= {4} AS sociodemo_left, partisan >= {5} AS sociodemo_right,
      affluence <= {6} AS sociodemo_poor, affluence >= {7} AS sociodemo_rich FROM q""".format(
    *[_q(a, p) for a in ATTRIBUTES for p in (0.25, 0.75)])


@query("quartile_membership", QUARTILE_SQL)
def _(spark, d):
    return win.quartile_membership(rounded(author_scores(spark, d)), ATTRIBUTES)


@query("exact_sample_n", """
    SELECT kind, day, id FROM (SELECT kind, day, id, row_number() OVER (PARTITION BY kind, day ORDER BY md5('7|' || id), id) AS rn
      FROM posts) WHERE rn <= 20""")
def _(spark, d):
    return smp.exact_sample_n(v.posts_short(spark, d).select("kind", "day", "id"), ["kind", "day"], 20, 7, "id")


@query("control_sample", """
    WITH want AS (SELECT strftime(day, '%Y-%m') AS month, kind, count(*) // 100 AS n FROM posts GROUP BY 1, 2),
    p AS (SELECT strftime(day, '%Y-%m') AS month, kind, author, id FROM posts WHERE author NOT IN (SELECT author FROM bots)),
    drawn AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY month, kind ORDER BY md5('5-posts|' || id), id) AS rn FROM p)
      JOIN want USING (month, kind) WHERE rn <= 3 * n)
    SELECT month, kind, author FROM (SELECT month, kind, author, n,
        row_number() OVER (PARTITION BY month, kind ORDER BY md5('5-authors|' || author), author) AS rn
      FROM (SELECT DISTINCT month, kind, author, n FROM drawn)) WHERE rn <= n""")
def _(spark, d):
    p = v.posts_short(spark, d).withColumn("month", month_label(F.col("day")))
    wanted = p.groupBy("month", "kind").agg(F.floor(F.count("*") / 100).alias("n"))
    return smp.control_sample(p, v.short_bots(spark, d), wanted, 5)


@query("balance_classes", """
    SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5('9|' || id), id) AS rn,
        (SELECT min(n) FROM (SELECT count(*) AS n FROM posts GROUP BY subreddit IN ('c3', 'c7'))) AS m
      FROM (SELECT id, subreddit IN ('c3', 'c7') AS label FROM posts)) WHERE rn <= m""")
def _(spark, d):
    p = v.posts_short(spark, d).select("id", F.col("subreddit").isin(v.SHORT_STRONG).alias("label"))
    return smp.balance_classes(p, "label", 9, "id")


_SINCE = {"c3": "2024-01-05", "c7": "2024-01-12"}


@query("balance_classes_pooled", """
    WITH pool AS (SELECT 'c3@' || id AS key, true AS label FROM posts WHERE subreddit = 'c3' """ + " ".join(
    f"UNION ALL SELECT '{c}@' || id, false FROM posts WHERE subreddit <> '{c}' AND day >= DATE '{since}'"
    for c, since in _SINCE.items()) + """)
    SELECT key, label FROM (SELECT key, label, row_number() OVER (PARTITION BY label ORDER BY md5('9|' || key), key) AS rn,
        (SELECT min(n) FROM (SELECT count(*) AS n FROM pool GROUP BY label)) AS m FROM pool) WHERE rn <= m""")
def _(spark, d):
    p = v.posts_short(spark, d)
    tables = [p.select(F.concat(F.lit(f"{c}@"), "id").alias("key"), (F.col("subreddit") == c).alias("label"), "day")
              for c in _SINCE]
    pool = store(smp.pooled_negatives(tables, "label", "day", list(_SINCE.values())).drop("day"), "pool")
    return smp.balance_classes(pool, "label", 9, "key")


@query("train_test_split", f"SELECT id, {u01(chr(39) + '3|' + chr(39) + ' || id')} < 0.75 AS is_train FROM posts")
def _(spark, d):
    return smp.train_test_split(v.posts_short(spark, d).select("id"), "id", 3)


_U = u01("'4|' || replicate || '|' || vec_id")


@query("bootstrap_sample", f"""
    WITH t AS (SELECT vec_id, replicate, {_U} AS u FROM vectors, generate_series(0, 4) g(replicate))
    SELECT vec_id, CAST(replicate AS INTEGER) AS replicate, weight FROM (SELECT *, (SELECT count(*) FROM (
      SELECT k, sum(exp(-1) / factorial(CAST(k AS INTEGER))) OVER (ORDER BY k) AS cdf FROM generate_series(0, 15) s(k)) WHERE cdf <= u) AS weight
      FROM t) WHERE weight > 0""")
def _(spark, d):
    return smp.bootstrap_sample(v.labelled_vectors(spark, d).select("vec_id"), 5, 4, "vec_id")


@query("topk_communities", "SELECT subreddit, count(*) AS n FROM lposts GROUP BY 1 ORDER BY n DESC, subreddit LIMIT 10")
def _(spark, d):
    from emberline.catalog.plans import long_posts

    return topk.topk_communities(long_posts(spark, d), 10)


_COEF = """
    SELECT subreddit AS feature, avg(score) - 25.5 AS coef, nullif(corr(score, day_no), 'NaN') AS activism, nullif(corr(score, l), 'NaN') AS action
    FROM (SELECT *, date_diff('day', DATE '1995-01-01', day) AS day_no, length(body) AS l FROM comments) GROUP BY 1"""


def _coefs(spark, d):
    c = v.comments_long(spark, d).select(
        "subreddit", "score", F.datediff("day", F.lit("1995-01-01").cast("date")).cast("double").alias("day_no"),
        F.length("body").cast("double").alias("l"))
    return c.groupBy(F.col("subreddit").alias("feature")).agg(
        (F.avg("score") - 25.5).alias("coef"), 
        pearson(F.col("score"), F.col("day_no")).alias("activism"), pearson(F.col("score"), F.col("l")).alias("action"))


@query("topk_coefficients", f"""
    SELECT feature, {r('coef')} AS coef FROM ({_COEF}) WHERE activism > 0 ORDER BY abs(coef) DESC, feature LIMIT 5""")
def _(spark, d):
    return rounded(topk.topk_coefficients(_coefs(spark, d), 5, where="activism > 0").select("feature", "coef"))


@query("topk_cross_class", f"""
    SELECT feature, {r('activism')} AS activism, {r('action')} AS action, {r('greatest(activism, action)')} AS max,
      {r('sqrt(activism * activism + action * action)')} AS l2
    FROM ({_COEF}) ORDER BY greatest(activism, action) DESC, feature LIMIT 8""")
def _(spark, d):
    return rounded(topk.topk_cross_class(_coefs(spark, d).drop("coef"), ["activism", "action"], 8))


@query("topk_per_group", """
    SELECT subreddit, link_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY n DESC, link_id) AS rank
      FROM (SELECT subreddit, link_id, count(*) AS n FROM comments GROUP BY 1, 2)) WHERE rank <= 15""")
def _(spark, d):
    c = v.comments_long(spark, d).groupBy("subreddit", "link_id").agg(F.count("*").alias("n"))
    return topk.topk_per_group(c, "subreddit", "n", 15, "link_id")


@query("every_nth_row", """
    SELECT day, n FROM (SELECT *, row_number() OVER (ORDER BY day) - 1 AS rn
      FROM (SELECT day, count(*) AS n FROM comments GROUP BY day)) WHERE rn >= 330 AND (rn - 330) % 365 = 0""")
def _(spark, d):
    daily = v.comments_long(spark, d).groupBy("day").agg(F.count("*").alias("n"))
    return topk.every_nth_row(daily, "day", 330, 365)
