"""Queries for column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.catalog.registry import query, r, rounded, sunday, wk
from emberline.functions import frames, numeric, text, time
from emberline.operators import aggregates as agg
from emberline.operators import windows as win
from emberline.sources import views as v
from emberline.sources.lookups import names_frame


def _order_days(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("extract_regions", """
    SELECT DISTINCT DocumentIdentifier, country, admin1code FROM nregions""")
def _(spark, d):
    return agg.explode_regions(v.news(spark, d).select("DocumentIdentifier", "V2Locations"))


@query("iso_week_label", """
    SELECT o_orderkey, isoyear(CAST(o_orderdate AS DATE)) || '_' || lpad(CAST(week(CAST(o_orderdate AS DATE)) AS VARCHAR), 2, '0') AS label
    FROM orders""")
def _(spark, d):
    return _order_days(spark, d).select("o_orderkey", time.iso_week_label(F.col("day")).alias("label"))


@query("week_shift", f"SELECT o_orderkey, {wk('o_orderdate')} AS week_idx, {wk('o_orderdate')} - 6 AS earlier FROM orders")
def _(spark, d):
    days = _order_days(spark, d).select("o_orderkey", time.week_idx(F.col("day")).alias("week_idx"))
    return days.withColumn("earlier", time.week_shift(F.col("week_idx"), -6))


@query("week_label_to_date", f"""
    SELECT o_orderkey, {sunday('o_orderdate')} AS sunday,
      CAST(date_trunc('week', o_orderdate) AS DATE) AS monday FROM orders""")
def _(spark, d):
    w = time.week_idx(F.col("day"))
    return _order_days(spark, d).select(
        "o_orderkey", time.week_to_sunday(w).alias("sunday"), time.week_to_monday(w).alias("monday")
    )


@query("cohort_window", """
    SELECT author, cohort, CAST(date_trunc('quarter', date_weak) - INTERVAL 12 MONTH AS DATE) AS window_start,
      CAST(date_trunc('quarter', date_weak) + INTERVAL 27 MONTH AS DATE) AS window_end FROM authors""")
def _(spark, d):
    a = v.authors_long(spark, d).withColumn("w", time.cohort_window(F.col("cohort")))
    return a.select("author", "cohort", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))


@query("quarter_cohort", """
    SELECT author, CAST(year(date) * 4 + quarter(date) AS BIGINT) AS q, year(date) || '-' || quarter(date) AS cohort FROM weak""")
def _(spark, d):
    return v.weak_long(spark, d).select(
        "author", time.quarter_idx(F.col("date")).alias("q"), time.cohort_label(F.col("date")).alias("cohort")
    )


@query("epoch_to_date", "SELECT id, created_utc, CAST(created AS DATE) AS day FROM posts")
def _(spark, d):
    return v.posts_short(spark, d).select("id", "created_utc", time.epoch_to_date(F.col("created_utc")).alias("day"))


@query("week_spine", """
    SELECT author, sunday FROM pw0""")
def _(spark, d):
    a = v.authors_long(spark, d).select(
        "author", F.date_sub("date_weak", 366).alias("s"),
        F.least(F.date_add("date_strong", 7), F.date_add("date_weak", 732)).alias("e"),
    )
    return time.week_spine(a, "s", "e").select("author", "sunday")


@query("person_period_duration", "SELECT author, week_idx, CAST(duration AS BIGINT) AS duration, activation FROM pw0")
def _(spark, d):
    from emberline.plans.person_period import author_weeks

    return author_weeks(v.authors_long(spark, d)).select("author", "week_idx", "duration", "activation")


@query("strip_type_prefix", "SELECT DISTINCT parent_id, substr(parent_id, 4) AS bare FROM comments")
def _(spark, d):
    c = v.comments_long(spark, d).select("parent_id").distinct()
    return c.withColumn("bare", text.strip_type_prefix(F.col("parent_id")))


@query("parse_json_field", """
    SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, CAST(NULL AS BIGINT) AS bad FROM events""")
def _(spark, d):
    ev = v.table(spark, d, "events")
    broken = F.expr("substring(props, 1, length(props) - 1)")
    return ev.select(
        "event_id",
        text.parse_json(F.col("props"), "k long").getField("k").alias("k"),
        text.parse_json(broken, "q long").getField("q").alias("bad"),
    )


def _halves(spark, d):
    """Comments per author in an early and a late half of the months."""
    late = F.col("day") >= F.lit("1998-07-01").cast("date")
    return v.comments_long(spark, d).groupBy("author", "subreddit").agg(
        F.count_if(late & (F.col("body") == "ECONOMY")).alias("s"),
        F.count_if(~late & (F.col("body") == "ECONOMY")).alias("l"),
    )


_HALVES = """
    WITH h AS (SELECT author, subreddit, count(*) FILTER (day >= DATE '1998-07-01' AND body = 'ECONOMY') AS s,
      count(*) FILTER (day < DATE '1998-07-01' AND body = 'ECONOMY') AS l FROM comments GROUP BY 1, 2)
    SELECT author, subreddit, {} FROM h"""


@query("safe_ratio", _HALVES.format(
    r("CASE WHEN l <> 0 THEN s * 1.0 / l WHEN s <> 0 THEN 1 ELSE 2 END") + " AS ratio"))
def _(spark, d):
    return rounded(_halves(spark, d).select(
        "author", "subreddit", numeric.safe_ratio(F.col("s"), F.col("l")).alias("ratio")))


@query("smoothed_ratio", _HALVES.format(r("(s + 0.001) / (l + 0.01)") + " AS ratio"))
def _(spark, d):
    return rounded(_halves(spark, d).select(
        "author", "subreddit", numeric.smoothed_ratio(F.col("s"), F.col("l")).alias("ratio")))


@query("new_in_short", _HALVES.format("s > 0 AND NOT l > 0 AS is_new"))
def _(spark, d):
    return _halves(spark, d).select(
        "author", "subreddit", numeric.new_in_short(F.col("s") > 0, F.col("l") > 0).alias("is_new"))


@query("weighted_period_merge", _HALVES.format(
    r("(s * 4 + l * 47) / 51.0") + " AS longmedium, " + r("(s * 4 + l) / 5.0") + " AS shortmedium"))
def _(spark, d):
    s, l = F.col("s"), F.col("l")
    return rounded(_halves(spark, d).select(
        "author", "subreddit",
        numeric.weighted_period_merge(s, l, *numeric.MEDIUM_LONG_WEIGHTS).alias("longmedium"),
        numeric.weighted_period_merge(s, l, *numeric.MEDIUM_SHORT_WEIGHTS).alias("shortmedium"),
    ))


@query("bool_union_merge", _HALVES.format("s > 0 OR l > 0 AS either"))
def _(spark, d):
    return _halves(spark, d).select(
        "author", "subreddit",
        numeric.bool_union(numeric.positive(F.col("s")), numeric.positive(F.col("l"))).alias("either"))


@query("log1p_transform", _HALVES.format(r("ln(s + 1)") + " AS log_s"))
def _(spark, d):
    return rounded(_halves(spark, d).select(
        "author", "subreddit", numeric.log1p_transform(F.col("s")).alias("log_s")))


@query("rate_to_total", f"""
    SELECT p.author, p.week_idx, {r('coalesce(a.avg_comments_per_thread, 0) * p.duration')} AS total
    FROM pw p JOIN activity a ON p.author = a.author AND p.week_idx = a.week_idx""")
def _(spark, d):
    from emberline.catalog.plans import long_posts
    from emberline.plans.person_period import author_weeks, observed_weeks

    posts = long_posts(spark, d)
    weeks = author_weeks(v.authors_long(spark, d), observed_weeks(posts))
    act = agg.weekly_activity(posts, ["avg_comments_per_thread", "n_comments_author_week"])
    rate = F.coalesce("avg_comments_per_thread", F.lit(0.0))
    return rounded(weeks.join(act, ["author", "week_idx"]).select(
        "author", "week_idx", numeric.rate_to_total(rate, F.col("duration")).alias("total")))


_IMPUTE = f"""
    SELECT vec_id, {r('coalesce(x, (SELECT median(x) FROM t)) * 100')} AS x
    FROM t"""


@query("median_impute", "WITH t AS (SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN embedding[1] END AS x FROM vectors)" + _IMPUTE)
def _(spark, d):
    t = v.labelled_vectors(spark, d).select(
        "vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")[0]).alias("x"))
    return rounded(win.median_impute(t, ["x"], percent=["x"]))


@query("median_impute_by", f"""
    WITH t AS (SELECT vec_id, label, CASE WHEN vec_id % 3 <> 0 THEN embedding[1] END AS x FROM vectors)
    SELECT vec_id, label, {r('coalesce(x, (SELECT median(x) FROM t u WHERE u.label = t.label))')} AS x FROM t""")
def _(spark, d):
    t = v.labelled_vectors(spark, d).select(
        "vec_id", "label", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")[0]).alias("x"))
    return rounded(win.median_impute(t, ["x"], by=["label"]))


@query("match_flags", """
    SELECT author, subreddit, subreddit IN ('Brand#8', 'Brand#9') AS mismatch, subreddit IN ('Brand#1', 'Brand#4') AS good_match
    FROM comments""")
def _(spark, d):
    bad = names_frame(spark, ["Brand#8", "Brand#9"], "subreddit")
    good = names_frame(spark, ["Brand#1", "Brand#4"], "subreddit")
    return agg.match_flags(v.comments_long(spark, d).select("author", "subreddit"), "subreddit", bad, good)


@query("unpivot_features", """
    SELECT author, feature, CAST(value AS DOUBLE) AS value FROM (
      SELECT author, count(*) AS n, sum(score) AS total FROM comments GROUP BY author)
    UNPIVOT (value FOR feature IN (n, total))""".replace("SELECT author, count(*) AS n, sum(score)",
                                                       "SELECT author, CAST(count(*) AS DOUBLE) AS n, sum(score)"))
def _(spark, d):
    wide = v.comments_long(spark, d).groupBy("author").agg(F.count("*").alias("n"), F.sum("score").alias("total"))
    return frames.unpivot_features(wide, ["author"])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("pivot_results", "SELECT lr, " + ", ".join(
    f"max(accuracy) FILTER (var_opinions = '{p}') AS \"{p}\"" for p in _PRIORITIES) + " FROM runs GROUP BY lr")
def _(spark, d):
    return frames.pivot_results(v.runs(spark, d), "lr", "var_opinions", "accuracy", _PRIORITIES)


@query("rename_by_map", "SELECT author, day AS date_strong, subreddit AS community, score AS n_score FROM comments")
def _(spark, d):
    c = v.comments_long(spark, d).select("author", "day", "subreddit", "score")
    named = frames.rename_by_map(c, {"day": "date_strong", "subreddit": "community"})
    return frames.rename_by_map(named, prefix="n_", keep=["author", "date_strong", "community"])


@query("ensure_columns", "SELECT author, count(*) AS n, false AS rx_long, false AS ry_long FROM comments GROUP BY author")
def _(spark, d):
    c = v.comments_long(spark, d).groupBy("author").agg(F.count("*").alias("n"))
    return frames.ensure_columns(c, ["n", "rx_long", "ry_long"])


@query("select_by_name", "SELECT id, link_id, parent_id, score FROM comments")
def _(spark, d):
    return frames.select_by_name(v.comments_long(spark, d), r".*_id|score", keep=["id"])
