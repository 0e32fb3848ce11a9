"""Queries for filters and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.catalog.registry import query, wk
from emberline.functions.text import theme_flags
from emberline.functions.time import week_idx
from emberline.operators import filters as flt
from emberline.operators import sets
from emberline.sources import views as v
from emberline.sources.lookups import names_frame

_POST = ["id", "author", "subreddit", "kind"]


@query("filter_community", "SELECT id, author, subreddit, kind FROM posts WHERE subreddit IN ('c3', 'c7')")
def _(spark, d):
    return flt.filter_community(v.posts_short(spark, d), v.SHORT_STRONG).select(*_POST)


@query("filter_community_list", "SELECT id, author, subreddit, kind FROM posts WHERE subreddit IN ('c3', 'c7')")
def _(spark, d):
    names = names_frame(spark, v.SHORT_STRONG, "subreddit")
    return flt.filter_community(v.posts_short(spark, d), names).select(*_POST)


@query("filter_keywords", "SELECT id, author, body FROM posts WHERE contains(lower(body), 'error') OR contains(lower(body), 'signup')")
def _(spark, d):
    return flt.filter_keywords(v.posts_short(spark, d), "body", ["Error", "signup"]).select("id", "author", "body")


@query("filter_authors", "SELECT id, author, kind FROM posts WHERE author IN (SELECT author FROM posts WHERE subreddit = 'c3' AND kind = 'RS')")
def _(spark, d):
    p = v.posts_short(spark, d)
    chosen = p.filter((F.col("subreddit") == "c3") & (F.col("kind") == "RS"))
    return flt.filter_authors(p, chosen).select("id", "author", "kind")


@query("exclude_bots", "SELECT id, author, kind FROM posts WHERE author NOT IN (SELECT author FROM bots)")
def _(spark, d):
    return flt.exclude_bots(v.posts_short(spark, d), v.short_bots(spark, d)).select("id", "author", "kind")


@query("filter_positive_score", "SELECT id, score FROM posts WHERE score > 0")
def _(spark, d):
    return flt.filter_positive_score(v.posts_short(spark, d)).select("id", "score")


@query("theme_filter", """
    SELECT DocumentIdentifier, day FROM news
    WHERE contains(V2Themes, 'eau') OR contains(V2Themes, 'sch') OR contains(V2Themes, 'license')""")
def _(spark, d):
    return flt.theme_filter(v.news(spark, d), v.NEWS_FILTER).select("DocumentIdentifier", "day")


@query("theme_flags", "SELECT DocumentIdentifier, is_strike, is_climate_action, is_climate, is_natural_disaster FROM nflags")
def _(spark, d):
    flags = theme_flags(F.col("V2Themes"), v.NEWS_STRIKE, v.NEWS_FLAGS, "[ ;,]")
    return v.news(spark, d).select("DocumentIdentifier", *[c.alias(n) for n, c in flags.items()])


@query("date_window_filter", "SELECT author, date FROM weak WHERE date > DATE '1996-01-01' AND date < DATE '1999-01-01'")
def _(spark, d):
    return flt.date_window_filter(v.weak_long(spark, d), "date", "1996-01-01", "1999-01-01")


@query("positive_news_filter", """
    SELECT country, admin1code, week_idx, tot_news FROM (
      SELECT country, admin1code, {w} AS week_idx, count(*) AS tot_news,
        count(*) FILTER (is_climate) AS a, count(*) FILTER (is_climate_action) AS b,
        count(*) FILTER (is_natural_disaster) AS c FROM nregions GROUP BY 1, 2, 3)
    WHERE a > 0 AND b > 0 AND c > 0""".format(w=wk("day")))
def _(spark, d):
    from emberline.operators.aggregates import explode_regions

    flags = theme_flags(F.col("V2Themes"), v.NEWS_STRIKE, v.NEWS_FLAGS, "[ ;,]")
    rows = explode_regions(v.news(spark, d).select("day", "V2Locations", *[c.alias(n) for n, c in flags.items()]))
    weeks = rows.groupBy("country", "admin1code", week_idx(F.col("day")).alias("week_idx")).agg(
        F.count("*").alias("tot_news"), *[F.count_if(F.col(n)).alias(n) for n in v.NEWS_FLAGS]
    )
    return flt.positive_news_filter(weeks, list(v.NEWS_FLAGS)).select(
        "country", "admin1code", "week_idx", "tot_news"
    )


@query("active_only_filter", """
    SELECT author FROM posts GROUP BY author
    HAVING (bool_or(subreddit = 'c1' AND day < DATE '2024-01-15') OR bool_or(subreddit = 'c2' AND day < DATE '2024-01-15'))
       AND (bool_or(subreddit = 'c1' AND day >= DATE '2024-01-15') OR bool_or(subreddit = 'c2' AND day >= DATE '2024-01-15'))""")
def _(spark, d):
    early = F.col("day") < F.lit("2024-01-15").cast("date")
    flags = v.posts_short(spark, d).groupBy("author").agg(*[
        F.bool_or((F.col("subreddit") == c) & (early if p == "long" else ~early)).alias(f"r{c}_{p}")
        for c in ("c1", "c2") for p in ("long", "short")
    ])
    return flt.active_only_filter(flags, ["rc1_long", "rc2_long"], ["rc1_short", "rc2_short"]).select("author")


_OVERLAP = """
    SELECT id, author FROM posts WHERE author {}IN (SELECT author FROM posts GROUP BY author
      HAVING avg(CASE WHEN subreddit = 'c3' THEN 1.0 ELSE 0 END) > 0 AND avg(CASE WHEN subreddit = 'c3' THEN 1.0 ELSE 0 END) < 1)"""


def _overlap(spark, d, keep):
    p = v.posts_short(spark, d).select("id", "author", (F.col("subreddit") == "c3").alias("label"))
    return flt.overlap_split(p, "label", keep=keep).select("id", "author")


@query("overlap_split", _OVERLAP.format(""))
def _(spark, d):
    return _overlap(spark, d, True)


@query("overlap_split_without", _OVERLAP.format("NOT "))
def _(spark, d):
    return _overlap(spark, d, False)


@query("union_sources", """
    SELECT source, author, link_id, count(*) AS n FROM (
      SELECT 'comments' AS source, author, link_id FROM comments
      UNION ALL SELECT 'submissions', author, NULL FROM subs) GROUP BY ALL""")
def _(spark, d):
    both = sets.union_sources(
        v.comments_long(spark, d), v.submissions_long(spark, d).drop("link_id"), ("comments", "submissions")
    )
    return both.groupBy("source", "author", "link_id").agg(F.count("*").alias("n"))


@query("intersect_keys", "SELECT author FROM weak INTERSECT SELECT author FROM strong")
def _(spark, d):
    return sets.intersect_keys(v.weak_long(spark, d), v.strong_long(spark, d), "author")


@query("except_authors", "SELECT author, date FROM weak WHERE author NOT IN (SELECT author FROM strong)")
def _(spark, d):
    return sets.except_authors(v.weak_long(spark, d), v.strong_long(spark, d))


@query("distinct_items", "SELECT DISTINCT parent_id, subreddit FROM comments")
def _(spark, d):
    return sets.distinct_items(v.comments_long(spark, d), ["parent_id", "subreddit"])
