"""Queries for joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.catalog.registry import query, r, rounded, wk
from emberline.functions.time import week_idx
from emberline.operators import aggregates as agg
from emberline.operators import interactions as inter
from emberline.operators import joins as jn
from emberline.session import store
from emberline.sources import views as v
from emberline.sources.lookups import names_frame


@query("history_broadcast_join", """
    SELECT c.id, c.author, c.day, a.subreddit_class, a.date FROM comments c JOIN class_act a ON c.author = a.author""")
def _(spark, d):
    c = v.comments_long(spark, d).select("id", "author", "day")
    return jn.history_broadcast_join(c, store(v.class_activations_long(spark, d), "authors"))


@query("cohort_window_history", """
    SELECT c.id, c.author, c.day, c.subreddit, c.parent_id FROM comments c JOIN authors a ON c.author = a.author
    WHERE c.day >= date_trunc('quarter', a.date_weak) - INTERVAL 12 MONTH
      AND c.day < date_trunc('quarter', a.date_weak) + INTERVAL 27 MONTH""")
def _(spark, d):
    c = v.comments_long(spark, d).select("id", "author", "day", "subreddit", "parent_id")
    return jn.cohort_window_history(c, store(v.authors_long(spark, d), "authors"))


@query("pre_activation_history", """
    SELECT c.id, c.author, c.day, CAST(date_trunc('month', s.date) AS DATE) AS activation_month
    FROM comments c JOIN strong s ON c.author = s.author
    WHERE date_trunc('month', c.day) >= date_trunc('month', s.date) - INTERVAL 24 MONTH
      AND date_trunc('month', c.day) < date_trunc('month', s.date)""")
def _(spark, d):
    c = v.comments_long(spark, d).select("id", "author", "day")
    return jn.pre_activation_history(c, store(v.strong_long(spark, d), "authors"))


@query("post_activation_history", """
    SELECT c.id, c.author, c.day, CAST(date_trunc('month', s.date) AS DATE) AS activation_month
    FROM comments c JOIN strong s ON c.author = s.author
    WHERE date_trunc('month', c.day) >= date_trunc('month', s.date)""")
def _(spark, d):
    c = v.comments_long(spark, d).select("id", "author", "day")
    return jn.post_activation_history(c, store(v.strong_long(spark, d), "authors"))


_Q = "year({0}) * 4 + quarter({0})"


@query("weak_cohort_window", f"""
    SELECT c.id, c.author, c.day FROM comments c JOIN weak w ON c.author = w.author
    WHERE {_Q.format('w.date')} >= {_Q.format('c.day')} - 8 AND {_Q.format('w.date')} < {_Q.format('c.day')} + 5
      AND {_Q.format('w.date')} >= 1995 * 4 + 1 AND {_Q.format('w.date')} < 1995 * 4 + 1 + 28""")
def _(spark, d):
    c = v.comments_long(spark, d).select("id", "author", "day")
    first = 1995 * 4 + 1
    return jn.weak_cohort_window(c, store(v.weak_long(spark, d), "authors"), bounds=(first, first + 28))


@query("geo_join", "SELECT author, country, admin1code, count(*) AS n FROM located GROUP BY ALL")
def _(spark, d):
    c = v.comments_long(spark, d).select("author", "subreddit")
    j = jn.geo_join(c, store(v.community_region(spark, d), "regions"), store(v.authors_long(spark, d), "authors"))
    return j.groupBy("author", "country", "admin1code").agg(F.count("*").alias("n"))


@query("activation_pair_join", """
    SELECT w.author, w.date AS date_weak, s.date AS date_strong, CAST(date_diff('day', w.date, s.date) AS DOUBLE) AS diff_days,
      s.date > w.date AS weak_then_strong, s.date = w.date AS simultaneous
    FROM weak w JOIN strong s ON w.author = s.author""")
def _(spark, d):
    return v.pairs_long(spark, d)


@query("left_feature_merge", """
    SELECT a.author, coalesce(c.n, 0) AS n_comments, coalesce(s.n, 0) AS n_submissions
    FROM authors a LEFT JOIN (SELECT author, count(*) AS n FROM comments GROUP BY author) c ON a.author = c.author
    LEFT JOIN (SELECT author, count(*) AS n FROM subs GROUP BY author) s ON a.author = s.author""")
def _(spark, d):
    c = v.comments_long(spark, d).groupBy("author").agg(F.count("*").alias("n_comments"))
    s = v.submissions_long(spark, d).groupBy("author").agg(F.count("*").alias("n_submissions"))
    return jn.left_feature_merge(v.authors_long(spark, d).select("author"), [c, s], ["author"])


@query("outer_period_merge", """
    SELECT coalesce(a.author, b.author) AS author, coalesce(a.subreddit, b.subreddit) AS subreddit, a.n AS n_short, b.n AS n_long
    FROM (SELECT author, subreddit, count(*) AS n FROM comments WHERE day >= DATE '2000-01-01' GROUP BY 1, 2) a
    FULL JOIN (SELECT author, subreddit, count(*) AS n FROM comments WHERE day < DATE '2000-01-01' GROUP BY 1, 2) b
      ON a.author = b.author AND a.subreddit = b.subreddit""")
def _(spark, d):
    c = v.comments_long(spark, d)
    late = F.col("day") >= F.lit("2000-01-01").cast("date")
    key = ["author", "subreddit"]
    return jn.outer_period_merge({
        "short": c.filter(late).groupBy(*key).agg(F.count("*").alias("n")),
        "long": c.filter(~late).groupBy(*key).agg(F.count("*").alias("n")),
    }, key)


@query("inner_reduce_merge", """
    SELECT a.author, a.n AS n_comments, b.n AS n_communities, c.n AS n_submissions
    FROM (SELECT author, count(*) AS n FROM comments GROUP BY 1) a
    JOIN (SELECT author, count(DISTINCT subreddit) AS n FROM comments GROUP BY 1) b ON a.author = b.author
    JOIN (SELECT author, count(*) AS n FROM subs GROUP BY 1) c ON a.author = c.author""")
def _(spark, d):
    c, s = v.comments_long(spark, d), v.submissions_long(spark, d)
    return jn.inner_reduce_merge([
        c.groupBy("author").agg(F.count("*").alias("n_comments")),
        c.groupBy("author").agg(F.countDistinct("subreddit").alias("n_communities")),
        s.groupBy("author").agg(F.count("*").alias("n_submissions")),
    ], ["author"])


@query("vocab_right_join", """
    SELECT v.subreddit, coalesce(p.author, '-- NO  AUTHORS --') AS author, coalesce(p.id, '-- NO  AUTHORS --') AS id
    FROM (SELECT 'c' || i AS subreddit FROM range(20) t(i) UNION ALL SELECT 'c99') v LEFT JOIN posts p ON p.subreddit = v.subreddit""")
def _(spark, d):
    vocab = names_frame(spark, [*[f"c{i}" for i in range(20)], "c99"], "subreddit")
    return jn.vocab_right_join(v.posts_short(spark, d).select("author", "subreddit", "id"), vocab, "subreddit")


@query("lag_week_join", f"""
    WITH f AS (SELECT author, {wk('day')} AS week_idx, count(*) AS n FROM posts GROUP BY 1, 2)
    SELECT s.author, s.week_idx, CAST(sum(f.n) AS BIGINT) AS n, count(*) AS weeks
    FROM f s JOIN f ON f.author = s.author AND f.week_idx BETWEEN s.week_idx - 3 AND s.week_idx - 2 GROUP BY 1, 2""")
def _(spark, d):
    facts = v.posts_short(spark, d).groupBy("author", week_idx(F.col("day")).alias("week_idx")).agg(
        F.count("*").alias("n"))
    lagged = jn.lag_week_join(facts.select("author", "week_idx"), facts, {"medium": (4, 2)})
    return lagged.groupBy("author", "week_idx").agg(F.sum("n").alias("n"), F.count("*").alias("weeks"))


@query("population_join", """
    SELECT o.country, o.admin1code, count(*) AS users, g.region, g.population
    FROM oneregion o JOIN (SELECT country, admin1code, 'R-' || country AS region,
        (SELECT sum(1000000 + n_nationkey) FROM nation WHERE n_regionkey = CASE country WHEN 'US' THEN 1 ELSE 2 END)::BIGINT AS population
      FROM georegion) g ON o.country = g.country AND o.admin1code = g.admin1code GROUP BY ALL""")
def _(spark, d):
    located = jn.geo_join(v.comments_long(spark, d).select("author", "subreddit"),
                          v.community_region(spark, d), v.authors_long(spark, d))
    users = agg.single_region_authors(agg.geo_counts(located))
    nation = v.table(spark, d, "nation")
    pop = nation.groupBy("n_regionkey").agg(F.sum(F.col("n_nationkey") + 1000000).alias("p"))
    # American figures use a point, Canadian ones a comma between thousands
    text = F.when(F.col("country") == "US", F.translate(F.format_number("p", 0), ",", ".")).otherwise(
        F.format_number("p", 0))
    region = F.when(F.col("country") == "US", 1).otherwise(2)
    population = v.community_region(spark, d).withColumn("n_regionkey", region).join(pop, "n_regionkey").select(
        "country", "admin1code", F.concat(F.lit("R-"), "country").alias("region"), text.alias("population"))
    return jn.population_join(users, population)


def short_window(spark, d):
    return v.posts_short(spark, d).withColumn("week_idx", week_idx(F.col("day")))


def short_history(spark, d):
    """Posts of authors from the month they turned strong, once per class."""
    p = v.posts_short(spark, d)
    both = None
    for community, name in (("c3", "activism"), ("c7", "action")):
        first = p.filter(F.col("subreddit") == community).groupBy("author").agg(F.min("day").alias("date"))
        hist = jn.post_activation_history(p, first).withColumn("subreddit_class", F.lit(name))
        both = hist if both is None else both.unionByName(hist)
    return both


def short_items(spark, d):
    return inter.active_items(inter.active_posts(short_history(spark, d), "activism", ["c3"]))


@query("interaction_join", """
    SELECT m.pairing, m.author, m.week_idx, m.item, m.n, p.posts AS active_posts, p.authors AS active_authors
    FROM (SELECT pairing, author, week_idx, item, count(*) AS n FROM mykeys GROUP BY 1, 2, 3, 4) m
    JOIN (SELECT m.pairing, m.author, m.item, count(*) AS posts, count(DISTINCT a.author) AS authors
          FROM (SELECT DISTINCT pairing, author, item FROM mykeys) m
          JOIN actkeys a ON m.pairing = a.pairing AND m.item = a.item AND m.author <> a.author GROUP BY 1, 2, 3) p
      ON m.pairing = p.pairing AND m.author = p.author AND m.item = p.item""")
def _(spark, d):
    return inter.interaction_join(short_window(spark, d), short_items(spark, d)).drop("is_active")


@query("interaction_semi_prefilter", "SELECT id, author FROM posts WHERE parent_id IN (SELECT parent_id FROM active)")
def _(spark, d):
    active = inter.active_posts(short_history(spark, d), "activism", ["c3"])
    return inter.interaction_semi_prefilter(v.posts_short(spark, d), active, "sibling").select("id", "author")


@query("interaction_counts", """
    SELECT pairing, author, week_idx, count(*) AS n_pairs, count(DISTINCT author_active) AS n_active_authors
    FROM pairs GROUP BY 1, 2, 3""")
def _(spark, d):
    from emberline.session import store

    items = store(short_items(spark, d), "active-items")
    met = store(inter.interaction_join(short_window(spark, d), items), "interactions")
    return inter.interaction_counts(met, items)
