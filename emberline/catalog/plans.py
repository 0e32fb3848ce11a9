"""Queries for whole analyses, and the posts they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.catalog import registry as reg
from emberline.catalog.registry import query, r, rounded, wk, z0
from emberline.functions.time import week_idx
from emberline.operators import aggregates as agg
from emberline.operators import joins as jn
from emberline.operators import sampling as smp
from emberline.operators import windows as win
from emberline.plans import features as ft
from emberline.plans.activation import activated_authors, pipe_activation
from emberline.plans.news_exposure import LAGS, exposure, news_weeks, pipe_news_exposure, region_exposure
from emberline.plans.person_period import pipe_interactions, pipe_person_period
from emberline.schemas import ATTRIBUTES, CONTROL, INTERACTION, NORM_NEWS, PAIRINGS
from emberline.session import store
from emberline.sources import views as v

MEETINGS = ["n_pairs_sibling", "n_active_authors_sibling"]
FEATURES = [*CONTROL, *INTERACTION]
_FLAGS = {"strike": v.NEWS_STRIKE, "substrings": v.NEWS_FLAGS, "separators": "[ ;,]"}
_KEY = ["author", "week_idx"]


def long_comments(spark, d) -> DataFrame:
    """One comment per id; ties are settled by all columns."""
    order = ["day", "author", "subreddit", "body", "link_id", "parent_id", "score"]
    return agg.dedup_first(v.comments_by_order(spark, d), "id", order, nullable=[], within=["l_orderkey"])


def long_posts(spark, d) -> DataFrame:
    both = long_comments(spark, d).unionByName(v.submissions_long(spark, d))
    return both.withColumn("week_idx", week_idx(F.col("day")))


# ---- activation ------------------------------------------------------------------------------

_SHORT_PAIRS = """
    SELECT w.author, s.subreddit, w.day AS date_weak, s.day AS date_strong FROM
      (SELECT author, day FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY created_utc, id) AS rn
         FROM posts WHERE contains(lower(body), 'error')) WHERE rn = 1) w
    JOIN (SELECT author, subreddit, day FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY created_utc, id) AS rn
         FROM posts WHERE subreddit IN ('c3', 'c7')) WHERE rn = 1) s ON w.author = s.author"""
_SHORT_WINDOW = """ WHERE date_strong > date_weak AND date_weak > DATE '2023-12-31' AND date_strong < DATE '2024-02-01'
    AND date_diff('day', date_weak, date_strong) < 732"""


@query("pipe_activation", f"SELECT subreddit, count(*) AS n FROM ({_SHORT_PAIRS}) {_SHORT_WINDOW} GROUP BY 1")
def _(spark, d):
    return pipe_activation(v.posts_short(spark, d), v.SHORT_KEYWORDS, v.SHORT_STRONG, "2023-12-31", "2024-02-01")


@query("activated_authors", f"SELECT author, subreddit, date_weak, date_strong FROM ({_SHORT_PAIRS}) {_SHORT_WINDOW}")
def _(spark, d):
    found = activated_authors(v.posts_short(spark, d), v.SHORT_KEYWORDS, v.SHORT_STRONG, "2023-12-31", "2024-02-01")
    return found.select("author", "subreddit", "date_weak", "date_strong")


@query("pipe_activation_long", """
    WITH s1 AS (SELECT author, subreddit, day FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY day, id, subreddit) AS rn
      FROM comments WHERE subreddit IN ('Brand#2', 'Brand#7')) WHERE rn = 1)
    SELECT s.subreddit, count(*) AS n FROM weak w JOIN s1 s ON w.author = s.author
    WHERE s.day > w.date AND w.date > DATE '1995-01-31' AND s.day < DATE '2001-06-01' AND date_diff('day', w.date, s.day) < 732
    GROUP BY 1""")
def _(spark, d):
    return pipe_activation(v.comments_long(spark, d), [v.WEAK_TYPE], v.STRONG_BRANDS, "1995-01-31", "2001-06-01", "day")


# ---- person period ---------------------------------------------------------------------------

_ACT = ", ".join(f"coalesce(a.{c}, 0) AS {c}" for c in CONTROL)
_FULL_ID = "CASE WHEN kind = 'RS' THEN 't3_' ELSE 't1_' END || id"


def _keys(side: int, table: str, columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {columns}, '{p}' AS pairing, {_FULL_ID if keys[side] == 'id' else keys[side]} AS item FROM {table}"
        for p, keys in PAIRINGS.items())


reg.CTES["lactive"] = """
    SELECT h.* FROM lposts h JOIN class_act s ON h.author = s.author
    WHERE s.subreddit_class = 'activism' AND date_trunc('month', h.day) >= date_trunc('month', s.date) AND h.subreddit <> 'Brand#2'"""
reg.CTES["lactkeys"] = "SELECT author, pairing, item, count(*) AS n FROM (" + _keys(0, "lactive", "author") + ") GROUP BY ALL"
reg.CTES["lmykeys"] = ("SELECT author, week_idx, pairing, item, count(*) AS n FROM ("
                       + _keys(1, "lposts", "author, week_idx") + ") GROUP BY ALL")
reg.CTES["linter"] = "SELECT author, week_idx, " + ", ".join(
    f"CAST(coalesce(sum(n) FILTER (pairing = '{p}'), 0) AS BIGINT) AS n_pairs_{p}, "
    f"count(DISTINCT active) FILTER (pairing = '{p}') AS n_active_authors_{p}" for p in PAIRINGS) + """
    FROM (SELECT m.author, m.week_idx, pairing, a.author AS active, m.n * a.n AS n FROM lmykeys m JOIN lactkeys a USING (pairing, item)
      WHERE m.author <> a.author) GROUP BY 1, 2"""
reg.CTES["facts"] = f"""
    SELECT p.author, p.week_idx, p.sunday, p.active, p.date_weak, p.date_strong, CAST(p.duration AS BIGINT) AS duration, p.activation, {_ACT},
      {", ".join(f"coalesce(i.{c}, 0) AS {c}" for c in INTERACTION)}
    FROM pw p LEFT JOIN activity a ON p.author = a.author AND p.week_idx = a.week_idx
    LEFT JOIN linter i ON p.author = i.author AND p.week_idx = i.week_idx"""


@query("pipe_person_period", f"""
    SELECT p.author, p.week_idx, p.sunday, p.active, p.date_weak, p.date_strong, CAST(p.duration AS BIGINT) AS duration, p.activation,
      coalesce(n_comments_author_week, 0) AS n_comments_author_week, coalesce(n_submissions_author_week, 0) AS n_submissions_author_week,
      coalesce(n_active_days_author_week, 0) AS n_active_days_author_week, {r('coalesce(avg_comments_per_thread, 0)')} AS avg_comments_per_thread,
      coalesce(n_different_subreddits, 0) AS n_different_subreddits
    FROM pw p LEFT JOIN activity a ON p.author = a.author AND p.week_idx = a.week_idx""")
def _(spark, d):
    posts = store(long_posts(spark, d), "posts")
    return rounded(pipe_person_period(posts, v.authors_long(spark, d)))


@query("pipe_interactions", "SELECT author, week_idx, " + ", ".join(
    f"count(*) FILTER (pairing = '{p}') AS n_pairs_{p}, count(DISTINCT author_active) FILTER (pairing = '{p}') AS n_active_authors_{p}"
    for p in PAIRINGS) + " FROM pairs GROUP BY 1, 2")
def _(spark, d):
    from emberline.catalog.joins import short_history, short_window

    return pipe_interactions(short_window(spark, d), short_history(spark, d), "activism", ["c3"])


def _long_history(spark, d, posts):
    """Posts of activists from the month they turned strong."""
    first = store(v.class_activations_long(spark, d).filter(F.col("subreddit_class") == "activism"), "activations")
    return jn.post_activation_history(posts, first).withColumn("subreddit_class", F.lit("activism"))


def feature_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Deduplicated posts, and the person-period facts, both written once."""
    posts = store(long_posts(spark, d), "posts")
    met = pipe_interactions(posts, _long_history(spark, d, posts), "activism", [v.STRONG_BRANDS[0]])
    facts = store(pipe_person_period(posts, v.authors_long(spark, d), extra=[met]), "facts")
    return posts, facts


# ---- sample and news ---------------------------------------------------------------------------

reg.CTES["sample"] = """
    SELECT author, week_idx, activation, duration FROM pw WHERE activation
    UNION ALL SELECT author, week_idx, activation, duration FROM (
      SELECT *, row_number() OVER (ORDER BY md5('8|' || author || '@' || week_idx), author || '@' || week_idx) AS rn
      FROM pw WHERE NOT activation AND date_weak < sunday AND sunday <= date_strong)
    WHERE rn <= 2 * (SELECT count(*) FROM pw WHERE activation)"""


@query("case_control_sample", "SELECT author, week_idx, activation FROM sample")
def _(spark, d):
    posts = store(long_posts(spark, d), "posts")
    weeks = store(pipe_person_period(posts, v.authors_long(spark, d)), "facts")
    return smp.case_control_sample(weeks, 8).select(*_KEY, "activation")


def _rolled(p):
    lag, width = LAGS[p]
    over = f"OVER (PARTITION BY country, admin1code ORDER BY week_idx ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"
    cols = ", ".join(
        f"CASE WHEN count(*) {over} = {width} THEN avg({c}) {over} ELSE 0 END AS {c}_{p}" for c in NORM_NEWS)
    return f"(SELECT country, admin1code, week_idx + {lag} AS week_idx, {cols} FROM nlweek)"


_NEWS = [f"{c}_{p}" for p in LAGS for c in NORM_NEWS]
reg.CTES["exposed"] = f"""
    SELECT author, week_idx, {', '.join(_NEWS)} FROM oneregion JOIN ({_rolled('short')}
      FULL JOIN {_rolled('medium')} m USING (country, admin1code, week_idx)
      FULL JOIN {_rolled('long')} l USING (country, admin1code, week_idx)) USING (country, admin1code)"""
reg.CTES["newsfeat"] = f"""
    SELECT s.author, s.week_idx, {', '.join(f'CASE WHEN e.{_NEWS[0]} IS NOT NULL THEN e.{c} ELSE m.{c} END AS {c}' for c in _NEWS)}
    FROM sample s LEFT JOIN exposed e ON s.author = e.author AND s.week_idx = e.week_idx
    LEFT JOIN (SELECT week_idx, {', '.join(f'median({c}) AS {c}' for c in _NEWS)} FROM exposed GROUP BY 1) m ON s.week_idx = m.week_idx
    WHERE e.{_NEWS[0]} IS NOT NULL OR m.week_idx IS NOT NULL"""


def author_regions(spark, d):
    located = jn.geo_join(v.comments_long(spark, d).select("author", "subreddit"),
                          v.community_region(spark, d), v.authors_long(spark, d))
    return agg.single_region_authors(agg.geo_counts(located))


@query("pipe_news_exposure", "SELECT author, week_idx, " + ", ".join(f"{r(c)} AS {c}" for c in _NEWS) + " FROM newsfeat")
def _(spark, d):
    posts = store(long_posts(spark, d), "posts")
    weeks = store(pipe_person_period(posts, v.authors_long(spark, d)), "facts")
    sample = store(smp.case_control_sample(weeks, 8), "sample")
    return rounded(pipe_news_exposure(v.news_long(spark, d), author_regions(spark, d), sample, **_FLAGS))


# ---- feature table -----------------------------------------------------------------------------

def _lagged(p):
    start, end = ft.WINDOWS[p]
    return (f"(SELECT author, week_idx, {', '.join(f'avg({c}) AS {c}_{p}' for c in FEATURES)} FROM ("
            f"SELECT DISTINCT s.author, s.week_idx, {', '.join(f'f.{c}' for c in FEATURES)} FROM sample s JOIN facts f "
            f"ON f.author = s.author AND f.week_idx BETWEEN s.week_idx - {start - 1} AND s.week_idx - {end}) GROUP BY 1, 2)")


reg.CTES["vocab"] = """
    SELECT subreddit, CAST(row_number() OVER (ORDER BY n DESC, subreddit) - 1 AS INTEGER) AS community
    FROM (SELECT subreddit, count(*) AS n FROM lposts GROUP BY 1 ORDER BY n DESC, subreddit LIMIT 1000)"""


def _joined(p):
    start, end = ft.WINDOWS[p]
    return (f"(SELECT s.author, s.week_idx, list_sort(list_distinct(list(v.community))) AS communities_{p} FROM sample s JOIN lposts f "
            f"ON f.author = s.author AND f.week_idx BETWEEN s.week_idx - {start - 1} AND s.week_idx - {end} "
            f"JOIN vocab v ON v.subreddit = f.subreddit GROUP BY 1, 2)")


def _feature_sql():
    from emberline.catalog.windows import QUARTILE_SQL

    quart = [q for a in ATTRIBUTES for q in win.QUARTILE_FLAGS[a]]
    acts = [f"{c}_{p}" for p in ft.WINDOWS for c in FEATURES]
    parts = [f"communities_{p}" for p in ft.WINDOWS]
    base = f"""SELECT s.author, s.week_idx, s.activation, CAST(s.duration AS BIGINT) AS duration,
        {', '.join(f'coalesce(n.{c}, 0) AS {c}' for c in _NEWS)}, {', '.join(f'coalesce({c}, 0) AS {c}' for c in acts)},
        {', '.join(f'coalesce({c}, []) AS {c}' for c in parts)}, {', '.join(f'coalesce(q.{c}, false) AS {c}' for c in quart)}
      FROM sample s JOIN newsfeat n ON s.author = n.author AND s.week_idx = n.week_idx
      {' '.join(f'LEFT JOIN {_lagged(p)} a{p} ON a{p}.author = s.author AND a{p}.week_idx = s.week_idx' for p in ft.WINDOWS)}
      {' '.join(f'LEFT JOIN {_joined(p)} j{p} ON j{p}.author = s.author AND j{p}.week_idx = s.week_idx' for p in ft.WINDOWS)}
      LEFT JOIN ({QUARTILE_SQL}) q ON q.author = s.author
      WHERE n.norm_climate_long > 0 AND n.norm_climate_action_long > 0 AND n.norm_natural_disaster_long > 0"""
    ratio = ", ".join(
        f"CASE WHEN {c}_long <> 0 THEN {c}_short / {c}_long WHEN {c}_short <> 0 THEN 1.0 ELSE 2.0 END AS {c}_short_long_ratio"
        for c in [*NORM_NEWS, *FEATURES])
    new = "[x FOR x IN communities_short IF NOT list_contains(communities_long, x)] AS communities_short_long_ratio"
    same = ", ".join(["activation", "duration", *[f"round({c}, 9)" for c in _DOUBLES], *parts, *quart])
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {same} ORDER BY author, week_idx) AS rn
      FROM (SELECT *, {ratio}, {new} FROM ({base}))) WHERE rn = 1"""


_DOUBLES = [*_NEWS, *[f"{c}_{p}" for p in ft.WINDOWS for c in FEATURES], *[f"{c}_short_long_ratio" for c in [*NORM_NEWS, *FEATURES]]]


reg.CTES["features"] = _feature_sql()


def feature_table(spark, d, balanced: bool = False) -> tuple[DataFrame, DataFrame]:
    """The feature table, and the long-period participation of its rows."""
    from emberline.catalog.windows import author_scores

    posts, facts = feature_inputs(spark, d)
    sample = store(smp.case_control_sample(facts, 8).select(*_KEY, "activation", "duration"), "sample")
    news = pipe_news_exposure(v.news_long(spark, d), author_regions(spark, d), sample, **_FLAGS)
    quart = win.quartile_membership(rounded(author_scores(spark, d)), ATTRIBUTES)
    vocab = store(ft.vocabulary(posts), "vocabulary")
    joined = posts.select(*_KEY, "subreddit").join(vocab.select("subreddit"), "subreddit")
    joined = store(joined.distinct(), "participation")
    table = ft.pipe_feature_table(
        sample, news, facts, FEATURES, joined, vocab, quart, NORM_NEWS, seed=6 if balanced else None)
    long = {"long": ft.WINDOWS["long"]}
    return table, agg.participation_long(jn.lag_week_join(sample, joined, long)).drop("period")


def _spelled(table: DataFrame) -> DataFrame:
    """Lists as text, as both engines write them alike."""
    return table.withColumns({
        c: F.array_join(F.col(c).cast("array<string>"), ",") for c, t in table.dtypes if t == "array<int>"})


def _spell(columns) -> str:
    return ", ".join(f"array_to_string({c}, ',') AS {c}" for c in columns)


_LISTS = [f"communities_{x}" for x in [*ft.WINDOWS, "short_long_ratio"]]


def _round_all(cols):
    return ", ".join(f"""{r('"' + c + '"')} AS "{c}" """ for c in cols)


@query("pipe_feature_table", f"""SELECT * REPLACE ({_round_all(_DOUBLES)}, {_spell(_LISTS)}) FROM features""")
def _(spark, d):
    return rounded(_spelled(feature_table(spark, d)[0]))


@query("pipe_feature_table_balanced", """
    SELECT author, week_idx, activation FROM (SELECT *, row_number() OVER (PARTITION BY activation
        ORDER BY md5('6|' || author || '@' || week_idx), author || '@' || week_idx) AS rn,
      least((SELECT count(*) FROM features WHERE activation), (SELECT count(*) FROM features WHERE NOT activation)) AS m FROM features)
    WHERE rn <= m""")
def _(spark, d):
    return feature_table(spark, d, balanced=True)[0].select(*_KEY, "activation")


def _robust_sql(mode):
    into, other, wa, wb = ("long", "short", 4, 47) if mode == "longmedium" else ("short", "long", 4, 1)
    cols = [f"{r(f'{c}_{other}')} AS {c}_{other}" for c in [*INTERACTION, *NORM_NEWS, *CONTROL]]
    for c in [*([] if mode == "longmedium" else INTERACTION), *NORM_NEWS, *CONTROL]:
        x = f"({c}_medium * {wa} + {c}_{into} * {wb}) / {float(wa + wb)}"
        cols.append(f"{x} > 0 AS {c}_{into}" if c in INTERACTION else f"{r(x)} AS {c}_{into}")
    cols += [_spell([f"communities_{other}"]),
             f"array_to_string(list_sort(list_distinct(list_concat(communities_medium, communities_{into}))), ',') AS communities_{into}"]
    return f"SELECT author, week_idx, activation, {', '.join(cols)} FROM features"


@query("pipe_period_robustness", _robust_sql("longmedium"))
def _(spark, d):
    table = feature_table(spark, d)[0]
    return rounded(_spelled(ft.pipe_period_robustness(table, "longmedium", NORM_NEWS, CONTROL, INTERACTION)))


@query("pipe_period_robustness_short", _robust_sql("shortmedium"))
def _(spark, d):
    table = feature_table(spark, d)[0]
    return rounded(_spelled(ft.pipe_period_robustness(table, "shortmedium", NORM_NEWS, CONTROL, INTERACTION)))


def _design_sql():
    act = [f"{c}_{p}" for p in ("long", "short") for c in CONTROL]
    news = [f"{c}_{p}" for p in ("long", "short") for c in NORM_NEWS]
    start, end = ft.WINDOWS["long"]
    return f"""
      WITH part AS (SELECT DISTINCT s.author, s.week_idx, f.subreddit FROM features s JOIN lposts f ON f.author = s.author
          AND f.week_idx BETWEEN s.week_idx - {start - 1} AND s.week_idx - {end} WHERE f.subreddit IN (SELECT subreddit FROM vocab)),
      popular AS (SELECT subreddit, {z0('ln(n + 0.1)')} AS log_popularity FROM (SELECT subreddit, count(*) AS n FROM part GROUP BY 1)),
      soc AS (SELECT author, week_idx, {', '.join(f'sum({a}) AS {a}' for a in ATTRIBUTES)} FROM part
        JOIN scores ON subreddit = community GROUP BY 1, 2),
      pop AS (SELECT author, week_idx, sum(log_popularity) AS log_popularity FROM part JOIN popular USING (subreddit) GROUP BY 1, 2)
      SELECT f.author, f.week_idx, activation, {', '.join(f'{r(z0(c))} AS {c}' for c in [*act, *news])},
        {', '.join(f'{r(z0(f"ln({c} + 1)"))} AS log_{c}' for c in act)},
        ({MEETINGS[0]}_short > 0 OR {MEETINGS[1]}_short > 0) AS interaction_short,
        {', '.join(f'{r(f"coalesce(soc.{a}, 0)")} AS {a}' for a in ATTRIBUTES)}, {r('coalesce(pop.log_popularity, 0)')} AS log_popularity
      FROM features f LEFT JOIN soc ON f.author = soc.author AND f.week_idx = soc.week_idx
      LEFT JOIN pop ON f.author = pop.author AND f.week_idx = pop.week_idx"""


@query("pipe_design_matrix", _design_sql())
def _(spark, d):
    table, part = feature_table(spark, d)
    scores = win.zscore(v.community_scores_raw(spark, d), ATTRIBUTES)
    meetings = (f"{MEETINGS[0]}_short", f"{MEETINGS[1]}_short")
    return rounded(ft.pipe_design_matrix(
        store(table, "features"), part, scores, ATTRIBUTES, NORM_NEWS, CONTROL, meetings))


@query("exposure", "SELECT author, week_idx, " + ", ".join(f"{r(c)} AS {c}" for c in _NEWS) + """
    FROM exposed JOIN (SELECT DISTINCT author, week_idx FROM lposts) USING (author, week_idx)""")
def _(spark, d):
    regions = region_exposure(news_weeks(v.news_long(spark, d), **_FLAGS))
    weeks = long_posts(spark, d).select(*_KEY).distinct()
    return rounded(exposure(regions, author_regions(spark, d), weeks))
