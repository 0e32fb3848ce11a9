"""Registration of queries, and the shared fragments of their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import tune

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; CTE names used by its SQL are supplied from :data:`CTES`."""
    def register(fn: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, and turn negative zero into zero."""
    return df.select(*[
        (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`")
        for c, t in df.dtypes
    ])


def r(x: str, digits: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE), {digits}) + 0.0)"


def wk(d: str) -> str:
    return f"CAST(floor(date_diff('day', DATE '1970-01-05', CAST({d} AS DATE)) / 7.0) AS BIGINT)"


def sunday(d: str) -> str:
    """Sunday on or after a date."""
    return f"CAST(CAST({d} AS DATE) + CAST((7 - dayofweek(CAST({d} AS DATE))) % 7 AS INTEGER) AS DATE)"


def u01(x: str) -> str:
    return f"(CAST('0x' || substr(md5({x}), 1, 13) AS BIGINT) / 4503599627370496.0)"


def z0(x: str, over: str = "OVER ()") -> str:
    return f"CASE WHEN stddev_pop({x}) {over} > 0 THEN ({x} - avg({x}) {over}) / stddev_pop({x}) {over} ELSE 0.0 END"


CTES: dict[str, str] = {
    "posts": """
        SELECT 'u' || user_id AS author, 'c' || (k % 20) AS subreddit, event_type || ' ' || props AS body,
          ts AS created, epoch_us(ts) // 1000000 AS created_utc, CAST(event_id AS VARCHAR) AS id,
          CASE WHEN event_type <> 'signup' THEN 't3_' || k END AS link_id,
          CASE WHEN event_type <> 'signup' THEN 't1_' || greatest(event_id - 1 - k, 0) END AS parent_id,
          value AS score, CASE WHEN event_type = 'signup' THEN 'RS' ELSE 'RC' END AS kind,
          CAST(ts AS DATE) AS day
        FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)""",
    "bots": "SELECT DISTINCT 'u' || user_id AS author FROM events WHERE user_id % 50 = 0",
    "comments": """
        SELECT 'a' || o_custkey AS author, p_brand AS subreddit, p_type AS body, CAST(l_shipdate AS DATE) AS day,
          l_orderkey || '-' || l_linenumber AS id, 't3_' || l_suppkey AS link_id, 't1_' || l_partkey AS parent_id,
          l_quantity AS score, 'RC' AS kind
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "comments1": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id
          ORDER BY day, author, subreddit, body, link_id, parent_id, score) AS rn FROM comments) WHERE rn = 1""",
    "subs": """
        SELECT 'a' || o_custkey AS author, c_mktsegment AS subreddit, o_orderpriority AS body,
          CAST(o_orderdate AS DATE) AS day, 's' || o_orderkey AS id, CAST(NULL AS VARCHAR) AS link_id,
          CAST(NULL AS VARCHAR) AS parent_id, 0.0 AS score, 'RS' AS kind
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "lposts": f"""
        SELECT *, {wk('day')} AS week_idx FROM (SELECT * FROM comments1 UNION ALL BY NAME SELECT * FROM subs)""",
    "weak": "SELECT author, min(day) AS date FROM comments WHERE body = 'ECONOMY' GROUP BY author",
    "strong": "SELECT author, min(day) AS date FROM comments WHERE subreddit IN ('Brand#2', 'Brand#7') GROUP BY author",
    "class_act": """
        SELECT author, CASE WHEN subreddit = 'Brand#2' THEN 'activism' ELSE 'action' END AS subreddit_class,
          min(day) AS date
        FROM comments WHERE subreddit IN ('Brand#2', 'Brand#7') GROUP BY 1, 2""",
    "authors": """
        SELECT w.author, w.date AS date_weak,
          CASE WHEN s.date > w.date THEN s.date ELSE DATE '2100-01-01' END AS date_strong,
          coalesce(s.date > w.date, false) AS active, year(w.date) || '-' || quarter(w.date) AS cohort
        FROM weak w LEFT JOIN strong s ON w.author = s.author""",
    "news": """
        SELECT doc_id AS DocumentIdentifier, CAST(DATE '2024-01-01' + CAST(doc_id % 91 AS INTEGER) AS DATE) AS day,
          source AS SourceCommonName, lower(text) AS V2Themes,
          '2#Place#' || substr(one, 1, 2) || '#' || one || '#0;3#Town#' || two AS V2Locations
        FROM (SELECT *, CASE WHEN lang = 'en' THEN 'US' || chr(CAST(65 + n % 26 AS INTEGER)) || chr(CAST(65 + n * 7 % 26 AS INTEGER))
                ELSE 'CA' || lpad(CAST(n AS VARCHAR), 2, '0') END AS one,
              CASE WHEN lang = 'en' THEN 'US' || chr(CAST(65 + m % 26 AS INTEGER)) || chr(CAST(65 + m * 7 % 26 AS INTEGER))
                ELSE 'CA' || lpad(CAST(m AS VARCHAR), 2, '0') END AS two
              FROM (SELECT *, CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS n, doc_id % 7 AS m FROM documents))""",
    "newsl": """
        SELECT doc_id AS DocumentIdentifier, CAST(DATE '1995-01-02' + CAST(doc_id * 37 % 2548 AS INTEGER) AS DATE) AS day,
          lower(text) AS V2Themes,
          '2#Place#' || CASE doc_id % 3 WHEN 0 THEN 'USNY' WHEN 1 THEN 'CA08' ELSE 'USCA' END || '#0;3#Town#USNY' AS V2Locations
        FROM documents""",
    "georegion": """
        SELECT * FROM (VALUES ('Brand#1', 'US', 'NY'), ('Brand#3', 'CA', '08'), ('Brand#4', 'US', 'CA'))
          t(subreddit, country, admin1code) WHERE subreddit IN (SELECT p_brand FROM part)""",
    "located": """
        SELECT c.author, g.country, g.admin1code FROM comments c JOIN georegion g ON c.subreddit = g.subreddit
        WHERE c.author IN (SELECT author FROM authors)""",
    "geocounts": "SELECT author, country, admin1code, count(*) AS n FROM located GROUP BY 1, 2, 3",
    "oneregion": """
        SELECT author, min(country) AS country, min(admin1code) AS admin1code, CAST(sum(n) AS BIGINT) AS n
        FROM geocounts GROUP BY author HAVING count(*) = 1""",
    "rawscores": """
        SELECT p_brand AS community, avg(p_size) AS age, avg(p_retailprice) AS gender,
          CAST(count(*) AS DOUBLE) AS partisan, avg(CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END) AS affluence
        FROM part GROUP BY p_brand""",
    "scores": "SELECT community, " + ", ".join(f"{z0(a)} AS {a}" for a in ("age", "gender", "partisan", "affluence"))
              + " FROM rawscores",
    "runs": """
        SELECT o_orderkey AS run_id, o_orderstatus AS lr, o_orderpriority AS var_opinions,
          o_totalprice AS accuracy, o_custkey AS key FROM orders""",
    "vectors": """
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label < 5 AS activation, label
        FROM embeddings""",
    "textf": r"""
        SELECT l.doc_id, l.quality, l.toxic, length(text) AS n_chars,
          len(string_split_regex(trim(text, E' \t\n\r'), '\s+')) AS n_words,
          length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) AS digit_share
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "surv": """
        SELECT o_custkey AS author, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 8 AS duration,
          l_returnflag = 'R' AS event, l_quantity, l_discount, l_tax, l_extendedprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "pw0": f"""
        SELECT author, {wk('sunday')} AS week_idx, sunday, active, date_weak, date_strong,
          least(date_diff('day', date_start, sunday), 7, date_diff('day', sunday, date_end)) AS duration,
          {wk('sunday')} = {wk('date_strong')} AS activation
        FROM (SELECT *, CAST(unnest(generate_series({sunday('date_start')}, date_end, INTERVAL 7 DAY)) AS DATE) AS sunday
          FROM (SELECT *, CAST(date_weak - 366 AS DATE) AS date_start,
            CAST(least(date_strong + 7, date_weak + 732) AS DATE) AS date_end FROM authors))""",
    "pw": """
        SELECT * FROM pw0 p WHERE EXISTS (
          SELECT 1 FROM (SELECT DISTINCT a.author, b.week_idx
            FROM (SELECT DISTINCT author, date_trunc('month', day) AS m FROM lposts WHERE kind = 'RC') a
            JOIN (SELECT DISTINCT date_trunc('month', day) AS m, week_idx FROM lposts WHERE kind = 'RC') b ON a.m = b.m) s
          WHERE s.author = p.author AND s.week_idx = p.week_idx)""",
    "activity": """
        SELECT author, week_idx, count(*) FILTER (kind = 'RC') AS n_comments_author_week,
          count(*) FILTER (kind = 'RS') AS n_submissions_author_week,
          count(DISTINCT day) FILTER (kind = 'RC') AS n_active_days_author_week,
          (SELECT 1.0) * count(parent_id) FILTER (kind = 'RC')
            / nullif(count(DISTINCT parent_id) FILTER (kind = 'RC'), 0) AS avg_comments_per_thread,
          count(DISTINCT subreddit) AS n_different_subreddits
        FROM lposts GROUP BY author, week_idx""",
    "active": f"""
        SELECT h.*, {wk('h.day')} AS week_idx FROM posts h
        JOIN (SELECT author, min(day) AS date FROM posts WHERE subreddit = 'c3' GROUP BY author) s ON h.author = s.author
        WHERE date_trunc('month', h.day) >= date_trunc('month', s.date) AND h.subreddit <> 'c3'""",
    "actkeys": """
        SELECT author, 'sibling' AS pairing, parent_id AS item FROM active
        UNION ALL SELECT author, 'thread', link_id FROM active
        UNION ALL SELECT author, 'replied_to_me', parent_id FROM active
        UNION ALL SELECT author, 'i_replied', CASE WHEN kind = 'RS' THEN 't3_' ELSE 't1_' END || id FROM active""",
    "mykeys": f"""
        SELECT author, {wk('day')} AS week_idx, 'sibling' AS pairing, parent_id AS item FROM posts
        UNION ALL SELECT author, {wk('day')}, 'thread', link_id FROM posts
        UNION ALL SELECT author, {wk('day')}, 'replied_to_me', CASE WHEN kind = 'RS' THEN 't3_' ELSE 't1_' END || id FROM posts
        UNION ALL SELECT author, {wk('day')}, 'i_replied', parent_id FROM posts""",
    "pairs": """
        SELECT m.pairing, m.item, m.author, m.week_idx, a.author AS author_active
        FROM mykeys m JOIN actkeys a ON m.pairing = a.pairing AND m.item = a.item AND m.author <> a.author""",
    "nflags": """
        SELECT *, list_contains(string_split_regex(V2Themes, '[ ;,]'), 'sch') AS is_strike,
          contains(V2Themes, 'ver') AS is_climate_action, contains(V2Themes, 'eau') AS is_climate,
          contains(V2Themes, 'ing') AS is_natural_disaster FROM news""",
    "nregions": """
        SELECT DISTINCT DocumentIdentifier, day, substr(code, 1, 2) AS country, substr(code, 3, 2) AS admin1code,
          is_strike, is_climate_action, is_climate, is_natural_disaster
        FROM (SELECT *, unnest(string_split_regex(V2Locations, '[;#]')) AS code FROM nflags)
        WHERE regexp_full_match(code, '(US\\w\\w|CA[0-9][0-9])')""",
    "nlflags": """
        SELECT *, contains(V2Themes, 'ver') AS is_climate_action, contains(V2Themes, 'eau') AS is_climate,
          contains(V2Themes, 'ing') AS is_natural_disaster FROM newsl""",
    "nlregions": """
        SELECT DISTINCT DocumentIdentifier, day, substr(code, 1, 2) AS country, substr(code, 3, 2) AS admin1code,
          is_climate_action, is_climate, is_natural_disaster
        FROM (SELECT *, unnest(string_split_regex(V2Locations, '[;#]')) AS code FROM nlflags)
        WHERE regexp_full_match(code, '(US\\w\\w|CA[0-9][0-9])')""",
}


def _week_table(regions: str) -> str:
    return f"""
        SELECT country, admin1code, {wk('day')} AS week_idx,
          count(*) FILTER (is_climate) AS tot_climate, count(*) FILTER (is_climate_action) AS tot_climate_action,
          count(*) FILTER (is_natural_disaster) AS tot_natural_disaster, count(*) AS tot_news,
          count(*) FILTER (is_climate) * 1.0 / count(*) AS norm_climate,
          count(*) FILTER (is_climate_action) * 1.0 / count(*) AS norm_climate_action,
          count(*) FILTER (is_natural_disaster) * 1.0 / count(*) AS norm_natural_disaster
        FROM {regions} GROUP BY 1, 2, 3
        HAVING count(*) FILTER (is_climate) > 0 AND count(*) FILTER (is_climate_action) > 0
          AND count(*) FILTER (is_natural_disaster) > 0"""


CTES["nweek"] = _week_table("nregions")
CTES["nlweek"] = _week_table("nlregions")


def _uses(text: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b(FROM|JOIN)\s+{n}\b", text)]


def with_ctes(sql: str) -> str:
    """Prefix a statement with the CTEs it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _uses(text):
            if name not in ordered:
                visit(CTES[name])
                ordered.append(name)

    visit(sql)
    body = sql.strip()
    if not ordered:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
