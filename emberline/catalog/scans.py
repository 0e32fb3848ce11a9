"""Queries for sources and sinks; the archive files are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.catalog.registry import query
from emberline.functions.time import date_from_path, month_label
from emberline.schemas import KIND_FOLDER, NEWS_POSITIONS, NEWS_WIDTH
from emberline.session import shared_dir, store
from emberline.sources import news as nws
from emberline.sources import posts as pst
from emberline.sources import sinks
from emberline.sources import views as v
from emberline.sources.lookups import scan_lookup

_BROKEN = "{not json"


def write_archive(spark, d) -> str:
    """The short posts as bz2 JSON lines, one folder per kind and month, with broken lines.

    Every sign-up brings one malformed line with it.
    """
    root = shared_dir(spark, "archive")
    posts = v.posts_short(spark, d)
    for kind, folder in KIND_FOLDER.items():
        part = posts.filter(F.col("kind") == kind)
        text = "body" if kind == "RC" else "selftext"
        fields = ["author", "subreddit", F.col("body").alias(text), "created_utc", "id",
                  F.floor("score").cast("long").alias("score"), F.lit(1).alias("unknown_field")]
        if kind == "RC":
            fields += ["link_id", "parent_id"]
        line = F.to_json(F.struct(*fields))
        lines = part.select(F.explode(
            F.array(line) if kind == "RC" else F.array(line, F.lit(_BROKEN))
        ).alias("value"))
        lines.write.option("compression", "bzip2").text(f"{root}/{folder}/2024/{kind}_2024-01.bz2")
    return root


_SCANNED = """
    SELECT author, subreddit, body, created_utc, id, link_id, CAST(floor(score) AS BIGINT) AS score,
      CAST(NULL AS VARCHAR) AS subreddit_id, parent_id, kind FROM posts WHERE kind = '{0}'"""


@query("scan_posts", _SCANNED.format("RC"))
def _(spark, d):
    return pst.scan_posts(spark, write_archive(spark, d), "RC", ["2024-01"])


@query("scan_posts_submissions", _SCANNED.format("RS") + """
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'RS' FROM posts WHERE kind = 'RS'""")
def _(spark, d):
    return pst.scan_posts(spark, write_archive(spark, d), "RS", ["2024-01"])


@query("scan_history", """
    SELECT id, author, month, kind FROM (SELECT *, strftime(day, '%Y-%m') AS month FROM comments1)
    WHERE month IN ('1996-03', '1996-04')""")
def _(spark, d):
    from emberline.catalog.plans import long_comments

    history = long_comments(spark, d).withColumn("month", month_label(F.col("day")))
    path = shared_dir(spark, "history")
    sinks.sink_table(sinks.spread(history, "month"), path, "parquet", ["kind", "month"])
    found = pst.scan_history(spark, path, ["1996-03", "1996-04", "2040-01"], "RC", history.schema)
    return found.select("id", "author", "month", "kind")


def write_news(spark, d) -> str:
    """News as headerless 27-column files, one folder per day."""
    path = shared_dir(spark, "news")
    rows = v.news(spark, d)
    values = {
        "DATE": F.date_format("day", "yyyyMMdd000000"),
        "SourceCommonName": F.col("SourceCommonName"),
        "DocumentIdentifier": F.col("DocumentIdentifier").cast("string"),
        "Themes": F.lit(""),
        "V2Themes": F.when(F.col("V2Themes").contains("eau"), F.regexp_replace("V2Themes", r"[^a-z]+", ";")),
        "V2Locations": F.col("V2Locations"),
    }
    names = {i: n for n, i in NEWS_POSITIONS.items()}
    columns = [
        (values[names[i]] if i in names else F.lit("-")).alias(f"c{i}") for i in range(NEWS_WIDTH)
    ]
    out = rows.select(*columns, F.date_format("day", "yyyyMMdd").alias("file_day"))
    sinks.spread(out, "file_day").write.partitionBy("file_day").option("sep", "\t").option(
        "encoding", "ISO-8859-1").option("compression", "gzip").csv(path)
    return path


@query("scan_news", """
    SELECT strftime(day, '%Y%m%d') || '000000' AS DATE, SourceCommonName, CAST(DocumentIdentifier AS VARCHAR) AS DocumentIdentifier,
      regexp_replace(V2Themes, '[^a-z]+', ';', 'g') AS V2Themes, V2Locations
    FROM news WHERE contains(V2Themes, 'eau')""")
def _(spark, d):
    return nws.scan_news(spark, f"{write_news(spark, d)}/*").drop("Themes")


@query("scan_lookup", """
    SELECT author FROM bots""")
def _(spark, d):
    path = shared_dir(spark, "bots")
    v.short_bots(spark, d).write.option("header", "true").csv(path)
    return scan_lookup(spark, "bots", path)


@query("file_volume", """
    SELECT strftime(day, '%Y-%m') AS month, kind, count(*) AS n
    FROM (SELECT day, kind FROM comments UNION ALL SELECT day, kind FROM subs) GROUP BY 1, 2""")
def _(spark, d):
    both = v.comments_long(spark, d).select("day", "kind").unionByName(
        v.submissions_long(spark, d).select("day", "kind"))
    return nws.file_volume(both.withColumn("month", month_label(F.col("day"))))


def write_news_lines(spark, d) -> str:
    """All documents as lines of news files, one folder per day; French ones are damaged.

    A French document loses all but five of its fields, and on every seventh day the lines are
    no text at all, so a file of that day has nothing to read.
    """
    path = shared_dir(spark, "news-lines")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 91).cast("int"))
    name = F.date_format(day, "yyyyMMdd")
    width = F.when(F.col("lang") == "fr", 5).otherwise(NEWS_WIDTH)
    fields = F.array_join(F.concat(F.array(name, F.col("doc_id").cast("string")), F.array_repeat(F.lit("-"), width - 2)), "\t")
    lines = v.table(spark, d, "documents").select(
        F.when(F.col("doc_id") % 91 % 7 == 6, F.lit("damaged")).otherwise(fields).alias("value"), name.alias("file_day"))
    sinks.spread(lines, "file_day").write.partitionBy("file_day").text(path)
    return path


# here the folder has the day
def _day():
    return F.to_date(F.regexp_extract("file_path", r"file_day=(\d{8})", 1), "yyyyMMdd")


def audited(spark, d):
    return nws.scan_news_audit(spark, f"{write_news_lines(spark, d)}/*")


_LINES = """
    SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 91 AS INTEGER) AS day, lang <> 'fr' AND doc_id % 91 % 7 <> 6 AS ok
    FROM documents"""


@query("news_volume", f"""
    SELECT CAST(g.day AS DATE) AS day, CAST(coalesce(n, 0) AS BIGINT) AS n
    FROM (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-04-05', INTERVAL 1 DAY)) AS day) g
    LEFT JOIN (SELECT day, count(*) FILTER (ok) AS n FROM ({_LINES}) GROUP BY day) c ON CAST(g.day AS DATE) = c.day""")
def _(spark, d):
    per_file = nws.file_audit(audited(spark, d), _day())
    return nws.news_volume(per_file, "day", "2023-12-25", "2024-04-05", records="good")


@query("bad_record_audit", f"""
    SELECT CAST(day AS DATE) AS day, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad FROM ({_LINES}) GROUP BY day""")
def _(spark, d):
    rows = audited(spark, d)
    return nws.bad_record_audit(rows.withColumn("day", _day()), "day")


@query("corrupted_inputs", f"""
    SELECT CAST(day AS DATE) AS day, count(*) FILTER (NOT ok) AS bad, count(*) FILTER (ok) = 0 AS unreadable
    FROM ({_LINES}) GROUP BY day HAVING count(*) FILTER (NOT ok) > 0""")
def _(spark, d):
    # a day is several files here: the rule per file is tested on files of one
    audit = store(nws.file_audit(audited(spark, d), _day()), "file-audit")
    every = audit.groupBy("day").agg(F.sum("good").alias("good"))
    return nws.corrupted_inputs(audit).groupBy("day").agg(F.sum("bad").alias("bad")).join(every, "day").select(
        "day", "bad", (F.col("good") == 0).alias("unreadable"))


@query("date_from_path", """
    SELECT CAST(DATE '2024-01-01' + CAST(doc_id % 91 AS INTEGER) AS DATE) AS day, count(*) AS n FROM documents GROUP BY 1""")
def _(spark, d):
    rows = v.news(spark, d).select(
        F.concat(F.lit("/archive/news/"), F.date_format("day", "yyyyMMdd"), F.lit("001500.csv.zip")).alias("path"))
    return rows.groupBy(date_from_path(F.col("path")).alias("day")).agg(F.count("*").alias("n"))


@query("sink_table", """
    SELECT fmt, kind, month, n FROM (SELECT kind, strftime(day, '%Y-%m') AS month, count(*) AS n FROM lposts GROUP BY 1, 2)
    CROSS JOIN (VALUES ('parquet'), ('parquet_gzip'), ('json'), ('csv'), ('tsv')) f(fmt)""")
def _(spark, d):
    from emberline.catalog.plans import long_posts

    # five writers read it: count once
    table = store(long_posts(spark, d).groupBy("kind", month_label(F.col("day")).alias("month")).agg(
        F.count("*").alias("n")), "month-counts")
    out = None
    for fmt in sinks.FORMATS:
        path = shared_dir(spark, f"sink-{fmt}")
        sinks.sink_table(table, path, fmt)
        back = sinks.read_table(spark, path, fmt, table.schema).withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


@query("incremental_month_load", """
    SELECT month, version, count(*) AS n FROM (
      SELECT strftime(day, '%Y-%m') AS month, CASE WHEN day < DATE '1998-01-01' THEN 1 ELSE 2 END AS version FROM comments1)
    GROUP BY 1, 2""")
def _(spark, d):
    from emberline.catalog.plans import long_comments

    path = shared_dir(spark, "months")
    posts = long_comments(spark, d).select("id", month_label(F.col("day")).alias("month"))
    first = posts.filter(F.col("month") < "1998-01").withColumn("version", F.lit(1))
    sinks.incremental_month_load(first, path)
    sinks.incremental_month_load(posts.withColumn("version", F.lit(2)), path)
    back = spark.read.schema("id string, version int, month string").parquet(path)
    return back.groupBy("month", "version").agg(F.count("*").alias("n"))
