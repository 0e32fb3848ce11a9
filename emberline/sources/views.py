"""The driver's tables seen as posts, news, lookups and model inputs.

Every view is a projection or join of whole tables; no view drops or caps rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.joins import activation_pair_join

# Rules of the test views.
WEAK_TYPE = "ECONOMY"
STRONG_BRANDS = ["Brand#2", "Brand#7"]
SHORT_KEYWORDS = ["error"]
SHORT_STRONG = ["c3", "c7"]
BRAND_REGION = {"Brand#1": ("US", "NY"), "Brand#3": ("CA", "08"), "Brand#4": ("US", "CA")}
NEWS_STRIKE = "sch"
NEWS_FLAGS = {"is_climate_action": "ver", "is_climate": "eau", "is_natural_disaster": "ing"}
NEWS_FILTER = ["eau", "sch", "license"]
FAR_FUTURE = "2100-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(x: Column) -> Column:
    return x.cast("string")


def _ntz_seconds(ts: Column) -> Column:
    """Epoch seconds of a zone-less timestamp, whatever the session zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def posts_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of posts out of ``events``; sign-ups are submissions."""
    ev = table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    )
    comment = F.col("event_type") != "signup"
    return ev.select(
        F.concat(F.lit("u"), _s(F.col("user_id"))).alias("author"),
        F.concat(F.lit("c"), _s(F.col("k") % 20)).alias("subreddit"),
        F.concat_ws(" ", "event_type", "props").alias("body"),
        F.col("ts").alias("created"),
        _ntz_seconds(F.col("ts")).alias("created_utc"),
        _s(F.col("event_id")).alias("id"),
        F.when(comment, F.concat(F.lit("t3_"), _s(F.col("k")))).alias("link_id"),
        F.when(
            comment,
            F.concat(F.lit("t1_"), _s(F.greatest(F.col("event_id") - 1 - F.col("k"), F.lit(0)))),
        ).alias("parent_id"),
        F.col("value").alias("score"),
        F.when(comment, "RC").otherwise("RS").alias("kind"),
        F.col("ts").cast("date").alias("day"),
    )


def short_bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bot list: every fiftieth user."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.filter(F.col("user_id") % 50 == 0).select(
        F.concat(F.lit("u"), _s(F.col("user_id"))).alias("author")
    )


def comments_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of comments out of ``lineitem``; an id occurs more than once."""
    return comments_of(*[table(spark, sf_dir, t) for t in ("lineitem", "orders", "part")])


def comments_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same comments with ``l_orderkey``, which their id begins with."""
    return comments_of(*[table(spark, sf_dir, t) for t in ("lineitem", "orders", "part")], "l_orderkey")


def comments_of(li: DataFrame, orders: DataFrame, part: DataFrame, *more: str) -> DataFrame:
    """Comments out of order lines, which may be a stream, and the columns ``more``.

    The orders are joined last, so the comments of an order leave the join in one partition.
    """
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    orders = orders.select("o_orderkey", "o_custkey")
    part = part.select("p_partkey", "p_brand", "p_type")
    return (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            *more,
            F.concat(F.lit("a"), _s(F.col("o_custkey"))).alias("author"),
            F.col("p_brand").alias("subreddit"),
            F.col("p_type").alias("body"),
            F.col("l_shipdate").cast("date").alias("day"),
            F.concat_ws("-", _s(F.col("l_orderkey")), _s(F.col("l_linenumber"))).alias("id"),
            F.concat(F.lit("t3_"), _s(F.col("l_suppkey"))).alias("link_id"),
            F.concat(F.lit("t1_"), _s(F.col("l_partkey"))).alias("parent_id"),
            F.col("l_quantity").alias("score"),
            F.lit("RC").alias("kind"),
        )
    )


def submissions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions out of ``orders``; they have no thread and no parent."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("a"), _s(F.col("o_custkey"))).alias("author"),
        F.col("c_mktsegment").alias("subreddit"),
        F.col("o_orderpriority").alias("body"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.concat(F.lit("s"), _s(F.col("o_orderkey"))).alias("id"),
        F.lit(None).cast("string").alias("link_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit(0.0).alias("score"),
        F.lit("RS").alias("kind"),
    )


def weak_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First day each author posted the keyword."""
    c = comments_long(spark, sf_dir).filter(F.col("body") == WEAK_TYPE)
    return c.groupBy("author").agg(F.min("day").alias("date"))


def strong_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First day each author posted in a class community."""
    c = comments_long(spark, sf_dir).filter(F.col("subreddit").isin(STRONG_BRANDS))
    return c.groupBy("author").agg(F.min("day").alias("date"))


def class_activations_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First day per author and class; the two strong brands are two classes."""
    c = comments_long(spark, sf_dir).filter(F.col("subreddit").isin(STRONG_BRANDS))
    names = F.when(F.col("subreddit") == STRONG_BRANDS[0], "activism").otherwise("action")
    return (
        c.withColumn("subreddit_class", names)
        .groupBy("author", "subreddit_class")
        .agg(F.min("day").alias("date"))
    )


def authors_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author table: weak authors; those who turn strong later are active, the rest controls."""
    # both first days in one pass over the comments; an author that is null has no strong one
    is_weak, is_strong = F.col("body") == WEAK_TYPE, F.col("subreddit").isin(STRONG_BRANDS)
    both = comments_long(spark, sf_dir).filter(is_weak | is_strong).groupBy("author").agg(
        F.count_if(is_weak).alias("_weak"),
        F.min(F.when(is_weak, F.col("day"))).alias("date_weak"),
        F.min(F.when(is_strong & F.col("author").isNotNull(), F.col("day"))).alias("date_strong"),
    ).filter(F.col("_weak") > 0)
    later = F.coalesce(F.col("date_strong") > F.col("date_weak"), F.lit(False))
    return both.select(
        "author",
        "date_weak",
        F.when(later, F.col("date_strong"))
        .otherwise(F.lit(FAR_FUTURE).cast("date"))
        .alias("date_strong"),
        later.alias("active"),
        F.concat_ws("-", _s(F.year("date_weak")), _s(F.quarter("date_weak"))).alias("cohort"),
    )


def pairs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation_pair_join(weak_long(spark, sf_dir), strong_long(spark, sf_dir))


def _region_code(lang: Column, n: Column) -> Column:
    """``US`` and two letters for English text, ``CA`` and two digits for the rest."""
    us = F.concat(F.lit("US"), F.char(n % 26 + 65), F.char(n * 7 % 26 + 65))
    return F.when(lang == "en", us).otherwise(
        F.concat(F.lit("CA"), F.lpad(_s(n), 2, "0"))
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News records out of ``documents``: 13 weeks, two locations per record."""
    n = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    one, two = _region_code(F.col("lang"), n), _region_code(F.col("lang"), F.col("doc_id") % 7)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("DocumentIdentifier"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 91).cast("int")).alias("day"),
        F.col("source").alias("SourceCommonName"),
        F.lower("text").alias("V2Themes"),
        F.concat(
            F.lit("2#Place#"), F.substring(one, 1, 2), F.lit("#"), one, F.lit("#0;3#Town#"), two
        ).alias("V2Locations"),
    )


def news_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records spread over the years of the long posts, in the three brand regions."""
    r = F.col("doc_id") % 3
    code = F.when(r == 0, "USNY").when(r == 1, "CA08").otherwise("USCA")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("DocumentIdentifier"),
        F.date_add(F.lit("1995-01-02").cast("date"), (F.col("doc_id") * 37 % 2548).cast("int")).alias("day"),
        F.lower("text").alias("V2Themes"),
        F.concat(F.lit("2#Place#"), code, F.lit("#0;3#Town#USNY")).alias("V2Locations"),
    )


def community_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region of the located communities."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("subreddit")).distinct()
    country, code = F.lit(None).cast("string"), F.lit(None).cast("string")
    for brand, (c, a) in BRAND_REGION.items():
        country = F.when(F.col("subreddit") == brand, c).otherwise(country)
        code = F.when(F.col("subreddit") == brand, a).otherwise(code)
    return brands.select("subreddit", country.alias("country"), code.alias("admin1code")).na.drop()


def community_scores_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numbers per brand, before standardisation."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("community")).agg(
        F.avg("p_size").alias("age"),
        F.avg("p_retailprice").alias("gender"),
        F.count("*").cast("double").alias("partisan"),
        F.avg((F.col("p_type") == WEAK_TYPE).cast("int")).alias("affluence"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment runs out of ``orders``: two settings and a metric."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderstatus").alias("lr"),
        F.col("o_orderpriority").alias("var_opinions"),
        F.col("o_totalprice").alias("accuracy"),
        F.col("o_custkey").alias("key"),
    )


def labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary classification input out of ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
        (F.col("label") < 5).alias("activation"),
        "label",
    )


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric features of the labelled documents, over their whole texts."""
    words = F.size(F.split(F.trim("text"), r"\s+"))
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.length("text").alias("n_chars"),
        words.alias("n_words"),
        (digits / F.length("text")).alias("digit_share"),
    )
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of 0 to 7 days with heavy ties, an event flag and covariates."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_quantity", "l_discount",
        "l_tax", "l_extendedprice",
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    return li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("author"),
        (F.abs(F.datediff("l_shipdate", "o_orderdate")) % 8).cast("long").alias("duration"),
        (F.col("l_returnflag") == "R").alias("event"),
        "l_quantity", "l_discount", "l_tax", "l_extendedprice",
    )


def thread_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in a conversation: the parent is the previous turn."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("t3_"), _s(F.col("conv_id"))).alias("link_id"),
        F.concat_ws("-", _s(F.col("conv_id")), _s(F.col("turn"))).alias("id"),
        F.when(
            F.col("turn") > 0,
            F.concat(F.lit("t1_"), _s(F.col("conv_id")), F.lit("-"), _s(F.col("turn") - 1)),
        ).alias("parent_id"),
        F.col("role").alias("author"),
        F.col("turn"),
    )
