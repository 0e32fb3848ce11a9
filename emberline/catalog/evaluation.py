"""Queries for evaluation and summaries of fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.catalog.aggregates import flat_vectors
from emberline.catalog.registry import query, r, rounded
from emberline.operators import evaluation as ev
from emberline.sources import views as v

# A coefficient per feature and replicate: the slope of score on week day per community and year.
_COEFS = """
    SELECT subreddit AS feature, year(day) AS replicate, regr_slope(score, date_diff('day', DATE '1995-01-01', day) % 7) AS coef
    FROM comments GROUP BY 1, 2"""


def _coefs(spark, d):
    days = (F.datediff("day", F.lit("1995-01-01").cast("date")) % 7).cast("double")
    c = v.comments_long(spark, d).withColumn("x", days)
    return c.groupBy(F.col("subreddit").alias("feature"), F.year("day").alias("replicate")).agg(
        F.regr_slope("score", "x").alias("coef"))


@query("bootstrap_ci", f"""
    SELECT feature, {r('avg(coef)')} AS coef, {r('quantile_cont(coef, 0.025)')} AS ci_lower, {r('quantile_cont(coef, 0.975)')} AS ci_upper,
      quantile_cont(coef, 0.025) * quantile_cont(coef, 0.975) > 0 AS significant FROM ({_COEFS}) GROUP BY 1""")
def _(spark, d):
    return rounded(ev.bootstrap_ci(_coefs(spark, d)))


@query("bootstrap_pvalue", f"""
    SELECT feature, {r('avg(coef)')} AS coefficient, {r('exp(avg(coef))')} AS exp_coefficient,
      {r('least(avg(CASE WHEN coef > 0 THEN 1.0 ELSE 0 END), 1 - avg(CASE WHEN coef > 0 THEN 1.0 ELSE 0 END))')} AS p
    FROM ({_COEFS}) GROUP BY 1""")
def _(spark, d):
    return rounded(ev.bootstrap_pvalue(_coefs(spark, d)))


_PRED = "(SELECT *, CASE WHEN digit_share < 0.01 THEN 1 ELSE 0 END AS prediction FROM textf)"


def _predicted(spark, d):
    return v.text_features(spark, d).withColumn("prediction", (F.col("digit_share") < 0.01).cast("int"))


@query("confusion_matrix", f"""
    SELECT prediction, count(*) FILTER (quality = 0) AS actual_0, count(*) FILTER (quality = 1) AS actual_1 FROM {_PRED} GROUP BY 1""")
def _(spark, d):
    return ev.confusion_matrix(_predicted(spark, d), "prediction", "quality")


@query("classification_metrics", f"""
    SELECT toxic, {r('avg(CASE WHEN prediction = quality THEN 1.0 ELSE 0 END)')} AS accuracy,
      {r('count(*) FILTER (prediction = 1 AND quality = 1) * 1.0 / nullif(count(*) FILTER (prediction = 1), 0)')} AS precision,
      {r('count(*) FILTER (prediction = 1 AND quality = 1) * 1.0 / nullif(count(*) FILTER (quality = 1), 0)')} AS recall,
      {r('greatest(count(*) FILTER (quality = 1), count(*) FILTER (quality = 0)) * 1.0 / count(*)')} AS random_baseline
    FROM {_PRED} GROUP BY toxic""")
def _(spark, d):
    return rounded(ev.classification_metrics(_predicted(spark, d), "prediction", "quality", ["toxic"]))


@query("metric_summary", f"""
    SELECT lr, 'accuracy' AS measure, {r('avg(accuracy)', 3)} AS mean, {r('stddev_samp(accuracy)', 3)} AS std FROM runs GROUP BY 1
    UNION ALL SELECT lr, 'key', {r('avg(key)', 3)}, {r('stddev_samp(key)', 3)} FROM runs GROUP BY 1""")
def _(spark, d):
    return rounded(ev.metric_summary(v.runs(spark, d), ["lr"], ["accuracy", "key"]), 3)


_ETA = "(0.5 + 2.0 * embedding[1] - embedding[2])"


@query("information_criteria", f"""
    WITH f AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CAST(activation AS INTEGER) * {_ETA} - ln(1 + exp({_ETA}))) AS ll FROM vectors)
    SELECT CAST(2 AS BIGINT) AS k, CAST(n AS BIGINT) AS n, {r('ll')} AS log_likelihood, {r('-2 / n * ll + 2 * 2 / n')} AS aic,
      {r('-2 * ll + ln(n) * 2')} AS bic FROM f""")
def _(spark, d):
    eta = F.lit(0.5) + 2.0 * F.col("e1") - F.col("e2")
    return rounded(ev.information_criteria(flat_vectors(spark, d), F.col("activation").cast("double"), eta, 2))


@query("sign_align", f"""
    WITH s AS (SELECT CASE WHEN corr(embedding[3], CAST(activation AS INTEGER)) < 0 THEN -1.0 ELSE 1.0 END AS sign FROM vectors)
    SELECT vec_id, {r('embedding[3] * sign')} AS opinion, {r('embedding[4] * sign')} AS coef FROM vectors, s""")
def _(spark, d):
    t = flat_vectors(spark, d).select("vec_id", "activation", F.col("e3").alias("opinion"), F.col("e4").alias("coef"))
    return rounded(ev.sign_align(t, "opinion", "activation", ["coef"]).drop("activation"))


@query("gaussian_ci", f"""
    WITH c AS (SELECT feature, avg(coef) AS loc, stddev_samp(coef) / sqrt(count(*)) AS scale FROM ({_COEFS}) GROUP BY 1)
    SELECT feature, {r('loc')} AS loc, {r('scale')} AS scale, {r('loc - 1.6448536269514722 * scale')} AS ci_lower,
      {r('loc + 1.6448536269514722 * scale')} AS ci_upper, abs(loc) > 1.6448536269514722 * scale AS significant,
      {r('CASE WHEN abs(loc) > 1.6448536269514722 * scale THEN loc ELSE 0 END')} AS kept FROM c""")
def _(spark, d):
    c = _coefs(spark, d).groupBy("feature").agg(
        F.avg("coef").alias("loc"), (F.stddev_samp("coef") / F.sqrt(F.count("*"))).alias("scale"))
    return rounded(ev.gaussian_ci(c, "loc", "scale"))


@query("grid_best_report", f"""
    SELECT lr, var_opinions, count(*) AS n_runs, max(accuracy) AS best_accuracy, {r('avg(accuracy)', 3)} AS mean_accuracy
    FROM runs WHERE key > 3 GROUP BY 1, 2""")
def _(spark, d):
    return rounded(ev.grid_best_report(v.runs(spark, d), ["lr", "var_opinions"], "accuracy", "key > 3"), 3)


@query("interval_overlap_metrics", f"""
    WITH s AS (SELECT lr, key, avg(accuracy) / 100000 AS score FROM runs GROUP BY 1, 2)
    SELECT {r('sum((a.score - b.score) * (a.score - b.score))', 3)} AS distance, count(*) AS n
    FROM s a JOIN s b ON a.key = b.key WHERE a.lr = 'O' AND b.lr = 'F'""")
def _(spark, d):
    s = v.runs(spark, d).groupBy("lr", "key").agg((F.avg("accuracy") / 100000).alias("score"))
    return rounded(ev.run_distance(s, "lr", ["key"], "score", "O", "F"), 3)


@query("label_gap", f"""
    SELECT label % 2 AS part, {r('avg(embedding[1]) FILTER (activation) - avg(embedding[1]) FILTER (NOT activation)')} AS gap
    FROM vectors GROUP BY 1""")
def _(spark, d):
    t = flat_vectors(spark, d).withColumn("part", F.col("label") % 2)
    return rounded(ev.label_gap(t, "e1", "activation", ["part"]))
