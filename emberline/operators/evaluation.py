"""Confusion tables, resampling summaries and information criteria."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.numeric import pearson
from emberline.operators.aggregates import summary_by


def bootstrap_ci(coefs: DataFrame, value: str = "coef", by: Sequence[str] = ("feature",)) -> DataFrame:
    """Mean and central 95 % of each coefficient; significant if both bounds share a sign.

    A group holds one value per replicate, which bounds the exact percentile's state.
    """
    ci = coefs.groupBy(*by).agg(
        F.avg(value).alias("coef"),
        F.percentile(value, [0.025, 0.975]).alias("_q"),
    )
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    return ci.select(
        *by, "coef", lo.alias("ci_lower"), hi.alias("ci_upper"), (lo * hi > 0).alias("significant")
    )


def bootstrap_pvalue(coefs: DataFrame, value: str = "coef", by: Sequence[str] = ("feature",)) -> DataFrame:
    """Mean, sign-based p-value and exponential of each coefficient."""
    above = F.avg((F.col(value) > 0).cast("double"))
    return coefs.groupBy(*by).agg(
        F.avg(value).alias("coefficient"),
        F.least(above, 1 - above).alias("p"),
        F.exp(F.avg(value)).alias("exp_coefficient"),
    )


def confusion_matrix(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Rows are predictions, columns actual classes 0 and 1."""
    return df.groupBy(predicted).agg(
        F.count_if(F.col(actual) == 0).alias("actual_0"),
        F.count_if(F.col(actual) == 1).alias("actual_1"),
    )


def classification_metrics(df: DataFrame, predicted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and the share of the larger class, in one aggregate."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    cells = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(p & a).alias("tp"),
        F.count_if(~p & ~a).alias("tn"),
        F.count_if(p).alias("pp"),
        F.count_if(a).alias("ap"),
    )
    return cells.select(
        *by,
        F.try_divide(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        F.try_divide("tp", "pp").alias("precision"),
        F.try_divide("tp", "ap").alias("recall"),
        F.try_divide(F.greatest("ap", F.col("n") - F.col("ap")), F.col("n")).alias("random_baseline"),
    )


def metric_summary(runs: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and deviation of each metric over runs."""
    return summary_by(runs, by, metrics)


def log_likelihood(label: Column, eta: Column) -> Column:
    """Bernoulli log-likelihood of a linear predictor, stable for large values."""
    softplus = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
    return F.sum(label * eta - softplus)


def aic(n: Column, ll: Column, k: Column) -> Column:
    """Per-observation AIC."""
    return -2 / n * ll + 2 * k / n


def bic(n: Column, ll: Column, k: Column) -> Column:
    return -2 * ll + F.log(n) * k


def information_criteria(df: DataFrame, label: Column, eta: Column, k: int) -> DataFrame:
    fit = df.agg(F.count("*").alias("n"), log_likelihood(label, eta).alias("ll"))
    kk = F.lit(float(k))
    return fit.select(
        F.lit(k).cast("long").alias("k"), "n", F.col("ll").alias("log_likelihood"),
        aic(F.col("n"), F.col("ll"), kk).alias("aic"), bic(F.col("n"), F.col("ll"), kk).alias("bic"),
    )


def sign_align(scores: DataFrame, score: str, label: str, coefs: Sequence[str] = ()) -> DataFrame:
    """Turn the score, and every coefficient tied to it, when it opposes the label."""
    corr = scores.agg(pearson(F.col(score), F.col(label))).first()[0]
    sign = -1.0 if corr is not None and corr < 0 else 1.0
    return scores.withColumns({c: F.col(c) * F.lit(sign) for c in [score, *coefs]})


def gaussian_ci(coefs: DataFrame, loc: str, scale: str, level: float = 0.9) -> DataFrame:
    """Central interval of a normal coefficient, significance, and the value or zero."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    lo, hi = F.col(loc) - z * F.col(scale), F.col(loc) + z * F.col(scale)
    sure = (lo > 0) | (hi < 0)
    return coefs.withColumns({
        "ci_lower": lo, "ci_upper": hi, "significant": sure,
        "kept": F.when(sure, F.col(loc)).otherwise(F.lit(0.0)),
    })


def run_distance(scores: DataFrame, run: str, key: Sequence[str], value: str,
                 a: str, b: str) -> DataFrame:
    """Squared distance between the scores of two runs over their common keys."""
    one = scores.filter(F.col(run) == a).select(*key, F.col(value).alias("_a"))
    two = scores.filter(F.col(run) == b).select(*key, F.col(value).alias("_b"))
    gap = F.col("_a") - F.col("_b")
    return one.join(two, list(key)).agg(F.sum(gap * gap).alias("distance"), F.count("*").alias("n"))


def label_gap(scores: DataFrame, value: str, label: str, by: Sequence[str]) -> DataFrame:
    """Mean score of positives minus mean score of negatives."""
    y = F.col(label)
    return scores.groupBy(*by).agg(
        (F.avg(F.when(y, F.col(value))) - F.avg(F.when(~y, F.col(value)))).alias("gap")
    )


def grid_best_report(runs: DataFrame, settings: Sequence[str], metric: str,
                     where: str | None = None) -> DataFrame:
    """Runs, best and mean metric per combination of settings, best first."""
    rows = runs.filter(where) if where else runs
    report = rows.groupBy(*settings).agg(
        F.count("*").alias("n_runs"),
        F.max(metric).alias(f"best_{metric}"),
        F.avg(metric).alias(f"mean_{metric}"),
    )
    return report.orderBy(F.desc(f"best_{metric}"), *settings)
