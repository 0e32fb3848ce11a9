"""Cox proportional hazards with Efron's ties.

Each Newton step groups the rows by duration and sums up risk sets from the longest duration on.
Durations are cut into buckets along approximate quantiles, so the running totals are a window per
bucket on top of one offset a bucket, and any number of distinct durations will do.  Efron's sums
over the deaths of a duration are differences of the digamma, trigamma and log-gamma functions, so
a duration costs the same with one death or a million.  One row of sums per step reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.models import assemble, population_factor, standardiser
from emberline.operators.ordering import running_totals
from emberline.session import store

#: Buckets of durations, and terms of Efron's sums that are added one by one before the series is exact.
BUCKETS, DIRECT = 128, 8


@dataclass
class CoxFit:
    features: list[str]
    coef: np.ndarray
    std_err: np.ndarray
    p: np.ndarray
    log_likelihood: float
    iterations: int

    def table(self, spark) -> DataFrame:
        rows = [
            (f, float(c), float(s), float(p))
            for f, c, s, p in zip(self.features, self.coef, self.std_err, self.p)
        ]
        return spark.createDataFrame(rows, "feature string, coef double, std_err double, p double")


def _eta(xs: Sequence[str], beta: np.ndarray, shift: float) -> Column:
    terms = [F.col(x) * F.lit(float(b)) for x, b in zip(xs, beta)]
    return sum(terms[1:], terms[0]) - F.lit(shift)


def _series(x0: Column, r: Column) -> tuple[Column, Column, Column]:
    """Sums of log x, 1 / x and 1 / x^2 over x = x0, x0 + 1, ... (``r`` terms, x0 above DIRECT).

    Differences of Stirling's series and its derivatives, written so that nothing large cancels.
    """
    x1, grow = x0 + r, F.log1p(r / x0)

    def fall(power: int) -> Column:
        return F.pow(x1, F.lit(-power)) - F.pow(x0, F.lit(-power))

    logs = r * F.log(x0) + (x1 - 0.5) * grow - r + fall(1) / 12 - fall(3) / 360 + fall(5) / 1260 - fall(7) / 1680
    inverse = grow - fall(1) / 2 - fall(2) / 12 + fall(4) / 120 - fall(6) / 252 + fall(8) / 240 - fall(10) / 132
    squares = r / (x0 * x1) - fall(2) / 2 - fall(3) / 6 + fall(5) / 30 - fall(7) / 42 + fall(9) / 30 - fall(11) * 5 / 66
    return logs, inverse, squares


def efron_sums(s0: Column, e0: Column, deaths: Column) -> tuple[Column, Column, Column]:
    """Sums over l < deaths of log, inverse and inverse square of s0 - l / deaths * e0.

    The terms are e0 / deaths times b + 1, ..., b + deaths with b = deaths * s0 / e0 - deaths.
    """
    unit = e0 / deaths
    b = F.greatest(deaths * (s0 - e0) / e0, F.lit(0.0))
    zero = F.lit(0.0)
    direct = [[F.when(deaths >= i, f(b + i)).otherwise(zero) for i in range(1, DIRECT + 1)]
              for f in (F.log, lambda x: 1 / x, lambda x: 1 / (x * x))]
    first = [sum(terms[1:], terms[0]) for terms in direct]
    rest = _series(b + DIRECT + 1, (deaths - DIRECT).cast("double"))
    logs, inverse, squares = (a + F.when(deaths > DIRECT, c).otherwise(zero) for a, c in zip(first, rest))
    return deaths * F.log(unit) + logs, inverse / unit, squares / (unit * unit)


def _upper(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i, d)]


def _risk_sets(rows: DataFrame, duration: str, event: str, xs: Sequence[str], beta: np.ndarray, shift: float) -> DataFrame:
    """Per duration with deaths: d, sums over the deaths (e*) and over the risk set (s*) of risk, risk*x and risk*x*x'."""
    w, e = F.col("_w"), F.col(event)
    upper = _upper(len(xs))
    moments = [w, *[w * F.col(x) for x in xs], *[w * F.col(xs[i]) * F.col(xs[j]) for i, j in upper]]
    rows = rows.withColumn("_w", F.exp(_eta(xs, beta, shift)))
    m = range(len(moments))
    grouped = rows.groupBy("_bucket", duration).agg(
        F.count_if(e).alias("d"), *[F.sum(x).alias(f"a{i}") for i, x in enumerate(moments)],
        *[F.coalesce(F.sum(F.when(e, x)), F.lit(0.0)).alias(f"e{i}") for i, x in enumerate(moments)],
        *[F.coalesce(F.sum(F.when(e, F.col(x))), F.lit(0.0)).alias(f"x{i}") for i, x in enumerate(xs)])
    # at most BUCKETS rows
    later = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = grouped.groupBy("_bucket").agg(*[F.sum(f"a{i}").alias(f"a{i}") for i in m]).select(
        "_bucket", *[F.coalesce(F.sum(f"a{i}").over(later), F.lit(0.0)).alias(f"o{i}") for i in m])
    inside = Window.partitionBy("_bucket").orderBy(F.desc(duration)).rowsBetween(Window.unboundedPreceding, 0)
    totals = grouped.select("*", *[F.sum(f"a{i}").over(inside).alias(f"t{i}") for i in m]).filter("d > 0")
    return totals.join(offsets, "_bucket").select(
        "d", *[f"e{i}" for i in m], *[f"x{i}" for i in range(len(xs))],
        *[(F.col(f"o{i}") + F.col(f"t{i}")).alias(f"s{i}") for i in m])


def _likelihood(sets: DataFrame, beta: np.ndarray, shift: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partial likelihood, gradient and information at ``beta``, in one row."""
    k, upper = len(beta), _upper(len(beta))
    logs, inv, inv2 = efron_sums(F.col("s0"), F.col("e0"), F.col("d"))
    # (s - f e) / (s0 - f e0) is linear in 1 / (s0 - f e0) for each moment
    split = {}
    for i in range(1, 1 + k + len(upper)):
        split[f"c{i}"] = F.col(f"e{i}") / F.col("e0")
        split[f"r{i}"] = F.col(f"s{i}") - F.col(f"e{i}") / F.col("e0") * F.col("s0")
    sets = sets.withColumns({"_logs": logs, "_inv": inv, "_inv2": inv2, **split})
    d, inv, inv2 = F.col("d"), F.col("_inv"), F.col("_inv2")
    c = [F.col(f"c{i}") for i in range(1, 1 + k + len(upper))]
    r = [F.col(f"r{i}") for i in range(1, 1 + k + len(upper))]
    dot = sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
    sums = [dot - d * shift - F.col("_logs"), *[F.col(f"x{i}") - (d * c[i] + r[i] * inv) for i in range(k)]]
    for n, (i, j) in enumerate(upper, k):
        sums.append(d * (c[n] - c[i] * c[j]) + inv * (r[n] - c[i] * r[j] - r[i] * c[j]) - inv2 * r[i] * r[j])
    row = sets.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"_{i}") for i, x in enumerate(sums)]).first()
    info = np.zeros((k, k))
    for n, (i, j) in enumerate(upper, 1 + k):
        info[i, j] = info[j, i] = row[n]
    return row[0], np.array(row[1:1 + k]), info


def _bucketed(df: DataFrame, duration: str, buckets: int) -> DataFrame:
    """The rows with ``_bucket``; the cuts only balance the work."""
    cuts = df.agg(F.percentile_approx(duration, [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []
    points = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    return df.withColumn("_bucket", F.size(F.filter(points, lambda c: c < F.col(duration))) if cuts else F.lit(0))


def fit_cox(df: DataFrame, duration: str, event: str, xs: Sequence[str], max_iter: int = 25,
            tol: float = 1e-9) -> CoxFit:
    """Newton steps, halved while the likelihood falls."""
    xs = list(xs)
    # each step reads the rows again: write them once, without what the fit doesn't need
    df = store(df.select(duration, event, *xs), "cox-rows")
    df = store(_bucketed(df, duration, BUCKETS), "cox")
    means = df.agg(*[F.avg(x) for x in xs]).first()
    centre = np.array([float(v) for v in means])
    beta, step = np.zeros(len(xs)), np.zeros(len(xs))
    best = -math.inf
    info = np.eye(len(xs))
    for it in range(max_iter):
        trial = beta + step
        shift = float(trial @ centre)
        ll, grad, now = _likelihood(_risk_sets(df, duration, event, xs, trial, shift), trial, shift)
        if not math.isfinite(ll) or ll < best - 1e-9 * abs(best):
            step = step / 2
            continue
        done = it > 0 and abs(ll - best) <= tol * (abs(ll) + tol)
        beta, best, info = trial, ll, now
        if done:
            break
        step = np.linalg.solve(info, grad)
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    p = np.array([math.erfc(abs(b / s) / math.sqrt(2)) for b, s in zip(beta, se)])
    return CoxFit(xs, beta, se, p, best, it + 1)


def cox_ph(df: DataFrame, duration: str, event: str, xs: Sequence[str]) -> DataFrame:
    """Coefficient, standard error and p-value per covariate."""
    return fit_cox(df, duration, event, xs).table(df.sparkSession)


def cox_pca(df: DataFrame, duration: str, event: str, features: Sequence[str], k: int,
            alpha: float = 0.05) -> DataFrame:
    """Cox on the first components of the standardised features, carried back to the features.

    Only components with p below ``alpha`` count, as in the usual reading of the fit.
    """
    vectors = store(assemble(df.withColumn("_y", F.col(event)), features, "_y", keep=[duration, event]), "cox-vectors")
    scaled = standardiser(vectors).transform(vectors)
    factor = population_factor(vectors.count())
    pca = PCA(k=k, inputCol="_z", outputCol="pc").fit(scaled)
    pcs = [f"pc{i}" for i in range(k)]
    array = vector_to_array(F.col("pc"))
    scores = pca.transform(scaled).select(duration, event, *[array[i].alias(n) for i, n in enumerate(pcs)])
    fit = fit_cox(scores, duration, event, pcs)
    kept = np.where(fit.p < alpha, fit.coef, 0.0)
    back = pca.pc.toArray() @ kept / factor
    rows = [(f, float(c)) for f, c in zip(features, back)]
    return df.sparkSession.createDataFrame(rows, "feature string, coef double")


def _outlast(rows: DataFrame, group: Sequence[str]) -> float:
    """Pairs of an event (``e``) with the rows (``ev``, ``ce``) of its group that outlast it.

    ``rows`` has one row per group and duration ``t``, so no window holds more than the durations.
    """
    longer = Window.partitionBy(*group).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    more = F.coalesce(F.sum(F.col("ev") + F.col("ce")).over(longer), F.lit(0)) + F.col("ce")
    pairs = rows.select((F.col("e").cast("double") * more).alias("pairs"))
    return pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]


def concordance(df: DataFrame, duration: str, event: str, eta: Column) -> DataFrame:
    """Share of comparable pairs that the risk orders rightly; equal risks count half.

    A pair is comparable when the earlier one is an event, or at equal durations when exactly
    one is.  Pairs are never listed: risks are ranked, and two ranks differ first at one binary
    digit, so a pair is counted in the group that shares the digits before it.  Per digit and
    group the rows are summed by duration, which leaves running totals over durations.
    """
    counted = store(
        df.withColumn("_eta", eta).groupBy("_eta", F.col(duration).alias("t")).agg(
            F.count_if(F.col(event)).alias("ev"), F.count_if(~F.col(event)).alias("ce")),
        "concordance")
    ranks = running_totals(counted.select("_eta").distinct(), [], "_eta", {"one": F.lit(1)})
    rows = store(counted.join(ranks.select("_eta", F.col("before_one").alias("rank")), "_eta"), "concordance")
    digits = max(1, int(ranks.count()).bit_length())
    each = rows.withColumn("digit", F.explode(F.sequence(F.lit(0), F.lit(digits - 1))))
    upper = (F.expr("shiftright(rank, digit)") % 2) == 1
    zero = F.lit(0)
    split = each.groupBy("digit", F.expr("shiftright(rank, digit + 1)").alias("prefix"), "t").agg(
        F.sum(F.when(upper, F.col("ev")).otherwise(zero)).alias("e"),
        F.sum(F.when(upper, zero).otherwise(F.col("ev"))).alias("ev"),
        F.sum(F.when(upper, zero).otherwise(F.col("ce"))).alias("ce"))
    right = _outlast(split, ["digit", "prefix"])
    tied = _outlast(rows.withColumn("e", F.col("ev")), ["rank"])
    every = rows.groupBy("t").agg(F.sum("ev").alias("ev"), F.sum("ce").alias("ce")).withColumn("e", F.col("ev"))
    comparable = _outlast(every.withColumn("g", zero), ["g"])
    value = (right + tied / 2) / comparable if comparable else None
    return df.sparkSession.createDataFrame([(value,)], "concordance double")
