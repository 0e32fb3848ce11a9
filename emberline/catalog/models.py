"""Queries for regressions and survival models (no SQL equivalent unless stated)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from emberline.catalog.aggregates import flat_vectors
from emberline.catalog.plans import long_posts
from emberline.catalog.registry import CTES, query, r, rounded, u01
from emberline.operators import models as mdl
from emberline.operators import sparse
from emberline.operators import survival as srv
from emberline.operators.evaluation import bootstrap_ci, metric_summary
from emberline.operators.topk import topk_per_group
from emberline.plans.features import vocabulary
from emberline.session import store
from emberline.sources import views as v

_DIM = 64
_ALL = [f"e{i}" for i in range(1, _DIM + 1)]
_METRICS = ["accuracy", "precision", "recall", "random_baseline"]
_GROUPS = {"first": (_ALL[:32], 6), "second": (_ALL[32:], 6)}


@query("pca_logistic")
def _(spark, d):
    return mdl.pca_logistic(flat_vectors(spark, d, _DIM), _ALL, "activation", 20)


@query("group_pca_logistic")
def _(spark, d):
    return mdl.group_pca_logistic(flat_vectors(spark, d, _DIM), _GROUPS, "activation")


@query("pca_logistic_sparse")
def _(spark, d):
    """Activation of weak authors on the communities they wrote in, of all in the vocabulary of the first 1000."""
    # the vocabulary and the lists read the posts, the lists and the names the vocabulary
    posts = store(long_posts(spark, d).select("author", "subreddit"), "posts")
    vocab = store(vocabulary(posts), "vocabulary")
    lists = posts.join(vocab, "subreddit").groupBy("author").agg(F.sort_array(F.collect_set("community")).alias("communities"))
    rows = v.authors_long(spark, d).join(lists, "author", "left").withColumn(
        "communities", F.coalesce("communities", F.array().cast("array<int>")))
    names = vocab.select(F.col("community").alias("place"), F.col("subreddit").alias("feature"))
    fit = sparse.pca_logistic_sparse(sparse.listed_flags(rows, "communities"), vocab.count(), "active", 20)
    return fit.join(names, "place").select("feature", "coef")


@query("pca_loadings_topk")
def _(spark, d):
    loadings = mdl.pca_loadings(flat_vectors(spark, d, _DIM), _ALL, 5)
    return topk_per_group(loadings, "component", "loading", 15, "feature")


@query("repeated_bootstrap_fit")
def _(spark, d):
    coefs, _ = mdl.repeated_bootstrap_fit(flat_vectors(spark, d, _DIM), _ALL, "activation", "vec_id", 20, 1000, 100, test=False)
    return bootstrap_ci(coefs)


@query("repeated_bootstrap_metrics")
def _(spark, d):
    _, runs = mdl.repeated_bootstrap_fit(flat_vectors(spark, d, _DIM), _ALL, "activation", "vec_id", 20, 100, 100)
    return metric_summary(runs.withColumn("selected_features", F.lit("all")), ["selected_features"], _METRICS)


@query("feature_group_ablation")
def _(spark, d):
    t = flat_vectors(spark, d, _DIM).drop("label")
    named = t.withColumnsRenamed(
        {f"e{i}": f"{'control' if i <= 32 else 'news'}{i}_{'short' if i % 2 else 'long'}" for i in range(1, _DIM + 1)})
    runs = mdl.feature_group_ablation(
        named, {"control": "control", "news": "news"}, "activation", "vec_id", 8, 100, 11, periods=["short", "long"],
        without=["news"])
    return metric_summary(runs, ["selected_features"], _METRICS)


@query("model_selection_aic_bic")
def _(spark, d):
    return mdl.model_selection(flat_vectors(spark, d, _DIM), _ALL, "activation", "vec_id", [2, 16, 64], 5)


@query("logit_inference")
def _(spark, d):
    t = v.text_features(spark, d).select("quality", "n_words", "digit_share", F.log1p("n_chars").alias("log_chars"))
    return mdl.logit_inference(t, ["n_words", "digit_share", "log_chars"], "quality")


def _newton(steps: int, first: str, step: str, last: str) -> str:
    """A fixed number of Newton steps, one CTE each; ``{0}`` in a step is the one before."""
    parts = [f"it0 AS ({first})", *[f"it{i + 1} AS ({step.format(f'it{i}')})" for i in range(steps)]]
    return "WITH " + ",\n".join(parts) + last.format(f"it{steps}")


_LOGIT_STEP = """
    SELECT b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1,
      h11 / (h00 * h11 - h01 * h01) AS v0, h00 / (h00 * h11 - h01 * h01) AS v1
    FROM (SELECT b0, b1, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01,
        sum(p * (1 - p) * x * x) AS h11
      FROM (SELECT b0, b1, quality AS y, ln(1 + n_chars) AS x, 1 / (1 + exp(-(b0 + b1 * ln(1 + n_chars)))) AS p FROM textf, {0})
      GROUP BY b0, b1)"""


@query("logit_inference_one", _newton(
    14, "SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1", _LOGIT_STEP, f"""
    SELECT 'log_chars' AS feature, {r('b1', 4)} AS coef, {r('sqrt(v1)', 4)} AS std_err FROM {{0}}
    UNION ALL SELECT 'intercept', {r('b0', 4)}, {r('sqrt(v0)', 4)} FROM {{0}}"""))
def _(spark, d):
    t = v.text_features(spark, d).select("quality", F.log1p("n_chars").alias("log_chars"))
    return rounded(mdl.logit_inference(t, ["log_chars"], "quality").select("feature", "coef", "std_err"), 4)


# All components of two features are a rotation, which leaves the penalty as it is: the fit is the
# penalised regression on the z-scores themselves.
_RIDGE_STEP = """
    SELECT b0 + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS b0,
      b1 + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS b1,
      b2 + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS b2
    FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det
      FROM (SELECT b0, b1, b2, sum(y - p) AS g0, sum((y - p) * z1) - b1 AS g1, sum((y - p) * z2) - b2 AS g2,
          sum(w) AS h00, sum(w * z1) AS h01, sum(w * z2) AS h02, sum(w * z1 * z1) + 1 AS h11, sum(w * z1 * z2) AS h12,
          sum(w * z2 * z2) + 1 AS h22
        FROM (SELECT *, p * (1 - p) AS w FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) AS p FROM z2features, {0}))
        GROUP BY b0, b1, b2))"""
CTES["z2features"] = """
    SELECT CAST(activation AS INTEGER) AS y, (embedding[1] - avg(embedding[1]) OVER ()) / stddev_pop(embedding[1]) OVER () AS z1,
      (embedding[2] - avg(embedding[2]) OVER ()) / stddev_pop(embedding[2]) OVER () AS z2 FROM vectors"""
_RIDGE = _newton(8, "SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2", _RIDGE_STEP, f"""
    SELECT 'e1' AS feature, {r('b1', 4)} AS coef FROM {{0}} UNION ALL SELECT 'e2', {r('b2', 4)} FROM {{0}}""")


@query("pca_logistic_two", _RIDGE)
def _(spark, d):
    return rounded(mdl.pca_logistic(flat_vectors(spark, d, 2), ["e1", "e2"], "activation", 2), 4)


@query("group_pca_logistic_two", _RIDGE)
def _(spark, d):
    groups = {"first": (["e1"], 1), "second": (["e2"], 1)}
    return rounded(mdl.group_pca_logistic(flat_vectors(spark, d, 2), groups, "activation"), 4)


def _weight(mean: float, seed: str) -> str:
    """Poisson weight of a row in a replicate."""
    steps = " + ".join(f"CAST(u >= {sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k + 1))!r} AS INTEGER)"
                       for k in range(16))
    u = u01(f"'{seed}|' || replicate || '|' || vec_id")
    return f"(SELECT {steps} FROM (SELECT {u} AS u))"


def _weighted(train: str, test: str, replicates: int, trials: str) -> str:
    """Newton steps of weighted ridge fits on two features, one fit per replicate and trial.

    ``trials`` has trial, and m1, m2 as the shares of the z-scores that a trial's features are made of.
    """
    first = f"""
      w AS (SELECT e.y, e.x1, e.x2, replicate, {train} AS w, {test} AS v
        FROM (SELECT vec_id, CAST(activation AS INTEGER) AS y, embedding[1] AS x1, embedding[2] AS x2 FROM vectors) e,
          range({replicates}) g(replicate)),
      mo AS (SELECT *, sqrt(q1 / n - a1 * a1) AS s1, sqrt(q2 / n - a2 * a2) AS s2, sign((q12 / n - a1 * a2)) AS rho FROM (
        SELECT replicate, sum(w) AS n, sum(w * x1) / sum(w) AS a1, sum(w * x2) / sum(w) AS a2, sum(w * x1 * x1) AS q1,
          sum(w * x2 * x2) AS q2, sum(w * x1 * x2) AS q12 FROM w GROUP BY replicate)),
      z AS (SELECT replicate, trial, y, w, v, CASE kind WHEN 'both' THEN (x1 - a1) / s1 WHEN 'one' THEN (x1 - a1) / s1
            WHEN 'axis' THEN ((x1 - a1) / s1 + rho * (x2 - a2) / s2) / sqrt(2) ELSE 0 END AS z1,
          CASE kind WHEN 'both' THEN (x2 - a2) / s2 WHEN 'two' THEN (x2 - a2) / s2 ELSE 0 END AS z2
        FROM w JOIN mo USING (replicate), ({trials}) t)"""
    step = """
      SELECT replicate, trial, b0 + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS b0,
        b1 + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS b1,
        b2 + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS b2
      FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det
        FROM (SELECT replicate, trial, b0, b1, b2, sum(w * (y - p)) AS g0, sum(w * (y - p) * z1) - b1 AS g1,
            sum(w * (y - p) * z2) - b2 AS g2, sum(q) AS h00, sum(q * z1) AS h01, sum(q * z2) AS h02,
            sum(q * z1 * z1) + 1 AS h11, sum(q * z1 * z2) AS h12, sum(q * z2 * z2) + 1 AS h22
          FROM (SELECT *, w * p * (1 - p) AS q FROM (
            SELECT *, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) AS p FROM z JOIN {0} USING (replicate, trial)))
          GROUP BY replicate, trial, b0, b1, b2))"""
    parts = ["it0 AS (SELECT DISTINCT replicate, trial, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM z)",
             *[f"it{i + 1} AS ({step.format(f'it{i}')})" for i in range(8)]]
    scored = """
      sc AS (SELECT replicate, trial, sum(v) AS n, coalesce(sum(v) FILTER (p AND y = 1), 0) AS tp, coalesce(sum(v) FILTER (NOT p AND y = 0), 0) AS tn,
        coalesce(sum(v) FILTER (p), 0) AS pp, coalesce(sum(v) FILTER (y = 1), 0) AS ap, sum(w) AS n_train, sum(w * (y * eta - ln(1 + exp(eta)))) AS ll
        FROM (SELECT *, b0 + b1 * z1 + b2 * z2 > 0 AS p, b0 + b1 * z1 + b2 * z2 AS eta FROM z JOIN it8 USING (replicate, trial))
        GROUP BY replicate, trial)"""
    return "WITH " + ",\n".join([first, *parts, scored])


@query("repeated_bootstrap_fit_two", _weighted(_weight(1.0, "100"), "0", 4, "SELECT 'all' AS trial, 'both' AS kind") + f"""
    SELECT replicate::INTEGER AS replicate, 'e1' AS feature, {r('b1', 4)} AS coef FROM it8
    UNION ALL SELECT replicate::INTEGER, 'e2', {r('b2', 4)} FROM it8""")
def _(spark, d):
    coefs, _ = mdl.repeated_bootstrap_fit(flat_vectors(spark, d, 2), ["e1", "e2"], "activation", "vec_id", 2, 4, 100, test=False)
    return rounded(coefs, 4)


_TRIALS = [("only_control", "one"), ("only_news", "two"), ("no_control", "two"), ("no_news", "one"), ("all", "both")]
_RATE = {"accuracy": "(tp + tn) / n", "precision": "tp / nullif(pp, 0)", "recall": "tp / nullif(ap, 0)", "random_baseline": "greatest(ap, n - ap) / n"}


@query("feature_group_ablation_two", _weighted(
    _weight(0.75, "11-train"), _weight(0.25, "11-test"), 6,
    " UNION ALL ".join(f"SELECT '{t}' AS trial, '{k}' AS kind" for t, k in _TRIALS)) + " UNION ALL ".join(
    f" SELECT trial AS selected_features, '{m}' AS measure, {r(f'avg({x})')} AS mean, {r(f'stddev_samp({x})')} AS std FROM sc GROUP BY trial"
    for m, x in _RATE.items()))
def _(spark, d):
    named = flat_vectors(spark, d, 2).drop("label").withColumnsRenamed({"e1": "control_short", "e2": "news_short"})
    runs = mdl.feature_group_ablation(named, {"control": "control", "news": "news"}, "activation", "vec_id", 2, 6, 11)
    return rounded(metric_summary(runs, ["selected_features"], _METRICS))


@query("model_selection_two", _weighted(
    f"CAST({u01("'5|' || vec_id")} < 0.75 AS INTEGER)", f"CAST({u01("'5|' || vec_id")} >= 0.75 AS INTEGER)", 1,
    "SELECT '1' AS trial, 'axis' AS kind UNION ALL SELECT '2', 'both'") + f"""
    SELECT CAST(trial AS INTEGER) AS k, {r('(tp + tn) / n')} AS accuracy, {r('ll', 3)} AS log_likelihood,
      {r('-2 / n_train * ll + 2 * CAST(trial AS INTEGER) / n_train', 3)} AS aic, {r('-2 * ll + ln(n_train) * CAST(trial AS INTEGER)', 3)} AS bic
    FROM sc""")
def _(spark, d):
    found = mdl.model_selection(flat_vectors(spark, d, 2), ["e1", "e2"], "activation", "vec_id", [1, 2], 5)
    return rounded(rounded(found, 6).select("k", "accuracy", *[F.round(c, 3).alias(c) for c in ("log_likelihood", "aic", "bic")]), 6)


# Efron: of d deaths at one duration the l-th leaves l/d of the deaths' risk out
_COX_STEP = """
    SELECT b + sum(g) / sum(h) AS b, 1 / sum(h) AS v FROM (
      SELECT b, CASE WHEN l = 0 THEN x1 ELSE 0 END - m1 AS g, m2 - m1 * m1 AS h FROM (
        SELECT b, l, x1, (s1 - l * e1 / d) / (s0 - l * e0 / d) AS m1, (s2 - l * e2 / d) / (s0 - l * e0 / d) AS m2 FROM (
          SELECT *, unnest(range(d)) AS l FROM (
            SELECT b, duration, d, x1, e0, e1, e2, sum(a0) OVER w AS s0, sum(a1) OVER w AS s1, sum(a2) OVER w AS s2 FROM (
              SELECT b, duration, count(*) FILTER (event) AS d, sum(x) FILTER (event) AS x1,
                sum(r) AS a0, sum(r * x) AS a1, sum(r * x * x) AS a2,
                sum(r) FILTER (event) AS e0, sum(r * x) FILTER (event) AS e1, sum(r * x * x) FILTER (event) AS e2
              FROM (SELECT b, duration, event, CAST(l_quantity AS DOUBLE) AS x, exp(b * l_quantity) AS r FROM surv, {0})
              GROUP BY b, duration)
            WINDOW w AS (ORDER BY duration DESC ROWS UNBOUNDED PRECEDING)))))
    GROUP BY b"""


@query("cox_ph_one", _newton(6, "SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS v", _COX_STEP, f"""
    SELECT 'l_quantity' AS feature, {r('b', 7)} AS coef, {r('sqrt(v)', 7)} AS std_err FROM {{0}}"""))
def _(spark, d):
    fit = srv.cox_ph(v.survival(spark, d), "duration", "event", ["l_quantity"])
    return rounded(fit.select("feature", "coef", "std_err"), 7)


_COX = ["l_quantity", "l_discount", "l_tax"]


def _cox_step(xs: list[str]) -> str:
    """A Newton step for three covariates, every death of a duration a row of its own."""
    k, pairs = range(3), [(i, j) for i in range(3) for j in range(i, 3)]
    beta = ", ".join(f"b{i}" for i in k)
    sums = ", ".join([f"sum(r){{f}} AS {{p}}0", *[f"sum(r * x{i}){{f}} AS {{p}}1{i}" for i in k],
                      *[f"sum(r * x{i} * x{j}){{f}} AS {{p}}2{i}{j}" for i, j in pairs]])
    names = ["0", *[f"1{i}" for i in k], *[f"2{i}{j}" for i, j in pairs]]
    grouped = f"""
      SELECT {beta}, duration, count(*) FILTER (event) AS d, {", ".join(f"sum(x{i}) FILTER (event) AS t{i}" for i in k)},
        {sums.format(f="", p="a")}, {sums.format(f=" FILTER (event)", p="e")}
      FROM (SELECT *, exp({" + ".join(f"b{i} * x{i}" for i in k)}) AS r
        FROM (SELECT duration, event, {", ".join(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(xs))} FROM surv), {{0}})
      GROUP BY {beta}, duration"""
    risk = f"""
      SELECT {beta}, d, {", ".join(f"t{i}" for i in k)}, {", ".join(f"e{n}" for n in names)},
        {", ".join(f"sum(a{n}) OVER w AS s{n}" for n in names)} FROM ({grouped})
      WINDOW w AS (ORDER BY duration DESC ROWS UNBOUNDED PRECEDING)"""
    means = f"""
      SELECT {beta}, l, {", ".join(f"t{i}" for i in k)},
        {", ".join(f"(s{n} - l * e{n} / d) / (s0 - l * e0 / d) AS m{n}" for n in names[1:])}
      FROM (SELECT *, unnest(range(d)) AS l FROM ({risk}))"""
    total = f"""
      SELECT {beta}, {", ".join(f"sum(CASE WHEN l = 0 THEN t{i} ELSE 0 END - m1{i}) AS g{i}" for i in k)},
        {", ".join(f"sum(m2{i}{j} - m1{i} * m1{j}) AS h{i}{j}" for i, j in pairs)}
      FROM ({means}) GROUP BY {beta}"""

    def h(i: int, j: int) -> str:
        return f"h{min(i, j)}{max(i, j)}"

    def inverse(i: int, j: int) -> str:
        (a, b), (c, e) = [n for n in k if n != i], [n for n in k if n != j]
        return f"{'' if (i + j) % 2 == 0 else '-'}({h(a, c)} * {h(b, e)} - {h(a, e)} * {h(b, c)}) / det"

    det = " + ".join(f"h0{j} * {'' if j % 2 == 0 else '-'}1 * ({h(1, a)} * {h(2, b)} - {h(1, b)} * {h(2, a)})"
                     for j in k for a, b in [[n for n in k if n != j]])
    steps = ", ".join(f"b{i} + " + " + ".join(f"({inverse(i, j)}) * g{j}" for j in k) + f" AS b{i}, {inverse(i, i)} AS v{i}" for i in k)
    return f"SELECT {steps} FROM (SELECT *, {det} AS det FROM ({total}))"


@query("cox_ph", _newton(
    6, "SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}, 0.0::DOUBLE AS v{i}" for i in range(3)), _cox_step(_COX),
    " UNION ALL ".join(f"SELECT '{x}' AS feature, {r(f'b{i}')} AS coef, {r(f'sqrt(v{i})')} AS std_err FROM {{0}}"
                       for i, x in enumerate(_COX))))
def _(spark, d):
    fit = srv.cox_ph(v.survival(spark, d), "duration", "event", _COX)
    return rounded(fit.select("feature", "coef", "std_err"))


@query("cox_pca")
def _(spark, d):
    return srv.cox_pca(v.survival(spark, d), "duration", "event", [*_COX, "l_extendedprice"], 3, alpha=0.5)


@query("concordance", f"""
    WITH g AS (SELECT duration, event, round(l_quantity - 10 * l_discount, 6) AS eta, count(*) AS n FROM surv GROUP BY 1, 2, 3)
    SELECT {r('''sum(CASE WHEN b.eta < a.eta THEN 1.0 WHEN b.eta = a.eta THEN 0.5 ELSE 0 END * a.n * b.n) / sum(1.0 * a.n * b.n)''')} AS concordance
    FROM g a JOIN g b ON a.event AND (b.duration > a.duration OR (b.duration = a.duration AND NOT b.event))""")
def _(spark, d):
    eta = F.round(F.col("l_quantity") - 10 * F.col("l_discount"), 6)
    return rounded(srv.concordance(v.survival(spark, d), "duration", "event", eta))
