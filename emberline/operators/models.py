"""Regressions on principal components, fitted by Spark ML.

Scaling, components and scores are Spark ML transformers, so matrices stay on the JVM and no
coefficient is spelled out in a plan.  Only coefficients and component matrices (features x
components) come to Python.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, StandardScalerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.batchfit import Fit, fit_all, resampled, split_once
from emberline.operators.evaluation import aic, bic
from emberline.operators.sampling import train_test_split


@dataclass
class PcaLogistic:
    """A fitted model, expressed on the standardised features."""

    features: list[str]
    coef: list[float]
    intercept: float
    stages: PipelineModel

    def table(self, spark) -> DataFrame:
        rows = [(f, float(c)) for f, c in zip(self.features, self.coef)]
        return spark.createDataFrame(rows, "feature string, coef double")

    def scored(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` with ``eta``, the linear predictor, and ``prediction`` (0 or 1)."""
        eta = vector_to_array(F.col("_raw"))[1]
        return self.stages.transform(vectors).select(*vectors.columns, eta.alias("eta"), "prediction")


def assemble(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Label as 0/1, the kept columns, and one vector of the features."""
    numeric = df.select(
        *keep, F.col(label).cast("double").alias("label"),
        *[F.col(f).cast("double").alias(f) for f in features],
    )
    vector = VectorAssembler(inputCols=list(features), outputCol="features")
    return vector.transform(numeric).select(*keep, "label", "features")


def standardiser(vectors: DataFrame) -> StandardScalerModel:
    """z-scores with the sample deviation into ``_z``; a constant feature becomes zero."""
    return StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="_z").fit(vectors)


def population_factor(n: int) -> float:
    """What turns z-scores with the sample deviation into those with the population's."""
    return math.sqrt(n / (n - 1)) if n > 1 else 1.0


def fit_pca_logistic(vectors: DataFrame, features: Sequence[str], k: int) -> PcaLogistic:
    """z-score, first ``k`` components, logistic, coefficients carried back to the features."""
    return fit_group_pca_logistic(vectors, features, {"all": (list(features), k)})


def fit_group_pca_logistic(vectors: DataFrame, features: Sequence[str],
                           groups: Mapping[str, tuple[Sequence[str], int]]) -> PcaLogistic:
    """As :func:`fit_pca_logistic`, with separate components for each group of features.

    The penalty is half the squared norm per whole sample, for population z-scores.  Spark
    scales by the sample deviation; the one factor between them goes into the penalty.
    """
    features = list(features)
    place = {f: i for i, f in enumerate(features)}
    scaler = standardiser(vectors)
    scaled = scaler.transform(vectors).select("label", "_z").persist()
    try:
        n = scaled.count()
        stages, loadings, outputs = [scaler], [], []
        for g, (columns, k) in enumerate(groups.values()):
            idx = [place[c] for c in columns]
            part, rows = "_z", scaled
            if idx != list(range(len(features))):
                part = f"_part{g}"
                stages.append(VectorSlicer(inputCol="_z", outputCol=part, indices=idx))
                rows = stages[-1].transform(scaled)
            pca = PCA(k=min(k, len(idx)), inputCol=part, outputCol=f"_pc{g}").fit(rows)
            block = np.zeros((len(features), pca.getK()))
            block[idx, :] = pca.pc.toArray()
            stages.append(pca)
            loadings.append(block)
            outputs.append(f"_pc{g}")
        stages.append(VectorAssembler(inputCols=outputs, outputCol="_pcs"))
        factor = population_factor(n)
        projected = PipelineModel(stages[1:]).transform(scaled).select("label", "_pcs")
        model = LogisticRegression(
            featuresCol="_pcs", labelCol="label", regParam=1.0 / n / factor**2, elasticNetParam=0.0,
            standardization=False, maxIter=200, tol=1e-10, rawPredictionCol="_raw", probabilityCol="_p",
        ).fit(projected)
        coef = np.hstack(loadings) @ model.coefficients.toArray() / factor
        return PcaLogistic(features, [float(c) for c in coef], float(model.intercept),
                           PipelineModel([*stages, model]))
    finally:
        scaled.unpersist()


def pca_logistic(df: DataFrame, features: Sequence[str], label: str, k: int) -> DataFrame:
    """Coefficient of each standardised feature."""
    vectors = assemble(df, features, label)
    return fit_pca_logistic(vectors, features, k).table(df.sparkSession)


def group_pca_logistic(df: DataFrame, groups: Mapping[str, tuple[Sequence[str], int]],
                       label: str) -> DataFrame:
    features = [c for columns, _ in groups.values() for c in columns]
    vectors = assemble(df, features, label)
    return fit_group_pca_logistic(vectors, features, groups).table(df.sparkSession)


def _fits(features: Sequence[str], groups: Mapping[str, tuple[Sequence[str], int]], name: str,
          replicates: int) -> list[Fit]:
    place = {f: i for i, f in enumerate(features)}
    parts = tuple((tuple(place[c] for c in columns), k) for columns, k in groups.values())
    return [Fit(name, b, parts) for b in range(replicates)]


def _rates() -> list[Column]:
    """Accuracy, precision, recall and the share of the larger class out of weighted counts."""
    n, tp, tn, pp, ap = (F.col(c) for c in ("n", "tp", "tn", "pp", "ap"))
    return [F.try_divide(tp + tn, n).alias("accuracy"), F.try_divide(tp, pp).alias("precision"),
            F.try_divide(tp, ap).alias("recall"), F.try_divide(F.greatest(ap, n - ap), n).alias("random_baseline")]


def repeated_bootstrap_fit(df: DataFrame, features: Sequence[str], label: str, key: str, k: int,
                           replicates: int, seed: int | str,
                           groups: Mapping[str, tuple[Sequence[str], int]] | None = None,
                           test: bool = True) -> tuple[DataFrame, DataFrame]:
    """Coefficients and test metrics of each resample, fitted together in weighted passes over the rows.

    Returns (replicate, feature, coef) and (replicate, accuracy, precision, recall,
    random_baseline); with ``test`` a quarter of the copies is held out.
    """
    fits = _fits(features, groups or {"all": (list(features), k)}, "all", replicates)
    rows = resampled(df, features, label, key, replicates, seed, 0.75 if test else None)
    fitted = fit_all(rows, features, fits)
    replicate = F.col("id").cast("int").alias("replicate")
    metrics = fitted.scores().select(replicate, *_rates())
    return (fitted.coefficients().select(replicate, "feature", "coef"),
            metrics if test else metrics.limit(0))


def select_group_columns(columns: Sequence[str], groups: Mapping[str, str], chosen: Sequence[str],
                         period: str | None = None) -> list[str]:
    """Columns whose name starts with the pattern of a chosen group and ends with a period."""
    rx = [re.compile(groups[g]) for g in chosen]
    names = [c for c in columns if any(r.match(c) for r in rx)]
    return [c for c in names if period is None or c.endswith(period)]


def feature_group_ablation(df: DataFrame, groups: Mapping[str, str], label: str, key: str, k: int,
                           replicates: int, seed: int | str, periods: Sequence[str] = (),
                           without: Sequence[str] = ()) -> DataFrame:
    """Test metrics with only one group, without one group, per period, and with everything.

    ``without`` names groups that a second series of period runs leaves out.  All trials see the
    same resamples, and all fits of all trials share the passes over the rows.
    """
    columns = [c for c in df.columns if c not in (label, key)]
    names = list(groups)
    trials = {f"only_{g}": ([g], None) for g in names}
    trials.update({f"no_{g}": ([h for h in names if h != g], None) for g in names})
    trials["all"] = (names, None)
    trials.update({f"all_{p}": (names, p) for p in periods})
    rest = [g for g in names if g not in without]
    if without:
        trials["reduced"] = (rest, None)
        trials.update({f"reduced_{p}": (rest, p) for p in periods})
    fits: list[Fit] = []
    for name, (chosen, period) in trials.items():
        features = select_group_columns(columns, groups, chosen, period)
        if features:
            fits += _fits(columns, {"all": (features, k)}, name, replicates)
    rows = resampled(df, columns, label, key, replicates, seed, 0.75)
    scores = fit_all(rows, columns, fits).scores()
    trial = F.element_at(F.array(*[F.lit(f.name) for f in fits]), F.col("id").cast("int") + 1)
    replicate = F.element_at(F.array(*[F.lit(f.replicate) for f in fits]), F.col("id").cast("int") + 1)
    return scores.select(trial.alias("selected_features"), replicate.alias("replicate"), *_rates())


def model_selection(df: DataFrame, features: Sequence[str], label: str, key: str, ks: Sequence[int],
                    seed: int | str, with_intercept: bool = True) -> DataFrame:
    """Accuracy, log-likelihood, AIC and BIC for several numbers of components.

    ``with_intercept=False`` leaves the intercept out of the log-likelihood.
    """
    split = train_test_split(df, key, seed)
    rows = split_once(split, features, label, F.col("is_train"))
    place = tuple(range(len(features)))
    fitted = fit_all(rows, features, [Fit(str(k), 0, ((place, k),)) for k in ks])
    k = F.element_at(F.array(*[F.lit(int(k)) for k in ks]), F.col("id").cast("int") + 1)
    n, ll = F.col("n_train"), F.col("ll" if with_intercept else "ll_without")
    scores = fitted.scores()
    return scores.select(
        k.alias("k"), *_rates()[:1], ll.alias("log_likelihood"), aic(n, ll, k.cast("double")).alias("aic"),
        bic(n, ll, k.cast("double")).alias("bic"))


def logit_inference(df: DataFrame, features: Sequence[str], label: str, alpha: float = 0.05) -> DataFrame:
    """Unpenalised logistic regression: coefficient, standard error, p-value and direction."""
    vectors = assemble(df, features, label)
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="label", maxIter=50)
    model = glm.fit(vectors)
    summary = model.summary
    names = [*features, "intercept"]
    coefs = [*model.coefficients.toArray(), model.intercept]
    rows = []
    for name, c, se, p in zip(names, coefs, summary.coefficientStandardErrors, summary.pValues):
        sign = 0 if p >= alpha else (1 if c > 0 else -1)
        rows.append((name, float(c), float(se), float(p), sign))
    return df.sparkSession.createDataFrame(
        rows, "feature string, coef double, std_err double, p double, predictor int"
    )


def pca_loadings(df: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """(component, feature, loading) of the standardised features."""
    vectors = assemble(df.withColumn("_y", F.lit(0.0)), features, "_y")
    pc = PCA(k=k, inputCol="_z", outputCol="_pc").fit(standardiser(vectors).transform(vectors)).pc.toArray()
    rows = [(j, f, float(pc[i, j])) for j in range(k) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "component int, feature string, loading double")
