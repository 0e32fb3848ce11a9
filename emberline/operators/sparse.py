"""Principal components of wide sparse tables by randomised block iteration with implicit centring.

A row lists its features (numbers from 0) and their values; what it doesn't list is zero.  The z-scores
of a sparse row are dense, so they are never made: with means m and deviations s, a pass multiplies
the rows with Q / s, takes m Q / s off each product, multiplies back and takes the means' part off
the sum.  A pass costs the listed values times the width of the block, a task gives one array per
column of the block, and no matrix of features by features exists.  The blocks of all passes make the
basis in which the components are found, until their residuals vanish; the basis (features x a few
hundred) is on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from emberline.operators.matrices import listed, summed, task_sums
from emberline.session import store

#: Columns of a block beyond the wanted components, blocks of a basis before it starts again, and passes at most.
OVERSAMPLE, BLOCKS, PASSES, TOLERANCE = 10, 8, 200, 1e-9


@dataclass
class Components:
    mean: np.ndarray
    scale: np.ndarray
    load: np.ndarray
    values: np.ndarray
    rows: int
    passes: int


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of everything listed."""
    idx, val = batch.column("idx"), batch.column("val")
    sizes = idx.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return (np.repeat(np.arange(len(sizes)), sizes), idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            val.flatten().to_numpy(zero_copy_only=False))


def _folded(at: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Adds ``rows`` to those of ``out`` that ``at`` names."""
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order][first]] += np.add.reduceat(rows[order], first, axis=0)


def _times(batch: pa.RecordBatch, w: np.ndarray, c: np.ndarray) -> np.ndarray:
    row, j, v = _flat(batch)
    out = np.zeros((batch.num_rows, w.shape[1]))
    _folded(row, v[:, None] * w[j], out)
    return out - c


def _gathered(sums: DataFrame, count: int, size: int) -> np.ndarray:
    out = np.zeros((count, size))
    table = sums.toArrow()
    for i, row in zip(table.column("id").to_pylist(), table.column("sums").to_pylist()):
        out[i] = row
    return out


def moments(rows: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means, population deviations (1 for a constant feature), and which features are constant."""
    def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        _, j, v = _flat(batch)
        sums[0, :d] += np.bincount(j, v, d)
        sums[1, :d] += np.bincount(j, v * v, d)
        sums[0, d] += batch.num_rows

    sums = _gathered(summed(task_sums(rows, add, 0, 2, d + 1)), 2, d + 1)
    n = int(sums[0, d])
    mean = sums[0, :d] / max(n, 1)
    var = np.maximum(sums[1, :d] / max(n, 1) - mean**2, 0)
    still = var <= 1e-14 * np.maximum(sums[1, :d] / max(n, 1), 1e-300)
    return n, mean, np.where(still, 1.0, np.sqrt(var)), still


def components(rows: DataFrame, d: int, k: int, seed: int = 0) -> Components:
    """The first ``k`` components of the z-scores of ``rows`` (idx, val), largest first."""
    n, mean, scale, still = moments(rows, d)
    k = min(k, d)
    width = min(d, k + OVERSAMPLE)

    def applied(q: np.ndarray) -> np.ndarray:
        """The correlation matrix times a block, in one pass."""
        w = q / scale[:, None]
        c = mean @ w

        def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
            row, j, v = _flat(batch)
            t = _times(batch, w, c)
            back = np.zeros((d, q.shape[1]))
            _folded(j, v[:, None] * t[row], back)
            sums[:, :d] += back.T
            sums[:, d] += t.sum(0)

        sums = _gathered(summed(task_sums(rows, add, 0, q.shape[1], d + 1)), q.shape[1], d + 1)
        return (sums[:, :d] - np.outer(sums[:, d], mean)).T / scale[:, None] / max(n, 1)

    rng = np.random.default_rng(seed)
    block = np.linalg.qr(rng.standard_normal((d, width)))[0]
    basis, images = np.empty((d, 0)), np.empty((d, 0))
    passes = 0
    while True:
        basis, images = np.hstack([basis, block]), np.hstack([images, applied(block)])
        passes += 1
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")
        values, turn = values[order], turn[:, order]
        load = np.where(still[:, None], 0, basis @ turn[:, :k])
        residual = np.linalg.norm(images @ turn[:, :k] - load * values[:k], axis=0).max(initial=0)
        if residual <= TOLERANCE * max(values[0], 1e-300) or basis.shape[1] >= d or passes >= PASSES:
            return Components(mean, scale, load, values[:k], n, passes)
        if basis.shape[1] + width > width * BLOCKS:  # start again with the best of the basis
            keep = turn[:, :width]
            basis, images = basis @ keep, images @ keep
            block = images - basis @ (basis.T @ images)
        else:
            block = images[:, -block.shape[1]:]
        for _ in range(2):  # twice is enough
            block = block - basis @ (basis.T @ block)
        q, r = np.linalg.qr(block)
        live = np.abs(np.diag(r)) > 1e-13 * max(values[0], 1e-300)
        block = q[:, live][:, :d - basis.shape[1]]
        if not block.shape[1]:
            return Components(mean, scale, load, values[:k], n, passes)


def scored(rows: DataFrame, found: Components, *keep: str) -> DataFrame:
    """The columns ``keep`` and the row's components as ``pcs``."""
    w = found.load / found.scale[:, None]
    c = found.mean @ w
    schema = rows.select(*keep).schema.add("pcs", ArrayType(DoubleType()))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(n) for n in keep]
            yield pa.RecordBatch.from_arrays([*kept, listed(_times(batch, w, c))], names=schema.names)

    return rows.select(*keep, *[n for n in ("idx", "val") if n not in keep]).mapInArrow(mapped, schema)


def listed_flags(df: DataFrame, places: str) -> DataFrame:
    """``idx`` and ``val`` out of a list of the features that are true."""
    return df.withColumns({"idx": F.col(places).cast("array<int>"), "val": F.transform(places, lambda _: F.lit(1.0))})


def pca_logistic_sparse(df: DataFrame, d: int, label: str, k: int) -> DataFrame:
    """(place, coef): regression on the first components of a sparse table, carried back to the features.

    As :func:`emberline.operators.models.pca_logistic`, for rows with ``idx`` and ``val``.
    """
    rows = store(df.select(F.col(label).cast("double").alias("label"), "idx", "val"), "sparse-rows")
    found = components(rows.select("idx", "val"), d, k)
    points = store(scored(rows, found, "label"), "sparse-scores").withColumn("features", array_to_vector("pcs"))
    model = LogisticRegression(
        featuresCol="features", labelCol="label", regParam=1.0 / max(found.rows, 1), elasticNetParam=0.0,
        standardization=False, maxIter=200, tol=1e-10).fit(points)
    coef = found.load @ model.coefficients.toArray()
    spark = df.sparkSession
    return spark.createDataFrame(
        [(i, float(x)) for i, x in enumerate(coef)], "place int, coef double")
