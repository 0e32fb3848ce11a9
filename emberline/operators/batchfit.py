"""Many weighted logistic fits on principal components at once.

All fits share the passes over the rows: a task multiplies a slice of rows with the weights of all
replicates and adds up sums of w, w x and w x x'; components come from each fit's summed moments, and
every Newton step is one more pass with the weights w p (1 - p).  The number of passes doesn't
depend on the number of fits.  A fit's numbers stay in a stored table (one row a fit); the driver
sees the linear predictors, which the next pass needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.matrices import TASK_BYTES, listed, matrix, summed, task_sums
from emberline.operators.sampling import poisson_weight, uniform
from emberline.session import store

MAX_STEPS, TOLERANCE = 40, 1e-12
_STATE = ("id long, mean array<double>, scale array<double>, load array<double>, theta array<double>, step array<double>, "
          "best double, linear array<double>, done boolean")


@dataclass(frozen=True)
class Fit:
    """A replicate's weights, and groups of features with the number of components of each."""

    name: str
    replicate: int
    groups: tuple[tuple[tuple[int, ...], int], ...]


def resampled(df: DataFrame, features: Sequence[str], label: str, key: str, replicates: int, seed: int | str,
              share: float | None = None) -> DataFrame:
    """label, x and the weights of each row in every replicate, ``train`` and ``test`` (arrays), written once.

    A resample of n out of n rows gives a row close to Poisson(1) copies.  With ``share``, copies
    fall into the training part with that probability, which makes both parts' weights
    independent Poisson numbers with means ``share`` and 1 - ``share``.
    """
    def weights(mean: float, tag: str) -> Column:
        draws = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda b: uniform(
            F.concat_ws("|", b.cast("string"), F.col(key).cast("string")), f"{seed}{tag}"))
        return F.transform(draws, lambda u: poisson_weight(u, mean).cast("int"))

    parts = {"train": weights(1.0, ""), "test": F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda b: F.lit(0))}
    if share is not None:
        parts = {"train": weights(share, "-train"), "test": weights(1 - share, "-test")}
    return _stored(df, features, label, parts)


def split_once(df: DataFrame, features: Sequence[str], label: str, is_train: Column) -> DataFrame:
    """As :func:`resampled`, with one replicate whose weights say on which side of a split a row is."""
    train = is_train.cast("int")
    return _stored(df, features, label, {"train": F.array(train), "test": F.array(1 - train)})


def _stored(df: DataFrame, features: Sequence[str], label: str, parts: dict[str, Column]) -> DataFrame:
    spread = df.sparkSession.sparkContext.defaultParallelism
    return store(df.select(
        F.col(label).cast("double").alias("label"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
        *[c.alias(n) for n, c in parts.items()]).repartition(spread), "fit-rows")


def _products(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per column of ``w``: sums of w, w x and the upper half of w x x'."""
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([w.sum(0)[:, None], w.T @ x, w.T @ (x[:, i] * x[:, j])])


def _unpacked(sums: np.ndarray, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    half = np.zeros((d, d))
    half[np.triu_indices(d)] = sums[1 + d:1 + d + d * (d + 1) // 2]
    return sums[0], sums[1:1 + d], half + np.triu(half, 1).T


def _passed(rows: DataFrame, count: int, size: int,
            adder: Callable[[slice], Callable[[pa.RecordBatch, np.ndarray], None]]) -> DataFrame:
    """The sums of ``count`` arrays; so many share a pass as a task may hold."""
    at_once = max(1, TASK_BYTES // (8 * size))
    parts = None
    for start in range(0, count, at_once):
        part = slice(start, min(count, start + at_once))
        one = task_sums(rows, adder(part), start, part.stop - start, size)
        parts = one if parts is None else parts.unionByName(one)
    return summed(parts)


def _arrays(batch: pa.RecordBatch, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (batch.column("label").to_numpy(zero_copy_only=False), matrix(batch.column("x")) - origin,
            matrix(batch.column("train")))


@dataclass
class Fitted:
    """Fits with their table of coefficients and the stored rows."""

    rows: DataFrame
    fits: Sequence[Fit]
    features: Sequence[str]
    origin: np.ndarray
    state: DataFrame
    linear: np.ndarray
    intercept: np.ndarray

    def coefficients(self) -> DataFrame:
        """(id, feature, coef): coefficients of the standardised features; a fit lists its own features."""
        spark = self.rows.sparkSession
        own = spark.createDataFrame(
            [(i, self.features[f], f) for i, fit in enumerate(self.fits) for idx, _ in fit.groups for f in idx],
            "id long, feature string, place int")
        d = len(self.features)
        coef = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda f: F.element_at("linear", f + 2) * F.element_at("scale", f + 1))
        return self.state.select("id", coef.alias("coefs")).join(own, "id").select(
            "id", "feature", F.element_at("coefs", F.col("place") + 1).alias("coef"))

    def scores(self) -> DataFrame:
        """Per fit the test part's n, tp, tn, pp, ap and the training part's n_train, ll and ll without the intercept."""
        replicate, linear, intercept, origin = (
            np.array([f.replicate for f in self.fits]), self.linear, self.intercept, self.origin)

        def adder(part: slice) -> Callable[[pa.RecordBatch, np.ndarray], None]:
            def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
                y, x, train = _arrays(batch, origin)
                w, v = train[:, replicate[part]], matrix(batch.column("test"))[:, replicate[part]]
                eta = x @ linear[part, 1:].T + linear[part, 0]
                p, a = eta > 0, (y > 0.5)[:, None]
                bare = eta - intercept[part]
                sums += np.stack([
                    v.sum(0), (v * (p & a)).sum(0), (v * (~p & ~a)).sum(0), (v * p).sum(0), (v * a).sum(0), w.sum(0),
                    (w * (a * eta - np.logaddexp(0, eta))).sum(0), (w * (a * bare - np.logaddexp(0, bare))).sum(0)], 1)
            return add

        names = ["n", "tp", "tn", "pp", "ap", "n_train", "ll", "ll_without"]
        sums = _passed(self.rows, len(self.fits), len(names), adder)
        return sums.select("id", *[F.col("sums")[k].alias(n) for k, n in enumerate(names)])


def fit_all(rows: DataFrame, features: Sequence[str], fits: Sequence[Fit]) -> Fitted:
    """Ridge-penalised logistic fits on the first components of the z-scores of each fit's feature groups.

    The penalty is half the squared norm of the component coefficients per whole sample, for
    population z-scores; a constant feature has the coefficient 0.
    """
    d, head = len(features), rows.select("x").first()
    origin = np.array([0.0 if v is None else v for v in head[0]]) if head else np.zeros(d)
    size = 1 + d + d * (d + 1) // 2
    replicate = np.array([f.replicate for f in fits])
    widest = max(sum(min(k, len(idx)) for idx, k in f.groups) for f in fits)

    def moments(part: slice) -> Callable[[pa.RecordBatch, np.ndarray], None]:
        def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
            _, x, w = _arrays(batch, origin)
            sums += _products(x, w[:, part])
        return add

    by_replicate: dict[int, list[int]] = {}
    for i, f in enumerate(fits):
        by_replicate.setdefault(f.replicate, []).append(i)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, sums in zip(batch.column("id").to_pylist(), matrix(batch.column("sums"))):
                n, s1, s2 = _unpacked(sums, d)
                mean = s1 / n if n else np.zeros(d)
                cov = s2 / n - np.outer(mean, mean) if n else np.zeros((d, d))
                var = np.maximum(np.diag(cov), 0)
                still = var <= 1e-12 * np.maximum(np.diag(s2) / max(n, 1), 1e-300)
                scale = np.where(still, 1.0, np.sqrt(var))
                corr = np.where(still[:, None] | still[None, :], 0, cov / np.outer(scale, scale))
                mean = np.where(still, 0, mean)
                for i in by_replicate.get(b, ()):
                    load, at = np.zeros((d, widest)), 0
                    for idx, k in fits[i].groups:
                        own = np.array(idx)
                        values, found = np.linalg.eigh(corr[np.ix_(own, own)])
                        k = min(k, len(own))
                        load[own, at:at + k] = found[:, np.argsort(-values, kind="stable")[:k]]
                        load[own[still[own]]] = 0
                        at += k
                    zero = np.zeros(widest + 1)
                    yield told(i, mean, scale, load, zero, zero, -np.inf, False)

    def told(i, mean, scale, load, theta, step, best, done) -> pa.RecordBatch:
        trial = theta + step
        slope = load @ trial[1:] / scale
        linear = np.concatenate([[trial[0] - mean @ slope], slope])
        return pa.RecordBatch.from_arrays(
            [pa.array([i], pa.int64()), *[listed(a.reshape(1, -1)) for a in (mean, scale, load, theta, step)],
             pa.array([best], pa.float64()), listed(linear[None]), pa.array([done])],
            [f.split()[0] for f in _STATE.split(", ")])

    def newton(linear: np.ndarray) -> Callable:
        def adder(part: slice) -> Callable[[pa.RecordBatch, np.ndarray], None]:
            def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
                y, x, train = _arrays(batch, origin)
                w = train[:, replicate[part]]
                eta = x @ linear[part, 1:].T + linear[part, 0]
                p = 0.5 * (1 + np.tanh(eta / 2))
                r = w * (y[:, None] - p)
                ll = (w * (y[:, None] * eta - np.logaddexp(0, eta))).sum(0)
                sums += np.hstack([_products(x, w * p * (1 - p)), r.sum(0)[:, None], r.T @ x, ll[:, None]])
            return add
        return adder

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mean, scale, theta, step, sums = (np.array(row[c]) for c in ("mean", "scale", "theta", "step", "sums"))
                load, best, trial = np.array(row["load"]).reshape(d, -1), row["best"], theta + step
                value = sums[-1] - 0.5 * trial[1:] @ trial[1:]
                if np.isfinite(best) and not value >= best - 1e-9 * (1 + abs(best)):
                    step = step / 2  # too far
                    yield told(row["id"], mean, scale, load, theta, step, best, bool(np.abs(step).max() < 1e-12))
                    continue
                n, s1, s2 = _unpacked(sums, d)
                z1 = (s1 - n * mean) / scale
                z2 = (s2 - np.outer(mean, s1) - np.outer(s1, mean) + n * np.outer(mean, mean)) / np.outer(scale, scale)
                r0, r1 = sums[size], sums[size + 1:size + 1 + d]
                h = np.eye(len(theta))
                h[0, 0] = n + 1e-12
                h[0, 1:] = h[1:, 0] = z1 @ load
                h[1:, 1:] += load.T @ z2 @ load
                g = np.concatenate([[r0], (r1 - r0 * mean) / scale @ load - trial[1:]])
                new = np.linalg.lstsq(h, g, rcond=None)[0]
                done = bool(np.isfinite(best) and value - best <= TOLERANCE * (1 + abs(value)) and np.abs(new).max() < 1e-6)
                yield told(row["id"], mean, scale, load, trial, np.zeros_like(new) if done else new, value, done)

    made = _passed(rows, 1 + max(replicate), size, moments)
    state = store(made.mapInArrow(begun, _STATE), "fits")
    columns = [f.split()[0] for f in _STATE.split(", ")]
    for _ in range(MAX_STEPS):
        at = state.select("id", "linear", "done").toArrow().sort_by("id")
        if not at.num_rows or all(at.column("done").to_pylist()):
            break
        linear = matrix(at.column("linear").combine_chunks())
        sums = _passed(rows, len(fits), size + 2 + d, newton(linear))
        state = store(state.join(sums, "id").select(*columns, "sums").mapInArrow(stepped, _STATE), "fits")
    at = state.select("id", "linear", F.col("theta")[0].alias("intercept")).toArrow().sort_by("id")
    linear = matrix(at.column("linear").combine_chunks()) if at.num_rows else np.zeros((len(fits), d + 1))
    return Fitted(rows, fits, features, origin, state, linear,
                  np.array(at.column("intercept").to_pylist(), np.float64) if at.num_rows else np.zeros(len(fits)))
