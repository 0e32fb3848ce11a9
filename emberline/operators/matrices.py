"""Sums of arrays over tasks, and cross products of columns in tiles.

A task adds up matrix products of its rows with numpy and gives one row per result, so the rows
that leave a task don't depend on the rows it has read; a sorted pass adds the tasks' arrays one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a matrix product at once, and bytes of sums that a task holds; they bound memory only.
SLICE = 512
TASK_BYTES = 128 << 20
#: Columns of a tile.
TILE = 256
#: Arrays that are added in one Arrow batch.
_BATCH = 16


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows; nulls become NaN."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def listed(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.array(rows.ravel()))


def task_sums(df: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], first: int, count: int, size: int) -> DataFrame:
    """(id, sums): what ``add`` makes of all batches of a task, in ``count`` arrays of ``size`` numbers from id ``first``."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((count, size)), False
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                add(batch.slice(start, SLICE), sums)
                seen = True
        for start in range(0, count if seen else 0, _BATCH):
            part = sums[start:start + _BATCH]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(first + start, first + start + len(part))), listed(part)], ["id", "sums"])

    return df.mapInArrow(mapped, "id long, sums array<double>")


def summed(parts: DataFrame) -> DataFrame:
    """The arrays (id, sums) of each id added; a task holds one sum, however many there are to add."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([known], pa.int64()), listed(total[None])], ["id", "sums"])

        for batch in batches:
            for i, row in zip(batch.column("id").to_pylist(), matrix(batch.column("sums"))):
                if i == known:
                    total += row
                    continue
                if known is not None:
                    yield told()
                known, total = i, row.copy()
        if known is not None:
            yield told()

    return parts.repartition("id").sortWithinPartitions("id").mapInArrow(mapped, "id long, sums array<double>")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, corr): Pearson correlation of every pair of columns, over rows where both are known.

    The matrix is cut into tiles of TILE columns; a task adds the products of two tiles for all its
    rows.  As many pairs of tiles share a pass over the rows as TASK_BYTES of sums allow.  Null if
    either column is constant over these rows.
    """
    values = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    head = matrix(values.limit(100).toArrow().column("v").combine_chunks())
    if not len(head):
        return df.sparkSession.range(0).selectExpr("0 AS i", "0 AS j", "cast(null AS double) AS corr")
    # sums of differences to some value of a column are not blurred by what all rows share
    origin = np.nan_to_num(head[np.isfinite(head).argmax(0), np.arange(head.shape[1])], posinf=0, neginf=0)
    width, tiles = len(columns), -(-len(columns) // TILE)
    pairs = [(a, b) for a in range(tiles) for b in range(a, tiles)]
    per_pass = max(1, TASK_BYTES // (6 * 8 * TILE * TILE))

    def span(tile: int) -> slice:
        return slice(tile * TILE, min((tile + 1) * TILE, width))

    def adder(chosen: Sequence[tuple[int, int]]) -> Callable[[pa.RecordBatch, np.ndarray], None]:
        def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
            lists = batch.column("v")
            x = matrix(lists) - origin
            known = lists.flatten().is_valid().to_numpy(zero_copy_only=False).reshape(x.shape).astype(np.float64)
            x[known == 0] = 0
            for n, (a, b) in enumerate(chosen):
                p, q, m, o = x[:, span(a)], x[:, span(b)], known[:, span(a)], known[:, span(b)]
                products = (m.T @ o, p.T @ o, m.T @ q, (p * p).T @ o, m.T @ (q * q), p.T @ q)
                sums[n, :6 * products[0].size] += np.concatenate([y.ravel() for y in products])
        return add

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair, row in zip(batch.column("id").to_pylist(), matrix(batch.column("sums"))):
                a, b = (np.arange(width)[span(t)] for t in pairs[pair])
                n, sx, sy, sxx, syy, sxy = row[:6 * len(a) * len(b)].reshape(6, len(a), len(b))
                with np.errstate(invalid="ignore", divide="ignore"):
                    spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
                    corr = (n * sxy - sx * sy) / np.sqrt(spread)
                none = ~(spread > 0) & ~np.isnan(spread) | (n == 0)
                i, j = np.repeat(a, len(b)), np.tile(b, len(a))
                yield told(i, j, corr, none)
                if pairs[pair][0] != pairs[pair][1]:
                    yield told(j, i, corr, none)

    def told(i: np.ndarray, j: np.ndarray, corr: np.ndarray, none: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(corr.ravel(), mask=none.ravel())], ["i", "j", "corr"])

    parts = None
    for start in range(0, len(pairs), per_pass):
        chosen = pairs[start:start + per_pass]
        one = task_sums(values, adder(chosen), start, len(chosen), 6 * min(TILE, width) ** 2)
        parts = one if parts is None else parts.unionByName(one)
    return summed(parts).mapInArrow(named, "i int, j int, corr double")
