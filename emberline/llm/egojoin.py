"""Near-duplicate vectors by the epsilon grid order join.

Unit vectors whose cosine is at least t are at most e = sqrt(2 - 2t) apart.  Vectors are projected
on the leading principal axes of a bounded sample, laid on a grid of cell width e and sorted by
cell.  The sorted order is cut into sequences; two sequences are joined only if the boxes around
their projections are within e (a projection never lengthens a distance), and the join halves both
sides again and again by the same test until small blocks are compared with one matrix product.

Equal vectors of a label are one class.  A pair of sequences reports, per class, how many vectors
it is linked with and one representative of its connected part, so a dense group costs rows in
proportion to its sequences and never all of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.components import components
from emberline.session import store

COSINE = 0.93
#: Vectors the principal axes are fitted on, at most, per vector length.
SAMPLE = 2000
AXES = 6
#: Classes per sequence, and per block that is compared as a whole.
SEQUENCE, BLOCK = 1024, 128
#: Rounding must not part two vectors on the grid; links themselves are decided without it.
SLACK = 1e-9


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest part first, so that nothing overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def classes_of(vectors: DataFrame) -> DataFrame:
    """label, dim, x (array<double>), rep (smallest vec_id) and n (vectors) of each distinct vector."""
    x = F.col("embedding")
    fit = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(
        x, lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), "label", x.cast("array<double>").alias("embedding"))
    return rows.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & x.isNotNull() & fit).groupBy(
        "label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))


def axes_of(classes: DataFrame, sample: int, axes: int) -> dict[int, np.ndarray]:
    """Leading principal axes for each vector length, from a sample drawn by hash."""
    out = {}
    for (dim,) in classes.select(F.size("embedding")).distinct().collect():
        rows = classes.filter(F.size("embedding") == dim).orderBy(F.xxhash64("rep"), "rep").limit(sample)
        x = unit_rows(np.array([r["embedding"] for r in rows.select("embedding").collect()], np.float64))
        x = x - x.mean(0)
        values, found = np.linalg.eigh(x.T @ x)
        out[dim] = found[:, np.argsort(-values)[:axes]]
    return out


def on_grid(classes: DataFrame, axes: dict[int, np.ndarray], width: float) -> DataFrame:
    """Adds the grid cell (array<int>) of each class."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.array(lists.value_lengths())
            cells = np.empty(len(sizes), object)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                cells[at] = list(np.floor(unit_rows(x) @ axes[int(dim)] / width).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(cells), pa.list_(pa.int32()))], names=[*batch.schema.names, "cell"])

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "embedding", "rep", "n").mapInArrow(
        mapped, f"label {kind}, embedding array<double>, rep long, n long, cell array<int>")


def sequences(grid: DataFrame, axes: dict[int, np.ndarray], size: int) -> DataFrame:
    """Cuts the grid order into sequences of one label and vector length, with their boxes."""
    kind = grid.schema["label"].dataType.simpleString()
    schema = (f"seq long, label {kind}, dim int, low array<double>, high array<double>, reps binary, counts binary, "
              "points binary")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.array(lists.value_lengths(), np.int64)
            label = batch.column("label").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(sizes) != 0) | (np.diff(label) != 0)) + 1
            for part in np.split(np.arange(len(sizes)), cuts):
                for first in range(0, len(part), size):
                    rows = part[first:first + size]
                    dim = int(sizes[rows[0]])
                    own = batch.slice(int(rows[0]), len(rows))
                    x = unit_rows(own.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                    seen = x @ axes[dim]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([number]), own.column("label").slice(0, 1), pa.array([dim], pa.int32()),
                        pa.array([seen.min(0).tolist()]), pa.array([seen.max(0).tolist()]),
                        pa.array([own.column("rep").to_numpy().tobytes()]),
                        pa.array([own.column("n").to_numpy().tobytes()]), pa.array([x.tobytes()]),
                    ], names=["seq", "label", "dim", "low", "high", "reps", "counts", "points"])
                    number += 1

    keys = ["label", F.size("embedding"), *[F.get("cell", F.lit(i)) for i in range(AXES)], "rep"]
    return grid.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(mapped, schema)


def joined(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, cosine: float, width: float,
           same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked rows of two sequences; ``pa_`` and ``pb`` are their projections."""
    left, right, stack = [], [], [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        if same and k + m < i + j:
            continue  # the mirror image is joined
        gap = np.maximum(0, np.maximum(pa_[i:j].min(0) - pb[k:m].max(0), pb[k:m].min(0) - pa_[i:j].max(0)))
        if float((gap * gap).sum()) > width * width + SLACK:
            continue
        if j - i > BLOCK or m - k > BLOCK:
            u, v = ((i + j) // 2, (k + m) // 2)
            rows = [(i, u), (u, j)] if j - i > 1 else [(i, j)]
            columns = [(k, v), (v, m)] if m - k > 1 else [(k, m)]
            stack += [(*r, *c) for r in rows for c in columns]
            continue
        x, y = np.nonzero(a[i:j] @ b[k:m].T >= cosine)
        x, y = x + i, y + k
        if same:
            x, y = x[x < y], y[x < y]
        left.append(x)
        right.append(y)
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest index of each node's connected part."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(pairs: DataFrame, axes: dict[int, np.ndarray], cosine: float, width: float) -> DataFrame:
    """Per class and pair of sequences: how many vectors it is linked with, and its part's first class."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                dim, same = row["dim"], row["seq"] == row["seq_b"]
                reps, counts = (np.frombuffer(row[c], np.int64) for c in ("reps", "counts"))
                x = np.frombuffer(row["points"]).reshape(-1, dim)
                reps_b, counts_b = (np.frombuffer(row[c], np.int64) for c in ("reps_b", "counts_b"))
                y = x if same else np.frombuffer(row["points_b"]).reshape(-1, dim)
                p, q = joined(x, y, x @ axes[dim], y @ axes[dim], cosine, width, same)
                if not len(p):
                    continue
                if same:
                    ids, weight, other = reps, counts, q
                else:
                    ids, weight, other = np.append(reps, reps_b), np.append(counts, counts_b), q + len(reps)
                n = np.bincount(p, weight[other], len(ids)) + np.bincount(other, weight[p], len(ids))
                root, at = roots(len(ids), p, other), np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(n[at].astype(np.int64)), pa.array(ids[root[at]])],
                    names=["rep", "links", "root"])

    return pairs.mapInArrow(mapped, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, axes: int = AXES,
                    size: int = SEQUENCE) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id``, ``embedding``, ``label``): vec_id, n_links,
    component_id (smallest vec_id reachable) and kept.

    Null labels, and vectors that are null, empty, zero or hold null, NaN or infinity, link with
    nothing; only vectors of one label and one length are compared.  A null vec_id links nothing,
    has a null component_id and is kept.  Rows that repeat a vec_id are separate vectors.  An empty
    table gives no row; other columns are ignored.
    """
    width = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    classes = store(classes_of(vectors), "classes")
    found = axes_of(classes, sample, min(axes, AXES))
    data = store(sequences(on_grid(classes, found, width), found, size), "sequences")
    # summaries only; the first axis is a join key, the boxes decide
    low, high = (F.col(c)[0] for c in ("low", "high"))
    cells = F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    around = F.explode(F.sequence(F.floor(low / width) - 1, F.floor(high / width) + 1))
    a = data.select("label", "dim", "seq", "low", "high", cells.alias("first"))
    b = data.select("label", "dim", F.col("seq").alias("seq_b"), F.col("low").alias("low_b"),
                    F.col("high").alias("high_b"), around.alias("first"))
    gaps = F.zip_with(
        F.zip_with("low", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    pairs = a.join(b, ["label", "dim", "first"]).filter(
        (F.col("seq") <= F.col("seq_b")) & (apart <= width * width + SLACK)).select("dim", "seq", "seq_b").distinct()
    heavy = ["reps", "counts", "points"]
    left = data.select("seq", *heavy)
    right = data.select(F.col("seq").alias("seq_b"), *[F.col(c).alias(f"{c}_b") for c in heavy])
    made = store(linked(pairs.join(left, "seq").join(right, "seq_b"), found, cosine, width), "links")
    per_class = made.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = components(made.filter("rep <> root").select("rep", "root")).withColumnRenamed("node", "rep")
    labels = classes.join(per_class, "rep", "left").join(reached, "rep", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label",
                          F.col("embedding").cast("array<double>").alias("embedding"))
    known = F.col("vec_id").isNotNull()
    return rows.join(labels, ["label", "embedding"], "left").select(
        "vec_id", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(known, F.coalesce("component_id", "vec_id")).alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
