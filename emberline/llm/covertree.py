"""Exact top-k inner products of quantised vectors by dual-tree search over cover trees.

Vectors become integers, floor(scale * x), so scores are exact and ties are real.  Rows are dealt to
blocks by their nearest pivot (large cells are salted), every block holds a cover tree, and the
queries of a block form a tree of their own.  A pair of nodes is left out when

    <cq, cc> + |cq| rc + |cc| rq + rq rc  <  the worst k-th score of the node's queries,

c and r being centres and covering radii; the same bound decides on pairs of whole blocks once each
query block has searched the block it is closest to.  The bound is strict, so equal scores are
always seen and ties can go to the smaller id.  Nothing is approximate and nothing is capped: a
block pair that can't be left out is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.session import store

SCALE = 64
K = 20
#: Rows a block is meant to have, and points below which a node is not split.
BLOCK_ROWS, LEAF = 4096, 128
#: Children a node may have: a level that needs more centres is too sparse to cover.
CHILDREN = 32
#: Pivots at most (they are vectors on the driver and in every task); large cells get salts.
PIVOTS = 64
_EXACT = 2.0**52


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, dim, v (array of floor(scale * x)) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), x.alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select(
        "vec_id", F.size("embedding").alias("dim"),
        F.transform("embedding", lambda e: F.floor(e * scale).cast("long")).alias("v"))


class Tree:
    """A cover tree: each level halves the radius its centres cover, centres keep that distance."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, copies: int | None = None):
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        if copies is not None and len(ids):
            # of equal vectors only the smallest ids can be among the best
            _, which = np.unique(points, axis=0, return_inverse=True)
            which = which.ravel()
            by = np.argsort(which, kind="stable")
            counts = np.bincount(which)
            nth = np.empty(len(ids), np.int64)
            nth[by] = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
            ids, points = ids[nth < copies], points[nth < copies]
        self.ids, self.points = ids, points
        self.float = points.astype(np.float64)
        self.most = float(np.abs(self.float).max()) if points.size else 0.0
        self.nodes: list[tuple[np.ndarray, float, float, np.ndarray, list[int]]] = []
        if len(ids):
            self._node(np.arange(len(ids)), 0)

    def _node(self, rows: np.ndarray, center: int) -> int:
        own = self.float[rows]
        middle = own[center]
        away = np.sqrt(((own - middle) ** 2).sum(1))
        radius, number = float(away.max()), len(self.nodes)
        self.nodes.append((middle, radius, float(np.linalg.norm(middle)), rows, []))
        if len(rows) > LEAF and radius > 0:
            left, children, cover = np.arange(len(rows)), [], radius / 2
            nearest, pick = away, center
            while len(left) and len(children) <= CHILDREN:
                d = nearest if not children else np.sqrt(((own[left] - own[pick]) ** 2).sum(1))
                inside = d <= cover
                group = left[inside]
                children.append((rows[group], int(np.flatnonzero(group == pick)[0])))
                left = left[~inside]
                if len(left):
                    pick = int(left[0])
            if not len(left):
                self.nodes[number][4].extend(self._node(r, c) for r, c in children)
            else:
                self._halve(number, rows, away)
        return number

    def _halve(self, number: int, rows: np.ndarray, away: np.ndarray) -> None:
        """Two centres far from each other share the points of a level too sparse to cover."""
        own = self.float[rows]
        a = int(away.argmax())
        from_a = ((own - own[a]) ** 2).sum(1)
        b = int(from_a.argmax())
        to_a = from_a <= ((own - own[b]) ** 2).sum(1)
        for side, pick in ((to_a, a), (~to_a, b)):
            group = np.flatnonzero(side)
            self.nodes[number][4].append(self._node(rows[group], int(np.flatnonzero(group == pick)[0])))


def search(queries: Tree, data: Tree, best: np.ndarray, best_ids: np.ndarray, k: int) -> None:
    """Improves each query's k best scores (descending, ties by id) in place."""
    if not queries.nodes or not data.nodes:
        return
    nothing = np.iinfo(np.int64).min
    # products of doubles are exact where no sum can be rounded
    exact = queries.most * data.most * queries.points.shape[1] < _EXACT

    def bound(q: tuple, c: tuple) -> float:
        most = float(q[0] @ c[0]) + q[2] * c[1] + c[2] * q[1] + q[1] * c[1]
        return most * (1 + 1e-9) + 1e-6 if most > 0 else most * (1 - 1e-9) + 1e-6

    stack = [(bound(queries.nodes[0], data.nodes[0]), 0, 0)]
    while stack:
        most, i, j = stack.pop()
        q, c = queries.nodes[i], data.nodes[j]
        worst = best[q[3], k - 1]
        if most < float(worst.min()):
            continue
        if not q[4] and not c[4]:
            if exact:
                scores = (queries.float[q[3]] @ data.float[c[3]].T).astype(np.int64)
            else:
                scores = queries.points[q[3]] @ data.points[c[3]].T
            ids = np.broadcast_to(data.ids[c[3]], scores.shape)
            scores = np.where(ids == queries.ids[q[3]][:, None], nothing, scores)
            hit = np.flatnonzero((scores >= worst[:, None]).any(1))
            if len(hit):
                rows = q[3][hit]
                both = np.concatenate([best[rows], scores[hit]], 1)
                both_ids = np.concatenate([best_ids[rows], ids[hit]], 1)
                both_ids = np.where(both == nothing, np.iinfo(np.int64).max, both_ids)
                order = np.lexsort((both_ids, -np.maximum(both, nothing + 1)), axis=1)[:, :k]
                best[rows] = np.take_along_axis(both, order, 1)
                best_ids[rows] = np.take_along_axis(both_ids, order, 1)
            continue
        split_query = q[4] and (not c[4] or q[1] > c[1])
        pairs = [(n, j) for n in q[4]] if split_query else [(i, n) for n in c[4]]
        # the most promising pair is searched first
        stack += sorted((bound(queries.nodes[a], data.nodes[b]), a, b) for a, b in pairs)


def packed(ids: np.ndarray, points: np.ndarray) -> dict:
    center = points.mean(0)
    return {"ids": ids.astype("<i8").tobytes(), "points": points.astype("<i8").tobytes(),
            "center": center.tolist(), "length": float(np.linalg.norm(center)),
            "radius": float(np.sqrt(((points - center) ** 2).sum(1)).max())}


def unpacked(row: dict, prefix: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], "<i8")
    return ids, np.frombuffer(row[f"{prefix}points"], "<i8").reshape(len(ids), dim)


_BLOCK = ("block long, dim int, n long, ids binary, points binary, center array<double>, length double, "
          "radius double")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, dim, pivot, v) of a cell, salted to about ``size`` per block."""
    cells = rows.groupBy("dim", "pivot").agg(F.count("*").alias("n")).select(
        "dim", "pivot", F.ceil(F.col("n") / size).alias("parts"))
    dealt = rows.join(cells, ["dim", "pivot"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), "parts"))
    grouped = dealt.groupBy("dim", "pivot", "salt").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members = batch.column("rows")[i].values
                ids = members.field("vec_id").to_numpy(zero_copy_only=False)
                dim = batch.column("dim")[i].as_py()
                points = members.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
                # equal rows have one id, hence one block: they count once
                rows = np.unique(np.column_stack([ids, points]), axis=0)
                ids, points = rows[:, 0], rows[:, 1:]
                row = packed(ids, points) | {"block": batch.column("block")[i].as_py(), "dim": dim, "n": len(ids)}
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    number = F.xxhash64("dim", "pivot", "salt").alias("block")
    return grouped.select(number, F.col("dim"), "rows").mapInArrow(mapped, _BLOCK)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(),
          "array<double>": pa.list_(pa.float64())}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in _BLOCK.split(", "))])


def with_pivots(rows: DataFrame, pivots: int, size: int) -> DataFrame:
    """Adds the nearest of some vectors drawn by hash, as many as there are blocks to fill."""
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    centers: dict[int, np.ndarray] = {}
    for dim, n in counts.items():
        some = rows.filter(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(
            max(1, min(pivots, n // size))).collect()
        centers[dim] = np.array([r["v"] for r in some], np.float64).reshape(len(some), dim)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            pivot = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                own, c = own.reshape(len(at), dim).astype(np.float64), centers[int(dim)]
                pivot[at] = ((c**2).sum(1) - 2 * own @ c.T).argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pivot)], names=["vec_id", "dim", "v", "pivot"])

    return rows.mapInArrow(mapped, "vec_id long, dim int, v array<long>, pivot int")


_FOUND = "q_block long, query_id long, vec_id long, score long"


def searched(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of every query in every pair of blocks, above the query's ``floor``."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # pairs come sorted by the block of data, so a tree is built once for all its pairs
        last, data, trees = None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if last != (row["dim"], row["block"]):
                    last, data = (row["dim"], row["block"]), Tree(*unpacked(row, "", row["dim"]), copies=k + 1)
                if row["q_block"] not in trees:
                    if len(trees) >= 16:
                        trees.clear()
                    trees[row["q_block"]] = Tree(*unpacked(row, "q_", row["dim"]))
                queries = trees[row["q_block"]]
                best = np.full((len(queries.ids), k), np.iinfo(np.int64).min)
                best_ids = np.full(best.shape, np.iinfo(np.int64).max)
                if row["floor"] is not None:
                    # a score below the k-th of another block can't be among the best
                    known = dict(zip(row["floor_ids"], row["floor"]))
                    best[:] = np.array([known.get(x, np.iinfo(np.int64).min + 1) - 1 for x in queries.ids.tolist()])[:, None]
                search(queries, data, best, best_ids, k)
                real = best_ids < np.iinfo(np.int64).max
                query = np.broadcast_to(queries.ids[:, None], best.shape)[real]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(query), row["q_block"])), pa.array(query), pa.array(best_ids[real]),
                    pa.array(best[real])], names=["q_block", "query_id", "vec_id", "score"])

    return pairs.select(
        "dim", "block", "q_block", "q_ids", "q_points", "ids", "points", "floor_ids", "floor").mapInArrow(mapped, _FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS,
          pivots: int = PIVOTS) -> DataFrame:
    """The k best vectors of every query row of ``vectors`` (``vec_id``, ``embedding``).

    Returns query_id, rank, vec_id, score.  Rows whose vec_id or vector is null, or whose vector
    holds null, NaN or infinity, take no part; vectors are compared with those of their own length
    (empty ones score 0); rows equal in id and vector count once; an id with several vectors is a
    candidate with each and gets the best of all of them as a query; fewer than k candidates give
    fewer rows; an empty table gives none.
    """
    rows = store(with_pivots(quantised(vectors, scale), pivots, block_rows), "vectors")
    data = store(blocks(rows, block_rows), "blocks")
    asked = blocks(rows.filter(is_query), block_rows // 4)
    queries = store(asked.select("dim", *[
        F.col(c).alias(f"q_{c}") for c in ("block", "n", "ids", "points", "center", "length", "radius")]), "queries")
    small = ["center", "length", "radius"]
    # block summaries only: one row per some thousand vectors
    inner = F.aggregate(F.zip_with("q_center", "center", lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    pairs = store(
        queries.select("dim", "q_block", "q_n", *[f"q_{c}" for c in small]).join(
            data.select("dim", "block", *small), "dim").select(
            "dim", "q_block", "q_n", "block", inner.alias("near"),
            (inner + F.col("q_length") * F.col("radius") + F.col("length") * F.col("q_radius")
             + F.col("q_radius") * F.col("radius")).alias("most")),
        "pairs")
    home = pairs.groupBy("dim", "q_block").agg(F.max_by("block", F.struct("near", "block")).alias("block"))
    heavy_q, heavy = queries.select("dim", "q_block", "q_ids", "q_points"), data.select("dim", "block", "ids", "points")
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("floor_ids", "floor")]
    first = store(
        searched(home.join(heavy_q, ["dim", "q_block"]).join(heavy, ["dim", "block"]).select("*", *none), k), "first")
    reached = first.groupBy("q_block", "query_id").agg(
        F.min("score").alias("worst"), F.count("*").alias("n"))
    floors = reached.groupBy("q_block").agg(
        F.count("*").alias("reached"),
        F.collect_list(F.when(F.col("n") >= k, F.col("query_id"))).alias("floor_ids"),
        F.collect_list(F.when(F.col("n") >= k, F.col("worst"))).alias("floor"),
        F.min(F.when(F.col("n") >= k, F.col("worst")).otherwise(F.lit(-(2**62)))).alias("least"))
    rest = pairs.join(home, ["dim", "q_block", "block"], "left_anti").join(floors, "q_block", "left").filter(
        F.col("least").isNull() | (F.col("reached") < F.col("q_n")) | (F.col("most") * (1 + F.signum("most") * 1e-9) + 1e-6 >= F.col("least")))
    more = searched(
        rest.join(heavy_q, ["dim", "q_block"]).join(heavy, ["dim", "block"]), k)
    found = first.unionByName(more).groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return found.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.s")).alias("score"))
