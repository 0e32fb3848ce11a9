"""The prefix trie of conversations by padded turn-id matrices over range shards.

Conversations are rows of turn ids.  Rows are put in order and cut into range shards; a shard is a
matrix of turn ids, padded with -1, whose rows are sorted by ``numpy.lexsort``.  A column's change
mask says where a row differs from the one above it; OR-accumulated over the columns it marks the
first row of every node of a depth, and ``reduceat`` over these rows sums up all nodes of the depth.
Columns are worked on in bands, and a band holds only the rows that reach it, so one long
conversation does not widen the matrix of all others.

A node that lies in several shards holds the first or the last row of each.  A shard gets the last
row before and the first row behind it, so it knows which nodes begin in it and which of its rows
end in a leaf; that makes every figure of a node a sum (or a minimum) over shards, and only these
boundary nodes are grouped again, by a 128-bit digest of their prefix.

A turn's id is two 64-bit hashes of role and text, so texts are never shuffled and two different
turns meet with a chance of 2^-128 a pair.  Copies of a conversation are neighbours in the order and
may fill many shards.  The ids of the conversations that end in a node are hashed in numeric order
where they stand; for a node in several shards they go on as one text per shard, which a sorted
pass joins shard after shard, holding one text at a time.

A conversation is one row of 24 bytes a turn; its text never is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.tokens import ragged
from emberline.session import store

#: Turns of a shard at most, about (24 bytes each), and the fewest for which it is worth another one.
SHARD_TURNS, LEAST_TURNS = 1_000_000, 5_000
#: Columns of a matrix.
BAND = 32
_WORD = r"[^\x20\x09-\x0D]+"
_TURNS = "array<struct<a: long, b: long, words: long>>"
#: A node as far as a shard goes; ``key`` names a node that other shards hold too.
_NODE = ("key binary, depth long, conv_id long, parent_key binary, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string, shard long")
_NONE = hashlib.sha256(b"").hexdigest()
_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq) with the turns of each conversation in order.

    Turns go by ``turn`` (null first), equal ones by role and then by their hash; repeated rows are
    turns of their own.  Null roles and texts are empty, rows without a conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn").alias("turn"), role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("a"),
            F.xxhash64(F.lit(2), text, role).alias("b"),
            F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select(
        "conv_id", F.transform("ts", lambda t: F.struct(t["a"], t["b"], t["words"])).cast(_TURNS).alias("seq"))


def rebuilt(seqs: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation with its first turns replaced by those of the first of its block of ids.

    Of conversation c the first h = crc32(decimal c) % ``heads`` turns come from conversation
    c - c % ``every`` (all if it has fewer, none if there is none); % has the sign of c.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % every
    firsts = seqs.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_base"), F.slice("seq", F.lit(1), F.lit(heads - 1)).alias("_head"))
    both = seqs.withColumn("_base", base).join(firsts, "_base", "left")
    head = F.coalesce("_head", F.array().cast(_TURNS))
    own = F.slice("seq", h + 1, F.greatest(F.size("seq"), F.lit(1)))
    return both.select("conv_id", F.concat(F.slice(head, F.lit(1), h), own).alias("seq"))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix of two rows of ids."""
    n = min(len(a), len(b))
    odd = np.flatnonzero((a[:n] != b[:n]).any(1))
    return int(odd[0]) if len(odd) else n


def _digests(ids: np.ndarray, upto: int) -> list[bytes]:
    """A digest of each prefix of a row with at most ``upto`` turns, the empty one first."""
    state, out = hashlib.blake2b(digest_size=16), []
    out.append(state.digest())
    for row in np.ascontiguousarray(ids[:upto]):
        state.update(row.tobytes())
        out.append(state.digest())
    return out


def dense(ids: np.ndarray) -> np.ndarray:
    """Ranks of (a, b) pairs in their order; equal pairs share a rank."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    ranks = np.zeros(len(ids), np.int64)
    ranks[order[1:]] = np.cumsum((ids[order[1:]] != ids[order[:-1]]).any(1))
    return ranks


def in_order(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
             convs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in lexicographic order, equal ones by conv_id, and the turns each shares with the row above it.

    Band after band, the rows that reach the band are sorted within the nodes that the bands before
    have made; rows that end in a band stand before those that go on.
    """
    rows, common = np.argsort(convs, kind="stable"), np.zeros(len(sizes), np.int64)
    place, node, at = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), 0
    while len(place) and (width := int(min(BAND, sizes[rows[place]].max() - at))) > 0:
        live = rows[place]
        own = np.clip(sizes[live] - at, 0, width)
        matrix = np.full((len(live), width), -1, np.int64)
        matrix[np.arange(width) < own[:, None]] = codes[ragged(starts[live] + at, own)]
        # of rows that agree to the end of the band, those that end there come first
        order = np.lexsort((sizes[live] > at + width, *matrix.T[::-1], node))
        live, own, matrix = live[order], own[order], matrix[order]
        changed = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
        same = node[1:] == node[:-1]  # nodes are numbered in order, so sorting has not moved them
        shared = np.minimum(np.minimum((~changed).sum(1), own[1:]), own[:-1])
        rows[place] = live
        common[place[1:][same]] = at + shared[same]
        node = np.concatenate([[0], np.cumsum(~(same & (shared == width)))])
        at += width
        keep = sizes[live] > at
        place, node = place[keep], node[keep]
    return rows, common


def shard_nodes(ids: np.ndarray, sizes: np.ndarray, words: np.ndarray, convs: np.ndarray,
                before: np.ndarray | None, behind: np.ndarray | None, shard: int) -> pa.Table:
    """All nodes that hold a row of the shard, with sums over its rows.

    ``ids`` has the (a, b) hashes of all turns of all rows, one row after the other, ``before`` and
    ``behind`` those of the row before the shard and of the row after it.
    """
    starts = np.cumsum(sizes) - sizes
    order, common = in_order(dense(ids), starts, sizes, convs)
    starts, sizes, convs, n = starts[order], sizes[order], convs[order], len(order)
    words = words[ragged(starts, sizes)]
    first, last = (ids[starts[i]:starts[i] + sizes[i]] for i in (0, n - 1))
    common[0] = -1 if before is None else _common(before, first)
    reach = -1 if behind is None else _common(last, behind)
    first_keys, last_keys = _digests(first, max(int(common[0]), 0)), _digests(last, max(reach, 0))
    # a row is the last one of a leaf if the next row does not go on from it
    leaf = (np.append(common[1:], reach) < sizes).astype(np.int64)
    upto, ends = np.concatenate([[0], np.cumsum(words)]), np.cumsum(sizes)
    begin = ends - sizes
    # words of the nodes that begin in a row
    fresh = upto[ends] - upto[begin + np.maximum(common, 0)]
    names = [str(c) for c in convs.tolist()]
    parent_low, parent_flag = np.zeros(n, np.int64), np.zeros(n, np.int8)
    live, levels = np.arange(n), []
    for depth in range(int(sizes.max()) + 1):
        live = live[sizes[live] >= depth]
        opens = common[live] < depth
        opens[0] = True
        at = np.flatnonzero(opens)
        top = live[at]
        low = np.minimum.reduceat(convs[live], at)
        tail = upto[ends[live]] - upto[begin[live] + max(depth - 1, 0)]
        mine = fresh[live]
        new = common[top] < depth  # the others begin in a shard before
        mine[at[new]] = tail[at[new]]
        more = (sizes[live] > depth) & (common[live] <= depth)
        stops = np.add.reduceat((sizes[live] == depth).astype(np.int64), at)
        flag = np.zeros(len(at), np.int8)
        flag[-1] = 2 * (live[-1] == n - 1 and depth <= reach)
        if live[0] == 0 and depth <= common[0]:
            flag[0] = 1
        texts: list[str | None] = [None] * len(at)
        hashes: list[str | None] = [_NONE] * len(at)
        for i in np.flatnonzero(stops):
            texts[i] = ",".join(names[top[i]:top[i] + stops[i]])
            hashes[i] = hashlib.sha256(texts[i].encode()).hexdigest()
        known = flag == 0
        up = parent_flag[top]
        keys = pa.array([None, *(k[depth] if depth < len(k) else None for k in (first_keys, last_keys))], pa.binary())
        ups = pa.array([None, *(k[depth - 1] if 0 < depth <= len(k) else None for k in (first_keys, last_keys))],
                       pa.binary())
        levels.append(pa.table({
            "key": keys.take(pa.array(flag)), "depth": np.full(len(at), depth), "conv_id": low,
            "parent_key": ups.take(pa.array(up)),
            "parent_conv_id": pa.array(parent_low[top], mask=(up > 0) | (depth == 0)),
            "n_convs": np.diff(np.append(at, len(live))), "n_children": np.add.reduceat(more.astype(np.int64), at),
            "n_leaves": np.add.reduceat(leaf[live], at), "saved_tokens": np.add.reduceat(tail - mine, at),
            "ends_sha256": pa.array(hashes, pa.string(), mask=~known), "ends": pa.array(texts, pa.string(), mask=known),
            "shard": np.full(len(at), shard)}))
        node = np.cumsum(opens) - 1
        parent_low[live], parent_flag[live] = low[node], flag[node]
    return pa.concat_tables(levels)


def _shard(rows: pa.Table) -> pa.Table:
    """A group of the shard's rows (side 0) and its neighbours (side -1 and 1)."""
    rows = rows.combine_chunks()
    side, seqs = rows.column("side").to_numpy(), rows.column("seq").combine_chunks()

    def taken(where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = seqs.take(pa.array(np.flatnonzero(where)))
        a, b, words = (part.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
        return np.stack([a, b], 1), part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), words

    ids, sizes, words = taken(side == 0)
    before, behind = (taken(side == s)[0] if (side == s).any() else None for s in (-1, 1))
    convs = rows.column("conv_id").to_numpy(zero_copy_only=False)[side == 0].astype(np.int64)
    return shard_nodes(ids, sizes, words, convs, before, behind, int(rows.column("shard")[0].as_py()))


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per key over its texts in the order of the rows, comma-joined."""
    key, state = None, None
    for batch in batches:
        keys, hashes = [], []
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k != key:
                if key is not None:
                    keys.append(key)
                    hashes.append(state.hexdigest())
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "sha"])


def shards_of(rows: DataFrame) -> DataFrame:
    """(shard, side, conv_id, seq): range shards of the order, each with its neighbouring rows."""
    turns = rows.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(-(-turns // SHARD_TURNS), min(spread, -(-turns // LEAST_TURNS)), 1)
    ranged = store(rows.repartitionByRange(n, "seq", "conv_id").withColumn(
        "shard", F.spark_partition_id().cast("long")), "trie-shards")
    edges = ranged.groupBy("shard").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    along = Window.orderBy("shard")  # one row per shard
    edges = edges.select("shard", F.lag("high").over(along).alias("before"), F.lead("low").over(along).alias("behind"))
    neighbours = edges.select("shard", F.explode(F.array(
        F.struct(F.lit(-1).alias("side"), F.col("before").alias("seq")),
        F.struct(F.lit(1).alias("side"), F.col("behind").alias("seq")))).alias("e")).select(
        "shard", "e.side", F.lit(None).cast("long").alias("conv_id"), "e.seq").filter("seq is not null")
    return ranged.select("shard", F.lit(0).alias("side"), "conv_id", "seq").unionByName(neighbours)


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One row per node of the trie of ``rows`` (conv_id, seq as :func:`sequences` gives it)."""
    parts = store(shards_of(rows).groupBy("shard").applyInArrow(_shard, _NODE), "trie-nodes")
    split = parts.filter("key is not null")
    ends = split.filter("ends is not null").select("key", "shard", "ends").repartition("key").sortWithinPartitions(
        "key", "shard").mapInArrow(_joined_ends, "key binary, sha string")
    whole = split.groupBy("key").agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.min("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in _SUMS])
    whole = store(whole.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(_NONE))), "trie-split")
    columns = ["conv_id", "depth", "parent_key", "parent_conv_id", *_SUMS, "ends_sha256"]
    nodes = parts.filter("key is null").select(columns).unionByName(
        whole.withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns))
    above = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_low"))
    return nodes.join(above, "parent_key", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_low").alias("parent_conv_id"), *_SUMS, "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations; no conversations give no node."""
    return trie_nodes(store(rebuilt(sequences(conversations)), "trie-rows"))
