"""Token ids stored as Re-Pair grammars, one per shard, with random access.

Documents in ascending ``doc_id`` order are cut into shards (one Arrow batch each).  A shard's
grammar is grown in rounds: count adjacent pairs, replace the frequent ones by new symbols where
they don't overlap, repeat.  The first rounds run over the shard's distinct words, weighted by how
often they occur, since a pair inside a word is as frequent as its words; later rounds run over the
documents and join symbols of neighbouring words.  No rule reaches over the end of a document.

File format: a Parquet folder with one row per shard.  ``alphabet`` lists the terminal ids in use
(u4), ``rules`` the pairs of the new symbols (2 x u4; symbol numbers, terminals first), ``lengths``
how many ids each symbol stands for (u4), ``symbols`` the documents' symbols (u2 or u4, see
``width``), ``doc_ids``, ``n_tokens`` and ``n_symbols`` the documents.  Any range of a document is
decoded by adding up lengths and expanding only the symbols it touches (:func:`read_range`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from emberline.llm.tokens import encoder, joined, ragged
from emberline.session import store

END_ID = 1
#: A pair becomes a rule when it occurs this often in the shard.
LEAST = 48
#: A phase ends after a round that removes less than this share of the symbols.
GAIN = 0.02
WORD_ROUNDS, TEXT_ROUNDS = 6, 4
_FILE = ("part int, shard int, tokens long, doc_ids array<long>, n_tokens array<long>, n_symbols array<long>, "
         "alphabet binary, rules binary, lengths binary, width int, symbols binary")
_NONE = np.iinfo(np.int64).max


def replace_pairs(symbols: np.ndarray, inside: np.ndarray, weight: np.ndarray | None, least: int,
                  new: int) -> tuple[np.ndarray, np.ndarray]:
    """One round.  ``inside[i]`` allows the pair (i, i + 1).

    Returns where pairs were replaced (the left places) with their new symbols in ``symbols``, and
    the rules.  More frequent pairs win where two overlap; in a run of one symbol every other pair
    is left for the next round.
    """
    at = np.flatnonzero(inside)
    keys = (symbols[at].astype(np.uint64) << np.uint64(32)) | symbols[at + 1]
    own = None if weight is None else weight[at]
    # a bucket's count bounds its pairs' counts: only pairs of heavy buckets are sorted
    bucket = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
    heavy = np.bincount(bucket, own, 1 << 20)[bucket] >= least
    at, keys, own = at[heavy], keys[heavy], None if own is None else own[heavy]
    pairs, which = np.unique(keys, return_inverse=True)
    counts = np.bincount(which, own, len(pairs))
    order = np.argsort(-counts, kind="stable")
    place = np.full(len(pairs), _NONE)
    kept = order[counts[order] >= least]
    place[kept] = np.arange(len(kept))
    rank = np.full(len(symbols) + 1, _NONE)
    rank[at + 1] = place[which]  # rank[i + 1] belongs to the pair at i
    mine, before, after = rank[1:], rank[:-1], np.append(rank[2:], _NONE)
    taken = np.flatnonzero((mine < before) & (mine <= after) & (mine < _NONE))
    used = np.bincount(mine[taken], None if weight is None else weight[taken], len(kept)) >= 4
    taken = taken[used[mine[taken]]]
    number = np.cumsum(used) - 1 + new
    rules = pairs[kept[used]]
    symbols[taken] = number[mine[taken]]
    return taken, np.stack([rules >> np.uint64(32), rules & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)


def grow(symbols: np.ndarray, sizes: np.ndarray, weight: np.ndarray | None, rounds: int, least: int, new: int
         ) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rounds over groups of ``sizes`` symbols (words or documents) that no rule leaves."""
    symbols, rules = symbols.copy(), []
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        group = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.append(group[1:] == group[:-1], False)
        taken, found = replace_pairs(symbols, inside, None if weight is None else weight[group], least, new)
        if not len(taken):
            break
        rules.append(found)
        new += len(found)
        keep = np.ones(len(symbols), bool)
        keep[taken + 1] = False
        sizes = np.bincount(group[keep], minlength=len(sizes))
        symbols = symbols[keep]
        if len(taken) < GAIN * len(keep):
            break
    return symbols, sizes, rules


def compress(flat: np.ndarray, lengths: np.ndarray, at: np.ndarray, counts: np.ndarray, end_id: int,
             terminals: int, least: int = LEAST) -> dict:
    """A shard's grammar out of the ids of its distinct words and the words of its documents."""
    weight = np.bincount(at, minlength=len(lengths))
    words, word_sizes, rules = grow(flat.astype(np.uint32), lengths, weight, WORD_ROUNDS, least, terminals)
    n_tokens = np.add.reduceat(np.append(lengths[at], 0), np.append(0, np.cumsum(counts)[:-1])) if len(counts) else counts
    n_tokens = np.where(counts > 0, n_tokens, 0) + 1
    symbols, sizes = joined(words, word_sizes, at, counts, end_id)
    symbols, sizes, more = grow(symbols, sizes, None, TEXT_ROUNDS, least, terminals + sum(map(len, rules)))
    pairs = np.concatenate([*rules, *more, np.empty((0, 2), np.uint32)])
    # number the terminals that occur and then the rules without gaps
    there = np.zeros(terminals, bool)
    for x in (symbols, pairs.ravel()):
        there[x[x < terminals]] = True
    alphabet = np.flatnonzero(there).astype(np.uint32)
    number = np.concatenate([np.cumsum(there) - 1, len(alphabet) + np.arange(len(pairs))]).astype(np.uint32)
    pairs, symbols = number[pairs], number[symbols]
    stand = np.ones(len(alphabet) + len(pairs), np.uint32)
    first = len(alphabet)
    for found in (*rules, *more):  # a rule uses symbols of earlier rounds only
        span = slice(first - len(alphabet), first - len(alphabet) + len(found))
        stand[first:first + len(found)] = stand[pairs[span]].sum(1)
        first += len(found)
    width = 2 if len(stand) <= 1 << 16 else 4
    return {
        "tokens": int(n_tokens.sum()), "n_tokens": n_tokens, "n_symbols": sizes,
        "alphabet": alphabet.astype("<u4").tobytes(), "rules": pairs.astype("<u4").tobytes(),
        "lengths": stand.astype("<u4").tobytes(), "width": width, "symbols": symbols.astype(f"<u{width}").tobytes(),
    }


def grammar(alphabet: bytes, rules: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expansion of every symbol: all ids, and each symbol's start and length in them."""
    out = [alphabet[i:i + 4] for i in range(0, len(alphabet), 4)]
    for a, b in np.frombuffer(rules, "<u4").reshape(-1, 2).tolist():
        out.append(out[a] + out[b])
    lengths = np.fromiter(map(len, out), np.int64, len(out)) // 4
    return np.frombuffer(b"".join(out), "<u4"), np.cumsum(lengths) - lengths, lengths


def decode(alphabet: bytes, rules: bytes, width: int, symbols: bytes) -> np.ndarray:
    """All ids of a shard."""
    flat, starts, lengths = grammar(alphabet, rules)
    at = np.frombuffer(symbols, f"<u{width}").astype(np.int64)
    return flat[ragged(starts[at], lengths[at])]


def read_range(shard: Row, index: int, start: int, stop: int) -> np.ndarray:
    """Ids ``[start, stop)`` of the shard's document number ``index``; touches no other symbols."""
    first = sum(shard["n_symbols"][:index])
    at = np.frombuffer(shard["symbols"], f"<u{shard['width']}")[first:first + shard["n_symbols"][index]]
    ends = np.cumsum(np.frombuffer(shard["lengths"], "<u4")[at], dtype=np.int64)
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    flat, starts, lengths = grammar(shard["alphabet"], shard["rules"])
    ids = flat[ragged(starts[at[a:b]], lengths[at[a:b]])]
    skip = start - (int(ends[a - 1]) if a else 0)
    return ids[skip:skip + max(0, stop - start)]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID, least: int = LEAST) -> DataFrame:
    """Encodes documents (``doc_id``, ``text``) and writes the shards; returns the table of the files.

    A null text is empty and holds the end id alone; null doc_ids come first; rows that share a
    doc_id are kept, ordered by text; an empty table gives empty files; other columns are ignored.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        terminals = max(encode.vocabulary(), end_id + 1)
        for shard, batch in enumerate(batches):
            row = compress(*encode.coded(batch.column("text")), end_id, terminals, least)
            row |= {"part": part, "shard": shard, "doc_ids": batch.column("doc_id").to_pylist()}
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return store(ordered.mapInArrow(shards, _FILE), "tokens")


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in _FILE.split(", "))])


def read_tokens(files: DataFrame) -> DataFrame:
    """Decoded documents of the files: doc_id, start, n_tokens, ids_crc32 and where they stand."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["n_tokens"], np.int64)
                ids = memoryview(decode(row["alphabet"], row["rules"], row["width"], row["symbols"]).tobytes())
                ends = np.cumsum(n)
                crcs = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(n), row["part"], np.int32)),
                    pa.array(np.full(len(n), row["shard"], np.int32)), pa.array(ends - n), pa.array(n),
                    pa.array(crcs, pa.int64()),
                ], names=["doc_id", "part", "shard", "at", "n_tokens", "ids_crc32"])

    decoded = files.drop("lengths", "n_symbols").mapInArrow(
        documents, "doc_id long, part int, shard int, at long, n_tokens long, ids_crc32 long")
    so_far = Window.unboundedPreceding, -1
    # one row per file, then one row per shard within its file
    per_part = files.groupBy("part").agg(F.sum("tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*so_far)), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(*so_far)
    base = files.select("part", "shard", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("inner")).join(
        per_part, "part").select("part", "shard", (F.col("before") + F.col("inner")).alias("base"))
    return decoded.join(base, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "shard")
