"""Best-fit packing of tokenised documents into sequences by length patterns.

Only the histogram of piece lengths decides how to pack, and it has one count per length up to
the capacity, however many documents there are.  The driver therefore sees at most ``capacity``
numbers:

1. enumerate patterns of few documents that fill a sequence exactly (pairs, triples, a document
   repeated with its remainder),
2. fit the repeat counts to the histogram by non-negative least squares (coordinate descent),
3. round them down to what the histogram still holds,
4. pack the residual by best fit on lengths: the longest left, then the longest that still fits,
   repeated until one of the lengths is used up.

Pieces get a place without any sort of a length's rows: each task numbers the pieces it makes by
length, the counts per (length, task) give the offsets, and a piece finds the run of its number in
the plan.  A length that a third of all pieces share is spread over all tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.tokens import CACHE_WORDS, SLICE, encoder, slices
from emberline.session import store

CAPACITY = 1024
END_ID = 2
#: Partner lengths tried per length when triples are enumerated.
FAN = 8
SWEEPS = 60
_PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, "
           "shard int, number long")
_SLOTS = "length long, first long, until long, times long, sequence long, place long"


def cut(n_tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, start and length of all pieces; only the first piece may be short."""
    pieces = -(-n_tokens // capacity)
    doc = np.repeat(np.arange(len(n_tokens)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = (n_tokens - (pieces - 1) * capacity)[doc]
    start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
    return doc, start, np.where(piece == 0, first, capacity)


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY,
                     keep_ids: bool = False, cache: int = CACHE_WORDS, rows: int = SLICE) -> DataFrame:
    """One row per piece, numbered within its length and task; ``keep_ids`` adds the ids.

    ``cache`` (words) and ``rows`` (documents at once) bound a worker's memory and change nothing else.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode = TaskContext.get().partitionId(), encoder(tokenizer, cache)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, rows, keep=encoder):
            ids, n = encode.batch(batch.column("text"), end_id)
            doc, start, length = cut(n, capacity)
            at = (np.cumsum(n) - n)[doc] + start
            raw = memoryview(ids.astype("<u4", copy=False).tobytes())
            spans = [raw[4 * a:4 * (a + m)] for a, m in zip(at.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            counts = np.bincount(length, minlength=capacity + 1)
            number = np.empty(len(length), np.int64)
            number[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
            number += seen[length]
            seen += counts
            piece = np.arange(len(doc)) - np.searchsorted(doc, doc)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start),
                pa.array(length), pa.array(np.fromiter(map(zlib.crc32, spans), np.int64, len(spans))),
                pa.array([bytes(x) for x in spans] if keep_ids else [None] * len(spans), pa.binary()),
                pa.array(np.full(len(doc), shard, np.int32)), pa.array(number),
            ], names=[f.split()[0] for f in _PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, _PIECES)


def patterns(lengths: list[int], capacity: int, fan: int = FAN) -> list[dict[int, int]]:
    """Multisets of present lengths that fill a sequence: length -> how often."""
    there, found = set(lengths), {}

    def add(*parts: int) -> None:
        if all(p in there for p in parts):
            found.setdefault(tuple(sorted(Counter(parts).items())), None)

    for a in lengths:
        if a == capacity:
            add(a)
            continue
        add(a, capacity - a)
        often, rest = divmod(capacity, a)
        if rest in there or not rest:
            add(*[a] * often, *[rest] * bool(rest))
        rest = capacity - a
        for b in {max(1, rest * k // (fan + 1)) for k in range(1, fan + 1)}:
            add(a, b, rest - b)
            if not (rest - b) % 2:
                add(a, b, (rest - b) // 2, (rest - b) // 2)
    return [dict(p) for p in found]


def fit(found: list[dict[int, int]], counts: dict[int, int], sweeps: int = SWEEPS) -> list[float]:
    """Non-negative least squares of repeat counts against the histogram, one pattern at a time."""
    left, x = {k: float(v) for k, v in counts.items()}, [0.0] * len(found)
    rows = [(list(p.items()), sum(m * m for m in p.values())) for p in found]
    for _ in range(sweeps):
        moved = 0.0
        for i, (parts, norm) in enumerate(rows):
            step = max(-x[i], sum(m * left[n] for n, m in parts) / norm)
            if step:
                x[i] += step
                moved += abs(step)
                for n, m in parts:
                    left[n] -= m * step
        if moved < 1e-3 * sum(counts.values()):
            break
    return x


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pattern, how many sequences) that hold every counted piece exactly once."""
    left = {k: v for k, v in counts.items() if v > 0}
    found = patterns(sorted(left), capacity)
    out = []
    for x, p in sorted(zip(fit(found, left), found), key=lambda y: -y[0]):
        times = min([int(x), *(left[n] // m for n, m in p.items())])
        if times > 0:
            out.append((p, times))
            for n, m in p.items():
                left[n] -= m * times
    left = {k: v for k, v in left.items() if v}
    while left:
        space, p = capacity, {}
        for n in sorted(left, reverse=True):
            if m := min(left[n], space // n):
                p[n] = m
                space -= m * n
        times = min(left[n] // m for n, m in p.items())
        out.append((p, times))
        for n, m in p.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return out


def slots(planned: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which numbers of a length go where: a row per pattern and length."""
    upto, sequence, rows = Counter(), 0, []
    for p, times in planned:
        place = 0
        for n, m in p.items():
            rows.append((n, upto[n], upto[n] + times * m, m, sequence, place))
            upto[n] += times * m
            place += n * m
        sequence += times
    return rows


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY,
                   keep_ids: bool = False, cache: int = CACHE_WORDS, rows: int = SLICE) -> DataFrame:
    """Packs all documents (``doc_id``, ``text``) into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start (ids of its document before it), length, ids_crc32,
    sequence_id and offset; with ``keep_ids`` also the piece's ids as little-endian 32-bit numbers.
    A null or empty text is one piece that holds the end id alone; a null doc_id is kept; repeated
    rows are packed each; an empty table gives no row; other columns are ignored.  ``cache`` and
    ``rows`` bound a worker's memory.
    """
    spark = docs.sparkSession
    made = store(tokenized_pieces(docs, tokenizer, end_id, capacity, keep_ids, cache, rows), "pieces")
    per_task = made.groupBy("length", "shard").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # a row per pattern and length: some thousands at most, whatever the input
    names = [f.split()[0] for f in _SLOTS.split(", ")]
    # from Arrow: out of a list it would be an RDD, whose Python workers stay beside those of the documents
    places = np.array(slots(plan(histogram, capacity)), np.int64).reshape(-1, len(names))
    where = spark.createDataFrame(pa.table(dict(zip(names, map(pa.array, places.T)))))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select(
        "length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = made.join(offsets, ["length", "shard"]).withColumn("nth", F.col("before") + F.col("number"))
    in_run = F.col("nth") - F.col("first")
    return nth.join(
        F.broadcast(where), (nth["length"] == where["length"]) & (F.col("nth") >= F.col("first"))
        & (F.col("nth") < F.col("until")),
    ).select(
        "doc_id", "piece", "start", nth["length"], "ids_crc32",
        (F.col("sequence") + F.floor(in_run / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("place") + in_run % F.col("times") * nth["length"]).cast("long").alias("offset"),
        *["ids"] * keep_ids,
    )
