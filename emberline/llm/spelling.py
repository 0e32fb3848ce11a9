"""Spelling variants by bidirectional FM-index search schemes over the vocabulary of a corpus.

Two words are near if they differ by one inserted, deleted or replaced code point.  The edit lies in
one half of the word, so the other half stands unchanged in the near word.  Two searches cover all
near words: one matches the left half exactly and extends to the right across the right half, the
other matches the right half and extends to the left, each allowing one error on the way.

The vocabulary is read in both directions.  Each reading is sorted and cut into range shards, and
each shard's words, with a delimiter behind each, have an FM-index of the reading turned round: a
backward step of that index appends a code point to what has been matched, and an interval of suffix
ranks stands for all places of the shard where it occurs.  The words that begin with a given half
are neighbours in the order, so a word is sent only to the shards that its half can reach: the first
code points of each shard (at most ``SHARDS`` of them, cut to ``BOUND`` code points) are the only
thing every task gets.  All words of a task are searched at once with numpy: a step looks up the
ranks of all intervals and all code points of the alphabet in bit vectors.

A near word that both searches would meet is counted by the first one only: the second skips words
that begin with the left half.  A task reports sums per word, never pairs.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.tokens import ragged
from emberline.session import store

#: Runs of letters in UTF-8; U+00C0 to U+00FF are c3 80 to c3 bf.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Words of a shard, about (more when there would be over SHARDS), and the fewest worth another one.
SHARD_WORDS, LEAST_WORDS, SHARDS = 60_000, 2_000, 50_000
#: Code points of the shard bounds that every task gets.
BOUND = 32
#: Words searched at once; bounds memory only.
AT_ONCE = 8192
LEAST_LENGTH, LEAST_COUNT, FACTOR, EVERY = 7, 2, 10, 31


def runs_of(text: str | None, doc: str, shortest: int) -> Counter:
    """The lower-cased runs of a text with at least ``shortest`` code points after the planted slips.

    If ``EVERY`` divides the unsigned crc32 of ``doc:run``, the run loses its code point number crc32 % length.
    """
    if not text:
        return Counter()
    out, seed = Counter(), zlib.crc32(f"{doc}:".encode())
    for run, n in Counter(_RUN.findall(text.encode("utf-8", "replace").translate(_LOWER))).items():
        if len(run) < shortest:  # bytes; never fewer than code points
            continue
        word, h = run.decode(), zlib.crc32(run, seed)
        if h % EVERY == 0:
            i = h % len(word)
            word = word[:i] + word[i + 1:]
        if len(word) >= shortest:
            out[word] += n
    return out


def vocabulary(documents: DataFrame, shortest: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): how often each word occurs in all texts, if ``least`` times or more.

    Null and empty texts have no words; the name of a null doc_id is empty; repeated rows count each time.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc"), batch.column("text")):
                words.update(runs_of(text.as_py(), doc.as_py(), shortest))
                if len(words) > 200_000:
                    yield told()
                    words.clear()
        yield told()

    rows = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= least)


class FmIndex:
    """Suffix ranks of a set of words, each turned round and closed by a delimiter of its own."""

    def __init__(self, words: list[str]):
        lengths = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet, codes = np.unique(chars, return_inverse=True)
        self.sigma, n, size = len(self.alphabet), len(words), int(lengths.sum()) + len(words)
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        text = np.empty(size, np.int64)  # delimiter of word i: i, then code points
        text[begin + lengths] = np.arange(n)
        text[ragged(begin, lengths)] = n + codes[
            np.repeat(2 * (np.cumsum(lengths) - lengths) + lengths - 1, lengths) - np.arange(len(codes))]
        self.suffixes = self._sorted(text)
        before = text[self.suffixes - 1]  # the text is a circle
        self.blocks = -(-(size + 1) // 64)
        self.bits = np.zeros((self.sigma, self.blocks), np.uint64)
        rank = np.flatnonzero(before >= n)
        np.bitwise_or.at(self.bits, (before[rank] - n, rank >> 6), np.uint64(1) << (rank & 63).astype(np.uint64))
        counts = np.bitwise_count(self.bits).astype(np.int64)
        self.upto = (np.cumsum(counts, 1) - counts).astype(np.int32)
        self.first = n + np.cumsum(counts.sum(1)) - counts.sum(1)
        # ranks of whole words, and their words
        self.whole = np.flatnonzero(before < n)
        self.word = np.searchsorted(begin, self.suffixes[self.whole])
        self.size, self.n = size, n

    @staticmethod
    def _sorted(text: np.ndarray) -> np.ndarray:
        """Suffix array by doubling; every suffix ends at a delimiter that occurs once."""
        _, rank = np.unique(text, return_inverse=True)
        size, step = len(text), 1
        while True:
            behind = np.full(size, -1, np.int64)
            behind[:-step or None] = rank[step:] if step < size else -1
            key = rank * (size + 1) + behind + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(size, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
            if rank[order[-1]] == size - 1:
                return order
            step *= 2

    def coded(self, chars: np.ndarray) -> np.ndarray:
        """Code points as numbers of the alphabet, -1 for those that no word has."""
        at = np.minimum(np.searchsorted(self.alphabet, chars), self.sigma - 1)
        return np.where(self.alphabet[at] == chars, at, -1)

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` ranks follow the code point."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.upto[code, block] + np.bitwise_count(self.bits[code, block] & mask)

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.first[code]
        return first + self.rank(code, low), first + self.rank(code, high)

    def found(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The word that is all of what was matched, or -1."""
        at = np.searchsorted(self.whole, low)
        safe = np.minimum(at, len(self.whole) - 1)
        hit = (at < len(self.whole)) & (self.whole[safe] < high)
        return np.where(hit, self.word[safe], -1)


def near_words(index: FmIndex, words: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) numbers of the index's words with one error behind a query's first ``halves`` code points.

    A query's own word is left out; each pair comes once.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.append(index.coded(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)), -1)
    start = np.cumsum(lengths) - lengths
    query = np.arange(len(words))
    low, high = np.zeros(len(words), np.int64), np.full(len(words), index.n)
    at = np.zeros(len(words), np.int64)
    pairs = []

    def step(code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Extends by a code point each; keeps what occurs."""
        own = np.flatnonzero(code >= 0)
        lo, hi = index.extend(code[own], low[own], high[own])
        live = lo < hi
        return own[live], lo[live], hi[live]

    def finish(query: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """The rest of each query without another error."""
        while len(query):
            ended = at >= lengths[query]
            word = index.found(low[ended], high[ended])
            pairs.append(np.stack([query[ended][word >= 0], word[word >= 0]]))
            query, at, low, high = query[~ended], at[~ended], low[~ended], high[~ended]
            keep, low, high = step(codes[start[query] + at], low, high)
            query, at = query[keep], at[keep] + 1

    alphabet = np.arange(index.sigma)
    while len(query):
        open_ = at >= halves[query]
        ended = at >= lengths[query]
        q, p, lo, hi = query[open_], at[open_], low[open_], high[open_]
        if len(q):
            here = np.where(ended[open_], -1, codes[np.minimum(start[q] + p, len(codes) - 1)])
            skip = ~ended[open_]
            finish(q[skip], p[skip] + 1, lo[skip], hi[skip])  # the near word lacks this code point
            code = np.tile(alphabet, len(q))
            item = np.repeat(np.arange(len(q)), index.sigma)
            other = code != here[item]
            keep, wide_low, wide_high = step(code[other], lo[item[other]], hi[item[other]])
            item = item[other][keep]
            finish(q[item], p[item], wide_low, wide_high)  # the near word has one more
            swap = skip[item]
            finish(q[item[swap]], p[item[swap]] + 1, wide_low[swap], wide_high[swap])  # or another one
        query, at, low, high = query[~ended], at[~ended], low[~ended], high[~ended]
        keep, low, high = step(codes[start[query] + at], low, high)
        query, at = query[keep], at[keep] + 1
    both = np.unique(np.concatenate([np.empty((2, 0), np.int64), *pairs], axis=1), axis=1)
    return both[0], both[1]


def _sums(rows: pa.Table, backward: bool) -> pa.Table:
    """Per searched word of a shard: how many near words the shard has, and the most frequent one."""
    rows = rows.combine_chunks()
    words, counts = rows.column("word").to_pylist(), rows.column("n").to_pylist()
    indexed = rows.column("indexed").to_numpy(zero_copy_only=False)
    own = np.flatnonzero(indexed)
    out: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}
    if len(own):
        turned = [w[::-1] for w in words] if backward else words
        index = FmIndex([turned[i] for i in own])
        asked = np.flatnonzero(~indexed)
        for first in range(0, len(asked), AT_ONCE):
            part = asked[first:first + AT_ONCE]
            texts = [turned[i] for i in part]
            # the left half has length // 2 code points, the right half the rest
            halves = np.array([len(t) - len(t) // 2 if backward else len(t) // 2 for t in texts])
            best: dict[int, list] = {}
            for q, w in zip(*(x.tolist() for x in near_words(index, texts, halves))):
                word, near = words[part[q]], words[own[w]]
                if backward and near.startswith(word[:len(word) // 2]):
                    continue  # the search to the right has it
                n = counts[own[w]]
                known = best.get(q)
                if known is None:
                    best[q] = [1, n, near]
                else:
                    known[0] += 1
                    if n > known[1] or (n == known[1] and near < known[2]):
                        known[1:] = n, near
            for q, (total, n, near) in best.items():
                for name, value in zip(out, (words[part[q]], total, n, near)):
                    out[name].append(value)
    return pa.table({"word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()),
                     "best_n": pa.array(out["best_n"], pa.int64()), "best": pa.array(out["best"], pa.string())})


def searched(words: DataFrame, n_words: int, backward: bool) -> DataFrame:
    """(word, n_near, best_n, best) per word and shard of one reading, for words with near words there."""
    reading = F.reverse("word") if backward else F.col("word")
    spread = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(max(-(-n_words // SHARD_WORDS), min(spread, -(-n_words // LEAST_WORDS)), 1), SHARDS)
    ranged = store(words.withColumn("reading", reading).repartitionByRange(n, "reading").withColumn(
        "shard", F.spark_partition_id()), "spelling-shards")
    # one row per shard, at most SHARDS rows of BOUND code points
    bounds = ranged.groupBy("shard").agg(F.min(F.substring("reading", 1, BOUND)).alias("low")).orderBy("shard").collect()
    shards, lows = [r["shard"] for r in bounds], [r["low"] for r in bounds]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, to = [], []
            for i, text in enumerate(batch.column("reading").to_pylist()):
                half = text[:len(text) - len(text) // 2 if backward else len(text) // 2]
                # a bound is a prefix of the shard's first word: the shard before may hold words with the half
                reach = range(max(bisect_left(lows, half[:BOUND]) - 1, 0), bisect_right(lows, half + chr(0x10FFFF)))
                rows += [i] * len(reach)
                to += [shards[s] for s in reach]
            part = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("word"), part.column("n"), pa.array(to, pa.int32()), pa.array([False] * len(rows))],
                ["word", "n", "shard", "indexed"])

    schema = "word string, n long, shard int, indexed boolean"
    asked = ranged.select("word", "n", "reading").mapInArrow(sent, schema)
    both = ranged.select("word", "n", "shard", F.lit(True).alias("indexed")).unionByName(asked)
    return both.groupBy("shard").applyInArrow(
        lambda rows: _sums(rows, backward), "word string, n_near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): follows (word, form) to the last form; a form has more occurrences, so there are no circles."""
    links = store(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = store(links.join(on, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        if not links.filter("_moved").limit(1).count():
            return links.select("word", "root")
        links = links.drop("_moved")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Near words, form and root of each word of a vocabulary (word, n) with distinct words.

    A form is the most frequent near word (ties: smallest in code-point order), if it occurs at
    least ``factor`` (over 1) times as often; without one, form and form_n are null and the root is
    the word.  An empty vocabulary gives no rows.
    """
    words = store(words.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    n_words = words.count()
    parts = searched(words, n_words, False).unionByName(searched(words, n_words, True))
    best = parts.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct(-F.col("best_n"), "best")).alias("top"))
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("top.col1")).alias("_n"), F.col("top.best").alias("_form"))
    kept = F.col("_n") >= factor * F.col("n")
    found = store(found.select(
        "word", "n", "n_near", F.when(kept, F.col("_form")).alias("form"), F.when(kept, F.col("_n")).alias("form_n")), "spelling")
    last = roots(found.filter("form is not null"))
    return found.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame) -> DataFrame:
    """The variants of the words of all texts."""
    return variants(vocabulary(documents))
