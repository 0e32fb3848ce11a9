"""N best segmentations of whole texts into the pieces of a ``sentencepiece`` file, and decoding.

A forward Viterbi pass over the lattice of a segment gives the best score from its start to every
place.  A backward A* search from the end uses these scores as heuristic; they are exact, so the
n-th complete path taken from the queue is the n-th best segmentation.

A text's lattice falls apart between two characters that stand next to each other in no piece
(nearly always where a blank begins a word).  Segments between such places are solved once per
batch, however often they occur, and the best segmentations of the whole text are put together
from theirs: the best is the best everywhere, and the next ones differ from it in the segments with
the smallest loss.

The file ranks its pieces by merges; a piece of rank r scores as the r-th word under Zipf's law, in
millionths of a natural logarithm, so sums are exact.  A character without a piece becomes its
bytes, at ten below the worst piece.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.tokens import MODELS, ragged, slices

N = 3
UNIT = 1_000_000
BLANK = "▁"
#: Solved segments in each of a worker's two generations, and searched ones; they bound its memory only.
CACHE, SEARCHED = 250_000, 50_000
_LEAST, _NEVER = -(1 << 62), 1 << 60


class Pieces:
    """Scores, lattice and n-best search of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(len(model))]
        plain = [i for i in range(len(model)) if not (
            model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        plain.sort(key=lambda i: (-model.get_score(i), i))
        total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
        self.table = {self.names[i]: (-round(UNIT * (math.log(r + 1) + total)), i) for r, i in enumerate(plain)}
        self.unknown = min(s for s, _ in self.table.values()) - 10 * UNIT
        self.longest = max(map(len, self.table))
        self.byte_ids = {int(self.names[i][1:-1], 16): i for i in range(len(model)) if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        self.pairs = np.unique(np.array(
            [(ord(a) << 32) | ord(b) for p in self.table for a, b in zip(p, p[1:])], np.uint64))
        #: lengths of the pieces that end with two characters (themselves), or with three
        self.lengths: dict[str, list[int]] = {}
        for size, tail in sorted({(len(p), p[-3:]) for p in self.table if len(p) > 1}):
            self.lengths.setdefault(tail, []).append(size)
        # two generations: what is in use survives when the older one goes
        self.recent: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.searched: dict[tuple[str, int], list[tuple[int, bytes]]] = {}

    def into(self, text: str, end: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """(start, score, ids) of the pieces that end at a place."""
        out, get = [], self.table.get
        for tail in (text[end - 2:end], text[end - 3:end]) if end > 2 else (text[:2],) if end == 2 else ():
            for length in self.lengths.get(tail, ()):
                if length <= end:
                    found = get(text[end - length:end])
                    if found is not None:
                        out.append((end - length, found[0], (found[1],)))
        found = get(text[end - 1])
        if found is not None:
            out.append((end - 1, found[0], (found[1],)))
        else:
            out.append((end - 1, self.unknown, self.spelled(text[end - 1])))
        return out

    def forward(self, text: str) -> tuple[list[int], list[tuple], list[int]]:
        """Viterbi: best score up to each place, (start, ids) of its last piece, and the loss of the next best last piece."""
        best, last, loss = [0], [()], [0]
        get, lengths = self.table.get, self.lengths.get
        for end in range(1, len(text) + 1):
            top, second, edge = _LEAST, _LEAST, None
            if end > 1:
                found = get(text[end - 2:end])
                if found is not None:
                    top, edge = best[end - 2] + found[0], (end - 2, (found[1],))
                if end > 2:
                    for length in lengths(text[end - 3:end], ()):
                        if length <= end:
                            found = get(text[end - length:end])
                            if found is not None:
                                score = best[end - length] + found[0]
                                if score > top:
                                    top, second, edge = score, top, (end - length, (found[1],))
                                elif score > second:
                                    second = score
            found = get(text[end - 1])
            score = best[end - 1] + (self.unknown if found is None else found[0])
            if score > top:
                top, second = score, top
                edge = end - 1, self.spelled(text[end - 1]) if found is None else (found[1],)
            elif score > second:
                second = score
            best.append(top)
            last.append(edge)
            loss.append(top - second)
        return best, last, loss

    def spelled(self, char: str) -> tuple[int, ...]:
        """The ids of a character that is no piece: its bytes."""
        return tuple(self.byte_ids.get(b, self.unknown_id) for b in char.encode())

    def first(self, text: str) -> tuple[int, bytes, int]:
        """Score and ids of the best segmentation, and how much the second best loses.

        The second best leaves the best path for good at some place, seen from the end, so its loss
        is the smallest one on the path.
        """
        found = self.recent.get(text)
        if found is not None:
            return found
        found = self.older.get(text)
        if found is None:
            best, last, loss = self.forward(text)
            place, ids, gap = len(text), [], _NEVER
            while place:
                gap = min(gap, loss[place])
                place, piece = last[place]
                ids[:0] = piece
            found = best[-1], np.array(ids, "<u4").tobytes(), gap if gap < _NEVER // 2 else _NEVER
        if len(self.recent) >= CACHE:
            self.older, self.recent = self.recent, {}
        self.recent[text] = found
        return found

    def ranked(self, text: str, n: int) -> list[tuple[int, bytes]]:
        """As :meth:`search`, kept for the next batches."""
        found = self.searched.get((text, n))
        if found is None:
            if len(self.searched) >= SEARCHED:
                self.searched.clear()
            found = self.searched[text, n] = self.search(text, n)
        return found

    def search(self, text: str, n: int) -> list[tuple[int, bytes]]:
        """The n best segmentations of a segment, best first, as (score, ids), by A* from the end."""
        best = self.forward(text)[0]
        out, queue, made = [], [(-best[-1], len(text), 0, 0, ())], 0
        while queue and len(out) < n:
            _, place, _, behind, path = heapq.heappop(queue)
            if not place:
                ids: list[int] = []
                while path:
                    piece, path = path
                    ids += piece
                out.append((behind, np.array(ids, "<u4").tobytes()))
                continue
            for start, score, piece in self.into(text, place):
                made += 1
                # what is left to the start is known exactly: the best score of the forward pass
                heapq.heappush(queue, (-(behind + score + best[start]), start, made, behind + score, (piece, path)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation."""
        return self.model.decode(ids)


def normalized(text: str | None) -> str:
    """The form the pieces are written in: a blank in front and marks for blanks."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def text_segments(pieces: Pieces, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct segments, the segment at each place, and places per text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    full = pc.if_else(
        pc.equal(texts, ""), texts,
        pc.binary_join_element_wise(pa.scalar(BLANK, pa.large_string()), pc.replace_substring(texts, " ", BLANK),
                                    pa.scalar("", pa.large_string())))
    # words: a mark and what follows up to the next mark
    lists = pc.split_pattern(full, BLANK)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    head = np.zeros(len(flat), bool)
    head[(np.cumsum(sizes) - sizes)[sizes > 0]] = True  # what stands before the first mark: nothing
    words = pc.binary_join_element_wise(
        pa.scalar(BLANK, pa.large_string()), pc.filter(flat, pa.array(~head)), pa.scalar("", pa.large_string()))
    sizes = np.maximum(sizes - 1, 0)
    coded = words.dictionary_encode()
    distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    joined = "".join(distinct)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
    ends = np.cumsum(lengths)
    cut = np.ones(len(codes), bool)  # a segment begins at the character
    if len(codes) > 1:
        keys = (codes[:-1] << np.uint64(32)) | codes[1:]
        found = np.minimum(np.searchsorted(pieces.pairs, keys), len(pieces.pairs) - 1)
        cut[1:] = pieces.pairs[found] != keys
        cut[(ends - lengths)[1:]] = True
    begins = np.flatnonzero(cut)
    stops = np.append(begins[1:], len(codes))
    parts = [joined[a:b] for a, b in zip(begins.tolist(), stops.tolist())]
    per_word = np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(distinct))
    coded = pa.array(parts, pa.large_string()).dictionary_encode()
    part_at = coded.indices.to_numpy(zero_copy_only=False)
    first = np.cumsum(per_word) - per_word
    places = part_at[ragged(first[at], per_word[at])] if len(at) else np.empty(0, np.int64)
    upto = np.append(0, np.cumsum(per_word[at]))
    word_ends = np.cumsum(sizes)
    return coded.dictionary.to_pylist(), places, upto[word_ends] - upto[word_ends - sizes]


def runs(pieces: Pieces, segments: list[str], places: np.ndarray, counts: np.ndarray) -> tuple:
    """Runs of marks can be pieces: segments that are one mark before another are solved together."""
    mark = np.fromiter((s == BLANK for s in segments), bool, len(segments))
    lone = mark[places]
    ends = np.cumsum(counts)
    lone[ends[counts > 0] - 1] = False  # the last mark of a text stays
    if not lone.any():
        return segments, places, counts
    stops = np.flatnonzero(~lone)
    marks = np.diff(stops, prepend=-1) - 1
    out, known = places[stops], {s: i for i, s in enumerate(segments)}
    several = np.flatnonzero(marks)
    # few runs differ, however many there are
    kinds, at = np.unique(np.stack([marks[several], out[several]]), axis=1, return_inverse=True)
    new = [known.setdefault(BLANK * n + segments[p], len(known)) for n, p in kinds.T.tolist()]
    out[several] = np.array(new, np.int64)[at]
    sizes = counts - np.bincount(np.repeat(np.arange(len(counts)), counts)[lone], minlength=len(counts))
    return list(known), out, sizes


def combined(losses: list[tuple[int, list[int]]], n: int) -> list[tuple[int, dict[int, int]]]:
    """The n smallest sums of one loss per place: (loss, {place: choice other than the best})."""
    queue, seen, out = [(0, ())], {()}, []
    by_place = dict(losses)
    while queue and len(out) < n:
        loss, choice = heapq.heappop(queue)
        out.append((loss, dict(choice)))
        picked = dict(choice)
        for place, options in losses:
            k = picked.get(place, 0) + 1
            if k < len(options):
                new = tuple(sorted((picked | {place: k}).items()))
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(queue, (sum(by_place[p][c] for p, c in new), new))
    return out


def segment_batch(pieces: Pieces, texts: pa.Array, n: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(text number, rank, score, ids) of the n best segmentations of every text."""
    segments, places, counts = runs(pieces, *text_segments(pieces, texts))
    firsts = [pieces.first(s) for s in segments]
    scores = np.array([s for s, _, _ in firsts], np.int64)
    gaps = np.array([g for _, _, g in firsts], np.int64)
    best_ids = [ids for _, ids, _ in firsts]
    solved: dict[int, list[tuple[int, bytes]]] = {}
    begin = 0
    for i, count in enumerate(counts.tolist()):
        own = places[begin:begin + count]
        begin += count
        parts = [best_ids[p] for p in own.tolist()]
        total = int(scores[own].sum())
        # only the places with the smallest loss can take part
        loss = gaps[own]
        if count > n > 1:
            near = np.argpartition(loss, n - 2)[:n - 1]
            near = near[np.lexsort((near, loss[near]))]
        else:
            near = np.argsort(loss, kind="stable")
        options = []
        for k in near.tolist() if n > 1 else ():
            if loss[k] < _NEVER:
                found = solved.get(own[k])
                if found is None:
                    found = solved[own[k]] = pieces.ranked(segments[own[k]], n)
                options.append((k, [found[0][0] - s for s, _ in found]))
        for rank, (lost, choice) in enumerate(combined(options, n), 1):
            ids = parts
            if choice:
                ids = list(parts)
                for k, c in choice.items():
                    ids[k] = solved[own[k]][c][1]
            yield i, rank, total - lost, b"".join(ids)


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """The worker's model."""
    return Pieces(path)


MODELS.append(pieces_of)


def segment_documents(docs: DataFrame, model: str, n: int = N) -> DataFrame:
    """doc_id, rank (from 1), score, n_tokens and ids (array) of the n best segmentations.

    A null or empty text has one segmentation without pieces; a text with fewer segmentations has
    fewer rows; equal scores are ordered by the search, the same way each time; null doc_ids and
    repeated rows are kept; an empty table gives no row; other columns are ignored.
    """
    return _mapped(docs, model, n, "ids array<int>", lambda ids: np.frombuffer(ids, "<u4").astype(np.int32), pa.list_(
        pa.int32()))


def segment_digests(docs: DataFrame, model: str, n: int = N) -> DataFrame:
    """As :func:`segment_documents`, with the ids' checksum (over u4) instead of the ids.

    The best segmentation is decoded again: ``decoded_crc32`` (of UTF-8) and ``round_trip``, whether
    that is the text; both are null for the others.
    """
    return _mapped(docs, model, n, "ids_crc32 long", zlib.crc32, pa.int64(), decoded=True)


def _mapped(docs: DataFrame, model: str, n: int, column: str, value, kind: pa.DataType, decoded: bool = False) -> DataFrame:
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in slices(batches, keep=pieces_of):
            texts, rows, back = batch.column("text"), [], []
            for i, rank, score, ids in segment_batch(pieces, texts, n):
                rows.append((i, rank, score, len(ids) // 4, value(ids)))
                if decoded:
                    text = pieces.decode(np.frombuffer(ids, "<u4").tolist()) if rank == 1 else None
                    back.append((None, None) if text is None else (
                        zlib.crc32(text.encode("utf-8", "replace")), text == (texts[i].as_py() or "")))
            at, rank, score, length, last = zip(*rows) if rows else [()] * 5
            crc, same = zip(*back) if back else [()] * 2
            columns = [
                batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(rank, pa.int32()),
                pa.array(score, pa.int64()), pa.array(length, pa.int64()), pa.array(last, kind)]
            names = ["doc_id", "rank", "score", "n_tokens", column.split()[0]]
            if decoded:
                columns += [pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
                names += ["decoded_crc32", "round_trip"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        mapped, f"doc_id long, rank int, score long, n_tokens long, {column}"
        + (", decoded_crc32 long, round_trip boolean" if decoded else ""))


def decode_documents(segmented: DataFrame, model: str) -> DataFrame:
    """``segmented`` (with ``ids``) with the decoded ``text``; a null list gives null."""
    rows = segmented.drop("text")
    schema = rows.select("*").schema.add("text", "string")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in slices(batches, keep=pieces_of):
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(mapped, schema)
