"""Exact token ids of whole texts from a ``tokenizers`` file, one distinct word at a time.

Both kinds of file cut a text into pre-tokens before any merge, and some places are cut whatever
stands around them.  Between such places a piece of text always gives the same ids, so a batch is
split there by Arrow, its distinct pieces are encoded once by the library (normaliser,
pre-tokeniser and model of the file itself), and the texts are put together again with array
operations.  The places are

* for a normaliser that turns white space into one blank and a pre-tokeniser that drops it (word
  ends in the vocabulary): every run of ASCII white space;
* for the byte-level pre-tokeniser: a single blank between two characters that are not white
  space.  A text with another blank is split by a regular expression with that condition.

The strings of special tokens inside a text are ordinary text, as the files' description advises.
Null texts are empty.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept in each of the two generations of a worker's cache; bounds its memory only.
CACHE_WORDS = 250_000
#: Documents, and bytes of their columns, that are worked on at once.
SLICE, SLICE_BYTES = 2500, 8 << 20
#: The caches that keep a worker's models.
MODELS: list[Callable] = []
#: Letters of one code point that normal form C keeps and whose lower case is one code point.
_PLAIN = "^(?P<core> ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<mark>[.,;:!?]?)$"
_LETTERS = [c for c in range(0x41, 0x100) if c not in (0xD7, 0xF7) and (c < 0x7B or c >= 0xC0) and chr(c).isalpha()]
_INNER_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: A blank beside other white space or at an end of the text.
_ODD_BLANK = r"\s |^ | $| \s"


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of ``[start, start + length)`` ranges."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def trimmed() -> None:
    """Gives freed memory back to the system, Arrow's and the C library's (where it can)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE, keep: object = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches in smaller parts of at most ``rows`` rows and about SLICE_BYTES; freed memory goes back after each batch.

    Parts are copies: some string kernels go wrong on a slice that doesn't begin at its buffer's
    start.  A worker serves one stage after the other: models of other files than ``keep`` are dropped.
    """
    for cache in MODELS:
        if cache.cache_info().currsize and cache is not keep:
            cache.cache_clear()
            trimmed()
    for batch in batches:
        first = 0
        while first < batch.num_rows:
            step = min(rows, batch.num_rows - first)
            while step > 1 and batch.slice(first, step).nbytes > SLICE_BYTES:
                step //= 2
            yield batch.take(pa.array(np.arange(first, first + step)))
            first += step
        trimmed()


class Encoder:
    """Ids of many texts by one tokenizer file."""

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.cache = cache

        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.splitter, self.model = (
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model)
        self.word_ends = self.normalizer is not None
        # what the model reads for a character: one per byte
        self.letters = {c: self.splitter.pre_tokenize_str(chr(c))[0][0] for c in _LETTERS}
        if not self.word_ends:
            self.letters[ord(" ")] = self.splitter.pre_tokenize_str(" ")[0][0]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _tokens(self, token: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(token)], np.uint32).tobytes()

    def _encode(self, word: str) -> bytes:
        """Any word by the file's own normaliser, pre-tokeniser and model."""
        text = self.normalizer.normalize_str(word) if self.word_ends else word
        return b"".join(self._tokens(token) for token, _ in self.splitter.pre_tokenize_str(text))

    def _lookup(self, keys: pa.Array, make) -> list[bytes]:
        recent, older, out = self.recent, self.older, []
        for key in keys.to_pylist():
            ids = recent.get(key)
            if ids is None:
                ids = older.get(key)
                if ids is None:
                    ids = make(key)
                if len(recent) >= self.cache:
                    self.older, self.recent = older, recent = recent, {}
                recent[key] = ids
            out.append(ids)
        return out

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of each word's ids.

        Letters with at most one mark behind them are two pre-tokens in either kind of file, so
        words that differ in the mark (or in case, where it is dropped) share their letters' ids.
        """
        parts = pc.extract_regex(words, _PLAIN)
        plain = parts.is_valid()
        core, mark = pc.filter(parts.field(0), plain), pc.filter(parts.field(1), plain)
        if self.word_ends:
            core = pc.utf8_lower(core)
        core, mark = core.dictionary_encode(), mark.dictionary_encode()
        other = pc.filter(words, pc.invert(plain))
        table = (
            self._lookup(core.dictionary, lambda key: self._tokens(key.translate(self.letters)))
            + [self._encode(x) for x in mark.dictionary.to_pylist()]
            + self._lookup(other, self._encode)
        )
        flat = np.frombuffer(b"".join(table), np.uint32)
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        starts = np.cumsum(sizes) - sizes
        n_core, n_mark = len(core.dictionary), len(mark.dictionary)
        is_plain = plain.to_numpy(zero_copy_only=False)
        # two table rows a word: letters and mark, or the whole word and an empty row
        rows = np.empty((len(words), 2), np.int64)
        rows[is_plain, 0] = core.indices.to_numpy(zero_copy_only=False)
        rows[is_plain, 1] = n_core + mark.indices.to_numpy(zero_copy_only=False)
        rows[~is_plain, 0] = n_core + n_mark + np.arange(len(other))
        sizes, starts = np.append(sizes, 0), np.append(starts, 0)
        rows[~is_plain, 1] = len(sizes) - 1
        return flat[ragged(starts[rows.ravel()], sizes[rows.ravel()])], sizes[rows].sum(1)

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pieces, the piece at each place, and the number of places of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.word_ends:
            lists = pc.ascii_split_whitespace(texts)
            flat = lists.flatten()
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            odd = pc.match_substring_regex(texts, _ODD_BLANK).to_numpy(zero_copy_only=False)
            lists = pc.split_pattern(texts, " ")
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            if odd.any():
                parts, counts = [], counts.copy()
                for i, text in enumerate(texts.to_pylist()):
                    own = _INNER_BLANK.split(text) if odd[i] else text.split(" ")
                    counts[i] = len(own)
                    parts += own
                flat = pa.array(parts, pa.large_string())
            first = np.zeros(len(flat), bool)
            first[(np.cumsum(counts) - counts)[counts > 0]] = True
            first = pa.array(first)
            flat = pc.binary_join_element_wise(
                pc.if_else(first, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())), flat,
                pa.scalar("", pa.large_string()))
        coded = flat.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), counts

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the batch's distinct words, their lengths, the word at each place, places per text."""
        words, at, counts = self.pieces(texts)
        flat, lengths = self.words(words)
        return flat, lengths, at, counts

    def batch(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's ids."""
        return joined(*self.coded(texts), end_id)


def joined(flat: np.ndarray, lengths: np.ndarray, at: np.ndarray, counts: np.ndarray,
           end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Texts put together from the symbols of their words, each closed by ``end_id``."""
    starts, sizes = np.cumsum(lengths) - lengths, lengths[at]
    symbols = flat[ragged(starts[at], sizes)]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.cumsum(counts)
    per_text = upto[ends] - upto[ends - counts]
    if end_id is not None:
        symbols = np.insert(symbols, np.cumsum(per_text), end_id)
        per_text = per_text + 1
    return symbols.astype(np.uint32, copy=False), per_text


@lru_cache(maxsize=1)
def encoder(path: str, cache: int = CACHE_WORDS) -> Encoder:
    """The worker's encoder of a file; later tasks of the worker find its words cached."""
    return Encoder(path, cache)


MODELS.append(encoder)
