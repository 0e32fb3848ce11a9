"""Language of documents: known words first, character n-grams for the others.

The model holds log frequencies per language of the commonest words and of character n-grams of
length 1 to 4 (with word edges).  A known word adds its log frequency; an unseen one is covered by
its n-grams, each place falling back from four characters to three, two and one until an n-gram is
known.  Words that only some languages know get a floor in the others.

What is learned comes from a bounded sample of labelled documents per language, drawn by hash; the
model has at most ``words`` words and ``grams`` n-grams per language and is broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.quality import held_out
from emberline.llm.tokens import slices, trimmed

SAMPLE = 600
WORDS, GRAMS = 8000, 12000
ORDERS = (4, 3, 2, 1)
#: An unseen word counts less than a known one: its n-grams are only indirect evidence.
UNSEEN = 0.6
#: Words that count fully; the evidence of longer texts is scaled to it, so scores don't saturate.
ENOUGH = 12
#: Documents that a worker works on at once; bounds its memory only.
AT_ONCE = 512
_WORD = regex.compile(r"\p{L}+")


def n_grams(word: str) -> Iterator[tuple[int, str]]:
    """(place, n-gram) of the word with its edges, all orders."""
    padded = f"^{word}$"
    for n in ORDERS:
        for i in range(len(padded) - n + 1):
            yield i, padded[i:i + n]


@dataclass
class Model:
    """Known words and n-grams; ``keys`` are sorted hashes of n-grams, ``values`` their evidence."""

    languages: list[str]
    words: dict[str, np.ndarray]
    keys: np.ndarray
    values: np.ndarray

    def unseen(self, words: list[str]) -> np.ndarray:
        """Mean evidence over the places of each word, by the longest n-gram known there."""
        out = np.zeros((len(words), len(self.languages)))
        if not words or not len(self.keys):
            return out
        padded = [f"^{w}$" for w in words]
        codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, padded), np.int64, len(padded))
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters to the word's end
        at = np.full(len(codes), -1)
        for order in ORDERS:
            place = np.flatnonzero((at < 0) & (left >= order))
            hashes = gram_hashes(codes, place, order)
            found = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[found] == hashes
            at[place[known]] = found[known]
        word = np.repeat(np.arange(len(words)), sizes)[at >= 0]
        n = np.maximum(np.bincount(word, minlength=len(words)), 1)
        for i in range(out.shape[1]):
            out[:, i] = np.bincount(word, self.values[at[at >= 0], i], len(words)) / n
        return out

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log evidence of each word for each language: its own if known, else its n-grams'."""
        found = [self.words.get(w) for w in words]
        new = [i for i, x in enumerate(found) if x is None]
        out = np.zeros((len(words), len(self.languages)))
        out[new] = UNSEEN * self.unseen([words[i] for i in new])
        old = [i for i, x in enumerate(found) if x is not None]
        if old:
            out[old] = np.stack([found[i] for i in old])
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        k = len(self.languages)
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        tokens, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        # nearly all tokens are one word between other signs
        one = pc.extract_regex(tokens, r"^\P{L}*(?P<word>\p{L}+)\P{L}*$")
        single = one.is_valid().to_numpy(zero_copy_only=False)
        words, token = one.field(0).to_pylist(), np.flatnonzero(single).tolist()
        words = [words[i] for i in token]
        for i in np.flatnonzero(~single).tolist():
            found = _WORD.findall(tokens[i].as_py())
            words += found
            token += [i] * len(found)
        distinct = pa.array(words, pa.string()).dictionary_encode()
        evidence = self.evidence(distinct.dictionary.to_pylist())[distinct.indices.to_numpy(zero_copy_only=False)]
        table = np.stack(
            [np.bincount(token, column, len(tokens)) for column in (*evidence.T, np.ones(len(words)))], 1)
        totals, some = np.zeros((len(sizes), k + 1)), sizes > 0
        if len(at):
            totals[some] = np.add.reduceat(table[at], (np.cumsum(sizes) - sizes)[some])
        n = totals[:, k]
        if not k:
            return ["und"] * len(sizes), np.zeros(len(sizes))
        total = totals[:, :k] * (np.minimum(n, ENOUGH) / np.maximum(n, 1))[:, None]
        weight = np.exp(total - total.max(1, keepdims=True))
        score = np.where(n > 0, 1 / weight.sum(1), 0.0)
        return [self.languages[b] if w else "und" for b, w in zip(weight.argmax(1), n)], score


def gram_hashes(codes: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the n-grams that start at the places."""
    out = np.full(len(place), order, np.uint64)
    for j in range(order):
        out = (out ^ codes[place + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def sample_counts(docs: DataFrame, folds: int, fold: int, sample: int, words: int, grams: int) -> dict:
    """Commonest words and n-grams of each language's sample, with their counts."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
        & ~held_out(F.col("doc_id"), folds, fold))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    place = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)) * F.col("n")
    drawn = known.join(F.broadcast(sizes), "lang").filter(place < sample).select("lang", "text")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in slices(batches, AT_ONCE):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
        for lang, found in counts.items():
            parts = Counter()
            for word, n in found.items():
                for _, gram in n_grams(word):
                    parts[gram] += n
            for kind, table in (("word", found), ("gram", parts)):
                terms = list(table)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(terms), pa.string()), pa.array([kind] * len(terms), pa.string()),
                    pa.array(terms, pa.string()), pa.array([table[t] for t in terms], pa.int64()),
                ], names=["lang", "kind", "term", "n"])

    counts = drawn.mapInArrow(mapped, "lang string, kind string, term string, n long").groupBy(
        "lang", "kind", "term").agg(F.sum("n").alias("n"))
    # bounded by the parameters: the commonest terms, and one total per language and kind
    top = F.slice(F.sort_array(F.collect_list(F.struct("n", "term")), False), 1, max(words, grams))
    packed = counts.groupBy("lang", "kind").agg(top.alias("top"), F.sum("n").alias("total"))
    out: dict[str, dict] = {}
    for row in packed.collect():
        limit = words if row["kind"] == "word" else grams
        out.setdefault(row["lang"], {})[row["kind"]] = (
            {t["term"]: t["n"] for t in row["top"][:limit]}, row["total"])
    return out


def build(counts: dict) -> Model:
    languages = sorted(counts)

    def table(kind: str) -> dict[str, np.ndarray]:
        found = [counts[lang].get(kind, ({}, 1)) for lang in languages]
        floor = np.array([np.log(0.1 / max(total, 1)) for _, total in found])
        out: dict[str, np.ndarray] = {}
        for i, (terms, total) in enumerate(found):
            for term, n in terms.items():
                if term not in out:
                    out[term] = floor.copy()
                out[term][i] = np.log(n / total)
        # only differences between languages count
        return {term: x - x.max() for term, x in out.items()}

    grams = table("gram")
    hashes = np.array([gram_hashes(
        np.frombuffer(g.encode("utf-32-le"), np.uint32).astype(np.uint64), np.zeros(1, np.int64), len(g))[0]
        for g in grams], np.uint64)
    order = np.argsort(hashes)
    values = np.array([*grams.values()]).reshape(len(grams), len(languages))
    return Model(languages, table("word"), hashes[order], values[order])


def predict_language(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs``, ``_lang`` and ``_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, *[] if "text" in keep else ["text"])
    schema = docs.select(*keep).schema.add("_lang", "string").add("_score", "double")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, AT_ONCE):
            lang, score = shared.value.predict(batch.column("text").cast(pa.string()))
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return rows.mapInArrow(mapped, schema)


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language is found, with a score of ``least`` or more."""
    kept = docs.drop("_lang", "_score")
    return predict_language(kept, fitted(kept), *kept.columns).filter(
        (F.col("_lang") != "und") & (F.col("_score") >= least)).select(*kept.columns)


def fitted(docs: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> Model:
    model = build(sample_counts(docs, folds, fold, sample, WORDS, GRAMS))
    trimmed()
    return model


def identify_language(docs: DataFrame, folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs`` (``doc_id``, ``text``, ``lang``).

    A null text or one without a letter is ``und`` with score 0, and so is every row when nothing
    can be learned; null lang, text or doc_id are not learned from; ties go to the first language
    in order; repeated rows are scored each; other columns are ignored.
    """
    model = fitted(docs, folds, fold, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict_language(rows, model, "doc_id").select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), F.col("_lang").alias("lang_pred"),
        F.col("_score").alias("score"))
