"""Quality of documents by votes of labelled neighbours in a latent-semantic space.

Terms are hashed: words, word shapes (``Aa.``, ``A!``, ``0``) and words that repeat the one before
them.  Damped counts times inverse document frequency, projected on the leading singular vectors of
a labelled sample, give a unit vector per document.  Every document is compared exactly with every
labelled vector, one matrix product per block, and the nearest ones vote with their similarity.

The labelled sample is bounded (``sample`` documents per label, drawn by hash), so the broadcast
model has a fixed size; so are the document frequencies, which come from the sample.  Counts, vectors
and votes are made for all documents from whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.tokens import slices, trimmed

#: Labelled documents per label that the model is fitted on, at most.
SAMPLE = 2000
TERMS, SHAPES, DIMENSIONS, NEIGHBOURS = 4096, 1024, 96, 15
#: Documents per matrix product.
BLOCK = 256
#: Documents that a worker works on at once, whole blocks; bounds its memory only.
AT_ONCE = 2 * BLOCK
THRESHOLD = 0.7


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the document belongs to the fold nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def term_counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of documents x terms: how often each hashed term occurs."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    shape = words
    for pattern, to in ((r"\p{Lu}+", "A"), (r"\p{L}+", "a"), (r"\p{N}+", "0"), (r"([^\p{L}\p{N}])[^\p{L}\p{N}]+", r"\1+")):
        shape = pc.replace_substring_regex(shape, pattern, to)
    # a capital at the start of a word is case of a sentence
    shape = pc.replace_substring_regex(shape, "^Aa$", "a")
    shape = shape.dictionary_encode()
    hashed = np.array([xxhash.xxh32_intdigest(s) % SHAPES for s in shape.dictionary.to_pylist()], np.int64)
    shapes = hashed[shape.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
    own = np.array([SHAPES + xxhash.xxh32_intdigest(w) % (TERMS - SHAPES - 1)
                    for w in pc.utf8_lower(words).to_pylist()], np.int64)
    real = np.fromiter(map(bool, words.to_pylist()), bool, len(words))
    ends = np.cumsum(sizes)
    for first in range(0, len(sizes), BLOCK):
        last = min(first + BLOCK, len(sizes))
        a, b = int(ends[first] - sizes[first]), int(ends[last - 1])
        place = at[a:b]
        row = np.repeat(np.arange(last - first), sizes[first:last])
        again = np.append(False, (place[1:] == place[:-1]) & (row[1:] == row[:-1])) if b > a else np.zeros(0, bool)
        keep = real[place]
        flat = np.concatenate([
            row[keep] * TERMS + shapes[place[keep]], row[keep] * TERMS + own[place[keep]],
            row[keep & again] * TERMS + TERMS - 1])
        yield np.bincount(flat, minlength=(last - first) * TERMS).reshape(-1, TERMS)


@dataclass
class Model:
    """Term weights, projection, and the labelled vectors with their votes."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    shares: np.ndarray
    neighbours: int = NEIGHBOURS

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return unit((np.log1p(counts, dtype=np.float32) * self.weights) @ self.axes)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Share of label 1 in the neighbours' votes; without any labelled row 0.5."""
        out = [np.empty(0)]
        k = min(self.neighbours, len(self.vectors))
        for counts in term_counts(texts):
            if not k:
                out.append(np.full(len(counts), 0.5))
                continue
            near = self.embed(counts) @ self.vectors.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, 1), 1e-6).astype(np.float64) ** 4 * self.shares[best]
            out.append((weight * self.votes[best]).sum(1) / weight.sum(1))
        return np.concatenate(out)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def fit(texts: list[str], labels: list[int], shares: list[float], dimensions: int = DIMENSIONS,
        neighbours: int = NEIGHBOURS) -> Model:
    """Singular vectors of the labelled sample by subspace iteration, and its unit vectors.

    ``shares``: how many documents a sampled one stands for, so that votes follow the true mix.
    """
    x = np.zeros((len(texts), TERMS), np.float32)
    first = 0
    for counts in term_counts(pa.array(texts, pa.string())):
        np.log1p(counts, out=x[first:first + len(counts)], casting="same_kind")
        first += len(counts)
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    weights[:SHAPES] *= 3
    weights[TERMS - 1] *= 3
    x *= weights
    rng = np.random.default_rng(0)
    axes = rng.standard_normal((TERMS, min(dimensions, TERMS))).astype(np.float32)
    for _ in range(6 if len(x) else 0):
        axes = np.linalg.qr(x.T @ (x @ axes))[0].astype(np.float32)
    return Model(weights, axes, unit(x @ axes), np.array(labels, np.float64), np.array(shares, np.float64), neighbours)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, skip: Column) -> DataFrame:
    """About ``sample`` documents of each label, those with the smallest hashes of their ids."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).filter(~skip)
    sizes = known.groupBy("label").agg(F.count("*").alias("n"))
    share = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)) * F.col("n") < sample
    drawn = known.join(sizes, "label").filter(share).dropDuplicates(["doc_id"]).select(
        "doc_id", "label", F.greatest(F.col("n") / sample, F.lit(1.0)).alias("share"))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(drawn), "doc_id")


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE,
           folds: int = 4, fold: int = 2) -> Model:
    rows = labelled_sample(docs, labels, label, sample, held_out(F.col("doc_id"), folds, fold)).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    model = fit([r["text"] or "" for r in rows], [r["label"] for r in rows], [r["share"] for r in rows])
    # the driver keeps the model only, also for the stages that follow
    del rows
    trimmed()
    return model


def score_documents(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``_score``; the text is read, never cut."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, *[] if "text" in keep else ["text"])
    schema = docs.select(*keep).schema.add("_score", "double")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, AT_ONCE):
            scores = shared.value.scores(batch.column("text").cast(pa.string()))
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=schema.names)

    return rows.mapInArrow(mapped, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more.

    Null and empty texts are scored too; without labels every score is 0.5 and nothing is rejected.
    """
    kept = docs.drop("_score")
    model = fitted(kept, labels)
    if not len(model.vectors):
        return kept
    return score_documents(kept, model, *kept.columns).filter(F.col("_score") >= threshold).select(*kept.columns)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = 4,
                     fold: int = 2, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null and empty texts are scored as a document without terms; a null doc_id is never learned
    from and not held out; repeated rows are scored each; without labels the score is 0.5; other
    columns are ignored.
    """
    model = fitted(docs, labels, "quality", sample, folds, fold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score_documents(rows, model, "doc_id").select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"))
