"""Quality, language and the pipeline on small made-up corpora."""

import random
import zlib
from collections import Counter
from types import SimpleNamespace
from unittest.mock import MagicMock

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from test_near import linked_documents
from test_scans import linked_secrets
from test_tokens import crc, plain
from texts import ODD

from emberline.llm import language, quality

SOUNDS = {"en": ["th", "er", "on", "an", "ing", "the "], "de": ["sch", "ung", "ein", "ver", "keit", "der "],
          "fr": ["eau", "oi", "eux", "ç", "é", "le "]}


def prose(rng, lang, n):
    return "".join(rng.choice(SOUNDS[lang]) + rng.choice(["", "", " "]) for _ in range(n)).strip().capitalize() + "."


def bad(rng, lang, n):
    words = prose(rng, lang, n).split()
    return rng.choice([" ".join(w.upper() + "!!" for w in words), " ".join(w for w in words for _ in range(5)),
                       " | ".join(words)])


@pytest.fixture(scope="module")
def corpus():
    rng, rows, labels = random.Random(5), [], []
    for i in range(400):
        lang, good = rng.choice(list(SOUNDS)), rng.random() < 0.7
        rows.append((i, (prose if good else bad)(rng, lang, 60), lang))
        labels.append((i, int(good), 0))
    return rows, labels


def label_frame(spark, labels):
    return spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, text string")


def test_quality_of_held_out_documents(spark, docs_of, corpus):
    rows, labels = corpus
    extra = list(enumerate(ODD, 1000)) + [(None, "no id"), (3, rows[3][1])]
    frame = label_frame(spark, [*labels, (None, 1, 0), (5, None, 0), (1001, 1, 0), (9999, 0, 0)])
    out = quality.classify_quality(docs_of(rows + extra), frame).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {d: q for d, q, _ in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_quality_uses_every_labelled_vector_exactly():
    rng = random.Random(0)
    texts = [prose(rng, "en", 20) for _ in range(40)] + [bad(rng, "en", 20) for _ in range(40)]
    model = quality.fit(texts, [1] * 40 + [0] * 40, [2.0] * 40 + [1.0] * 40, neighbours=7)
    counts = np.concatenate(list(quality.term_counts(pa.array(texts))))
    near = model.embed(counts) @ model.vectors.T
    for row, score in zip(near, model.scores(pa.array(texts))):
        best = np.argsort(-row, kind="stable")[:7]
        weight = np.maximum(row[best], 1e-6).astype(float) ** 4 * model.shares[best]
        assert score == pytest.approx((weight * model.votes[best]).sum() / weight.sum(), abs=1e-6)


def test_quality_without_labels(spark, docs_of):
    out = quality.classify_quality(docs_of([(1, "a b"), (2, None)]), label_frame(spark, [])).collect()
    assert {(r.score, r.predicted) for r in out} == {(0.5, 0)}
    assert quality.classify_quality(docs_of([]), label_frame(spark, [(1, 1, 0)])).collect() == []


def test_language_of_held_out_documents(spark, docs_of, corpus):
    rows, _ = corpus
    extra = [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "der", "de"), (3, rows[3][1], rows[3][2])]
    out = language.identify_language(docs_of(rows + extra)).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {d: x for d, _, x in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in out}
    for i, text in enumerate(ODD):
        blank = not any(c.isalpha() for c in text or "")
        assert (by_id[1000 + i].lang_pred == "und") == blank and (by_id[1000 + i].score == 0) == blank


def test_language_falls_back_to_shorter_grams():
    counts = {"aa": {"word": ({"known": 5}, 10), "gram": ({"xyz": 3, "x": 4}, 20)},
              "bb": {"word": ({"known": 1, "other": 1}, 10), "gram": ({"yz": 6, "z": 1}, 20)}}
    model = language.build(counts)
    known, unseen, nothing = model.evidence(["known", "xyz", "qqq"])
    assert known == pytest.approx([0, np.log(1 / 10) - np.log(5 / 10)])
    rows = {g: np.array(v) for g, v in {
        "xyz": [np.log(3 / 20), np.log(0.1 / 20)], "yz": [np.log(0.1 / 20), np.log(6 / 20)],
        "z": [np.log(0.1 / 20), np.log(1 / 20)]}.items()}
    places = [rows[g] - rows[g].max() for g in ("xyz", "yz", "z")]  # ^ and $ have no gram
    assert unseen == pytest.approx(language.UNSEEN * np.mean(places, 0))
    assert nothing == pytest.approx([0, 0])


def test_language_without_examples(spark, docs_of):
    out = language.identify_language(docs_of([(1, "a b"), (2, None)])).collect()
    assert {(r.lang_pred, r.score) for r in out} == {("und", 0.0)}
    assert language.identify_language(docs_of([])).collect() == []


def test_pipeline_stages(spark, corpus, tmp_path):
    rows, labels = corpus
    rng = random.Random(1)
    secret = " password=abcdef0123456789abcdef and " + prose(rng, "en", 40)
    more = [(1000, secret, "en"), (1001, "12 34", None), (1002, rows[0][1], "en"), (1003, rows[0][1] + " x", "en")]
    full = [(d, t, x, "s", len(t)) for d, t, x in rows + more]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    label_frame(spark, labels).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, texts, seen = docs.columns, {d: t for d, t, *_ in full}, []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        result = stage(spark, docs, str(tmp_path))
        result.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append(name)
        if name == "best-fit packing":
            got = Counter((r.doc_id, r.start, r.ids_crc32) for r in docs.collect())
            ids = plain(public_tokenizers.path("byte_bpe_50k.json"), [t for _, t in before])
            assert got == Counter((d, 0, crc([*x, 2])) for (d, _), x in zip(before, ids))
            continue
        assert docs.columns == columns
        after = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
        good = {d for d, q, _ in labels if q}
        if name == "quality classifier":
            assert len(good - set(after)) <= 4 and len(set(after) - good) <= 4 + 15  # four have no label
        elif name == "language ID":
            assert set(d for d, _ in before) - set(after) <= {1001} and 1001 not in after
        elif name == "MinHash near-dedup":
            assert set(after) == {k[0] for k in linked_documents(before, 5, 80) if k[3]}
        else:
            for d, text in before:
                assert (after[d][0] == text) == (not linked_secrets(text))
                assert after[d][1] == len(after[d][0]) and "password" not in after[d][0]
    assert seen == [name for name, _ in corpus_pipeline.STAGES] and texts
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] > 0


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_pipeline_on_odd_tables(spark, corpus, tmp_path, kind):
    """No documents give no pieces; null ids, odd texts and no labels at all break nothing."""
    rows = [] if kind == "empty" else [(d, t, x) for d, t, x in corpus[0]] + [
        (None if i % 3 == 0 else 5000 + i, t, None) for i, t in enumerate(ODD)]
    spark.createDataFrame([(d, t, x, None, None) for d, t, x in rows], "doc_id long, text string, lang string, source string, "
                          "n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in got}
    # without labels nothing is rejected for its quality, so clean documents stay
    assert kept <= {d for d, *_ in rows} and len(kept) >= 0.7 * len({t for _, t, x in rows if x})


def test_driver_gives_memory_back_after_fits(spark, monkeypatch):
    from emberline.llm import language, quality

    docs = spark.createDataFrame([(i, f"word{i} and more words", "en") for i in range(20)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    done = []
    for module in (quality, language):
        monkeypatch.setattr(module, "trimmed", lambda name=module.__name__: done.append(name))
    assert len(quality.fitted(docs, labels).vectors) and language.fitted(docs).languages == ["en"]
    assert done == ["emberline.llm.quality", "emberline.llm.language"]


@pytest.mark.parametrize("module, made", [(quality, quality.score_documents), (language, language.predict_language)])
def test_workers_take_documents_in_small_parts(module, made):
    """A worker's memory is bounded by the documents it works on at once; none is left out."""

    class Sizes:
        def scores(self, texts):
            return np.full(len(texts), float(len(texts)))

        def predict(self, texts):
            return ["en"] * len(texts), self.scores(texts)

    docs = MagicMock()
    docs.sparkSession.sparkContext.broadcast = lambda model: SimpleNamespace(value=model)
    docs.select.return_value.schema = StructType().add("doc_id", "long")
    docs.select.return_value.mapInArrow = lambda mapped, schema: mapped
    batch = pa.record_batch({"doc_id": pa.array(range(3000)), "text": pa.array(["word"] * 3000)})
    parts = list(made(docs, Sizes(), "doc_id")(iter([batch])))
    assert [d for part in parts for d in part["doc_id"].to_pylist()] == list(range(3000))
    assert max(s for part in parts for s in part["_score"].to_pylist()) == module.AT_ONCE <= 512
