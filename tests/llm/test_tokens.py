"""Token files, packing and piece segmentation against the libraries themselves."""

import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from texts import ODD
from tokenizers import Tokenizer

from emberline.llm import nbest, packing, repair, tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def plain(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_library(path):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab éÉß.,'!? \n\t1-") for _ in range(30)) for _ in range(200)]
    for _ in range(2):  # the second time from the cache
        ids, n = tokens.encoder(path).batch(pa.array(texts, pa.string()))
        want = plain(path, texts)
        assert n.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def test_repair_files_give_the_ids_back(spark, docs_of):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "no id"), (6, "same id"), (1000, "the cat sat on the mat " * 400)]
    files = repair.write_tokens(docs_of(rows), WORD, least=4)
    got = sorted(tuple(r)[:4] for r in repair.read_tokens(files).collect() if r.doc_id is not None)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1]))
    start, want = len(plain(WORD, ["no id"])[0]) + 1, []
    for (doc, _), ids in zip(order, plain(WORD, [t for _, t in order])):
        want.append((doc, start, len(ids) + 1, crc([*ids, 1])))
        start += len(ids) + 1
    assert got == sorted(want)
    shards = files.collect()
    assert any(len(s["rules"]) for s in shards)
    for s in shards:
        for i, doc in enumerate(s["doc_ids"]):
            if doc == 1000:
                ids = [*plain(WORD, [rows[-1][1]])[0], 1]
                for a, b in ((0, 1), (5, 60), (700, 701), (0, len(ids)), (len(ids) - 1, len(ids) + 9)):
                    assert repair.read_range(s, i, a, b).tolist() == ids[a:b]


def test_no_documents(spark, docs_of):
    assert repair.read_tokens(repair.write_tokens(docs_of([]), WORD)).collect() == []
    assert packing.pack_documents(docs_of([]), BYTE).collect() == []
    assert nbest.segment_documents(docs_of([]), public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def test_packing_places_every_token_once(spark, docs_of):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(1000 + i, "copy of one") for i in range(150)] + list(enumerate(ODD, 5000)) + [(None, "no id"), (7, "again")]
    out = packing.pack_documents(docs_of(rows), BYTE, capacity=64, keep_ids=True).collect()
    by_text, sequences = Counter(), {}
    for r in out:
        assert 1 <= r.length <= 64 and crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32
        by_text[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = Counter()
    for (doc, _), ids in zip(rows, plain(BYTE, [t for _, t in rows])):
        ids = [*ids, 2]
        first = len(ids) - (-(-len(ids) // 64) - 1) * 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, b - a, crc(ids[a:b])] += 1
    assert by_text == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(k[3] * n for k, n in want.items())
    assert len(sequences) <= 1.05 * -(-total // 64) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_the_histogram_up(seed):
    rng = random.Random(seed)
    counts = Counter(min(1024, max(1, int(rng.expovariate(1 / 300)))) for _ in range(3000))
    counts[333] += 1500  # a third of all pieces
    made = Counter()
    for pattern, times in packing.plan(counts):
        assert sum(n * m for n, m in pattern.items()) <= 1024 and times > 0
        for n, m in pattern.items():
            made[n] += m * times
    assert made == counts


def brute(pieces, text, n):
    t, out = nbest.normalized(text), []

    def go(i, score, ids):
        if i == len(t):
            out.append((score, tuple(ids)))
            return
        for j in range(i + 1, len(t) + 1):
            if found := pieces.table.get(t[i:j]):
                go(j, score + found[0], [*ids, found[1]])
        if t[i] not in pieces.table:
            go(i + 1, score + pieces.unknown, [*ids, *(pieces.byte_ids[b] for b in t[i].encode())])

    go(0, 0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("n", [1, 3, 7])
def test_n_best_segmentations(n):
    pieces, rng = nbest.pieces_of(public_tokenizers.path("piece_bpe_32k.model")), random.Random(2)
    texts = ["", None, "the cat", " a  b", "hi\nyo", "é😀x", "   ", "in. on", "  the", "a   b c", "▁ a"]
    texts += ["".join(rng.choice("ab the\n.▁") for _ in range(8)) for _ in range(60)]
    got = {}
    for i, rank, score, ids in nbest.segment_batch(pieces, pa.array(texts, pa.string()), n):
        got.setdefault(i, []).append((score, tuple(np.frombuffer(ids, "<u4").tolist())))
        assert rank == len(got[i])
        assert pieces.decode(list(got[i][-1][1])) == (texts[i] or "").replace("▁", " ")
    for i, text in enumerate(texts):
        want = brute(pieces, text, n)
        assert [s for s, _ in got[i]] == [s for s, _ in want[:n]]
        assert set(got[i]) <= set(want) and len(set(got[i])) == len(got[i])


def test_segmented_documents_decode(spark, docs_of):
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = list(enumerate(ODD)) + [(None, "no id"), (3, "again")]
    out = nbest.decode_documents(nbest.segment_documents(docs_of(rows), model), model).collect()
    want = Counter((d, (t or "").replace("▁", " ")) for d, t in rows)
    assert Counter((r.doc_id, r.text) for r in out if r["rank"] == 1) == want
    assert all(r.n_tokens == len(r.ids) for r in out)


def test_memory_of_a_dropped_model_goes_back_before_the_next_stage(monkeypatch):
    model, done = lru_cache(maxsize=1)(lambda path: [path]), []
    model("a")
    monkeypatch.setattr(tokens, "MODELS", [model])
    monkeypatch.setattr(tokens, "trimmed", lambda: done.append(model.cache_info().currsize))
    next(tokens.slices(iter([pa.record_batch({"text": ["x"]})])))
    assert done == [0]


def test_slots_of_sequences_need_no_python_workers(docs_of):
    """An RDD of the driver's rows would hold workers beside those that tokenise."""
    for rows in ([(i, "some words " * i) for i in range(30)], []):
        packed = packing.pack_documents(docs_of(rows), str(public_tokenizers.path("byte_bpe_50k.json")))
        plan = packed._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" not in plan and "ExistingRDD" not in plan
        assert packed.count() == len(rows)
