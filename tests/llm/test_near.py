"""Near duplicates and search against brute force."""

import math
import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from texts import ODD

from emberline.llm import covertree, egojoin, minhash
from emberline.llm.components import components
from emberline.llm.tokens import slices


class Parts:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)

    def least(self, ids):
        low = {}
        for i, v in enumerate(ids):
            if v is not None:
                low[self.find(i)] = min(low.get(self.find(i), v), v)
        return [None if v is None else low[self.find(i)] for i, v in enumerate(ids)]


def shingles(text, n):
    words = regex.findall(r"[^\x20\x09-\x0D]+", regex.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def linked_documents(rows, n, percent):
    sets, parts = [shingles(t, n) for _, t in rows], Parts(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]) and None not in (rows[i][0], rows[j][0]):
                parts.join(i, j)
    low = parts.least([d for d, _ in rows])
    return Counter((d, len(s), c, c == d) for (d, _), s, c in zip(rows, sets, low))


@pytest.mark.parametrize("n", [2, 5])
def test_documents(spark, docs_of, n):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(200)]
    base, rows = [rng.choice(words) for _ in range(40)], []
    for i in range(220):  # near copies whose pairs lie on both sides of the threshold
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(40)] = rng.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(base).upper()) for i in range(100)]  # a large group of copies
    rows += [(2000 + i, " ".join(rng.choice(words) for _ in range(30))) for i in range(50)]
    rows += list(enumerate(ODD, 3000)) + [(None, " ".join(base)), (3003, "a")]
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs_of(rows), words=n).collect())
    assert got == linked_documents(rows, n, 80)


def test_parts_of_a_batch_keep_their_texts():
    texts = ["é" * (i % 40) + " Größe X" for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(slices([batch], 70))
    assert [t for part in parts for t in part.column(0).to_pylist()] == texts
    got = [x for part in parts for x in minhash.shingle_sets(part.column(0), 2)]
    assert all((a == b).all() for a, b in zip(got, minhash.shingle_sets(batch.column(0), 2)))


def test_components_of_a_bucket_meet_in_chunks():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base, texts = [rng.choice(words) for _ in range(30)], []
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(30)] = rng.choice(words)
        texts.append(" ".join(own))
    sets = minhash.shingle_sets(pa.array(texts), 2)
    signs = minhash.sign_bits(minhash.superminhash(sets, 160))
    buckets = np.tile(np.arange(32), (120, 1))  # all share every bucket
    buckets[100:, 0] = 99  # but for these, which meet the others in the second
    component = np.arange(120) % 40

    def table(rows, bucket):
        return pa.table({
            "bucket": pa.array([bucket] * len(rows), pa.int64()), "largest": pa.array([0] * len(rows), pa.int64()),
            "rep": pa.array(rows, pa.int64()), "component": pa.array(component[rows], pa.int64()),
            "s0": pa.array(signs[rows, 0]), "s1": pa.array(signs[rows, 1]),
            "buckets": pa.array(list(buckets[rows]), pa.list_(pa.int64())),
            "shingles": pa.array([sets[i].view(np.int64) for i in rows], pa.list_(pa.int64()))})

    got, want = Parts(120), Parts(120)
    for i, c in enumerate(component):
        got.join(i, c)
        want.join(i, c)
    for bucket, members in ((0, range(100)), (99, range(100, 120)), (1, range(120))):
        members = list(members)
        outside = [i for i in members if component[i] != 0]
        for a in range(0, len(outside), 25):
            for b in range(0, len(members), 25):
                for x, y in minhash.chunk_links(table(outside[a:a + 25], bucket), table(members[b:b + 25], bucket), 80):
                    assert 100 * len(set(sets[x]) & set(sets[y])) >= 80 * len(set(sets[x]) | set(sets[y]))
                    got.join(x, y)
    for i in range(120):
        for j in range(i):
            if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j])):
                want.join(i, j)
    assert got.least(list(range(120))) == want.least(list(range(120)))
    assert len(set(want.least(list(range(120))))) > 1


def test_keep_one_of_each_group(spark, docs_of):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (9, "A b  c d e f"), (8, ""), (7, None), (None, "a b c d e f")]
    kept = minhash.keep_distinct(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([3, 8, 7, None])
    assert minhash.near_duplicates(docs_of([])).collect() == []
    assert minhash.keep_distinct(docs_of([])).collect() == []


def test_keep_rows_that_repeat_an_id(spark, docs_of):
    """A repeated doc_id with a copied and a unique text keeps the unique one; equal rows stay once."""
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v"), (3, "m n o p q r"), (3, "m n o p q r"),
            (3, "M n o p q r"), (4, ""), (4, ""), (None, "m n o p q r"), (None, "m n o p q r"), (5, "z y x w v u")]
    kept = minhash.keep_distinct(docs_of(rows))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([
        (1, "a b c d e f"), (2, "q r s t u v"), (3, "M n o p q r"), (4, ""), (4, ""), (None, "m n o p q r"),
        (None, "m n o p q r"), (5, "z y x w v u")])


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(1, 2**63, 1000).astype(np.uint64)
    a, b = np.sort(pool[:800]), np.sort(pool[200:])
    many = [minhash.superminhash([minhash.mix(a + np.uint64(s)), minhash.mix(b + np.uint64(s))], 160) for s in range(30)]
    assert abs(np.mean([(x[0] == x[1]).mean() for x in many]) - 0.6) < 0.02
    one, = minhash.superminhash([np.array([7], np.uint64)], 160)
    # one shingle meets every slot, at every rank once
    assert sorted(one.astype(int)) == list(range(160))


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(500 + i, 501 + i) for i in range(60)]
    links += [(700, 701 + i) for i in range(80)] + [(3, 3), (None, 4), (900, None)]
    parts = Parts(1000)
    for a, b in links:
        if a is not None and b is not None:
            parts.join(a, b)
    low = parts.least(list(range(1000)))
    real = {x for a, b in links if None not in (a, b) and a != b for x in (a, b)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, low[x]) for x in real)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def files_of_stores(monkeypatch, module):
    """Label and number of data files of each table that the module stores from now on."""
    made, real = [], module.store

    def counted(df, label, *more):
        out = real(df, label, *more)
        made.append((label, len(out.inputFiles())))
        return out

    monkeypatch.setattr(module, "store", counted)
    return made


@pytest.fixture
def uncoalesced(spark):
    """Shuffles keep 16 partitions, however little is in them."""
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_rounds_write_files_by_their_links(spark, monkeypatch, uncoalesced):
    """Each file costs an executor a child process, so a round of few links writes one."""
    made = files_of_stores(monkeypatch, sys.modules[components.__module__])
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert sorted(map(tuple, components(links).collect())) == [(i, 0) for i in range(301)]
    assert len(made) > 3 and all(n == 1 for _, n in made[1:])
    monkeypatch.setattr(sys.modules[components.__module__], "LINKS", 100)
    del made[:]
    assert sorted(map(tuple, components(links).collect())) == [(i, 0) for i in range(301)]
    assert all(1 < n <= 3 for _, n in made[1:])


def test_links_are_written_once(docs_of, monkeypatch, uncoalesced):
    """The stages that compare full sets write no files of their own; only components() stores links."""
    made = files_of_stores(monkeypatch, minhash)
    rows = [(i, " ".join(f"w{j}" for j in range(40) if j != i % 45)) for i in range(90)]
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs_of(rows), words=2).collect())
    assert got == linked_documents(rows, 2, 80)
    assert [label for label, _ in made] == ["fingerprints", "classes", "buckets", "sets", "open", "rest"]


def vectors():
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=12).tolist(), int(rng.integers(3))) for i in range(300)]
    hot = rng.normal(size=12)
    rows += [(2000 + i, hot.tolist(), 1) for i in range(150)]
    rows += [(3000 + i, (hot + rng.normal(size=12) * 0.3).tolist(), int(rng.integers(2))) for i in range(150)]
    rows += [(5000, None, 1), (5001, hot.tolist(), None), (5002, [0.0] * 12, 1), (5003, [1.0, None] + [0.0] * 10, 1),
             (None, hot.tolist(), 1), (5004, [math.nan] * 12, 1), (5005, [1.0, 2.0], 1), (5006, [2.0, 4.0], 1),
             (5007, [], 1), (2000, hot.tolist(), 1), (5008, [1e-30] * 12, 2), (5009, [1e30] * 12, 2)]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int, rep int, n string, pivot int, dim int, v string"


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], VECTORS).repartition(4)


@pytest.mark.parametrize("size", [32, 1024])
def test_vectors(spark, size):
    df = vector_frame(spark, vectors())
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    parts, degree, groups = Parts(len(rows)), [0] * len(rows), {}
    for i, (v, e, label) in enumerate(rows):
        if v is not None and label is not None and e and None not in e and all(map(math.isfinite, e)) and any(e):
            groups.setdefault((label, len(e)), []).append(i)
    for members in groups.values():
        x = np.array([rows[i][1] for i in members], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= 0.93)):
            if a != b:
                degree[members[a]] += 1
                parts.join(members[a], members[b])
    low = parts.least([v for v, _, _ in rows])
    got = Counter(tuple(r) for r in egojoin.near_duplicates(df, size=size).collect())
    assert got == Counter((v, d, c, c == v) for (v, _, _), d, c in zip(rows, degree, low))
    assert sum(degree) > 10_000


@pytest.mark.parametrize("kw", [{"k": 5, "block_rows": 32}, {"k": 20}])
def test_top_k(spark, kw):
    df = vector_frame(spark, [r for r in vectors() if r[0] != 5009])
    rows = {(r.vec_id, str(r.embedding)): (r.vec_id, r.embedding) for r in df.collect()}.values()
    real = [(i, np.floor(64 * np.array(e, float)).astype(int)) for i, e in rows
            if i is not None and e is not None and None not in e and all(map(math.isfinite, e))]
    want = set()
    for q, x in real:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in real if i != q and len(x) == len(y))[:kw["k"]]
            want.update((q, n, i, -s) for n, (s, i) in enumerate(best, 1))
    got = sorted(tuple(r) for r in covertree.top_k(df, F.col("vec_id") % 20 == 0, **kw).collect())
    assert got == sorted(want)


def test_no_vectors(spark):
    none = vector_frame(spark, [])
    assert egojoin.near_duplicates(none).collect() == []
    assert covertree.top_k(none, F.col("vec_id") % 20 == 0).collect() == []
