"""The prefix trie against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from emberline.llm import trie
from texts import ODD

SCHEMA = "conv_id long, turn long, role string, text string, key int, side string, shard int, seq string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    seqs = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + s[h:]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(seqs[c]) == len(p)))
        out.append((
            min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids),
            sum(len(q) == len(p) + 1 for q in below),
            sum(not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in below) for q in below),
            sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q),
            hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(spark, rows, parts=3):
    full = [(*r, 1, "x", 2, "y") for r in rows]
    got = trie.prefix_trie(spark.createDataFrame(full, SCHEMA).repartition(parts))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def conversations(seed, n, hot):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(3 * n), n):
        texts = ["same start", "and on", "to the end"] if rng.random() < hot else [
            rng.choice(["a", "b b", "same start", "c\tc c"]) for _ in range(rng.randint(1, 9))]
        rows += [(c, i, rng.choice(["user", "assistant"]) if i else "user", t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("least", [1, 40, 5000])
def test_equals_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(trie, "LEAST_TURNS", least)  # shards of one row and more, so nodes lie in several
    rows = conversations(least, 150, 0.4)
    assert nodes(spark, rows) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "LEAST_TURNS", 6)
    rows = [(i // 3, i % 3, "user", t) for i, t in enumerate(ODD)]
    rows += [(20, None, None, None), (20, 0, "user", "x"), (20, 0, "user", "x"), (21, 5, "user", None), (None, 0, "user", "lost"),
             (40, 1, None, "y"), (40, 0, "a", "y"), (45, 0, "user", "short"), (-7, 0, "user", "short"), (60, 0, "u", "z")]
    rows += [(61, i, "user", f"t{i % 3}") for i in range(300)] + [(62, i, "user", f"t{i % 3}") for i in range(280)]
    assert nodes(spark, rows) == brute(rows)


def test_no_conversations(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "user", "x")]) == []


def test_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "LEAST_TURNS", 10)
    rows = [(c, i, "user", f"hot {i}") for c in range(400) for i in range(3)]
    assert nodes(spark, rows, 8) == brute(rows)


def test_order_of_rows_over_bands():
    rng = random.Random(1)
    rows = [[rng.randint(0, 1) for _ in range(rng.choice([0, 1, 31, 32, 33, 64, 100]))] for _ in range(300)]
    rows += [[0] * 32, [0] * 32, [0] * 64 + [1], [0] * 65, [0] * 32 + [1], []]
    convs = np.array(rng.sample(range(1000), len(rows)))
    sizes = np.array([len(r) for r in rows])
    order, common = trie.in_order(np.array([x for r in rows for x in r]), np.cumsum(sizes) - sizes, sizes, convs)
    want = sorted(range(len(rows)), key=lambda i: (rows[i], convs[i]))
    assert order.tolist() == want
    for i, (a, b) in enumerate(zip(want, want[1:])):
        n = next((k for k, (x, y) in enumerate(zip(rows[a], rows[b])) if x != y), min(len(rows[a]), len(rows[b])))
        assert common[i + 1] == n
