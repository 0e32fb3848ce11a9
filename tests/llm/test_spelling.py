"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from texts import ODD

from emberline.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows):
    words = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            i = h % len(run)
            words[run[:i] + run[i + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def brute(words):
    out, form = {}, {}
    for w, n in words.items():
        close = [x for x in words if x != w and abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = (form[w], n, len(close), words[form[w]] if form[w] else None)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def result(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def edited(rng, word, letters):
    i, kind = rng.randrange(len(word) + 1), rng.randrange(3)
    if kind == 0:
        return word[:i] + rng.choice(letters) + word[i:]
    i = min(i, len(word) - 1)
    return word[:i] + (rng.choice(letters) if kind == 1 else "") + word[i + 1:]


@pytest.mark.parametrize("seed", [1, 2])
def test_vocabulary(spark, monkeypatch, seed):
    """Few letters and long repeats give many edits per pair; small shards part the neighbours."""
    monkeypatch.setattr(spelling, "LEAST_WORDS", 40)
    monkeypatch.setattr(spelling, "AT_ONCE", 50)
    rng, letters = random.Random(seed), "abé" if seed == 1 else "abcdefghÿß"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(150)}
    words |= {"a" * 7, "a" * 8, "a" * 9, "a" * 40, "a" * 41, "a" * 20 + "b" + "a" * 20, "ab" * 10, "ba" * 10, "ab" * 10 + "a"}
    for w in sorted(words)[::2]:
        words |= {e for e in (edited(rng, w, letters) for _ in range(4)) if len(e) >= 7}
    words = {w: rng.choice([2, 3, 30, 30, 400, 5000]) for w in sorted(words)}
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()], "word string, n int, form string, root int")
    assert result(spelling.variants(df.repartition(5))) == brute(words)


def test_documents(spark, docs_of):
    rng = random.Random(4)
    base = ["Größenordnung", "straßenbahn", "abcdefgh", "ABCDEFGHI", "naïveté", "ÀÉÎÕÜÿÿ", "mississippi", "x×y÷zzzzzzzz"]
    rows = [(i, " ".join(rng.choice(base) + rng.choice(["", ".", "-", "1"]) for _ in range(120))) for i in range(60)]
    rows += [(100, "Straßenbahm straßenbahm"), (100, "straßenbahm"), (None, "abcdefg abcdefg abcdefgh")]
    rows += list(enumerate(ODD, 200))
    got = result(spelling.spelling_variants(docs_of(rows)))
    assert got == brute(counted(rows))
    assert got["straßenbahm"][0] == "straßenbahn"


def test_empty_tables(spark, docs_of):
    assert result(spelling.spelling_variants(docs_of([]))) == {}
    assert result(spelling.spelling_variants(docs_of([(1, None), (2, ""), (3, "short words only")]))) == {}


def test_chain_of_forms(spark):
    words = {"variantenn": 2, "varianten": 30, "variante": 500, "variant": 9000}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {w: r[1] for w, r in result(spelling.variants(df)).items()} == dict.fromkeys(words, "variant")


def test_no_pairs_leave_a_task(spark):
    """Every word is near every other one: rows per shard and word, not per pair."""
    words = [("prefix" + chr(0x61 + i % 26) + "suffix" + chr(0x61 + i // 26) + "end", 2 + i) for i in range(600)]
    df = spark.createDataFrame(words, "word string, n long")
    parts = spelling.searched(df.repartition(3), len(words), False)
    assert parts.count() <= len(words) * 2
    assert parts.agg(F.sum("n_near")).first()[0] > 0
