"""Reply trees against a brute-force version, and the template's way back."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from emberline.llm import chat
from texts import ODD

MESSAGES = "message_id string, parent_id string, role string, text string, score double, id string, up string, leaf int, rank int"
TURNS = "conv_id long, turn long, role string, text string, id string, leaf int, formatted string"
CONTROL = ["<|im_end|>", "<|im_start|>", "<!|im_end|>", "<!!|im_start|>assistant\n", "<", "|im_end|>", "<|im_end|", "<<|im_end|>>",
           "<|other|>", "\n", "!|im_end|>", "<!", "\\", "$1", "é😀"]


def read(df):
    turns = chat.read_turns(F.col("formatted"))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return df.select("*", turns.alias("turns"), loss.alias("loss")).collect()


def best_paths(rows, branches):
    """Paths of ids per root, best first."""
    nodes = {r[0]: r for r in rows}
    answers = defaultdict(list)
    for i, up, *_ in nodes.values():
        answers[up if up in nodes else None].append(i)
    found = defaultdict(list)

    def walk(i, path):
        path = [*path, i]
        if not answers[i]:
            found[path[0]].append(path)
        for a in answers[i]:
            walk(a, path)

    for root in answers[None]:
        walk(root, [])
    mean = lambda p: sum(nodes[i][4] or 0 for i in p) / len(p)
    return {root: sorted(paths, key=lambda p: (-round(mean(p), 9), -len(p), p[-1]))[:branches] for root, paths in found.items()}


def test_trees(spark):
    rng, rows = random.Random(3), []
    for i in range(200):
        up = None if rng.random() < 0.05 else f"m{rng.randrange(max(1, i)):03}" if rng.random() < 0.6 else f"m{i - 1:03}"
        text = "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 6)))
        rows.append((f"m{i:03}", up if up != f"m{i:03}" else None, rng.choice(["user", "assistant", "tool x\n"]), text,
                     rng.choice([None, 0.0, 1.0, 2.0, 5.0]), "x", "y", 1, 2))
    rows.append(("lone", "absent", None, None, None, "x", "y", 1, 2))
    rows += [("c1", "c2", "user", "round", 1.0, "x", "y", 1, 2), ("c2", "c1", "user", "round", 1.0, "x", "y", 1, 2),
             ("c3", "c2", "user", "below", 1.0, "x", "y", 1, 2), (None, None, "user", "no id", 1.0, "x", "y", 1, 2)]
    rows += rows[:20]
    nodes = {r[0]: r for r in rows if r[0] and not r[0].startswith("c")}
    for branches in (1, 2, None):
        want = best_paths(list(nodes.values()), branches)
        got = read(chat.format_trees(spark.createDataFrame(rows, MESSAGES).repartition(5), branches))
        assert {(r["root"], r["rank"]): r["leaf"] for r in got} == {
            (root, n + 1): p[-1] for root, paths in want.items() for n, p in enumerate(paths)}
        for r in got:
            path = [nodes[i] for i in want[r["root"]][r["rank"] - 1]]
            assert [tuple(t) for t in r["turns"]] == [(m[2] or "", m[3] or "") for m in path]
            assert r["loss"] == "".join(m[3] or "" for m in path if m[2] == "assistant")
            assert r["formatted"].count(chat.END) == r["formatted"].count(chat.START) == len(path)


def digests(rows):
    turns = defaultdict(list)
    for c, turn, role, text in [*rows, *[(-1, i, r, "<|im_end|><|im_start|>assistant ok") for i, r in enumerate(["user", "assistant"])]]:
        turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, ts in turns.items():
        ts = [t[2:] for t in sorted(ts)]
        loss = "".join(t for r, t in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest(), len(loss),
                  hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations(spark):
    rng = random.Random(5)
    rows = [(i % 5, None if i == 3 else i, rng.choice(["user", "assistant", None, "a b"]), t) for i, t in enumerate([*ODD, *CONTROL])]
    rows += [(7, i, "assistant" if i % 2 else "user", rng.choice(CONTROL)) for i in range(70)]
    rows += [(8, 0, "assistant", "twice"), (8, 0, "assistant", "twice"), (None, 0, "user", "no id"), (9, 0, "assistant", None)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS).repartition(4)
    got = chat.conversation_digests(df)
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert {r[0]: tuple(r)[1:5] for r in got.collect()} == digests(rows)


def test_empty_table(spark):
    got = chat.conversation_digests(spark.createDataFrame([], TURNS)).collect()
    assert {r[0]: tuple(r)[1:5] for r in got} == digests([])
    assert chat.format_trees(spark.createDataFrame([], MESSAGES)).collect() == []


def test_no_python_workers(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "x", 1, "y")], TURNS)
    plan = chat.conversation_digests(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
