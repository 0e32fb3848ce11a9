"""Spans of regular expressions in whole texts, by DataFrame functions only.

A span is a struct (start, end, kind, found): code points, end exclusive.  Spark gives the matches
of a pattern and the text between them; their lengths give the places.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,kind:string,found:string>>"


# A fold that appends copies what it has at every step, so arrays are folded in blocks of this size.
BLOCK = 64


def scanned(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """What a running fold gives at every item; ``step(state, item)`` is the new state and the item's result.

    n items copy n x 64 + (n / 64)^2 references, not n^2.  ``out`` is the type of a result.
    """
    def blocks(xs: Column) -> Column:
        last = F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(xs, i * BLOCK + 1, F.lit(BLOCK)))

    none = F.array().cast(f"array<{out}>")

    def within(last: Column, block: Column) -> Column:
        def one(acc: Column, item: Column) -> Column:
            new, result = step(acc["state"], item)
            return F.struct(new.alias("state"), F.concat(acc["out"], F.array(result)).alias("out"))

        return F.aggregate(block, F.struct(last["state"].alias("state"), none.alias("out")), one)

    def folded(xs: Column) -> Column:
        return F.aggregate(
            blocks(xs), F.array(F.struct(state.alias("state"), none.alias("out"))),
            lambda acc, block: F.concat(acc, F.array(within(F.element_at(acc, -1), block))))

    # inside a function of its own the items are a variable: computed once, not once per block
    done = F.flatten(F.transform(F.array(items), folded))
    return F.flatten(F.transform(done, lambda b: b["out"]))


def located(text: Column, pattern: str, kind: str) -> Column:
    """All matches of a pattern, leftmost and non-overlapping, with their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    # one length of text more than matches: the last pair has no match
    pairs = F.zip_with(found, between, lambda f, n: F.struct(f.alias("f"), n.alias("n")))

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + pair["n"]
        end = start + F.coalesce(F.length(pair["f"]), F.lit(0))
        return end, F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), pair["f"].alias("found"))

    spans = F.filter(scanned(pairs, F.lit(0), step, SPAN[6:-1]), lambda s: s["found"].isNotNull())
    # most texts have none: they are searched once and not split
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(SPAN))


def distance(a: Column, b: Column) -> Column:
    """Code points between two spans; 0 or less where they touch or overlap."""
    return F.greatest(a["start"] - b["end"], b["start"] - a["end"])


def clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others, by start of the others and end of the spans.

    A span is overlapped if, of the others that start before its end, one ends behind its start.
    """
    events = F.array_sort(F.concat(
        F.transform(spans, lambda s: F.struct(
            s["end"].alias("at"), F.lit(0).alias("far"), s.alias("span"))),
        F.transform(others, lambda o: F.struct(
            o["start"].alias("at"), o["end"].alias("far"), F.lit(None).cast(SPAN[6:-1]).alias("span")))))

    def step(far: Column, e: Column) -> tuple[Column, Column]:
        return F.greatest(far, e["far"]), F.when(e["span"].isNotNull() & (far <= e["span"]["start"]), e["span"])

    kept = F.filter(scanned(events, F.lit(0), step, SPAN[6:-1]), lambda s: s.isNotNull())
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(kept)


def ordered(spans: Column, kinds: Sequence[str]) -> Column:
    """By start, then kind as listed, then end."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
        s["found"].alias("found")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["found"].alias("found")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with ordered spans replaced by their kind in angle brackets; overlapping ones by the first's."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["text"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"],
                       F.lit(">"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], new).otherwise(acc["text"]).alias("text"))

    done = F.aggregate(spans, zero, step, lambda acc: F.concat(
        acc["text"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
