"""Personal data in texts: strict patterns, and proposals judged by boosted trees.

Strict kinds (email, ip, card, phone) are patterns with a check: octets, Luhn, digits.  High-recall
generators also propose looser spans, which may overlap, and the parts of long runs of digits.  Boosted trees score the proposals from
their format (digits, separators, shape) and context (words before, neighbouring characters); they
learn from the proposals that are strict spans or that break a strict kind's check, on a bounded
sample weighted back to the table's mix, and never see the checks themselves.  On all such proposals
of a held-out fifth of the table the lowest score is chosen at which enough are right; proposals
above it that touch no strict span are added as ``likely``.

Everything is expressions over the row or Spark ML on the JVM; there is no Python on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.spans import SPAN, clear_of, distance, listed, located, ordered, redacted
from emberline.session import store

# Two private characters stand for a dot inside a domain and for a blank or hyphen inside a number;
# with them no pattern repeats a group, which Java would do by recursion.
DOT, GAP, OTHER = "\ue000", "\ue001", "\ue002"
EMAIL = rf"[A-Za-z0-9._%+{DOT}-]+@[A-Za-z0-9-]+{DOT}[A-Za-z0-9{DOT}-]+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = rf"[0-9][0-9{GAP}]*[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
OCTETS = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
BASE = ("email", "ip", "card", "phone")
LIKELY = "likely"
# What may be personal data: numbers with separators, dotted numbers, things around an at sign.
PROPOSALS = {
    "number": r"[+(]?[0-9][\x20()./0-9-]{5,}[0-9]",
    "dotted": r"[0-9]+\.[0-9]+\.[0-9.]*[0-9]",
    "at": r"[A-Za-z0-9._%+-]+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9.-]+",
}
# A run this long may hold several numbers side by side: its parts of whole digit groups with 7 to 19
# digits, not more than 3 other characters apart, are proposed too.
LONG, PART = 14, "part"
START = r"[+(](?=[0-9])|(?<![0-9+(])[0-9]"
PIECE = r"(?=([\s\S]{24}(?:[+(][0-9]|(?<![0-9+(])[0-9])[\s\S]{0,74}))"
PARTS = [rf"^[+(]?[0-9](?:[\x20()./-]{{0,3}}[0-9]){{{n - 1}}}(?![0-9])" for n in range(7, 20)]
# What has the format of a strict kind, so that its check decides.
ADDRESS_LIKE = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"
CARD_LIKE = r"^[0-9](?:[\x20-]?[0-9]){11,18}$"
CONTEXT = {
    "call": r"(?i)(tel|phone|call|fax|mobile|contact)", "pay": r"(?i)(card|visa|master|pay|iban|account)",
    "host": r"(?i)(ip|host|addr|server)", "mail": r"(?i)(mail|write|send)",
}
#: Proposals the trees are fitted on, at most.
SAMPLE = 20_000
PRECISION = 0.95
FEATURES = ("f_length", "f_digits", "f_gaps", "f_dots", "f_marks", "f_plus", "f_sign", "f_runs", "f_left", "f_right",
            *[f"f_{k}" for k in PROPOSALS], *[f"f_{k}" for k in CONTEXT])


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass: every second from the right doubled, sum of digits divisible by ten."""
    values = F.transform(F.split(F.reverse(number), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def between(x: Column, low: int, high: int) -> Column:
    n = F.length(digits(x["found"]))
    return (n >= low) & (n <= high)


def base_spans(text: Column) -> Column:
    """Strict spans, unordered."""
    none = F.array().cast(SPAN)
    plain = F.translate(text, DOT + GAP, OTHER + OTHER)
    joined = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    email = F.when(F.contains(text, F.lit("@")), located(joined, EMAIL, "email")).otherwise(none)
    ip = F.filter(located(text, IP, "ip"), lambda s: s["found"].rlike(OCTETS))
    chained = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", GAP)
    card = F.filter(located(chained, CARD, "card"), lambda s: between(s, 12, 19) & luhn(digits(s["found"])))
    phone = F.filter(located(text, PHONE, "phone"), lambda s: between(s, 9, 15))
    return F.concat(email, F.when(text.rlike("[0-9]"), F.concat(ip, card, phone)).otherwise(none))


def proposals(text: Column) -> Column:
    return F.concat(*[located(text, pattern, kind) for kind, pattern in PROPOSALS.items()])


def around(text: Column, s: Column) -> Column:
    """A span with the 24 characters before it, filled up with blanks, and the one after it."""
    before = F.lpad(F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))), 24, " ")
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["found"].alias("found"),
                    before.alias("before"), F.substring(text, s["end"] + 1, F.lit(1)).alias("after"))


def parts(run: Column) -> Column:
    """Spans of the parts of a run: at every start of a digit group one for each number of digits."""
    starts = F.filter(
        F.transform(F.split(F.regexp_replace(run["found"], START, OTHER), ""), lambda c, i: F.when(c == OTHER, i)),
        lambda i: i.isNotNull())
    # each start with what stands around it, cut out in one pass
    pieces = F.regexp_extract_all(F.concat(run["before"], run["found"], run["after"]), F.lit(PIECE), F.lit(1))

    def at(i: Column, piece: Column) -> Column:
        rest = F.substring(piece, F.lit(25), F.length(piece))
        some = F.filter(F.array(*[F.regexp_extract(rest, p, 0) for p in PARTS]), lambda x: F.length(x) > 0)
        return F.transform(some, lambda x: F.struct(
            (run["start"] + i).alias("start"), (run["start"] + i + F.length(x)).alias("end"),
            F.lit(PART).alias("kind"), x.alias("found"), F.substring(piece, 1, 24).alias("before"),
            F.substring(piece, F.length(x) + 25, F.lit(1)).alias("after")))

    return F.filter(F.flatten(F.zip_with(starts, pieces, at)), lambda s: s["end"] - s["start"] < run["end"] - run["start"])


def long_runs(spans: Column) -> Column:
    return F.filter(spans, lambda s: (s["kind"] == "number") & (F.length(digits(s["found"])) >= LONG))


def first_of_overlapping(spans: Column) -> Column:
    """By start, then longest: each span that overlaps none kept before it."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"), s["found"].alias("found"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        span = F.struct(s["start"].alias("start"), (-s["last"]).alias("end"), s["kind"].alias("kind"), s["found"].alias("found"))
        return F.when(s["start"] >= acc["at"], F.struct(span["end"].alias("at"), F.concat(acc["spans"], F.array(span)).alias(
            "spans"))).otherwise(acc)

    return F.aggregate(keyed, zero, step, lambda acc: acc["spans"])


def described(rows: DataFrame) -> DataFrame:
    """Format and context features of proposals: rows with span, before and after."""
    found = F.col("span.found")

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(found, pattern, "")).cast("double")

    before, after = F.col("before"), F.col("after")
    flags = {
        "f_plus": found.startswith("+"), "f_sign": F.contains(found, F.lit("@")),
        "f_left": before.rlike("[A-Za-z0-9]$"), "f_right": after.rlike("^[A-Za-z0-9]"),
        **{f"f_{k}": F.col("span.kind").isin(k, *[PART] * (k == "number")) for k in PROPOSALS},
        **{f"f_{k}": before.rlike(p) for k, p in CONTEXT.items()},
    }
    return rows.select(
        "*", F.length(found).cast("double").alias("f_length"), count("[^0-9]").alias("f_digits"),
        count("[^\\x20-]").alias("f_gaps"), count("[^.]").alias("f_dots"), count("[^()/]").alias("f_marks"),
        F.size(F.regexp_extract_all(found, F.lit("[0-9]+"), F.lit(0))).cast("double").alias("f_runs"),
        *[c.cast("double").alias(n) for n, c in flags.items()])


def candidates(docs: DataFrame) -> DataFrame:
    """One row per proposal, with its key, the text around it, and whether it is known to be right.

    ``label`` is 1 where the proposal is a strict span, 0 where it has the format of a strict kind
    and fails every check (12 to 19 digits like a card's by Luhn, four short groups by octets), else
    null.  Parts of a run have none: that a part fails says nothing about the number it was cut from.
    """
    text = F.col("text")
    whole = F.transform(F.filter(proposals(text), lambda s: F.length(s["found"]) >= 6), lambda s: around(text, s))
    rows = docs.withColumn("_whole", whole).withColumn("_long", long_runs(F.col("_whole")))
    more = F.when(F.size("_long") > 0, F.concat("_whole", F.flatten(F.transform("_long", parts)))).otherwise(F.col("_whole"))
    # texts aren't repeated with their proposals
    each = rows.select("key", "base", F.explode(more).alias("_each")).select(
        "key", "base", F.struct("_each.start", "_each.end", "_each.kind", "_each.found").alias("span"),
        "_each.before", "_each.after")
    strict = F.exists("base", lambda b: (b["start"] == F.col("span.start")) & (b["end"] == F.col("span.end")))
    free = ~F.exists("base", lambda b: distance(b, F.col("span")) < 0)
    found = F.col("span.found")
    card = F.length(digits(found)).between(12, 19) & luhn(digits(found))
    broken = (found.rlike(ADDRESS_LIKE) & ~found.rlike(OCTETS) | found.rlike(CARD_LIKE)) & ~card
    return each.select(
        "key", "span", "before", "after", free.alias("free"),
        F.when(F.col("span.kind") == PART, None).when(strict, 1.0).when(free & broken, 0.0).alias("label"))


def fitted(found: DataFrame, sample: int, precision: float):
    """Boosted trees and the calibrated threshold, or nothing if there is only one kind of label."""
    known = found.filter(F.col("label").isNotNull())
    place = F.pmod(F.xxhash64("key", "span.start", "span.end"), F.lit(1 << 30)) / (1 << 30)
    learn, held = known.withColumn("_place", place / 0.8).filter("_place < 1"), known.filter(place >= 0.8)
    sizes = {r["label"]: r["n"] for r in learn.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    # a drawn proposal weighs as many as it stands for, so the mix of labels is the table's at any size
    share = reduce(lambda c, k: c.when(F.col("label") == k, min(1.0, sample / 2 / sizes[k])), sizes, F.when(F.lit(False), 1.0))
    drawn = store(learn.withColumn("_share", share).filter("_place < _share").select(
        "label", (1 / F.col("_share")).alias("_weight"), *FEATURES), "proposals")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    rows = vectors.transform(drawn)
    if rows.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(maxIter=8, maxDepth=3, maxBins=32, seed=1, cacheNodeIds=False, weightCol="_weight").fit(rows)
    held = trees.transform(vectors.transform(held)).select(
        F.round(vector_to_array("probability")[1], 2).alias("score"), "label")
    bins = held.groupBy("score").agg(F.sum("label").alias("right"), F.count("*").alias("n")).collect()
    right = n = 0
    threshold = None
    for row in sorted(bins, key=lambda r: -r["score"]):
        right, n = right + row["right"], n + row["n"]
        if right >= precision * n:
            threshold = row["score"]
    return None if threshold is None else (vectors, trees, threshold)


def find_personal(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION,
                  name: str = "_spans") -> DataFrame:
    """The rows of ``docs`` with a column ``name``: ordered spans (start, end, kind, found).

    Null and empty texts have none.  Every row is judged by itself; rows equal in id and text get
    equal spans.  With no proposals, or none to learn from, only strict spans are found.  A column
    of that name is replaced.
    """
    rows = docs.drop(name)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = rows.withColumn("__base", base_spans(text)).withColumn("__key", F.xxhash64("doc_id", "text"))
    # only texts that may hold a proposal go on
    maybe = text.rlike(r"[0-9][\x20()./0-9-]{5,}[0-9]|[0-9]\.[0-9]+\.|@|\(at\)|\[at\]")
    some = whole.filter(maybe).select(F.col("__key").alias("key"), text.alias("text"), F.col("__base").alias("base"))
    found = store(described(candidates(some)).drop("before", "after"), "candidates")
    model = fitted(found, sample, precision)
    if model is None:
        return whole.withColumn(name, ordered(F.col("__base"), (*BASE, LIKELY))).drop("__key", "__base")
    vectors, trees, threshold = model
    scored = trees.transform(vectors.transform(found.filter("free")))
    likely = scored.filter(F.round(vector_to_array("probability")[1], 2) >= threshold).groupBy("key").agg(
        F.collect_set(F.struct("span.start", "span.end", F.lit(LIKELY).alias("kind"), "span.found")).alias("__likely"))
    both = whole.join(likely.withColumnRenamed("key", "__key"), "__key", "left")
    # of overlapping proposals the first, then the longest, stays
    more = F.coalesce("__likely", F.array().cast(SPAN))
    spans = F.concat("__base", first_of_overlapping(more))
    return both.withColumn(name, ordered(spans, (*BASE, LIKELY))).drop("__key", "__base", "__likely")


def scan_personal(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): doc_id, counts, base_sha256 and spans."""
    found = find_personal(docs.select("doc_id", "text"), sample, precision)

    def of(*kinds: str) -> Column:
        return F.filter("_spans", lambda s: s["kind"].isin(*kinds))

    base = of(*BASE)
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def redact_personal(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind."""
    text = redacted(F.col("text"), F.col("__spans"))
    return find_personal(docs, name="__spans").withColumn("text", F.when(F.col("text").isNotNull(), text)).select(*docs.columns)
