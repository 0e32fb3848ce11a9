"""Credentials in texts: strong patterns, and weak parts that only count together.

Strong kinds stand alone: assignments to a secret's name, access key ids, long hexadecimal runs.
Weak kinds mean nothing by themselves: a login or client id, a token of mixed characters, the
address of a service.  They are linked by an interval join within a scope, ``reach`` code points
around each part: an identifier needs a secret there, a secret an identifier or an endpoint, an
endpoint both.  Strong spans take part as identifiers (access) and secrets (assign, hex).

Parts that overlap are no complements in ``scan_secrets``, as in its SQL.  ``redact_secrets`` also takes
an endpoint as the complement of a secret in its own user-info or query values, but not in its path.

A scope never leaves its document, so the join runs inside the row, on arrays: no shuffle, no row
key, and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.spans import SPAN, clear_of, listed, located, ordered, redacted, scanned

ASSIGN = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
# a run that is long enough is found whole from its first character on
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
IDENTIFIER = r"(?i)(?:user(?:name)?|login|account|client_?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}"
SECRET = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"(?:https?|ftp|ssh|postgres|mysql|redis|amqp|mongodb)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "secret", "endpoint")
REACH = 200


def base_spans(text: Column) -> Column:
    """Strong spans, unordered."""
    assign = F.filter(
        located(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 12)
    return F.concat(assign, located(text, ACCESS, "access"), located(text, HEX, "hex"))


def weak_spans(text: Column) -> Column:
    """Parts that need a complement; secrets mix digits with letters of both cases."""
    secret = F.filter(located(text, SECRET, "secret"), lambda s: s["found"].rlike("[0-9]") & s["found"].rlike(
        "[a-z]") & s["found"].rlike("[A-Z]"))
    return F.concat(located(text, IDENTIFIER, "identifier"), secret, located(text, ENDPOINT, "endpoint"))


def carried(s: Column, e: Column) -> Column:
    """Whether a secret stands in the user-info or in a query value of an endpoint."""
    before = F.substring(e["found"], F.lit(1), s["start"] - e["start"])
    after = F.substring(e["found"], s["end"] - e["start"] + 1, F.length(e["found"]))
    user = before.rlike(r"^[a-z]+:(//[^/?#]*)?$") & after.rlike("^[^/?#]*@")
    value = before.rlike(r"^[^?#]*\?([^#]*[&;])?[^#&;=]*=[^#&;]*$")
    return (s["start"] >= e["start"]) & (s["end"] <= e["end"]) & (user | value)


# Complements by role: identifiers, secrets, endpoints.
ROLES = {"identifier": 0, "access": 0, "secret": 1, "assign": 1, "hex": 1, "endpoint": 2}
NEAR = "struct<n:int,before:array<int>>"


def nearest(spans: Column, parts: Column, back: bool) -> Column:
    """Per span, in their order, the end of the last part of each role that ends before it starts.

    With ``back`` all places are mirrored: minus the start of the next part behind it.  Both are one sort of
    ends and starts and one running fold, so a text may hold many spans.
    """
    def place(x: Column, close: bool) -> Column:
        return -x["start"] if back and close else -x["end"] if back else x["end"] if close else x["start"]

    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    # at one place parts come first: a part that touches a span counts
    events = F.array_sort(F.concat(
        F.transform(parts, lambda p: F.struct(
            place(p, True).alias("at"), F.lit(-1).alias("n"), role[p["kind"]].alias("role"))),
        F.transform(spans, lambda s, n: F.struct(place(s, False).alias("at"), n.alias("n"), F.lit(-1).alias("role")))))

    def step(last: Column, e: Column) -> tuple[Column, Column]:
        new = F.array(*[F.when(e["role"] == k, e["at"]).otherwise(last[k]) for k in range(3)])
        return new, F.when(e["n"] >= 0, F.struct(e["n"].alias("n"), last.alias("before")))

    found = scanned(events, F.array(*[F.lit(None).cast("int")] * 3), step, NEAR)
    return F.transform(F.array_sort(F.filter(found, lambda x: x.isNotNull())), lambda x: x["before"])


def linked(weak: Column, base: Column, reach: int, inside: bool = False) -> Column:
    """Weak spans with their complements in reach; with ``inside`` also secrets that an endpoint carries."""
    parts = F.concat(weak, base)
    around = F.zip_with(nearest(weak, parts, False), nearest(weak, parts, True), lambda b, a: F.struct(
        b.alias("before"), a.alias("behind")))

    def complete(s: Column, n: Column) -> Column:
        def near(role: int) -> Column:
            return F.coalesce(n["before"][role] >= s["start"] - reach, F.lit(False)) | F.coalesce(
                n["behind"][role] >= -s["end"] - reach, F.lit(False))

        return F.when(s["kind"] == "identifier", near(1)).when(
            s["kind"] == "secret", near(0) | near(2)).otherwise(near(0) & near(1))

    judged = F.zip_with(weak, around, lambda s, n: F.struct(s.alias("span"), complete(s, n).alias("kept")))
    if inside:
        # endpoints don't overlap, so a secret stands in the last one that starts no later, if in any
        events = F.array_sort(F.transform(judged, lambda j: F.struct(
            j["span"]["start"].alias("at"), F.when(j["span"]["kind"] == "endpoint", 0).otherwise(1).alias("rank"),
            j.alias("judged"))))

        def step(last: Column, e: Column) -> tuple[Column, Column]:
            s = e["judged"]["span"]
            own = F.coalesce((s["kind"] == "secret") & carried(s, last), F.lit(False))
            return F.when(e["rank"] == 0, s).otherwise(last), F.struct(
                s.alias("span"), (e["judged"]["kept"] | own).alias("kept"))

        judged = scanned(events, F.lit(None).cast(SPAN[6:-1]), step, f"struct<span:{SPAN[6:-1]},kept:boolean>")
    kept = F.transform(F.filter(judged, lambda j: j["kept"]), lambda j: j["span"])
    return F.when(F.size(weak) > 0, kept).otherwise(F.array().cast(SPAN))


def find_secrets(docs: DataFrame, reach: int = REACH, name: str = "_spans", inside: bool = False) -> DataFrame:
    """The rows of ``docs`` with a column ``name``: ordered spans (start, end, kind, found).

    Null and empty texts have none; every row is searched by itself, so repeated rows and null ids
    don't matter; a column of that name is replaced.
    """
    text, base, weak = "__text", "__base", "__weak"
    rows = docs.drop(name).withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumn(base, base_spans(F.col(text))).withColumn(weak, weak_spans(F.col(text)))
    rows = rows.withColumn(weak, clear_of(F.col(weak), F.col(base)))
    spans = F.concat(F.col(base), linked(F.col(weak), F.col(base), reach, inside))
    return rows.withColumn(name, ordered(spans, KINDS)).drop(text, base, weak)


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): doc_id, counts, base_sha256 and spans."""
    found = find_secrets(docs.select("doc_id", "text"), reach)

    def of(*kinds: str) -> Column:
        return F.filter("_spans", lambda s: s["kind"].isin(*kinds))

    base = of(*BASE)
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def redact_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with every span replaced by its kind, and ``n_chars`` (if there) counted anew."""
    text = redacted(F.col("text"), F.col("__spans"))
    out = find_secrets(docs, reach, "__spans", inside=True).withColumn("text", F.when(F.col("text").isNotNull(), text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
