"""Near-duplicate documents by SuperMinHash, banding, exact verification and components.

A signature slot holds rank plus fraction: every shingle draws its own permutation of the slots
and offers the value ``j + r`` to the j-th slot of it, so a shingle's offers are correlated and the
estimate varies less than with independent hashes.  Once all slots of a document lie below ``j + 1``
no later rank can lower them and the document stops; long documents need two or three ranks
instead of one hash per slot.

Texts with equal shingle sets are one class, so copies cost one comparison.  Classes that agree on
a band are candidates.  A bucket of them is never expanded into its pairs:

1. two rounds of stars: every class is compared with the bucket's centre only, the second round
   (another centre) only in buckets that the first did not join into one component;
2. what is left: in a bucket with several components, the classes outside the largest one are
   compared with those of other components, so no candidate link is lost.  Both sides are cut into
   chunks, and a pair of chunks is compared inside one task, which returns links only.

Every link is confirmed on the full sets.  With 32 bands of 5 slots a pair at the threshold shares
no band with probability 3e-6, and less above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.components import components
from emberline.llm.tokens import ragged, slices
from emberline.session import store

WORDS = 5
PERCENT = 80
BANDS, ROWS = 32, 5
#: Shingles whose permutations are in memory at once.
CHUNK = 60_000
#: Documents that a worker works on at once; bounds its memory only.
AT_ONCE = 1000
#: Classes per chunk where a bucket's components are compared.
SIDE = 256
#: Of 128 sign bits, those that may differ in a pair worth verifying (about 58 do at similarity 0.1,
#: 13 at 0.8; more than 34 has probability below 1e-7 there).
BITS_APART = 34

_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles.

    Words are runs between ASCII white space with A-Z in lower case.  A text with fewer words has
    the whole sequence as its one shingle, a text without words (or null) none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    at = coded.indices.to_numpy(zero_copy_only=False)
    real = np.fromiter(map(bool, vocabulary), bool, len(vocabulary))[at] if len(at) else np.zeros(0, bool)
    doc = np.repeat(np.arange(len(counts)), counts)[real]
    counts, hashes = np.bincount(doc, minlength=len(counts)), codes[at[real]]
    # the shingle that starts at each place
    full = max(0, len(hashes) - words + 1)
    rolled = np.zeros(full, np.uint64)
    for k in range(words):
        rolled = mix(rolled * _C3 + hashes[k:k + full])
    out, end = [], 0
    for n in counts.tolist():
        start, end = end, end + n
        if n >= words:
            out.append(np.unique(rolled[start:end - words + 1]))
        elif n:
            one = np.uint64(n)
            for h in hashes[start:end]:
                one = mix(np.array([one]) * _C3 + h)[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures, one row per set; an empty set has only infinite slots."""
    out = np.full((len(sets), slots), np.inf)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends, first = np.cumsum(sizes), 0
    while first < len(sets):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + CHUNK, "right")))
        _signatures(np.concatenate(sets[first:last]), np.repeat(np.arange(last - first), sizes[first:last]),
                    out[first:last])
        first = last
    return out


def _signatures(hashes: np.ndarray, doc: np.ndarray, out: np.ndarray) -> None:
    slots, flat = out.shape[1], out.reshape(-1)
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(hashes), 1))
    rows = np.arange(len(hashes))
    for j in range(slots):
        if not len(rows):
            return
        x = mix(hashes + np.array([j + 1], np.uint64) * _C3)
        swap = j + ((mix(x) >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        slot = order[rows, swap].astype(np.int64)
        order[rows, swap] = order[rows, j]
        np.minimum.at(flat, doc * slots + slot, j + (x >> np.uint64(11)) * 2.0**-53)
        going = (out.max(1) >= j + 1)[doc]
        if not going.all():
            hashes, doc, rows = hashes[going], doc[going], rows[going]


def bands(signatures: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket per band."""
    bits = signatures.view(np.uint64).reshape(len(signatures), n_bands, rows)
    out = np.tile(np.arange(1, n_bands + 1, dtype=np.uint64) * _C3, (len(signatures), 1))
    for k in range(rows):
        out = mix(out * _C2 + bits[:, :, k])
    return out.view(np.int64)


def sign_bits(signatures: np.ndarray) -> np.ndarray:
    """One bit of each of the first 128 slots, as two 64-bit numbers."""
    bits = np.zeros((len(signatures), 128), np.uint8)
    some = mix(signatures[:, :128].copy().view(np.uint64)) & np.uint64(1)
    bits[:, :some.shape[1]] = some
    return np.packbits(bits, axis=1).view(np.int64)


def fingerprints(docs: DataFrame, words: int, n_bands: int, rows: int) -> DataFrame:
    """Per document: size and digest of its shingle set, buckets, sign bits."""
    slots = n_bands * rows

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, AT_ONCE):
            sets = shingle_sets(batch.column("text"), words)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            signatures = superminhash(sets, slots)
            buckets, signs = bands(signatures, n_bands, rows), sign_bits(signatures)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array(list(buckets), pa.list_(pa.int64())), pa.array(signs[:, 0]), pa.array(signs[:, 1]),
            ], names=["doc_id", "n_shingles", "digest", "buckets", "s0", "s1"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        mapped, "doc_id long, n_shingles long, digest binary, buckets array<long>, s0 long, s1 long")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, AT_ONCE):
            sets = shingle_sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([
                batch.column("rep"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
            ], names=["rep", "digest", "shingles"])

    return docs.select("rep", "text").mapInArrow(mapped, "rep long, digest binary, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough."""
    a = sets.select(F.col("rep").alias("x"), F.col("shingles").alias("sx"))
    b = sets.select(F.col("rep").alias("y"), F.col("shingles").alias("sy"))
    common = F.size(F.array_intersect("sx", "sy"))
    return pairs.join(a, "x").join(b, "y").filter(
        100 * common >= percent * (F.size("sx") + F.size("sy") - common)).select("x", "y")


def across(rest: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) between components of a bucket, one per class outside the largest and component.

    ``rest`` has bucket, rep, component, the bucket's largest component, and the number of chunks on
    each side.  A row is sent to as many tasks as the other side has chunks.
    """
    full = rest.join(classes.select("rep", "buckets", "s0", "s1"), "rep").join(sets, "rep")
    chunk = F.xxhash64("rep")
    columns = full.withColumn("column", F.pmod(chunk, "columns").cast("int")).withColumn(
        "row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    rows = full.filter("component <> largest").withColumn("row", F.pmod(chunk, "rows").cast("int")).withColumn(
        "column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    keys, about = ["bucket", "row", "column"], ["rep", "component", "largest", "buckets", "s0", "s1", "shingles"]

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(
            [{"x": x, "y": y} for x, y in chunk_links(left, right, percent)],
            schema=pa.schema([("x", pa.int64()), ("y", pa.int64())]))

    # new names for one side, as both come from the same table
    other = columns.select(*[F.col(c).alias(c) for c in (*keys, *about)])
    return rows.select(*keys, *about).groupBy(*keys).cogroup(other.groupBy(*keys)).applyInArrow(
        compared, "x long, y long")


def chunk_links(left: pa.Table, right: pa.Table, percent: int) -> Iterator[tuple[int, int]]:
    """Compares the classes of ``left``, all outside the bucket's largest component, with ``right``."""
    if not left.num_rows or not right.num_rows:
        return

    def arrays(table: pa.Table) -> tuple:
        lists = table["shingles"].combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        buckets = table["buckets"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(size), -1)
        return (*(table[c].to_numpy() for c in ("rep", "component")), buckets,
                np.stack([table["s0"].to_numpy(), table["s1"].to_numpy()], 1).view(np.uint64), size, flat)

    rep_x, comp_x, buckets_x, signs_x, size_x, flat_x = arrays(left)
    rep, comp, buckets, signs, size, flat = arrays(right)
    bucket, largest = left["bucket"][0].as_py(), left["largest"][0].as_py()
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(flat, kind="stable")
    values, owner = flat[order], owner[order]
    end = np.cumsum(size_x)
    for i in range(len(rep_x)):
        band = int(np.flatnonzero(buckets_x[i] == bucket)[0])
        near = (comp != comp_x[i]) & ((comp == largest) | (rep_x[i] < rep))
        near &= (size_x[i] * 100 >= percent * size) & (size * 100 >= percent * size_x[i])
        near &= np.bitwise_count(signs ^ signs_x[i]).sum(1) <= BITS_APART
        # a pair is met in the first bucket that it shares
        near &= ~(buckets[:, :band] == buckets_x[i, :band]).any(1)
        if not near.any():
            continue
        own = flat_x[end[i] - size_x[i]:end[i]]
        first, last = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        common = np.bincount(owner[ragged(first, last - first)], minlength=len(size))
        hits = np.flatnonzero(near & (100 * common >= percent * (size_x[i] + size - common)))
        for j in hits[np.unique(comp[hits], return_index=True)[1]]:
            yield int(rep_x[i]), int(rep[j])


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, n_bands: int = BANDS,
                    rows: int = ROWS, keep_digest: bool = False) -> DataFrame:
    """Adds nothing to and drops nothing from ``docs`` (``doc_id``, ``text``): one row per row with
    doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept.

    Texts without words and null texts have no shingle and are linked with nothing.  A null doc_id
    has a null component_id, links nothing and is kept.  Rows that repeat a doc_id each follow
    their own text.  An empty table gives no row; other columns are ignored.
    """
    made = store(fingerprints(docs, words, n_bands, rows), "fingerprints")
    classes = store(
        made.filter("digest is not null and doc_id is not null").groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"),
            F.first("s0").alias("s0"), F.first("s1").alias("s1")),
        "classes")
    members = classes.select("rep", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("rep").alias("center"), F.max("rep").alias("other")).filter(
        "center <> other")
    # candidates only: a class that shares no bucket goes no further
    members = store(members.join(shared, "bucket"), "buckets")
    reps = members.select("rep").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string")).join(reps, "rep")
    # a repeated doc_id can have other texts: keep those of the class
    sets = store(
        full_sets(texts, words).join(classes.select("rep", "digest"), ["rep", "digest"]).dropDuplicates(
            ["rep", "digest"]).drop("digest"),
        "sets")

    def star(center: str, rows_: DataFrame) -> DataFrame:
        return rows_.filter(F.col(center) != F.col("rep")).select(
            F.col(center).alias("x"), F.col("rep").alias("y")).distinct()

    def grown(found: DataFrame, links: DataFrame) -> DataFrame:
        """Components by the links behind ``found`` and by more; each node's link to its component stands for the former."""
        return components(found.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(links))

    # links go to components() as they are: it writes them once, distinct, in few files
    found = components(verified(star("center", members), sets, percent))

    def labelled(rows_: DataFrame) -> DataFrame:
        return rows_.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep"))

    open_ = labelled(members.select("bucket", "rep"))
    several = open_.groupBy("bucket").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"),
        # another centre in each bucket, so that a class meets many in one round
        F.min_by("rep", F.xxhash64("rep", "bucket")).alias("pick")).filter("lo <> hi").select("bucket", "pick")
    again = store(open_.join(several, "bucket"), "open")
    of_pick = found.select(F.col("node").alias("pick"), F.col("component").alias("of_pick"))
    second = again.join(of_pick, "pick", "left").filter(
        F.coalesce("of_pick", "pick") != F.col("component"))
    found = grown(found, verified(star("pick", second), sets, percent))
    # the rest: outside a bucket's largest component, against other components
    last = labelled(again.select("bucket", "rep"))
    sizes = last.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("bucket").agg(
        F.max_by("component", F.struct("size", "component")).alias("largest"), F.max("size").alias("most"),
        F.sum("size").alias("all"), F.count("*").alias("parts")).filter("parts > 1").select(
        "bucket", "largest", F.ceil(F.col("all") / SIDE).cast("int").alias("columns"),
        F.ceil((F.col("all") - F.col("most")) / SIDE).cast("int").alias("rows"))
    rest = store(last.join(largest, "bucket"), "rest")
    found = grown(found, across(rest, classes, sets, percent))
    label = classes.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id"))
    out = made.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return out.join(label, "digest", "left").select(
        *["digest"] * keep_digest, "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"))


def with_digests(docs: DataFrame, words: int) -> DataFrame:
    """The columns of ``docs`` and ``_shingles``, the digest of each text's shingle set (null without words)."""
    schema = docs.select("*").schema.add("_shingles", "binary")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, AT_ONCE):
            sets = shingle_sets(batch.column("text").cast(pa.string()), words)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=schema.names)

    return docs.mapInArrow(mapped, schema)


def keep_distinct(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group, of the smallest doc_id.

    Rows that repeat a doc_id are judged each by its own text: one goes if its group has a smaller
    doc_id, and of those with one doc_id and shingle set the smallest row (by text, then the other
    columns) stays.  Null doc_ids and texts without words all stay.  No rows give none.
    """
    found = store(near_duplicates(docs, words, percent, keep_digest=True), "groups")
    ids = found.filter("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("_n"), F.max(~F.col("kept")).alias("_copy"))
    touched = store(ids.filter("_copy or _n > 1").select(F.col("doc_id").alias("_copy_id"), (F.col("_n") > 1).alias("_several")),
                    "copies")
    same_id = F.col("doc_id").cast("long") == F.col("_copy_id")
    rest = docs.join(touched.select("_copy_id"), same_id, "left_anti")
    # ids that stand for several rows; none in a sound table, so its size decides how the join is done
    several = store(touched.filter("_several").select("_copy_id"), "repeated")
    own = with_digests(docs.join(several, same_id, "left_semi"), words)
    gone = found.filter(~F.col("kept")).join(several, same_id).select(
        "_copy_id", F.col("digest").alias("_copy_digest")).distinct()
    judged = own.join(gone, same_id & (F.col("_shingles") == F.col("_copy_digest")), "left_anti")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    single = judged.filter("_shingles is not null").groupBy("doc_id", "_shingles").agg(
        F.min(F.struct("text", *others)).alias("_row")).select("doc_id", "_row.*")
    return rest.unionByName(judged.filter("_shingles is null").drop("_shingles")).unionByName(
        single.select(docs.columns))
