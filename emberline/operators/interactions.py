"""Meetings of an author with active authors through siblings, threads and replies.

The post keys of the four pairings become rows (pairing, item), so one join serves all.
Neither the join nor the counts emit the pairs of a popular item: both sides are counted
per item first, a pair count is a product, and distinct authors are unions of whole lists.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.schemas import PAIRINGS
from emberline.session import store

# Prefix of a full item key by kind of post.
KIND_PREFIX = {"RC": "t1_", "RS": "t3_"}

_ITEM = ["pairing", "item"]
_KEY = ["pairing", "author", "week_idx"]
# The authors up to which a union is listed by rows.
SPARSE = 64
# Larger unions: (item, author) pairs in a part, sets in a group at most and at least, tasks, and pairs at a time.
LISTED, GROUP, LEAST, TASKS, PAIRS = 1 << 25, 1 << 21, 10_000, 32, 1 << 22


def _full_id() -> Column:
    prefix = F.when(F.col("kind") == "RS", KIND_PREFIX["RS"]).otherwise(KIND_PREFIX["RC"])
    return F.concat(prefix, F.col("id"))


def _keyed(posts: DataFrame, side: int, columns: Sequence[str], pairings: Sequence[str]) -> DataFrame:
    """One row per post and pairing under which it has an item key; a post needs an author."""
    def item(pairing: str) -> Column:
        key = PAIRINGS[pairing][side]
        return _full_id() if key == "id" else F.col(key)

    keys = F.array(*[F.struct(F.lit(p).alias("pairing"), item(p).alias("item")) for p in pairings])
    return (
        posts.filter(F.col("author").isNotNull())
        .select(*columns, F.explode(keys).alias("_k"))
        .select(*columns, "_k.pairing", "_k.item")
        .filter(F.col("item").isNotNull())
    )


def active_posts(history: DataFrame, subreddit_class: str, own: Sequence[str]) -> DataFrame:
    """Posts of a class's active authors outside the communities of the class."""
    return history.filter(
        (F.col("subreddit_class") == subreddit_class) & ~F.col("subreddit").isin(list(own))
    )


def active_items(active: DataFrame, pairings: Sequence[str] = tuple(PAIRINGS)) -> DataFrame:
    """Posts per (pairing, item, active author)."""
    rows = _keyed(active, 0, ["author"], pairings)
    return rows.groupBy(*_ITEM, F.col("author").alias("author_active")).agg(F.count("*").alias("c"))


def interaction_join(window: DataFrame, items: DataFrame,
                     pairings: Sequence[str] = tuple(PAIRINGS)) -> DataFrame:
    """The join of an author's posts with the posts of other active authors, in factored form.

    One row per (pairing, item, author, week): ``n`` posts of the author meet
    ``active_posts`` posts by ``active_authors`` other authors, which stands for
    ``n * active_posts`` pairs.  ``window`` has author, week_idx, kind and the item keys;
    ``items`` comes from :func:`active_items`.

    Both sides are shuffled once, by item; a post goes out once per item key, and the pairings of
    the key are listed behind the shuffle.  An item's totals and the author's own share in them
    are windows over its rows, which are sorted and may spill.
    """
    keys = {PAIRINGS[p][1]: [q for q in pairings if PAIRINGS[q][1] == PAIRINGS[p][1]] for p in pairings}
    each = F.array(*[F.struct(F.lit(i).alias("key"), (_full_id() if key == "id" else F.col(key)).alias("item"))
                     for i, key in enumerate(keys)])
    mine = window.filter(F.col("author").isNotNull()).select("author", "week_idx", F.explode(each).alias("_k")).select(
        "_k.item", "author", "week_idx", F.col("_k.key").alias("_key")).filter(F.col("item").isNotNull())
    theirs = items.select("item", F.col("author_active").alias("author"), "pairing", "c")
    names = F.array(*[F.array(*[F.lit(p) for p in ps]) for ps in keys.values()])
    is_mine = F.col("_key").isNotNull()
    rows = mine.unionByName(theirs, allowMissingColumns=True).repartition("item").select(
        "item", "author", "week_idx", "c", is_mine.alias("_mine"),
        F.explode(F.when(is_mine, names[F.col("_key")]).otherwise(F.array("pairing"))).alias("pairing"))
    met = rows.groupBy(*_KEY, "item", "_mine").agg(F.count("*").alias("n"), F.sum("c").alias("_c"))
    own, whole = Window.partitionBy(*_ITEM, "author"), Window.partitionBy(*_ITEM)
    met = met.withColumn("_own", F.sum("_c").over(own)).withColumns({
        "_posts": F.sum("_c").over(whole), "_authors": F.count_if(~F.col("_mine")).over(whole)})
    is_active = F.col("_own").isNotNull()
    return met.filter(F.col("_mine") & F.col("_posts").isNotNull()).select(
        *_KEY, "item", "n",
        (F.col("_posts") - F.coalesce("_own", F.lit(0))).alias("active_posts"),
        (F.col("_authors") - is_active.cast("long")).alias("active_authors"),
        is_active.alias("is_active"),
    ).filter(F.col("active_authors") > 0)


def interaction_semi_prefilter(window: DataFrame, active: DataFrame, pairing: str) -> DataFrame:
    """Window posts whose key of one pairing occurs on the active side at all."""
    keys = _keyed(active, 0, [], [pairing]).select("item")
    key = PAIRINGS[pairing][1]
    rows = window.withColumn("item", _full_id() if key == "id" else F.col(key))
    return rows.join(keys, "item", "left_semi").drop("item")


def _numbered(known: DataFrame) -> DataFrame:
    """(it, num) out of (it, author_active), with a number for each active author, from 0 without gaps."""
    marked = known.select("author_active").distinct().withColumn("_id", F.monotonically_increasing_id())
    marked = store(marked, "author-numbers").withColumn("_part", F.shiftright("_id", 33))
    # one row per task that numbered authors
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    parts = marked.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    numbers = marked.join(parts, "_part").select("author_active", place.alias("num"))
    return known.join(numbers, "author_active").select("it", "num")


def _distinct_listed(owner: np.ndarray, who: np.ndarray, width: int, count: int) -> np.ndarray:
    """Distinct numbers below ``width`` per owner out of (owner, number) pairs."""
    pairs = np.sort(owner * width + who)
    pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
    return np.bincount(pairs // width, minlength=count)


def _union_sizes(its: pa.ListArray, ids: np.ndarray, who: pa.ListArray) -> np.ndarray:
    """Size of the union of the listed items' authors for each of ``its``; ``who`` has the authors of ``ids``.

    An item that holds more than one author in 64 is a bitmap, and bitmaps are combined by words;
    the others are lists.
    """
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    flat = who.flatten().to_numpy(zero_copy_only=False)
    lens = who.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = (np.cumsum(lens) - lens)[order]
    lens = lens[order]
    width = int(flat.max(initial=0)) + 1
    words = -(-width // 64)
    owner = np.repeat(np.arange(len(its)), its.value_lengths().to_numpy(zero_copy_only=False))
    item = its.flatten().to_numpy(zero_copy_only=False)
    place = np.minimum(np.searchsorted(ids, item), len(ids) - 1)
    there = ids[place] == item  # an item may have no author in this part
    owner, place = owner[there], place[there]

    thick = np.flatnonzero(lens > max(words, 64))
    bits = np.zeros((len(thick), words), np.uint64)
    for row, i in zip(bits, thick):
        mine = flat[starts[i]:starts[i] + lens[i]]
        flags = np.zeros(words * 64, np.uint8)
        flags[mine] = 1
        row[:] = np.packbits(flags, bitorder="little").view(np.uint64)
    bitmap = np.full(len(ids), -1)
    bitmap[thick] = np.arange(len(thick))

    sizes = np.zeros(len(its), np.int64)
    ends = np.searchsorted(owner, np.arange(len(its) + 1))
    mixed = np.zeros(len(its), bool)
    mixed[owner[bitmap[place] >= 0]] = True
    for s in np.flatnonzero(mixed):
        mine = place[ends[s]:ends[s + 1]]
        rows = bitmap[mine]
        union = np.bitwise_or.reduce(bits[rows[rows >= 0]], axis=0)
        sizes[s] = np.bitwise_count(union).sum(dtype=np.int64)
        rest = mine[rows < 0]
        if len(rest):
            more = np.unique(np.concatenate([flat[starts[i]:starts[i] + lens[i]] for i in rest])).astype(np.uint64)
            sizes[s] += np.count_nonzero((union[more >> np.uint64(6)] >> (more & np.uint64(63))) & np.uint64(1) == 0)
    plain = ~mixed[owner]
    owner, place = owner[plain], place[plain]
    listed = np.cumsum(lens[place])
    at = 0
    while at < len(owner):  # whole sets, about PAIRS pairs at a time
        done = listed[at - 1] if at else 0
        to = max(int(np.searchsorted(listed, done + PAIRS)), at + 1)
        to = int(np.searchsorted(owner, owner[to - 1], side="right"))
        first, n = owner[at], lens[place[at:to]]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = flat[np.repeat(starts[place[at:to]], n) + offset]
        some = _distinct_listed(np.repeat(owner[at:to] - first, n), found, width, owner[to - 1] - first + 1)
        sizes[first:first + len(some)] += some
        at = to
    return sizes


def _unions(sets: pa.Table, lists: pa.Table) -> pa.Table:
    """Union sizes of one group of sets over one part of the authors."""
    if not len(sets) or not len(lists):
        return pa.table({"set": pa.array([], pa.int64()), "_n": pa.array([], pa.int64())})
    its, who = (t.column(c).combine_chunks() for t, c in ((sets, "its"), (lists, "who")))
    sizes = _union_sizes(its, lists.column("it").to_numpy(), who)
    return pa.table({"set": sets.column("set"), "_n": pa.array(sizes, pa.int64())})


def _dealt(pairs: int, members: int, sets: int) -> tuple[int, int]:
    """Parts of the authors and groups of the sets; sets go to every part and lists to the groups that read them.

    A part has at most about LISTED of the (item, author) ``pairs`` and a group GROUP sets.  Up to TASKS
    tasks are then made by doubling what is cheaper to send once more.
    """
    parts, groups = max(-(-pairs // LISTED), 1), max(-(-sets // GROUP), 1)
    while parts * groups < min(TASKS, -(-sets // LEAST)):
        if members * parts <= pairs * groups:
            parts *= 2
        else:
            groups *= 2
    return parts, groups


def _large_unions(members: DataFrame, numbered: DataFrame) -> DataFrame:
    """(set, _n): authors in the union of the items of a set, out of (set, it) and (it, num).

    The authors are dealt into parts and the sets into groups.  A task meets one part with one group:
    it gets an array of authors per item and an array of items per set, and no row or bitmap per set
    and block of authors is shuffled.  A list goes only to the groups that have the item.
    """
    sets = store(members.groupBy("set").agg(F.collect_list("it").alias("its")), "union-sets")
    lists = store(numbered.join(members.select("it").distinct(), "it", "left_semi"), "union-authors")
    found = sets.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("its")), F.lit(0)).alias("members")).first()
    parts, groups = _dealt(lists.count(), found["members"], found["n"])
    part, place = F.expr(f"cast(num % {parts} AS int)"), F.expr(f"cast(num div {parts} AS int)")
    lists = lists.groupBy("it", part.alias("part")).agg(F.collect_list(place).alias("who"))

    group = F.pmod(F.xxhash64("set"), F.lit(groups)).cast("int").alias("group")
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    dealt = sets.select("set", "its", group, each)
    if groups > 1:
        readers = sets.select(group, F.explode("its").alias("it")).distinct()
        sent = lists.join(readers, "it")
    else:
        sent = lists.withColumn("group", F.lit(0))
    pieces = dealt.groupBy("part", "group").cogroup(
        sent.select("it", "who", "part", "group").groupBy("part", "group")).applyInArrow(_unions, "set long, _n long")
    return pieces.groupBy("set").agg(F.sum("_n").alias("_n"))


def interaction_counts(met: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs and distinct active authors per (pairing, author, week).

    ``n_pairs`` counts joined pairs of posts, not distinct posts; it is a sum of products.
    ``n_active_authors`` is the size of the union of the author sets of a key's items, less the
    author if they are in it.  No pair of a key and an active author of a popular item is listed:

    * a key with one item has its answer in the join, and keys that met the same items (equal
      digests of 128 bits) share one union;
    * a union whose items have at most SPARSE authors together lists their numbers;
    * any other one is made in a task that has the items' authors as lists or bitmaps.
    """
    total = F.col("active_authors") + F.col("is_active").cast("long")
    # partitioned by author and week: the keys of all pairings of a week are written side by side
    keys = met.repartition("author", "week_idx").groupBy(*_KEY).agg(
        F.count("*").alias("_k"), F.max("active_authors").alias("_one"), F.sum(total).alias("_total"),
        F.max("is_active").alias("_self"), F.sum(F.col("n") * F.col("active_posts")).alias("n_pairs"),
        F.sort_array(F.collect_list("item")).alias("_its"))
    # a key with one item has its answer and needs no list
    some = F.col("_k") > 1
    keys = store(keys.withColumn("_its", F.when(some, F.col("_its"))), "interaction-keys")
    digest = [F.xxhash64(F.lit(salt), "_its").alias(f"_d{salt}") for salt in (0, 1)]
    several = keys.filter(some).withColumns({f"_d{salt}": d for salt, d in enumerate(digest)})
    same = ["pairing", "_k", "_d0", "_d1"]
    sets = several.groupBy(*same).agg(
        F.min(F.struct("author", "week_idx")).alias("_key"), F.min("_total").alias("_total"), F.any_value("_its").alias("_its"))
    # a set whose first key has no week gets no union: its keys answer with their largest item
    sets = store(sets.filter("_key.week_idx IS NOT NULL").drop("_key").withColumn(
        "set", F.monotonically_increasing_id()), "interaction-sets")
    members = sets.select("set", "_total", "pairing", F.explode("_its").alias("item"))
    names = store(members.select(*_ITEM).distinct().withColumn("it", F.monotonically_increasing_id()), "union-items")
    members = store(members.join(names, _ITEM).select("set", "_total", "it"), "interaction-items")
    known = store(items.join(names, _ITEM).select("it", "author_active"), "interaction-known")
    numbered = store(_numbered(known), "interaction-authors")
    few = members.filter(F.col("_total") <= SPARSE).join(numbered, "it").groupBy("set").agg(
        F.size(F.collect_set("num")).cast("long").alias("_n"))
    many = _large_unions(members.filter(F.col("_total") > SPARSE).select("set", "it"), numbered)
    sizes = few.unionByName(many)
    unions = sets.select("set", *same).join(sizes, "set").select(*same, "_n")
    one = keys.filter(~some).select(*_KEY, "n_pairs", F.col("_one").alias("n_active_authors"))
    return one.unionByName(several.join(unions, same, "left").select(*_KEY, "n_pairs", F.coalesce(
        F.col("_n") - F.col("_self").cast("long"), F.col("_one")).alias("n_active_authors")))


def interaction_features(counts: DataFrame, pairings: Sequence[str] = tuple(PAIRINGS)) -> DataFrame:
    """One row per (author, week) with two columns per pairing, zero where it has none."""
    def of(p: str, c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("pairing") == p, F.col(c))), F.lit(0)).alias(f"{c}_{p}")

    return counts.groupBy("author", "week_idx").agg(
        *[of(p, c) for c in ("n_pairs", "n_active_authors") for p in pairings]
    )
