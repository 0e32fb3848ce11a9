"""Hand-made cases for the edges of the semantics."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.functions import numeric, text, time
from emberline.operators import aggregates as agg
from emberline.operators import batchfit, matrices, models
from emberline.operators import evaluation as ev
from emberline.operators import interactions as inter
from emberline.operators import joins as jn
from emberline.operators import ordering, sampling, sparse, windows
from emberline.operators import survival as srv
from emberline.schemas import PAIRINGS

D = dt.date


def days(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "day date")


def test_weeks_at_new_year(spark):
    df = days(spark, D(2015, 12, 31), D(2016, 1, 1), D(2016, 1, 3), D(2016, 1, 4), D(2018, 12, 31))
    rows = df.select(time.iso_week_label(F.col("day")), time.week_idx(F.col("day"))).collect()
    assert [r[0] for r in rows] == ["2015_53", "2015_53", "2015_53", "2016_01", "2019_01"]
    assert rows[0][1] == rows[2][1] == rows[3][1] - 1


def test_week_index_before_the_epoch_and_sunday(spark):
    row = days(spark, D(1970, 1, 4)).select(
        time.week_idx(F.col("day")), time.week_to_sunday(time.week_idx(F.col("day")))).first()
    assert tuple(row) == (-1, D(1970, 1, 4))


def test_cohort_windows(spark):
    df = spark.createDataFrame([("2015-1",), ("2021-4",), ("2022-2",)], "c string")
    rows = df.select(time.cohort_window(F.col("c")).alias("w")).select("w.*").collect()
    assert [tuple(r) for r in rows] == [
        (D(2014, 1, 1), D(2017, 4, 1)), (D(2020, 10, 1), D(2024, 1, 1)), (D(2021, 4, 1), D(2024, 7, 1))]


def test_person_period_edges(spark):
    from emberline.plans.person_period import author_weeks

    rows = [
        ("sunday", D(2020, 1, 5) + dt.timedelta(366), D(2100, 1, 1)),  # starts on a Sunday
        ("early", D(2020, 6, 1), D(2019, 6, 3)),  # strong date soon after the start
        ("none", D(2020, 6, 1), D(2019, 5, 1)),  # ends before it starts
    ]
    a = spark.createDataFrame(rows, "author string, date_weak date, date_strong date").withColumn("active", F.lit(True))
    found = author_weeks(a).orderBy("author", "sunday").collect()
    assert {r.author for r in found} == {"sunday", "early"}
    first = next(r for r in found if r.author == "sunday")
    assert (first.sunday, first.duration) == (D(2020, 1, 5), 0)
    early = [r for r in found if r.author == "early"]
    assert [(r.sunday, r.duration, r.activation) for r in early] == [(D(2019, 6, 2), 1, False), (D(2019, 6, 9), 1, True)]


def test_ratios(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (0.0, 3.0), (2.0, 4.0), (None, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(numeric.safe_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 2.0, 0.0, 0.5, 0.0]


def test_regions(spark):
    cases = {
        None: [], "1#x#USNY#1;2#USNY#USCA": [("US", "NY"), ("US", "CA")], "usny#US#CA8#CA08#CA085": [("CA", "08")],
        "": [], "USNY": [("US", "NY")],
    }
    df = spark.createDataFrame([(k,) for k in cases], "loc string")
    got = [[tuple(x) for x in r[0]] for r in df.select(text.extract_regions(F.col("loc"))).collect()]
    assert got == list(cases.values())


def test_strike_is_a_token_and_the_rest_are_substrings(spark):
    df = spark.createDataFrame([("A,STRIKE;B",), ("STRIKES;CLIMATE_X",), (None,)], "t string")
    flags = text.theme_flags(F.col("t"))
    rows = df.select(flags["is_strike"], flags["is_climate"]).collect()
    assert [tuple(r) for r in rows] == [(True, False), (False, True), (None, None)]


def test_population_numbers(spark):
    df = spark.createDataFrame([("39.029.342",), ("15,500,632",), (" 7 ",), ("n/a",)], "p string")
    assert [r[0] for r in df.select(text.parse_population(F.col("p"))).collect()] == [39029342, 15500632, 7, None]


def test_tolerant_parsing(spark):
    from emberline.sources.posts import posts_from_text

    lines = [
        '{"author":"a","subreddit":"s","body":null,"created_utc":5,"id":"x","extra":1}',
        "{broken", '{"author":"b","selftext":"t"}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    rc = posts_from_text(df, "RC").collect()
    assert [r.author for r in rc] == ["a", None, "b"]
    assert rc[0].body is None and rc[0].created_utc == 5
    assert [r.body for r in posts_from_text(df, "RS").collect()] == [None, None, "t"]


def test_news_audit_by_file(spark, tmp_path):
    from emberline.schemas import NEWS_WIDTH
    from emberline.sources import news

    good = "\t".join(["20240105"] + ["-"] * (NEWS_WIDTH - 1))
    files = {"20240105001500.csv": [good, good, "short\tline"], "20240105003000.csv": ["no news"], "20240107000000.csv": [good]}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    audit = news.file_audit(news.scan_news_audit(spark, str(tmp_path)))
    got = {r.file_path.rsplit("/", 1)[1]: (r.day, r.good, r.bad, r.unreadable) for r in audit.collect()}
    assert got == {"20240105001500.csv": (D(2024, 1, 5), 2, 1, False), "20240105003000.csv": (D(2024, 1, 5), 0, 1, True),
                   "20240107000000.csv": (D(2024, 1, 7), 1, 0, False)}
    assert [r.n for r in news.news_volume(audit, records="good").orderBy("day").collect()] == [2, 0, 1]
    assert {r.file_path[-18:] for r in news.corrupted_inputs(audit).collect()} == set(list(files)[:2])


def test_faulty_load_keeps_the_months_there(spark, tmp_path):
    from emberline.sources import sinks

    path = str(tmp_path / "months")
    sinks.incremental_month_load(spark.createDataFrame([("a", "2024-01")], "id string, month string"), path)
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        sinks.incremental_month_load(
            spark.createDataFrame([("b", "2024-01")], "id string, quarter string"), path, partition="quarter")
    assert [tuple(r) for r in spark.read.parquet(path).select("id", "month").collect()] == [("a", "2024-01")]


def test_first_activation_tie_and_empty(spark):
    rows = [("a", 10, "z", "s1"), ("a", 10, "y", "s2"), ("b", 5, "q", "s3")]
    df = spark.createDataFrame(rows, "author string, created_utc long, id string, subreddit string").withColumn(
        "day", time.epoch_to_date(F.col("created_utc")))
    got = {r.author: r.subreddit for r in agg.first_activation(df).collect()}
    assert got == {"a": "s2", "b": "s3"}
    assert agg.first_activation(df.filter("false")).count() == 0


def test_dedup_takes_first_non_null_per_column(spark):
    rows = [("x", 2, "late", "p"), ("x", 1, None, "q"), ("x", 3, "last", None), ("y", 1, None, None)]
    df = spark.createDataFrame(rows, "id string, t int, a string, b string")
    got = {r.id: (r.t, r.a, r.b) for r in agg.dedup_first(df, "id", ["t"]).collect()}
    assert got == {"x": (1, "late", "q"), "y": (1, None, None)}


def test_rolling_rows_and_calendar(spark):
    weeks = [("US", "NY", w, float(w)) for w in (1, 2, 3, 4, 6, 7)] + [("US", "CA", w, 1.0) for w in (1, 2, 3)]
    df = spark.createDataFrame(weeks, "country string, admin1code string, week_idx long, x double")
    rows = {(r.admin1code, r.week_idx): r.x for r in windows.rolling_mean_lagged(df, ["x"], 4, 2).collect()}
    assert rows[("NY", 6)] == 2.5 and rows[("NY", 8)] == 3.75 and rows[("NY", 5)] == 0.0
    assert all(x == 0.0 for (a, _), x in rows.items() if a == "CA")
    cal = {(r.admin1code, r.week_idx): r.x for r in windows.rolling_mean_lagged(df, ["x"], 4, 2, calendar=True).collect()}
    assert cal[("NY", 6)] == 2.5 and cal[("NY", 8)] == 0.0


def test_zscore_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    assert [tuple(r) for r in windows.zscore(df, ["x", "c"]).orderBy("x").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_bootstrap_signs(spark):
    rows = [("pos", 1.0), ("pos", 2.0), ("neg", -1.0), ("neg", -3.0), ("mix", -1.0), ("mix", 1.0)]
    df = spark.createDataFrame(rows, "feature string, coef double")
    sig = {r.feature: r.significant for r in ev.bootstrap_ci(df).collect()}
    assert sig == {"pos": True, "neg": True, "mix": False}
    p = {r.feature: r.p for r in ev.bootstrap_pvalue(df).collect()}
    assert p == {"pos": 0.0, "neg": 0.0, "mix": 0.5}


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    for n, ties in ((1, False), (7, False), (5000, False), (5000, True)):
        x = rng.normal(size=n).round(1 if ties else 12)
        df = spark.createDataFrame([(float(v),) for v in x], "x double")
        got = ordering.exact_quantiles(df, ["x"], {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.975}, buckets=16).first()
        assert np.allclose([got.a, got.b, got.c, got.d], np.quantile(x, [0, 0.25, 0.5, 0.975]))


def test_weighted_median(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 3)], "x double, w int")
    assert ordering.quantiles_wide(df, ["x"], 0.5, weight="w").first().x == np.median([1] * 5 + [2] + [9] * 3)


def test_running_totals_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randint(0, 40), rng.randint(1, 5)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, n int")
    got = {(r.g, r.o): (r.n, r.before_n) for r in
           ordering.running_totals(df, ["g"], "o", {"n": F.col("n")}, buckets=8).collect()}
    for g, o in got:
        assert got[(g, o)] == (
            sum(x for a, b, x in rows if (a, b) == (g, o)), sum(x for a, b, x in rows if a == g and b < o))


def test_sample_sizes_with_a_hot_stratum(spark):
    df = spark.range(20000).select(
        F.col("id"), F.when(F.col("id") < 15000, "hot").when(F.col("id") < 19990, "warm").otherwise("cold").alias("s"))
    got = sampling.exact_sample_n(df, ["s"], 4321, 1, "id")
    sizes = {r.s: r["count"] for r in got.groupBy("s").count().collect()}
    assert sizes == {"hot": 4321, "warm": 4321, "cold": 10}
    assert got.select("id").distinct().count() == got.count()
    again = sampling.exact_sample_n(df.repartition(3), ["s"], 4321, 1, "id")
    assert got.exceptAll(again).count() == 0
    want = spark.createDataFrame([("hot", 3), ("warm", 0)], "s string, n long")
    assert {r.s: r["count"] for r in sampling.exact_sample_n(df, ["s"], want, 1, "id").groupBy("s").count().collect()} == {"hot": 3}


def test_balanced_classes_are_equal(spark):
    df = spark.range(1000).select("id", (F.col("id") < 70).alias("y"))
    sizes = {r.y: r["count"] for r in sampling.balance_classes(df, "y", 3, "id").groupBy("y").count().collect()}
    assert sizes == {True: 70, False: 70}


def test_bootstrap_weights_are_poisson(spark):
    df = spark.range(20000)
    w = sampling.bootstrap_sample(df, 2, 9, "id").groupBy("replicate").agg(
        F.sum("weight").alias("n"), F.count("*").alias("k")).collect()
    for r in w:
        assert abs(r.n / 20000 - 1) < 0.03 and abs(r.k / 20000 - (1 - np.exp(-1))) < 0.02


def _random_posts(rng, n):
    rows = []
    for i in range(n):
        kind = "RS" if rng.random() < 0.2 else "RC"
        hot = rng.random() < 0.4
        rows.append((
            f"u{rng.randint(0, 30)}", rng.randint(0, 2), kind, str(i),
            None if kind == "RS" else ("t3_0" if hot else f"t3_{rng.randint(0, 20)}"),
            None if kind == "RS" else f"{rng.choice(['t1', 't3'])}_{rng.randint(0, n)}",
        ))
    return rows


@pytest.mark.parametrize("seed", [5, 6])
def test_interactions_match_brute_force(spark, seed):
    rng = random.Random(seed)
    mine, act = _random_posts(rng, 400), _random_posts(rng, 300)
    mine += [(None, 1, "RC", "9001", "t3_0", "t1_5")] * 3  # posts without author meet nobody
    act += [(None, 1, "RC", "9002", "t3_0", "t1_5")] * 3
    schema = "author string, week_idx int, kind string, id string, link_id string, parent_id string"
    items = inter.active_items(spark.createDataFrame(act, schema))
    met = inter.interaction_join(spark.createDataFrame(mine, schema), items)
    got = {(r.pairing, r.author, r.week_idx): (r.n_pairs, r.n_active_authors)
           for r in inter.interaction_counts(met, items).collect()}

    def key(post, name):
        author, week, kind, pid, link, parent = post
        return {"id": ("t3_" if kind == "RS" else "t1_") + pid, "link_id": link, "parent_id": parent}[name]

    want = {}
    for p, (a_key, o_key) in PAIRINGS.items():
        for m, a in itertools.product(mine, act):
            if m[0] is None or a[0] is None:
                continue
            k = key(m, o_key)
            if k is not None and k == key(a, a_key) and m[0] != a[0]:
                n, who = want.setdefault((p, m[0], m[1]), (0, set()))
                want[(p, m[0], m[1])] = (n + 1, who | {a[0]})
    assert got == {k: (n, len(who)) for k, (n, who) in want.items()}


def test_thread_of_many_active_authors(spark):
    act = spark.range(10_000).select(
        F.concat(F.lit("a"), F.col("id").cast("string")).alias("author"), F.lit("RC").alias("kind"),
        F.concat(F.lit("x"), F.col("id").cast("string")).alias("id"), F.lit("t3_hot").alias("link_id"),
        F.concat(F.lit("t1_"), (F.col("id") % 2).cast("string")).alias("parent_id"))
    mine = spark.createDataFrame(
        [("u", 1, "RC", "m1", "t3_hot", "t1_0"), ("u", 1, "RC", "m2", "t3_hot", "t1_1"), ("a5", 1, "RC", "m3", "t3_hot", "t1_0")],
        "author string, week_idx int, kind string, id string, link_id string, parent_id string")
    items = inter.active_items(act)
    got = {(r.pairing, r.author): (r.n_pairs, r.n_active_authors)
           for r in inter.interaction_counts(inter.interaction_join(mine, items), items).collect()}
    assert got[("thread", "u")] == (20_000, 10_000) and got[("thread", "a5")] == (9_999, 9_999)
    assert got[("sibling", "u")] == (10_000, 10_000) and got[("sibling", "a5")] == (5_000, 5_000)


def test_popular_item_on_both_sides_lists_no_pairs(spark):
    """10,000 active authors and 10,000 keys of one item (1e8 pairs); each key has an item of its own besides."""
    n = 10_000
    items = spark.range(n).select(F.lit("thread").alias("pairing"), F.lit("hot").alias("item"),
                                  F.concat(F.lit("a"), "id").alias("author_active"), F.lit(1).cast("long").alias("c"))
    items = items.unionByName(spark.range(n).select(
        F.lit("thread").alias("pairing"), F.concat(F.lit("i"), "id").alias("item"),
        F.concat(F.lit("b"), F.col("id") % 7).alias("author_active"), F.lit(1).cast("long").alias("c")))
    met = spark.range(n).select(
        F.concat(F.lit("a"), "id").alias("author"), F.explode(F.array(F.lit("hot"), F.concat(F.lit("i"), "id"))).alias("item"))
    own = F.col("item") == "hot"
    met = met.select(
        F.lit("thread").alias("pairing"), "author", F.lit(1).alias("week_idx"), "item", F.lit(1).cast("long").alias("n"),
        F.when(own, n - 1).otherwise(1).cast("long").alias("active_posts"),
        F.when(own, n - 1).otherwise(1).cast("long").alias("active_authors"), own.alias("is_active"))
    counts = inter.interaction_counts(met, items)
    assert counts.groupBy("n_pairs", "n_active_authors").count().collect() == [(n, n, n)]
    assert n < largest_output(counts) < 1_000_000


def largest_output(df):
    """Most rows that a node of the executed plan has put out."""
    df.collect()
    rows = [0]

    def walk(node):
        node = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
        node = node.plan() if node.nodeName().endswith("QueryStage") else node
        metric = node.metrics().get("numOutputRows")
        rows.append(metric.get().value() if metric.isDefined() else 0)
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return max(rows)


@pytest.mark.parametrize("sparse", [0, 3, 64])
def test_unions_by_lists_and_by_bitmaps(spark, monkeypatch, sparse):
    monkeypatch.setattr(inter, "SPARSE", sparse)
    rng = random.Random(sparse)
    of = {f"i{k}": rng.sample(range(3000), rng.choice([1, 2, 5, 900])) for k in range(30)}
    items = spark.createDataFrame([("thread", i, f"a{x:04}", 1) for i, xs in of.items() for x in xs],
                                  "pairing string, item string, author_active string, c long")
    keys = {(f"a{x:04}", w): rng.sample(sorted(of), rng.choice([1, 2, 4])) for x in range(60) for w in (1, 2)}
    keys |= {(f"z{x}", 1): ["i1", "i2", "i3"] for x in range(20)}  # equal sets of items
    rows = [("thread", a, w, i, 2, len(of[i]) - (int(a[1:]) in of[i]), len(of[i]) - (int(a[1:]) in of[i]), int(a[1:]) in of[i])
            if a[0] == "a" else ("thread", a, w, i, 2, len(of[i]), len(of[i]), False) for (a, w), its in keys.items() for i in its]
    met = spark.createDataFrame([r for r in rows if r[6] > 0], "pairing string, author string, week_idx int, item string, "
                                "n long, active_posts long, active_authors long, is_active boolean")
    got = {(r.author, r.week_idx): r.n_active_authors for r in inter.interaction_counts(met, items).collect()}
    want = {k: len({x for i in its for x in of[i]} - ({int(k[0][1:])} if k[0][0] == "a" else set())) for k, its in keys.items()}
    assert got == {k: n for k, n in want.items() if n}


def test_unions_of_scattered_authors_move_no_row_per_set_and_block(spark, monkeypatch):
    """400 keys of two items, each with 100 of 30,000 authors; all parts and groups of the union step are used."""
    monkeypatch.setattr(inter, "LISTED", 1500, raising=False)
    monkeypatch.setattr(inter, "LEAST", 150, raising=False)
    of = {f"i{k}": [(k * 131 + j * 300) % 30_000 for j in range(100)] for k in range(50)}
    of |= {"hot": list(range(0, 30_000, 20))}
    items = spark.createDataFrame([("thread", i, f"a{x:05}", 1) for i, xs in of.items() for x in xs],
                                  "pairing string, item string, author_active string, c long")
    names = sorted(of)
    keys = {f"z{n}": (names[n % 51], names[(n * 7 + n // 51 + 1) % 51]) for n in range(400)}
    keys = {k: its for k, its in keys.items() if its[0] != its[1]}
    met = spark.createDataFrame([("thread", a, 1, i, 1, len(of[i]), len(of[i]), False) for a, its in keys.items() for i in its],
                                "pairing string, author string, week_idx int, item string, "
                                "n long, active_posts long, active_authors long, is_active boolean")
    counts = inter.interaction_counts(met, items)
    got = {r.author: r.n_active_authors for r in counts.collect()}
    assert got == {a: len({x for i in its for x in of[i]}) for a, its in keys.items()}
    assert largest_output(counts) < 10_000


def test_interaction_join_shuffles_both_sides_once(spark):
    """One exchange by item: no grouping before it, and none for the totals or the own share behind it."""
    mine = spark.createDataFrame([("u", 1, "RC", "m1", "t3_x", "t1_0"), ("a", 1, "RC", "m2", "t3_x", "t1_0"), ("u", None, "RC", "m3", "t3_x", "t1_0")],
                                 "author string, week_idx int, kind string, id string, link_id string, parent_id string")
    items = spark.createDataFrame([("thread", "t3_x", "a", 2), ("thread", "t3_x", "b", 1), ("sibling", "t1_0", "a", 5), ("i_replied", "t1_0", "b", 7)],
                                  "pairing string, item string, author_active string, c long")
    met = inter.interaction_join(mine, items)
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    got = {(r.pairing, r.author, r.week_idx): (r.n, r.active_posts, r.active_authors, r.is_active) for r in met.collect()}
    assert got == {
        ("thread", "u", 1): (1, 3, 2, False), ("thread", "u", None): (1, 3, 2, False), ("thread", "a", 1): (1, 1, 1, True),
        ("sibling", "u", 1): (1, 5, 1, False), ("sibling", "u", None): (1, 5, 1, False),
        ("i_replied", "u", 1): (1, 7, 1, False), ("i_replied", "u", None): (1, 7, 1, False), ("i_replied", "a", 1): (1, 7, 1, False)}


def test_unions_send_what_is_smaller_more_often():
    """20 million authors of items are not sent 32 times to spread a million sets; with small lists the sets stay."""
    parts, groups = inter._dealt(20_000_000, 2_400_000, 1_200_000)
    assert parts * groups >= inter.TASKS and 20_000_000 * groups + 2_400_000 * parts < 32 * 20_000_000 / 4
    assert inter._dealt(1_000, 2_400_000, 1_200_000) == (1, 32)
    assert inter._dealt(0, 0, 0) == (1, 1)
    parts, groups = inter._dealt(10 * inter.LISTED, 100, 50)
    assert (parts, groups) == (10, 1)


def test_interaction_is_of_the_class_and_outside_its_communities(spark):
    h = spark.createDataFrame(
        [("a", "own", "x"), ("a", "else", "x"), ("a", "else", "y")], "author string, subreddit string, subreddit_class string")
    assert [tuple(r) for r in inter.active_posts(h, "x", ["own"]).collect()] == [("a", "else", "x")]


def test_full_keys_of_different_kinds_do_not_collide(spark):
    schema = "author string, week_idx int, kind string, id string, link_id string, parent_id string"
    mine = spark.createDataFrame([("u", 1, "RC", "7", None, None)], schema)
    act = spark.createDataFrame([("a", 1, "RC", "9", None, "t3_7")], schema)
    met = inter.interaction_join(mine, inter.active_items(act))
    assert met.count() == 0


def test_windows_of_periods_are_disjoint_and_points_in_time(spark):
    from emberline.plans.features import WINDOWS

    facts = spark.range(0, 80).select(F.lit("a").alias("author"), F.col("id").alias("week_idx"), F.col("id").alias("x"))
    sample = facts.filter("week_idx = 60").select("author", "week_idx")
    got = {}
    for r in jn.lag_week_join(sample, facts, WINDOWS).collect():
        got.setdefault(r.period, set()).add(r.x)
    assert got == {"short": {59}, "medium": {55, 56, 57, 58}, "long": set(range(8, 55))}


def test_lag_mean_counts_equal_weeks_once(spark):
    facts = spark.createDataFrame([("a", 8, 2.0), ("a", 7, 2.0), ("a", 6, 5.0)], "author string, week_idx long, x double")
    sample = spark.createDataFrame([("a", 9)], "author string, week_idx long")
    lagged = jn.lag_week_join(sample, facts, {"p": (4, 1)})
    assert agg.lag_mean(lagged, ["x"], ["p"]).first().x_p == 3.5
    assert agg.lag_mean(lagged, ["x"], ["p"], dedup=False).first().x_p == 3.0


def test_weekly_activity_against_python(spark):
    rng = random.Random(3)
    posts = [(f"u{rng.randint(0, 5)}", rng.choice(["RC", "RC", "RS"]), D(2021, 3, 1) + dt.timedelta(rng.randint(0, 20)),
              rng.choice(["p1", "p2", None]), f"s{rng.randint(0, 3)}") for _ in range(500)]
    df = spark.createDataFrame(posts, "author string, kind string, day date, parent_id string, subreddit string").withColumn(
        "week_idx", time.week_idx(F.col("day")))
    for r in agg.weekly_activity(df).collect():
        own = [p for p in posts if p[0] == r.author and (p[2] - D(1970, 1, 5)).days // 7 == r.week_idx]
        rc = [p for p in own if p[1] == "RC"]
        parents = [p[3] for p in rc if p[3]]
        assert r.n_comments_author_week == len(rc) and r.n_submissions_author_week == len(own) - len(rc)
        assert r.n_active_days_author_week == len({p[2] for p in rc})
        assert r.n_different_subreddits == len({p[4] for p in own})
        assert r.avg_comments_per_thread == (len(parents) / len(set(parents)) if parents else None)


def _ridge_brute(x, y, w, k):
    """Coefficients of the z-scores: penalised Newton steps on the first components of weighted moments."""
    n = w.sum()
    mean = w @ x / n
    z = (x - mean) / np.sqrt(w @ (x - mean) ** 2 / n)
    values, found = np.linalg.eigh((z * w[:, None]).T @ z / n)
    load = found[:, np.argsort(-values)[:k]]
    a, theta = np.hstack([np.ones((len(x), 1)), z @ load]), np.zeros(k + 1)
    keep = np.diag([0.0] + [1.0] * k)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ theta))
        theta = theta + np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + keep, a.T @ (w * (y - p)) - keep @ theta)
    return load @ theta[1:], theta[0], (a @ theta)


@pytest.fixture(scope="module")
def fit_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6)) * [1, 5, 0.1, 1, 2, 1] + [0, 100, -3, 0, 1, 1000]
    x[:, 3] = x[:, 0] + 0.3 * x[:, 3]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 4])))).astype(int)
    return spark.createDataFrame([(i, bool(b), *map(float, r)) for i, (b, r) in enumerate(zip(y, x))],
                                 "id long, hit boolean, " + ", ".join(f"f{i} double" for i in range(6))), x, y


def test_resampled_fits_equal_weighted_newton_steps(spark, fit_rows):
    df, x, y = fit_rows
    features = [f"f{i}" for i in range(6)]
    coefs, metrics = models.repeated_bootstrap_fit(df, features, "hit", "id", 3, 7, "s")
    got = {(r.replicate, r.feature): r.coef for r in coefs.collect()}
    rows = batchfit.resampled(df, features, "hit", "id", 7, "s", 0.75).collect()
    runs = {r.replicate: r for r in metrics.collect()}
    xs, ys = np.array([r.x for r in rows]), np.array([r.label for r in rows])
    assert abs(np.mean([r.train for r in rows]) - 0.75) < 0.1 and abs(np.mean([r.test for r in rows]) - 0.25) < 0.1
    for b in range(7):
        w, v = np.array([r.train[b] for r in rows], float), np.array([r.test[b] for r in rows], float)
        want, _, eta = _ridge_brute(xs, ys, w, 3)
        assert np.allclose([got[b, f] for f in features], want, atol=1e-6)
        assert abs(runs[b].accuracy - v @ ((eta > 0) == ys) / v.sum()) < 1e-12


def test_jobs_do_not_grow_with_replicates(spark, fit_rows):
    df, counts = fit_rows[0], []
    for b in (2, 60):
        spark.sparkContext.setJobGroup(f"fits-{b}", "")
        models.repeated_bootstrap_fit(df, ["f0", "f1"], "hit", "id", 2, b, "s", test=False)[0].collect()
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fits-{b}")))
    spark.sparkContext.setJobGroup("", "")
    assert counts[1] <= counts[0] + 12, counts  # a few more Newton steps for the slowest of the fits


def test_fits_of_odd_tables(spark):
    schema = "id long, hit boolean, a double, b double"
    still = spark.createDataFrame([(i, i % 2 == 0, 5.0, float(i)) for i in range(20)], schema)
    got = {r.feature: r.coef for r in models.repeated_bootstrap_fit(still, ["a", "b"], "hit", "id", 2, 1, 1, test=False)[0].collect()}
    assert got["a"] == 0 and abs(got["b"]) < 5
    one = spark.createDataFrame([(i, True, 1.0 * i, float(i % 3)) for i in range(20)], schema)
    assert models.repeated_bootstrap_fit(one, ["a", "b"], "hit", "id", 2, 2, 1, test=False)[0].count() == 4


def test_correlations_in_tiles_with_gaps(spark, monkeypatch):
    monkeypatch.setattr(matrices, "TILE", 3)
    monkeypatch.setattr(matrices, "TASK_BYTES", 1000)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8)) + 1e6
    x[:, 5] = 7.25
    gaps = rng.random(x.shape) < 0.2
    rows = [tuple(None if g else float(v) for v, g in zip(r, gs)) for r, gs in zip(x, gaps)]
    names = [f"c{i}" for i in range(8)]
    got = {(r.a, r.b): r["corr"] for r in agg.corr_matrix(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names).collect()}
    assert len(got) == 64
    for i, j in itertools.product(range(8), range(8)):
        both = ~gaps[:, i] & ~gaps[:, j]
        if 5 in (i, j):
            assert got[names[i], names[j]] is None
        else:
            assert abs(got[names[i], names[j]] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-6


def test_correlation_rows_do_not_grow_with_columns_squared(spark):
    """A task gives one row per pair of tiles, whatever the rows and columns."""
    df = spark.range(500).select(*[F.sin(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(100)])
    plan = agg.corr_matrix(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_sparse_components_equal_exact_ones(spark):
    """800 sparse features: the components agree with the dense matrix's to 1e-6, and so does the fit."""
    rng, d, k = np.random.default_rng(4), 800, 6
    topics = [rng.choice(d, 60, replace=False) for _ in range(8)]
    rows = []
    for i in range(600):
        own = np.unique(np.concatenate([rng.choice(topics[i % 8], 25 - 2 * (i % 8)), rng.choice(d, 10)]))
        rows.append((i % 8 < 3, [int(x) for x in own if x != 7], [float(x) for x in rng.choice([1.0, 2.0], len(own) - (7 in own))]))
    rows += [(True, [], []), (False, [0], [1.0])]
    df = spark.createDataFrame(rows, "hit boolean, idx array<int>, val array<double>").repartition(5)
    x = np.zeros((len(rows), d))
    for i, (_, idx, val) in enumerate(rows):
        x[i, idx] = val
    deviation = x.std(0)
    z = (x - x.mean(0)) / np.where(deviation > 0, deviation, 1)
    values, exact = np.linalg.eigh(z.T @ z / len(x))
    found = sparse.components(df, d, k)
    assert np.allclose(found.values, values[::-1][:k], rtol=1e-8)
    assert np.allclose(np.abs((found.load * exact[:, ::-1][:, :k]).sum(0)), 1, atol=1e-9)
    assert np.allclose(found.load @ found.load.T, exact[:, ::-1][:, :k] @ exact[:, ::-1][:, :k].T, atol=1e-6)
    got = {r.place: r.coef for r in sparse.pca_logistic_sparse(df, d, "hit", k).collect()}
    want, _, _ = _ridge_brute(np.delete(x, np.flatnonzero(deviation == 0), 1), np.array([float(r[0]) for r in rows]), np.ones(len(rows)), k)
    assert np.allclose([got[i] for i in np.flatnonzero(deviation > 0)], want, atol=1e-5) and got[7] == 0


def test_efron_sums_without_a_loop_over_deaths(spark):
    cases = [(s0, share, d) for s0 in (1.0, 1e-3, 1e5) for share in (1.0, 0.999, 0.3, 1e-6) for d in (1, 2, 8, 9, 10, 500)]
    df = spark.createDataFrame([(s0, s0 * share, d) for s0, share, d in cases], "s0 double, e0 double, d long")
    for r in df.select("*", *srv.efron_sums(F.col("s0"), F.col("e0"), F.col("d"))).collect():
        left = [r.s0 - l / r.d * r.e0 for l in range(r.d)]
        want = [sum(math.log(v) for v in left), sum(1 / v for v in left), sum(1 / v**2 for v in left)]
        assert np.allclose(r[3:], want, rtol=1e-9, atol=1e-9), (r, want)


def _cox_brute(rows, beta):
    """Efron log partial likelihood."""
    ll = 0.0
    for t in sorted({r[0] for r in rows if r[1]}):
        risk = [np.exp(np.dot(beta, r[2])) for r in rows if r[0] >= t]
        died = [r for r in rows if r[0] == t and r[1]]
        e = sum(np.exp(np.dot(beta, r[2])) for r in died)
        ll += sum(np.dot(beta, r[2]) for r in died)
        ll -= sum(np.log(sum(risk) - k / len(died) * e) for k in range(len(died)))
    return ll


def test_cox_maximises_the_efron_likelihood(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(300):
        x = rng.normal(size=2)
        t = int(min(7, rng.exponential(3 / np.exp(0.8 * x[0] - 0.5 * x[1]))))
        rows.append((t, bool(rng.random() < 0.8), x))
    df = spark.createDataFrame([(t, e, float(x[0]), float(x[1])) for t, e, x in rows], "t int, e boolean, a double, b double")
    fit = srv.fit_cox(df, "t", "e", ["a", "b"])
    best = _cox_brute(rows, fit.coef)
    assert abs(best - fit.log_likelihood) < 1e-6
    for step in ([1e-3, 0], [-1e-3, 0], [0, 1e-3], [0, -1e-3]):
        assert _cox_brute(rows, fit.coef + np.array(step)) < best
    assert 0.5 < fit.coef[0] < 1.1 and -0.9 < fit.coef[1] < -0.2
    h = 1e-4
    info = -(_cox_brute(rows, fit.coef + [h, 0]) - 2 * best + _cox_brute(rows, fit.coef - [h, 0])) / h**2
    inv = np.linalg.inv(np.array([[info, 0], [0, 1]]))  # scale only: the off-diagonal is small here
    assert abs(fit.std_err[0] / np.sqrt(inv[0, 0]) - 1) < 0.2
    eta = F.col("a") * float(fit.coef[0]) + F.col("b") * float(fit.coef[1])
    got = srv.concordance(df, "t", "e", eta).first()[0]
    num = den = 0.0
    for i, j in itertools.product(rows, rows):
        if i[1] and (j[0] > i[0] or (j[0] == i[0] and not j[1])):
            a, b = np.dot(fit.coef, i[2]), np.dot(fit.coef, j[2])
            den += 1
            num += 1.0 if b < a else 0.5 if a == b else 0.0
    assert abs(got - num / den) < 1e-9


def test_logistic_recovers_direction_and_ignores_row_order(spark):
    from emberline.operators import models as mdl

    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 4))
    y = rng.random(1500) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1])))
    rows = [(int(i), *map(float, x[i]), 3.0, bool(y[i])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, flat double, y boolean")
    names = ["a", "b", "c", "d", "flat"]
    one = {r.feature: r.coef for r in mdl.pca_logistic(df, names, "y", 5).collect()}
    two = {r.feature: r.coef for r in mdl.pca_logistic(df.orderBy(F.desc("id")), names, "y", 5).collect()}
    assert abs(one["a"] - 1.5) < 0.3 and abs(one["b"] + 1.0) < 0.3 and abs(one["c"]) < 0.2 and abs(one["flat"]) < 1e-6
    assert all(abs(one[k] - two[k]) < 1e-2 for k in one)
    groups = {"g": (["a", "b"], 2), "h": (["c", "d"], 2)}
    three = {r.feature: r.coef for r in mdl.group_pca_logistic(df, groups, "y").collect()}
    assert abs(three["a"] - one["a"]) < 0.05
    glm = {r.feature: r for r in mdl.logit_inference(df, ["a", "b", "c"], "y").collect()}
    assert glm["a"].predictor == 1 and glm["b"].predictor == -1 and abs(glm["a"].coef - 1.5) < 0.3


def test_log_likelihood_is_stable(spark):
    df = spark.createDataFrame([(1.0, 800.0), (0.0, -800.0), (1.0, 0.0)], "y double, eta double")
    got = df.agg(ev.log_likelihood(F.col("y"), F.col("eta"))).first()[0]
    assert abs(got + np.log(2)) < 1e-12
