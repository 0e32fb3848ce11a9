"""What must be visible in physical plans; the oracle tests look for forbidden nodes."""

import datetime as dt

import pytest
from oracle import DATA

def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark):
    from emberline.operators.filters import filter_positive_score
    from emberline.sources import views as v

    df = filter_positive_score(v.posts_short(spark, f"{DATA}/sf0.001")).select("id", "score")
    plan = physical(df)
    assert "GreaterThan(value,0.0)" in plan
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_month_filter_prunes_folders(spark, tmp_path):
    from emberline.sources.posts import scan_history

    df = spark.createDataFrame(
        [("a", "RC", "2020-01"), ("b", "RS", "2020-01"), ("c", "RC", "2020-02")], "id string, kind string, month string")
    df.write.partitionBy("kind", "month").parquet(str(tmp_path / "h"))
    found = scan_history(spark, str(tmp_path / "h"), ["2020-01"], "RC", df.schema)
    assert "PartitionFilters: [isnotnull(kind" in physical(found)
    assert [r.id for r in found.collect()] == ["a"]
    assert scan_history(spark, str(tmp_path / "h"), ["2031-01"], "RC", df.schema).count() == 0


def test_small_lookup_is_broadcast_without_hint(spark):
    from emberline.operators.joins import history_broadcast_join
    from emberline.session import store
    from emberline.sources import views as v

    authors = store(v.class_activations_long(spark, f"{DATA}/sf0.001"), "authors")
    c = v.comments_long(spark, f"{DATA}/sf0.001").select("id", "author")
    assert "BroadcastHashJoin" in physical(history_broadcast_join(c, authors))


@pytest.mark.parametrize("name", ["cohort_window_history", "pre_activation_history", "post_activation_history", "weak_cohort_window"])
def test_history_queries_broadcast_authors_and_bound_days(spark, name):
    from emberline.catalog import QUERIES

    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    rows = df.count()
    plan = physical(df)
    assert rows and "BroadcastHashJoin" in plan
    assert "cast(l_shipdate" in plan and ("DATE" in plan or "GreaterThanOrEqual" in plan or ">= " in plan)


def test_history_bounds_prune_month_folders(spark, tmp_path):
    import datetime as dt

    from emberline.operators.joins import pre_activation_history

    rows = [("a", dt.date(2020, m, 5), f"2020-{m:02}") for m in range(1, 10)]
    path = str(tmp_path / "posts")
    spark.createDataFrame(rows, "author string, day date, month string").write.partitionBy("month").parquet(path)
    first = spark.createDataFrame([("a", dt.date(2020, 6, 20))], "author string, date date")
    df = pre_activation_history(spark.read.parquet(path), first, months=2)
    assert sorted(r.day.month for r in df.collect()) == [4, 5]
    assert "(month" in physical(df).split("PartitionFilters")[1][:120]


def test_periods_share_one_lag_join(spark):
    from emberline.operators.joins import lag_week_join
    from emberline.plans.features import WINDOWS

    facts = spark.range(100).selectExpr("concat('a', id % 3) author", "id week_idx", "id x")
    plan = physical(lag_week_join(facts.select("author", "week_idx"), facts, WINDOWS))
    assert plan.count("Join") == 1


def test_lagged_rows_are_not_broadcast(spark):
    """The file of a sample is small, its lagged rows are 52 times as many."""
    from emberline.operators.joins import lag_week_join
    from emberline.plans.features import WINDOWS
    from emberline.session import store

    sample = store(spark.range(60, 90).selectExpr("concat('a', id % 3) author", "id week_idx"), "sample")
    facts = store(spark.range(100).selectExpr("concat('a', id % 3) author", "id week_idx", "id x"), "facts")
    lagged = lag_week_join(sample, facts, WINDOWS)
    rows = lagged.collect()
    want = {(f"a{w % 3}", w, p, w - n) for w in range(60, 90) for p, (start, end) in WINDOWS.items()
            for n in range(end, start) if n % 3 == 0}
    assert len(rows) == len(want) and {(r.author, r.week_idx, r.period, r.x) for r in rows} == want
    assert "Broadcast" not in physical(lagged)


def test_feature_table_does_not_broadcast_its_sample(spark):
    from emberline.plans.features import WINDOWS, pipe_feature_table
    from emberline.session import store

    sample = store(spark.createDataFrame(
        [("a", 60, True, 7), ("b", 61, False, 7)], "author string, week_idx long, activation boolean, duration long"), "sample")
    news = sample.select("author", "week_idx", *[(sample.week_idx + 0.5).alias(f"n_{p}") for p in WINDOWS])
    facts = store(spark.createDataFrame(
        [("a", 59, 3), ("a", 40, 6), ("a", 39, 4), ("b", 58, 2)], "author string, week_idx long, x long"), "facts")
    took = store(spark.createDataFrame(
        [("a", 59, "s"), ("a", 40, "t"), ("b", 58, "t")], "author string, week_idx long, subreddit string"), "participation")
    vocab = store(spark.createDataFrame([("s", 0), ("t", 1)], "subreddit string, community int"), "vocabulary")
    quart = store(spark.createDataFrame([("a", True)], "author string, old boolean"), "quartiles")
    table = pipe_feature_table(sample, news, facts, ["x"], took, vocab, quart, ["n"])
    assert physical(table).count("SortMergeJoin") >= 3  # news, and the lagged activity and participation
    got = {r.author: r for r in table.collect()}
    assert (got["a"].x_short, got["a"].x_medium, got["a"].x_long, got["a"].old) == (3.0, 0.0, 5.0, True)
    assert (got["b"].x_short, got["b"].x_medium, got["b"].x_long, got["b"].old) == (0.0, 2.0, 0.0, False)
    assert (got["a"].communities_short, got["a"].communities_long, got["b"].communities_medium) == ([0], [1], [1])


def test_rank_per_group_is_cut_before_the_exchange(spark):
    from emberline.operators.topk import topk_per_group

    df = spark.range(100).selectExpr("id % 3 g", "id v", "id t")
    assert "WindowGroupLimit" in physical(topk_per_group(df, "g", "v", 5, "t"))


def test_weekly_activity_copies_no_post(spark):
    """Distinct threads and communities are counted by grouping twice, not by expanding every post."""
    from emberline.operators.aggregates import weekly_activity

    df = spark.range(10).selectExpr(
        "'a' author", "id week_idx", "'RC' kind", "date'2020-01-01' day", "'p' parent_id", "'s' subreddit")
    assert "Expand" not in physical(weekly_activity(df))


@pytest.fixture
def no_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_comments_of_an_order_are_deduplicated_where_they_were_joined(spark, no_broadcast):
    from emberline.catalog.plans import long_comments

    plan = physical(long_comments(spark, f"{DATA}/sf0.001"))
    assert plan.count("Exchange hashpartitioning") == 4  # two joins


def test_weekly_activity_shuffles_once(spark):
    from emberline.operators.aggregates import weekly_activity

    df = spark.createDataFrame([("a", 1, "RC", "p", "s", dt.date(2024, 1, 1))],
                               "author string, week_idx long, kind string, parent_id string, subreddit string, day date")
    assert physical(weekly_activity(df)).count("Exchange hashpartitioning") == 1


def test_weeks_are_filtered_before_they_are_shuffled(spark, no_broadcast):
    from emberline.plans.person_period import pipe_person_period

    day = dt.date(2024, 1, 1)
    posts = spark.createDataFrame([("a", 2818, "RC", "p", "s", day)],
                                  "author string, week_idx long, kind string, parent_id string, subreddit string, day date")
    authors = spark.createDataFrame([("a", day, dt.date(2100, 1, 1), False)],
                                    "author string, date_weak date, date_strong date, active boolean")
    table = pipe_person_period(posts, authors)
    lines = physical(table).splitlines()
    made = next(i for i, x in enumerate(lines) if "Generate explode" in x and "sequence" in x)
    above = [x for x in lines[:made] if "Exchange" in x or "array_contains" in x]
    assert "array_contains" in above[-1] and table.count() == 1


def test_sinks_write_one_stored_table(spark, monkeypatch):
    from emberline.catalog import QUERIES
    from emberline.sources import sinks

    seen, write = [], sinks.sink_table
    monkeypatch.setattr(sinks, "sink_table", lambda df, *a, **k: (seen.append(df.inputFiles()), write(df, *a, **k)))
    QUERIES["sink_table"](spark, f"{DATA}/sf0.001")
    assert len(seen) == 5 and not any("lineitem" in f for files in seen for f in files)


def test_sparse_components_read_the_comments_once_for_the_posts(spark, monkeypatch):
    from emberline.catalog import QUERIES
    from emberline.operators import sparse

    seen = []
    none = spark.createDataFrame([], "place int, coef double")
    monkeypatch.setattr(sparse, "pca_logistic_sparse", lambda df, *_: seen.append(df) or none)
    QUERIES["pca_logistic_sparse"](spark, f"{DATA}/sf0.001")
    # once for the first days, and not for the stored posts
    assert physical(seen[0]).count("/lineitem.parquet") == 1
