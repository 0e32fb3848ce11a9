"""Streams fed in several batches must agree with the batch operators."""

import datetime as dt
import random

from pyspark.sql import functions as F

from emberline.operators.aggregates import first_activation
from emberline.streaming import jobs

SCHEMA = "author string, subreddit string, ts timestamp, day date, created_utc long, id string, kind string"


def _posts(n, start, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = start + dt.timedelta(minutes=rng.randint(0, 20 * 24 * 60))
        rows.append((f"u{rng.randint(0, 9)}", "s", t, t.date(), int(t.timestamp()), f"{seed}-{i}", rng.choice(["RC", "RS"])))
    return rows


def _feed(spark, tmp_path, batches):
    """One file per batch, processed by one trigger each."""
    schema = spark.createDataFrame([], SCHEMA).schema
    src = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        yield jobs.post_stream(spark, src, schema)


def test_first_activation_over_batches(spark, tmp_path):
    a, b = _posts(60, dt.datetime(2024, 3, 1), 1), _posts(60, dt.datetime(2024, 2, 20), 2)
    for stream in _feed(spark, tmp_path, [a, b]):
        got = jobs.run_to_table(jobs.stream_first_activation(stream), str(tmp_path / "out"), str(tmp_path / "ck"), "update")
    want = first_activation(spark.createDataFrame(a + b, SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_snapshots_bound_what_a_read_costs(spark, tmp_path):
    batches = [_posts(30, dt.datetime(2024, 3, 20 - 2 * i), i) for i in range(7)]
    for stream in _feed(spark, tmp_path, batches):
        got = jobs.run_to_table(jobs.stream_first_activation(stream), str(tmp_path / "out"), str(tmp_path / "ck"), "update", every=3)
    want = first_activation(spark.createDataFrame([p for b in batches for p in b], SCHEMA))
    want = sorted(map(tuple, want.select(*got.columns).collect()))
    assert sorted(map(tuple, got.collect())) == want
    assert {f.split("/out/")[1].rsplit("/", 1)[0] for f in got.inputFiles() if "/snapshots/" in f} == {"snapshots/upto=5"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "(batch" in plan.split("PartitionFilters")[2] and "> 5)" in plan.split("PartitionFilters")[2][:120]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    out, schema = str(tmp_path / "out"), "author string, day int"
    batches = [spark.createDataFrame(rows, schema) for rows in ([("a", 9), ("b", 9)], [("a", 7)], [("c", 5)], [("b", 3)])]
    jobs.open_table(spark, out, batches[0].schema)
    for i in (0, 1, 1, 2, 3, 3):  # every second one ends in a snapshot
        jobs.save_batch(batches[i], i, out, "author", every=2)
    jobs.open_table(spark, out, batches[0].schema)
    got = jobs.updated_table(spark, out, batches[0].schema, "author")
    assert sorted(map(tuple, got.collect())) == [("a", 7), ("b", 3), ("c", 5)]
    # a snapshot without its mark is not read
    spark.createDataFrame([("x", 1)], schema).write.parquet(f"{out}/snapshots/upto=9")
    assert jobs.updated_table(spark, out, batches[0].schema, "author").count() == 3


def test_ingest_drops_copies_across_batches(spark, tmp_path):
    a = _posts(50, dt.datetime(2024, 3, 1), 3)
    for stream in _feed(spark, tmp_path, [a, a[:20] + _posts(10, dt.datetime(2024, 3, 5), 4)]):
        jobs.stream_month_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    ids = [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(ids) == len(set(ids)) == 60


def test_ingest_derives_columns_and_packs_what_it_keeps(spark, tmp_path):
    a, b = _posts(50, dt.datetime(2024, 3, 1), 5), _posts(10, dt.datetime(2024, 3, 5), 6)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    was = spark.conf.get(jobs.STATE_CODEC)
    for stream in _feed(spark, tmp_path, [a, a[:20] + b]):
        jobs.stream_month_ingest(stream, out, ck, partition="month", derived={"month": F.date_format("day", "yyyy-MM")})
    rows = spark.read.schema(SCHEMA + ", month string").parquet(out)
    want = [(*p, p[3].strftime("%Y-%m")) for p in a + b]
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    assert all(f.endswith(".zstd.parquet") for f in rows.inputFiles())
    assert f'"{jobs.STATE_CODEC}":"zstd"' in (tmp_path / "ck" / "offsets" / "0").read_text()
    assert spark.conf.get(jobs.STATE_CODEC) == was


def test_ingest_goes_on_from_a_checkpoint_of_another_codec(spark, tmp_path):
    a, b = _posts(50, dt.datetime(2024, 3, 1), 7), _posts(10, dt.datetime(2024, 3, 5), 8)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    streams = _feed(spark, tmp_path, [a, a[:20] + b])
    old = next(streams).withWatermark("ts", "31 days").dropDuplicatesWithinWatermark(["id"])
    old.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(
        availableNow=True).start().awaitTermination()
    jobs.stream_month_ingest(next(streams), out, ck)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == sorted(p[5] for p in a + b)


def test_late_posts_are_dropped_from_closed_weeks(spark, tmp_path):
    early, late = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 30)
    post = lambda a, t, i: (a, "s", t, t.date(), 0, i, "RC")
    batches = [[post("a", early, "1"), post("a", late, "2")], [post("a", early, "3"), post("b", late, "4")]]
    for stream in _feed(spark, tmp_path, batches):
        got = jobs.run_to_table(jobs.stream_weekly_counts(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    rows = [tuple(r) for r in got.collect()]
    assert rows == [("a", dt.date(2024, 1, 1), 1, 0)]


def test_weekly_windows_start_on_monday(spark):
    w = spark.createDataFrame([(dt.datetime(2024, 1, 7, 23, 59),)], "ts timestamp").select(
        F.window("ts", "7 days", "7 days", "4 days").start.cast("date")).first()[0]
    assert w == dt.date(2024, 1, 1)
