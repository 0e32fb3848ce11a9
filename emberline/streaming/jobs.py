"""Structured Streaming forms of ingest, weekly counts and first activation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Setting: codec of the state's files; a checkpoint keeps the one it began with.
STATE_CODEC = "spark.sql.streaming.stateStore.compression.codec"


def post_stream(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*") -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def stream_month_ingest(posts: DataFrame, out: str, checkpoint: str, key: str = "id",
                        time: str = "ts", watermark: str = "31 days",
                        partition: str | None = None, derived: Mapping[str, Column] | None = None) -> None:
    """Append new posts once per id; a copy that arrives within the watermark is dropped.

    Runs until the files present are done, then stops; the checkpoint makes the next run
    go on from there, also after a failure.  Columns ``derived`` from others are added behind the
    shuffle of the posts; state and output are kept small by zstd.
    """
    unique = posts.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])
    if derived:
        unique = unique.withColumns(dict(derived))
    writer = unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).option(
        "compression", "zstd")
    if partition:
        writer = writer.partitionBy(partition)
    conf = posts.sparkSession.conf
    was = conf.get(STATE_CODEC, None)
    conf.set(STATE_CODEC, "zstd")  # a stream takes the settings of its start
    try:
        running = writer.trigger(availableNow=True).outputMode("append").start()
    finally:
        conf.set(STATE_CODEC, was) if was else conf.unset(STATE_CODEC)
    running.awaitTermination()


def stream_weekly_counts(posts: DataFrame, time: str = "ts", watermark: str = "2 days") -> DataFrame:
    """Posts per author in Monday-based weeks; a week is final once the watermark passes it."""
    week = F.window(time, "7 days", "7 days", "4 days")
    counts = posts.withWatermark(time, watermark).groupBy("author", week.alias("w")).agg(
        F.count_if(F.col("kind") == "RC").alias("n_comments_author_week"),
        F.count_if(F.col("kind") == "RS").alias("n_submissions_author_week"),
    )
    return counts.select(
        "author", F.to_date("w.start").alias("monday"), "n_comments_author_week", "n_submissions_author_week"
    )


def stream_first_activation(posts: DataFrame) -> DataFrame:
    """First post per author so far, for update or complete mode.

    State is one row per author and never expires, as a first activation never does.
    """
    return posts.groupBy("author").agg(F.min(F.struct("created_utc", "id", "subreddit", "day")).alias("b")).select(
        "author", "b.subreddit", "b.day"
    )


#: Batches between two snapshots of an updated table.
SNAPSHOT_EVERY = 16


def _versions(spark: SparkSession, out: str, schema: T.StructType, upto: int | None = None) -> DataFrame:
    """Rows of the last snapshot (not after ``upto``) and of the batches since, with their ``batch``.

    A snapshot counts once its mark is written, so a half-written one is never read.
    """
    marks = spark.read.schema("one long, upto long").parquet(f"{out}/marks")
    if upto is not None:
        marks = marks.filter(F.col("upto") < upto)
    last = marks.agg(F.max("upto")).first()[0]
    batches = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(
        f"{out}/batches").filter(F.col("batch") > last)
    if upto is not None:
        batches = batches.filter(F.col("batch") <= upto)
    if last < 0:
        return batches
    snapshot = spark.read.schema(schema).parquet(f"{out}/snapshots/upto={last}")
    return snapshot.withColumn("batch", F.lit(last).cast("long")).unionByName(batches)


def updated_table(spark: SparkSession, out: str, schema: T.StructType, key: str, upto: int | None = None) -> DataFrame:
    """The table as it stands: of each key the row of the last batch that touched it."""
    rest = [f.name for f in schema.fields if f.name != key]
    last = _versions(spark, out, schema, upto).groupBy(key).agg(F.max(F.struct("batch", *rest)).alias("_l"))
    return last.select(*[F.col(c) if c == key else F.col(f"_l.{c}").alias(c) for c in schema.fieldNames()])


def _mark(spark: SparkSession, out: str, upto: int) -> None:
    spark.range(1).select(F.col("id").alias("one")).write.mode("overwrite").parquet(f"{out}/marks/upto={upto}")


def open_table(spark: SparkSession, out: str, schema: T.StructType) -> None:
    """Lays down the folders of an updated table; does no harm to one that is there."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/batches/batch=-1")
    _mark(spark, out, -1)


def save_batch(batch: DataFrame, batch_id: int, out: str, key: str, every: int = SNAPSHOT_EVERY) -> None:
    """Writes a batch under its number, and a snapshot after each ``every`` batches.

    Batch, snapshot and mark are named by the number: a batch that comes again replaces itself and
    its snapshot by equal ones.
    """
    batch.write.mode("overwrite").parquet(f"{out}/batches/batch={batch_id}")
    if (batch_id + 1) % every == 0:
        spark, schema = batch.sparkSession, batch.schema
        updated_table(spark, out, schema, key, batch_id).write.mode("overwrite").parquet(f"{out}/snapshots/upto={batch_id}")
        _mark(spark, out, batch_id)


def run_to_table(df: DataFrame, out: str, checkpoint: str, mode: str = "append",
                 key: str = "author", every: int = SNAPSHOT_EVERY) -> DataFrame:
    """Process what is there and return the table as it stands.

    Append results go to Parquet files.  Update results are written per batch and merged into a
    snapshot every few batches; a read costs the last snapshot and the batches since.
    """
    spark = df.sparkSession
    schema = df.schema
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(schema).parquet(out)
    open_table(spark, out, schema)
    writer.outputMode("update").foreachBatch(
        lambda batch, batch_id: save_batch(batch, batch_id, out, key, every)).start().awaitTermination()
    return updated_table(spark, out, schema, key)
