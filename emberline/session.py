"""Session settings and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are designed for.  No operator hints a broadcast: Spark compares the
# size of a side with its broadcast threshold, statically and again at run time (AQE).
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot author or thread is split even when the split costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "emberline", cpus: int | str | None = None, **extra: str) -> SparkSession:
    """Session with the recommended settings; ``cpus`` selects a local master."""
    builder = SparkSession.builder.appName(app)
    if cpus is not None:
        builder = builder.master(f"local[{cpus}]")
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended run-time settings to a session somebody else built."""
    for key, value in RECOMMENDED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="emberline-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared folder (``spark.checkpoint.dir``)."""
    return os.path.join(_root(spark), "emberline", f"{label}-{uuid.uuid4().hex}")


def store(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write once to the shared folder and read back.

    Use it for a table that several jobs read: its size is then known to the planner,
    which is what lets Spark choose a broadcast join for small tables on its own.
    """
    path = shared_dir(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
