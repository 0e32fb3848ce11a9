"""Writers, and the load that skips months already present."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_WRITERS = {
    "parquet": ("parquet", {"compression": "zstd"}),
    "parquet_gzip": ("parquet", {"compression": "gzip"}),
    "json": ("json", {"compression": "bzip2"}),
    "csv": ("csv", {"compression": "gzip", "header": "true"}),
    "tsv": ("csv", {"sep": "\t", "header": "true"}),
}
FORMATS = list(_WRITERS)


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
               mode: str = "errorifexists") -> None:
    """Write a table; csv and json are for exchange, Parquet for tables read again."""
    source, options = _WRITERS[fmt]
    writer = df.write.format(source).options(**options).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_table(spark, path: str, fmt: str, schema) -> DataFrame:
    source, options = _WRITERS[fmt]
    keep = {k: v for k, v in options.items() if k != "compression"}
    return spark.read.format(source).options(**keep).schema(schema).load(path)


def spread(df: DataFrame, partition: str, files: int = 8) -> DataFrame:
    """Rows of a partition value go to ``files`` tasks, so that no task writes a whole month."""
    columns = [c for c in df.columns if c != partition]
    return df.repartition(partition, F.pmod(F.xxhash64(*columns), F.lit(files)))


def incremental_month_load(df: DataFrame, path: str, partition: str = "month",
                           overwrite: Sequence[str] = ()) -> None:
    """Append only the partitions that the table at ``path`` does not hold yet.

    Partitions named in ``overwrite`` are written again.  The present partitions come from
    a scan of the partition column alone, which reads no column data, and are few, one per
    month.
    """
    spark = df.sparkSession
    try:
        listed = spark.read.parquet(path).select(F.col(partition).cast("string"))
        present = {r[0] for r in listed.distinct().collect()}
    except AnalysisException as e:
        # only a table that is not there yet; anything else must not lead to an overwrite
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        present = set()
    missing = df.filter(~F.col(partition).isin(sorted(present - set(overwrite)))) if present else df
    (
        spread(missing, partition).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
