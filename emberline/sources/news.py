"""News files: tab-separated, no header, 27 columns, one file per quarter of an hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.time import date_from_path
from emberline.schemas import NEWS_COLUMNS, NEWS_POSITIONS, NEWS_WIDTH

_CORRUPT = "_corrupt_record"


def _news_schema() -> T.StructType:
    names = {pos: name for name, pos in NEWS_POSITIONS.items()}
    fields = [T.StructField(names.get(i, f"_f{i}"), T.StringType()) for i in range(NEWS_WIDTH)]
    return T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])


def _read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return (
        spark.read.schema(_news_schema())
        .option("sep", "\t")
        .option("encoding", "ISO-8859-1")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .csv(paths)
    )


def scan_news(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The six used columns of records that have themes."""
    return _read(spark, paths).select(*NEWS_COLUMNS).na.drop(subset=["V2Themes"])


def scan_news_audit(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Path of the file, the date field and whether each line has the expected width."""
    lines = spark.read.text(paths)
    fields = F.split("value", "\t")
    return lines.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.get(fields, F.lit(NEWS_POSITIONS["DATE"])).alias("DATE"),
        (F.size(fields) == NEWS_WIDTH).alias("ok"),
    )


def file_audit(audit: DataFrame, day: Column | None = None) -> DataFrame:
    """Good and bad records per file and its day; a file without a good record is unreadable.

    The day is in the file's name unless ``day`` finds it elsewhere in ``file_path``.
    """
    per_file = audit.groupBy("file_path").agg(
        F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))
    found = date_from_path(F.col("file_path")) if day is None else day
    return per_file.select("file_path", found.alias("day"), "good", "bad", (F.col("good") == 0).alias("unreadable"))


def news_volume(df: DataFrame, day: str = "day", first=None, last=None, records: str | None = None) -> DataFrame:
    """Records per calendar day, with a zero for days that have none.

    Counts rows, or adds up the column ``records`` of a table per file.  The spine is a sequence
    between two scalars: rows grow with days, not with records.
    """
    counted = df.groupBy(day).agg((F.sum(records) if records else F.count("*")).alias("n"))
    bounds = counted.agg(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi")).alias("b"))
    lo = F.lit(first).cast("date") if first is not None else F.col("b.lo")
    hi = F.lit(last).cast("date") if last is not None else F.col("b.hi")
    spine = bounds.select(F.explode(F.sequence(lo, hi)).alias(day))
    return spine.join(counted, day, "left").select(
        day, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")
    )


def bad_record_audit(df: DataFrame, day: str, ok: str = "ok") -> DataFrame:
    """Good and bad records per day."""
    return df.groupBy(day).agg(
        F.count_if(F.col(ok)).alias("good"), F.count_if(~F.col(ok)).alias("bad")
    )


def corrupted_inputs(files: DataFrame) -> DataFrame:
    """The files that hold at least one bad record."""
    return files.filter(F.col("bad") > 0)


def file_volume(df: DataFrame, month: str = "month", kind: str = "kind") -> DataFrame:
    """Rows per month and kind of post."""
    return df.groupBy(month, kind).agg(F.count("*").alias("n"))
