"""The post archive: one JSON object per line, one file or folder per kind and month."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.text import parse_json
from emberline.schemas import COMMENT, KIND_FOLDER, POST_COLUMNS, SUBMISSION

_CORRUPT = "_corrupt_record"


def month_paths(root: str, kind: str, months: Iterable[str]) -> list[str]:
    """``<root>/<folder>/<year>/<kind>_<YYYY-MM>*`` for each ``YYYY-MM``."""
    return [f"{root}/{KIND_FOLDER[kind]}/{m[:4]}/{kind}_{m}*" for m in months]


def _schema(kind: str) -> T.StructType:
    return COMMENT if kind == "RC" else SUBMISSION


def as_posts(df: DataFrame, kind: str) -> DataFrame:
    """The nine post fields plus ``kind``; a submission's text becomes the body."""
    if "selftext" in df.columns:
        df = df.withColumnRenamed("selftext", "body")
    fields = {f.name: f.dataType for f in COMMENT.fields}
    present = set(df.columns)
    return df.select(
        *[F.col(c) if c in present else F.lit(None).cast(fields[c]).alias(c) for c in POST_COLUMNS],
        F.lit(kind).alias("kind"),
    )


def scan_posts(spark: SparkSession, root: str, kind: str, months: Iterable[str],
               keep_corrupt: bool = False) -> DataFrame:
    """Posts of one kind for some months, as one splittable scan.

    A malformed line becomes a row of nulls, as a missing field becomes a null; unknown
    fields are ignored.  ``keep_corrupt`` adds the offending text as ``_corrupt_record``.
    """
    schema = _schema(kind)
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .json(month_paths(root, kind, months))
    )
    posts = as_posts(raw, kind)
    if keep_corrupt:
        return raw.select(
            *[c for c in posts.columns if c in raw.columns], _CORRUPT
        ).withColumn("kind", F.lit(kind))
    return posts


def posts_from_text(lines: DataFrame, kind: str, column: str = "value") -> DataFrame:
    """Same as :func:`scan_posts` for JSON lines that already sit in a text column."""
    parsed = lines.select(parse_json(F.col(column), _schema(kind)).alias("p")).select("p.*")
    return as_posts(parsed, kind)


def scan_history(spark: SparkSession, root: str, months: Iterable[str] | None = None,
                 kind: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """History table partitioned by kind and month; a month without files gives no rows.

    The explicit schema makes an empty month an empty frame instead of an error, and the
    filters on the partition columns prune folders before any file is opened.
    """
    if schema is None:
        schema = T.StructType([
            *COMMENT.fields,
            T.StructField("kind", T.StringType()),
            T.StructField("month", T.StringType()),
        ])
    df = spark.read.schema(schema).option("mergeSchema", "false").parquet(root)
    if kind is not None:
        df = df.filter(F.col("kind") == kind)
    if months is not None:
        df = df.filter(F.col("month").isin(list(months)))
    return df
