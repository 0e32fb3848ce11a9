"""Reshaping and column selection."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rename_by_map(df: DataFrame, names: Mapping[str, str] | None = None, *, prefix: str = "",
                  suffix: str = "", keep: Sequence[str] = ()) -> DataFrame:
    """Rename by a mapping, or add a prefix and suffix to all columns but ``keep``."""
    names = dict(names or {})
    if prefix or suffix:
        names.update({c: f"{prefix}{c}{suffix}" for c in df.columns if c not in keep})
    return df.withColumnsRenamed(names)


def ensure_columns(df: DataFrame, columns: Sequence[str], value=False) -> DataFrame:
    """Add the absent columns, filled with one value."""
    present = set(df.columns)
    return df.withColumns({c: F.lit(value) for c in columns if c not in present})


def select_by_name(df: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose whole name matches a regular expression, after the kept ones."""
    rx = re.compile(pattern)
    chosen = [c for c in df.columns if c not in keep and rx.fullmatch(c)]
    return df.select(*keep, *chosen)


def unpivot_features(df: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None,
                     name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long."""
    columns = list(columns or [c for c in df.columns if c not in ids])
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(ids), columns, name, value)


def pivot_results(df: DataFrame, row: str | Sequence[str], column: str, value: str,
                  columns: Sequence[str]) -> DataFrame:
    """Long to wide for a stated list of columns, so no job is needed to find them."""
    rows = [row] if isinstance(row, str) else list(row)
    return df.groupBy(*rows).pivot(column, list(columns)).agg(F.max(value))
