"""Every operator as a query on the driver's tables, with an independent SQL statement."""

from emberline.catalog import (  # noqa: F401  (importing registers the queries)
    aggregates,
    evaluation,
    filters,
    joins,
    models,
    plans,
    scalars,
    scans,
    streams,
    windows,
)
from emberline.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
