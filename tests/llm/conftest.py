from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators use inside.
CLASH = ", component int, digest string, rep long, _spans int, _score string, rows int, label2 int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents out of (doc_id, text[, lang]) with clashing extra columns, over several partitions."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, 1, "x", 2, 3, "y", 4, 5) for r in rows]
        return spark.createDataFrame(full, DOCS + CLASH).repartition(parts)

    return make

