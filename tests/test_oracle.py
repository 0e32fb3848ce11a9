"""Every query with SQL must equal DuckDB on the whole tables; the others must give rows."""

import os

import pytest
from oracle import DATA, compare, connect

from emberline.catalog import ORACLES, QUERIES

SF = os.environ.get("EMBERLINE_TEST_SF", "0.001")
# too few documents at this size for the 46 rows of the long news window
EMPTY_AT_SMALL_SF = {
    "pipe_feature_table", "pipe_feature_table_balanced", "pipe_period_robustness",
    "pipe_period_robustness_short", "pipe_design_matrix",
}


@pytest.fixture(scope="module")
def duck():
    return {sf: connect(sf) for sf in {SF, "0.01"}}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    sf = "0.01" if name in EMPTY_AT_SMALL_SF else SF
    assert compare(spark, duck[sf], QUERIES[name], ORACLES[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf{SF}").collect()
