"""The driver contract, and a cross-section of the queries against DuckDB."""

import os

import pytest
from check import compare, connect
from conftest import SMALL

import __spark_entry__ as entry_points

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()
# One or two queries per area; EVENKEEL_FULL=1 compares all of them.
SAMPLE = (
    "balanced_region_scores", "write_read_roundtrip", "feature_sets", "contract_violations", "layered_assign",
    "cf_tables", "rule_from_effect", "shuffle_split_wide", "counterbalance_up", "residualize_cont",
    "ordinal_encode_large", "roc_auc", "glm_two_predictor", "fit_ridge", "score_wide", "unpack_name",
    "spearman_matrix", "cond_density", "stream_d2", "stream_assign",
)
CHOSEN = sorted(SQL) if os.environ.get("EVENKEEL_FULL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_contract_is_consistent(spark):
    assert set(SQL) <= set(QUERIES)
    assert entry_points.entry(spark).count() == 5


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    status, _, _, note = compare(spark, con, name, QUERIES[name], SQL[name], SMALL)
    assert status == "OK", note
