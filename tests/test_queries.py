"""Registered queries against their SQL on the smallest tables; check.py does the same for all of them."""

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
FAST = [
    "dedupe_trades", "merge_sources", "active_ffill", "active_ffill_limit", "strict_panel", "supervised_rows_active", "family_state",
    "asof_backward_by", "pair_self_join", "normalize_markets", "explode_trades", "classify_market", "classify_domain_family",
    "window_violations", "quality_gates", "missingness_decomposition", "overlap_stats", "chronological_folds", "result_slices",
    "bootstrap_cluster", "placebo_shuffle_within_ts", "threshold_graph_features", "neighborhood_topology", "diagram_stats",
    "persistence_image", "fit_impute_scale",
]


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, name):
    status, note = check.compare(spark, con, name, queries()[name], oracle_sql()[name], SF)
    assert status == "ok", note


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
