"""Every registered query against its SQL. By default a fixed selection runs; TIDEMARK_ALL=1 runs all of them."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SELECTION = """scan_histories features adj_factor outcome_sessions_5 asof_reference asof_join_bucketed asof_bitemporal calendar_target_join next_session_join quarter_over_quarter investability research_eligible
stage_monotone append_if_absent freeze_once downsample_minmax chrono_sort alert_budget reliability_bins cluster_bootstrap dataset_summary walk_forward_folds apply_split outcome_calendar_days event_features persistence_check
announcement_cadence weekly_candidates daily_movers correlation_matrix score_portfolios ttm_as_of financing_evidence macro_regime dedupe_companies research_league assess_company build_observations capture_outcomes
reconstruct merger_terms parse_forms_xml stream_append stream_case_stage""".split()
SQL = entry.oracle_sql()
NAMES = sorted(SQL) if os.environ.get("TIDEMARK_ALL") else SELECTION


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, SQL[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())
