"""Registered queries against DuckDB at the smallest scale."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# one or two per family; tests/compare.py runs all of them
PICKS = [
    "a7_deaccumulate", "a10_fragment_catalogue", "a13_upsert", "b2_detection_filter", "b10_label_filter",
    "b18_season_region", "c1_point_in_polygon", "c10_fragment_routing", "c24_nearest_event",
    "c25_events_within", "d9_dataset_statistics", "d21_region_month_series", "d26_numeric_psi",
    "e2_mean_std", "e11_event_history", "f6_near_event_negatives", "f12_weighted_sample",
    "g2_gradient_statistics", "g7_coast_distance", "h3_categorical_block", "m5_pr_curve_sampled",
    "m6_reliability_equal_count", "m9_risk_concentration", "m24_prior_offsets", "m27_quantile_map",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert len(entry.entry(spark).columns) == 5


@pytest.mark.parametrize("name", PICKS)
def test_query_matches_sql(spark, con, name):
    entry.queries()
    from cindergrid.catalog.base import ENTRIES

    status, message, _, _ = compare(spark, con, ENTRIES[name], SF)
    assert status == "ok", message
