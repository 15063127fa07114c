import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
import check_oracle  # noqa: E402

SF = "/root/testdata/sf0.001"
# One query per area; the whole registry runs through tools/check_oracle.py.
SAMPLE = [
    "q_commission_metrics", "q_required_not_null", "q_removal_funnel", "q_quantiles", "q_summary_compare",
    "q_winsorized_ratios", "q_capped_bins", "q_trip_labels", "q_join_calendar", "q_weather_clean_f", "q_station_to_day",
    "q_uplift_by_band", "q_circular_mean", "q_ecdf", "q_rectangle_overlap", "q_points_in_polygons",
    "q_write_read_partitioned", "q_month_mart", "q_eval_metrics",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check_oracle.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["pickup_hour", "is_weekend", "mean", "sd", "n", "se", "lo", "hi"]
    assert 24 < df.count() <= 48


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 110


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, con, name):
    result = check_oracle.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", ["q_trip_labels", "q_join_weather", "q_uplift"])
def test_trip_queries_neither_cross_join_nor_collect(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
