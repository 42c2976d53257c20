"""Every query that has SQL agrees with it; plans have no single-task or pairwise steps."""

import os

import pytest
from oracle import compare, connect, fetch

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
# small fitted parts are covered elsewhere, in test_clusters and test_control
PLANNED = sorted(set(SQL) - {"dbscan_clusters"} - {n for n in SQL if n.startswith("stream_")})


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toArrow()
    assert compare(got, fetch(duck, SQL[name])) == ""


@pytest.mark.parametrize("name", ["detect_cycles", "rolling_rows", "instability_score", "detect_fluctuations", "observer_risk", "asof_grid_join", "run_counter", "islands", "power_stats", "state_snapshot", "phase_transitions"])
def test_no_row_window_by_series_alone(spark, name):
    """Windows over readings are partitioned by series and slice, never by the series alone."""
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    for bad in ("CartesianProduct", "Join Cross", "Join Inner\n"):
        assert bad not in plan
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in physical
    assert "BroadcastNestedLoopJoin" not in physical and "CartesianProduct" not in physical


def test_filters_reach_the_scan(spark):
    df = entry.queries()["scan_entity_range"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type)" in plan and "EqualTo(event_type,click)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:3] == ["entity_id", "start", "end"]
