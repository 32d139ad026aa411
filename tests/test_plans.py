"""Plan-shape checks: the properties the design relies on at scale."""
from logweave import run_features, run_preprocess


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numeric_filter_is_pushed_and_columns_pruned(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = run_preprocess(li, [{"step_type": "filter_rows", "input_selector": {"mode": "explicit",
                                                                              "columns": ["l_quantity"]},
                               "params": {"operator": "gt", "value": "40"}},
                              {"step_type": "select_columns", "params": {"columns": ["l_quantity"]}}],
                         rid="l_orderkey")
    plan = _plan(out)
    assert "GreaterThan(l_quantity,40.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_group_statistics_aggregate_then_join(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    steps = [{"step_type": "group_frequency", "input_selector": {"mode": "explicit", "columns": ["user_id"]}},
             {"step_type": "time_window_count", "input_selector": {"mode": "explicit", "columns": ["user_id"]},
              "params": {"time_column": "ts", "window_minutes": 60}},
             {"step_type": "window_spike_flag", "input_selector": {"mode": "explicit", "columns": ["user_id"]},
              "params": {"time_column": "ts", "window_minutes": 60, "threshold": 2}}]
    plan = _plan(run_features(ev, steps, rid="event_id"))
    assert "Window" not in plan                      # no per-key window over all rows
    assert "partial_count" in plan                   # map-side combine
    assert plan.count("HashAggregate") <= 4          # window count + spike fused: two aggregates (x2 phases)
