"""Group statistics with one key holding a third of the rows, on the sort-merge path with AQE skew
splitting (broadcast disabled), must equal a brute-force count."""
from collections import Counter

from logweave import run_features


def test_hot_key_group_join(spark):
    keys = ["hot" if i % 3 == 0 else (None if i % 7 == 0 else f"k{i % 50}") for i in range(30000)]
    df = spark.createDataFrame([(i, k, i % 11) for i, k in enumerate(keys)], "rid long, k string, v long")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = run_features(df, [
            {"step_type": "group_frequency", "input_selector": {"mode": "explicit", "columns": ["k"]}},
            {"step_type": "group_unique_count", "input_selector": {"mode": "explicit", "columns": ["k"]},
             "params": {"target_column": "v"}}], rid="rid")
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    counts = Counter(keys)
    distinct = {}
    for i, k in enumerate(keys):
        distinct.setdefault(k, set()).add(i % 11)
    assert len(rows) == 30000
    for r in rows:
        assert r["k_group_count"] == counts[r["k"]]
        assert r["k_v_unique_count"] == len(distinct[r["k"]])
