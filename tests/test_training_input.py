"""Choice of training columns by source, and training runs that are repeated on a new version."""
import pytest

from logweave.ml import runs
from logweave.plans.chain import run_features
from logweave.plans.training_input import choice_frame, choose_training_columns


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, f"host{k % 3}", float(k % 11), f"message {k}", "attack" if k % 4 == 0 else "ok") for k in range(200)]
    return spark.createDataFrame(rows, "rid long, hostname string, amount double, message string, label string")


def test_sources(table):
    every = choose_training_columns(table, target="label", rid="rid")
    assert every["selection_source"] == "dataset_safe_defaults"
    assert every["used_feature_columns"] == ["hostname", "amount"]
    assert every["exclusion_reasons"] == {"message": "raw_text_column", "label": "target_column"}
    asked = choose_training_columns(table, ["amount", "nowhere", "amount"], target="label", rid="rid")
    assert (asked["selection_source"], asked["requested_feature_columns"]) == ("explicit_request", ["amount"])
    step = choose_training_columns(table, target="label", rid="rid", preprocess_columns=["hostname", "gone"])
    assert (step["selection_source"], step["used_feature_columns"]) == ("preprocess_pipeline_defaults", ["hostname"])


def test_candidates_of_a_feature_pipeline(table):
    out = run_features(table, [{"step_type": "text_length", "input_selector": {"mode": "explicit", "columns": ["message"]}}], rid="rid")
    made = [c for c in out.columns if c not in table.columns]
    choice = choose_training_columns(out, target="label", rid="rid", feature_pipeline={}, dataset_columns=table.columns)
    assert choice["selection_source"] == "feature_pipeline_candidates" and choice["used_feature_columns"] == made
    assert choice["exclusion_reasons"] == dict.fromkeys(["hostname", "amount", "message", "label"], "not_in_training_candidates")
    stored = {"training_candidate_columns": ["amount", "gone"], "business_context_columns": ["hostname"],
              "feature_lineage": {"amount": {"step_type": "numeric_scale"}, "gone": {}, "hostname": None}}
    choice = choose_training_columns(out, target="label", rid="rid", feature_pipeline=stored)
    assert choice["used_feature_columns"] == ["amount"] and choice["business_context_columns"] == ["hostname"]
    assert choice["feature_lineage"] == {"amount": {"step_type": "numeric_scale", "used_for_training": True}}
    rows = choice_frame(out, choice).collect()
    assert [r.column for r in rows if r.used] == ["amount"] and {r.source for r in rows} == {"feature_pipeline_candidates"}


def test_no_candidates_is_not_all_columns(table):
    choice = choose_training_columns(table, target="label", rid="rid", feature_pipeline={}, dataset_columns=table.columns)
    assert choice["used_feature_columns"] == [] and len(choice["exclusion_reasons"]) == 4
    with pytest.raises(ValueError, match="No usable training columns"):
        runs.train_run(table, {"algorithm": "svm", "target": "label", "rid": "rid", "selection": {
            "feature_pipeline": {}, "dataset_columns": table.columns}}, "/nowhere")


def test_retrain_keeps_the_first_run(spark, table, tmp_path):
    config = {"algorithm": "logistic_regression", "target": "label", "rid": "rid", "context_columns": ["message"]}
    first = runs.train_run(table, config, str(tmp_path))
    before = sorted(map(tuple, spark.read.parquet(f"{first}/predictions").collect()), key=str)
    newer = table.selectExpr("*", "amount + rid AS extra").union(table.selectExpr(
        "rid + 1000", "hostname", "amount", "message", "label", "amount + rid"))
    second = runs.retrain(newer, first, str(tmp_path))
    assert first != second
    assert sorted(map(tuple, spark.read.parquet(f"{first}/predictions").collect()), key=str) == before
    one, two = runs.read_run(spark, first), runs.read_run(spark, second)
    assert one["config"] == two["config"] == config
    assert two["choice"]["used_feature_columns"] == [*one["choice"]["used_feature_columns"], "extra"]
    assert spark.read.parquet(f"{second}/metrics").selectExpr("train_rows + test_rows AS n").first().n == 400
    assert spark.read.parquet(f"{second}/predictions").columns[0] == "message"
