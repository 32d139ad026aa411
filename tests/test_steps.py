"""The reference's step tests, re-expressed on Spark DataFrames."""
import datetime as dt

import pytest

from logweave import run_features, run_preprocess
from logweave.operators.columns import StepError
from logweave.operators.preprocess import apply_field_mapping


def sel(*cols):
    return {"mode": "explicit", "columns": list(cols)}


def ordered(df, rid="rid"):
    return [r.asDict() for r in df.orderBy(rid).collect()]


def test_field_mapping_fill_and_trim(spark):
    df = spark.createDataFrame([(0, "2026-04-10 10:00:00", " Error "), (1, None, "Ok ")],
                               "rid long, timestamp string, message string")
    mapped = apply_field_mapping(df, {"event_time": "timestamp", "raw_message": "message"})
    out = ordered(run_preprocess(mapped, [
        {"step_type": "fill_null", "input_selector": sel("event_time"), "params": {"value": "1970-01-01 00:00:00"}},
        {"step_type": "trim_text", "input_selector": sel("raw_message"),
         "output_mode": {"mode": "new_column", "suffix": "_trimmed"}}], rid="rid"))
    assert out[1]["event_time"] == "1970-01-01 00:00:00"
    assert out[0]["raw_message_trimmed"] == "Error"
    assert out[0]["timestamp"] == "2026-04-10 10:00:00"  # mapping copies, original kept


def test_text_length_and_ip_flags(spark):
    df = spark.createDataFrame([(0, "error timeout", "10.0.0.1"), (1, "login ok", "8.8.8.8")],
                               "rid long, raw_message string, source_ip string")
    out = ordered(run_features(df, [
        {"step_type": "text_length", "input_selector": sel("raw_message"), "output_mode": {"suffix": "_length"}},
        {"step_type": "ip_features", "input_selector": sel("source_ip")}], rid="rid"))
    assert out[0]["raw_message_length"] == 13
    assert (out[0]["source_ip_is_private"], out[1]["source_ip_is_private"]) == (1, 0)
    assert out[0]["source_ip_ip_version"] == 4


def test_complexity_columns(spark):
    df = spark.createDataFrame([(0, "error timeout 500", "curl/8.0"), (1, "login ok", "Mozilla/5.0")],
                               "rid long, raw_message string, user_agent string")
    out = run_features(df, [
        {"step_type": "shannon_entropy", "input_selector": sel("raw_message"), "output_mode": {"suffix": "_entropy"}},
        {"step_type": "char_composition", "input_selector": sel("user_agent")},
        {"step_type": "pattern_flags", "input_selector": sel("raw_message"),
         "params": {"patterns": ["ip", "hash", "base64_like"]}}], rid="rid")
    for c in ("raw_message_entropy", "user_agent_digit_ratio", "user_agent_special_ratio", "raw_message_has_ip"):
        assert c in out.columns
    r = ordered(out)[0]
    assert r["raw_message_entropy"] > 0.0
    assert r["user_agent_digit_ratio"] == pytest.approx(2 / 8)
    assert r["user_agent_special_ratio"] == pytest.approx(2 / 8)


def test_selector_modes(spark):
    df = spark.createDataFrame(
        [(0, "error on 10.0.0.1", "abc123", dt.datetime(2026, 4, 10, 10, 0)),
         (1, "ok", "XYZ", dt.datetime(2026, 4, 10, 10, 5))],
        "rid long, raw_message string, payload_text string, event_time timestamp")
    out = run_features(df, [
        {"step_type": "token_count", "input_selector": {"mode": "dtype", "dtype": "string"},
         "output_mode": {"suffix": "_tokens"}},
        {"step_type": "pattern_flags", "input_selector": {"mode": "role_tag", "role_tag": "text"},
         "params": {"patterns": ["ip"]}},
        {"step_type": "derive_time_parts", "input_selector": {"mode": "name_pattern", "name_pattern": "^event_"}}],
        rid="rid")
    for c in ("raw_message_tokens", "payload_text_tokens", "raw_message_has_ip", "event_time_hour"):
        assert c in out.columns
    r = ordered(out)
    assert r[0]["raw_message_has_ip"] == 1 and r[1]["raw_message_has_ip"] == 0
    assert r[0]["event_time_hour"] == 10 and r[0]["event_time_dayofweek"] == 4


def test_combined_columns(spark):
    df = spark.createDataFrame(
        [(0, 100.0, 10.0, "10.0.0.1", "10.0.0.1", "GET", "/admin"),
         (1, 45.0, 5.0, "8.8.8.8", "1.1.1.1", "POST", "/health")],
        "rid long, bytes_sent double, request_duration double, source_ip string, dest_ip string, method string, "
        "path string")
    out = ordered(run_features(df, [
        {"step_type": "ratio_feature", "input_selector": sel("bytes_sent", "request_duration"),
         "output_mode": {"output_column": "bytes_per_second"}},
        {"step_type": "difference_feature", "input_selector": sel("bytes_sent", "request_duration"),
         "output_mode": {"suffix": "_delta"}},
        {"step_type": "concat_fields", "input_selector": sel("method", "path"), "params": {"separator": " "},
         "output_mode": {"output_column": "request_signature"}},
        {"step_type": "equality_flag", "input_selector": sel("source_ip", "dest_ip"),
         "output_mode": {"output_column": "same_ip_flag"}}], rid="rid"))
    assert out[0]["bytes_per_second"] == 10.0
    assert out[1]["bytes_sent_request_duration_delta"] == 40.0
    assert out[0]["request_signature"] == "GET /admin"
    assert (out[0]["same_ip_flag"], out[1]["same_ip_flag"]) == (1, 0)


def _t(h, m):
    return dt.datetime(2026, 4, 10, h, m)


def test_group_and_window_counts(spark):
    df = spark.createDataFrame(
        [(0, _t(10, 1), "10.0.0.1", "1.1.1.1"), (1, _t(10, 3), "10.0.0.1", "1.1.1.1"),
         (2, _t(10, 17), "10.0.0.1", "2.2.2.2"), (3, _t(10, 18), "8.8.8.8", "1.1.1.1")],
        "rid long, event_time timestamp, source_ip string, dest_ip string")
    out = ordered(run_features(df, [
        {"step_type": "group_frequency", "input_selector": sel("source_ip", "dest_ip"),
         "output_mode": {"output_column": "pair_count"}},
        {"step_type": "group_unique_count", "input_selector": sel("source_ip"), "params": {"target_column": "dest_ip"},
         "output_mode": {"output_column": "source_unique_dest_count"}},
        {"step_type": "time_window_count", "input_selector": sel("source_ip"),
         "params": {"time_column": "event_time", "window_minutes": 15},
         "output_mode": {"output_column": "source_15m_count"}}], rid="rid"))
    assert out[0]["pair_count"] == 2
    assert out[2]["source_unique_dest_count"] == 2
    assert (out[0]["source_15m_count"], out[2]["source_15m_count"]) == (2, 1)


def test_window_unique_and_spike(spark):
    df = spark.createDataFrame(
        [(0, _t(10, 1), "10.0.0.1", "1.1.1.1"), (1, _t(10, 2), "10.0.0.1", "2.2.2.2"),
         (2, _t(10, 4), "10.0.0.1", "2.2.2.2"), (3, _t(10, 16), "10.0.0.1", "3.3.3.3")],
        "rid long, event_time timestamp, source_ip string, dest_ip string")
    out = ordered(run_features(df, [
        {"step_type": "window_unique_count", "input_selector": sel("source_ip"),
         "params": {"time_column": "event_time", "target_column": "dest_ip", "window_minutes": 15},
         "output_mode": {"output_column": "u"}},
        {"step_type": "window_spike_flag", "input_selector": sel("source_ip"),
         "params": {"time_column": "event_time", "window_minutes": 15, "threshold": 3},
         "output_mode": {"output_column": "spike"}}], rid="rid"))
    assert (out[0]["u"], out[3]["u"]) == (2, 1)
    assert (out[0]["spike"], out[3]["spike"]) == (1, 0)


def test_behavior_tracking_sequence(spark):
    df = spark.createDataFrame(
        [(0, _t(10, 1), "req-1", "200", "/login"), (1, _t(10, 3), "req-1", "500", "/login"),
         (2, _t(10, 5), "req-1", "500", "/admin"), (3, _t(10, 16), "req-2", "200", "/health")],
        "rid long, event_time timestamp, request_id string, status_code string, path string")
    g = sel("request_id")
    out = ordered(run_features(df, [
        {"step_type": "group_duration", "input_selector": g, "params": {"time_column": "event_time"},
         "output_mode": {"output_column": "dur"}},
        {"step_type": "group_event_order", "input_selector": g, "params": {"time_column": "event_time"},
         "output_mode": {"output_column": "ord"}},
        {"step_type": "time_since_previous_event", "input_selector": g, "params": {"time_column": "event_time"},
         "output_mode": {"output_column": "prev"}},
        {"step_type": "group_value_change_flag", "input_selector": g,
         "params": {"time_column": "event_time", "target_column": "status_code"},
         "output_mode": {"output_column": "chg"}},
        {"step_type": "window_target_unique_count", "input_selector": g,
         "params": {"time_column": "event_time", "target_column": "path", "window_minutes": 15},
         "output_mode": {"output_column": "pu"}},
        {"step_type": "window_status_change_count", "input_selector": g,
         "params": {"time_column": "event_time", "target_column": "status_code", "window_minutes": 15},
         "output_mode": {"output_column": "wc"}}], rid="rid"))
    assert out[0]["dur"] == 240.0
    assert out[2]["ord"] == 3
    assert out[0]["prev"] is None and out[2]["prev"] == 120.0
    assert (out[0]["chg"], out[1]["chg"]) == (0, 1)
    assert out[2]["pu"] == 2
    assert out[2]["wc"] == 1


def test_errors_are_step_errors(spark):
    df = spark.createDataFrame([(0, "a")], "rid long, x string")
    with pytest.raises(StepError):
        run_features(df, [{"step_type": "no_such_step"}], rid="rid")
    with pytest.raises(StepError):
        run_features(df, [{"step_type": "ratio_feature", "input_selector": sel("x")}], rid="rid")
    with pytest.raises(StepError):
        run_features(df, [{"step_type": "regex_match_count", "input_selector": sel("x"),
                           "params": {"pattern": "("}}], rid="rid")
    # disabled steps are skipped
    out = run_features(df, [{"step_type": "no_such_step", "enabled": False}], rid="rid")
    assert out.columns == ["rid", "x"]


def test_lineage_and_column_classes(spark):
    from logweave.plans.lineage import classify_columns
    df = spark.createDataFrame([(0, "10.0.0.1", "GET /x", 5.0)], "rid long, source_ip string, msg string, v double")
    res = run_features(df, [{"step_type": "text_length", "input_selector": sel("msg")},
                            {"step_type": "group_frequency", "input_selector": sel("source_ip")}],
                       rid="rid", collect_lineage=True)
    assert set(res.lineage) == {"msg_length", "source_ip_group_count"}
    assert res.lineage["source_ip_group_count"]["recipe_id"] == "behavior_tracking_base"
    classes = classify_columns(res.frame, df.columns, res.lineage)
    assert classes["training_candidate_columns"] == ["msg_length", "source_ip_group_count"]
    assert "source_ip" in classes["business_context_columns"] and "msg" in classes["business_context_columns"]
    assert classes["feature_lineage"]["msg_length"]["used_for_training"] is True


def test_steps_on_join_derived_columns_seal_the_chain(spark):
    import pandas as pd
    data = [(i, f"u{i % 7}", float(i % 5), "a" if i % 3 else "b") for i in range(200)]
    df = spark.createDataFrame(data, "rid long, user string, v double, kind string")
    out = run_features(df, [
        {"step_type": "group_frequency", "input_selector": sel("user"), "output_mode": {"output_column": "n_user"}},
        {"step_type": "ratio_feature", "input_selector": sel("v", "n_user"), "output_mode": {"output_column": "r"}},
        {"step_type": "frequency_encode", "input_selector": sel("n_user")},           # reads a joined column
        {"step_type": "group_unique_count", "input_selector": sel("n_user"), "params": {"target_column": "kind"},
         "output_mode": {"output_column": "u"}},
        {"step_type": "numeric_scale", "input_selector": sel("r")},                  # dataset stat on a derived column
        {"step_type": "group_event_order", "input_selector": sel("n_user"), "params": {"time_column": "rid"},
         "output_mode": {"output_column": "o"}}], rid="rid")
    got = {r["rid"]: r.asDict() for r in out.collect()}
    pdf = pd.DataFrame(data, columns=["rid", "user", "v", "kind"])
    pdf["n_user"] = pdf.groupby("user")["user"].transform("size")
    pdf["r"] = pdf["v"] / pdf["n_user"]
    pdf["n_user_freq"] = pdf["n_user"].map(pdf["n_user"].value_counts())
    pdf["u"] = pdf.groupby("n_user")["kind"].transform("nunique")
    pdf["r_scaled"] = (pdf["r"] - pdf["r"].mean()) / pdf["r"].std()
    pdf["o"] = pdf.sort_values("rid").groupby("n_user").cumcount() + 1
    for _, w in pdf.iterrows():
        g = got[w["rid"]]
        assert g["n_user"] == w["n_user"] and abs(g["r"] - w["r"]) < 1e-12
        assert g["n_user_freq"] == w["n_user_freq"] and g["u"] == w["u"]
        assert abs(g["r_scaled"] - w["r_scaled"]) < 1e-9
        assert g["o"] == w["o"]
