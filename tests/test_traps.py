"""Semantics traps."""
import datetime as dt
import ipaddress
import random

import pytest

from logweave import run_features, run_preprocess


def sel(*cols):
    return {"mode": "explicit", "columns": list(cols)}


def by_rid(df):
    return {r["rid"]: r.asDict() for r in df.collect()}


def test_null_keys_group_and_freq(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, "a")], "rid long, k string")
    out = by_rid(run_features(df, [
        {"step_type": "group_frequency", "input_selector": sel("k")},
        {"step_type": "frequency_encode", "input_selector": sel("k")},
        {"step_type": "category_encode", "input_selector": sel("k")}], rid="rid"))
    assert out[0]["k_group_count"] == 2 and out[2]["k_group_count"] == 1
    assert out[0]["k_freq"] == 2
    assert out[0]["k_code"] == -1 and out[2]["k_code"] == 0


def test_null_time_window_bucket(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, dt.datetime(2024, 1, 1))], "rid long, t timestamp")
    out = by_rid(run_features(df, [{"step_type": "time_window_count", "params": {"time_column": "t"}}], rid="rid"))
    assert out[0]["t_15m_count"] == 2 and out[2]["t_15m_count"] == 1


@pytest.mark.parametrize("values,bins", [
    ([5.0, 5.0, None], 4), ([0.0, 0.0], 3), ([float(i) for i in range(11)], 5),
    ([0.1 * i for i in range(37)] + [None], 7), ([-3.5, 2.25, 2.25, 9.0, 1e6], 5)])
def test_bucket_matches_pandas_cut(spark, values, bins):
    import pandas as pd
    df = spark.createDataFrame(list(enumerate(values)), "rid long, x double")
    out = by_rid(run_features(df, [{"step_type": "numeric_bucket", "input_selector": sel("x"),
                                    "params": {"bins": bins}}], rid="rid"))
    want = pd.cut(pd.Series(values, dtype="float64"), bins=bins, labels=False, duplicates="drop")
    for i, w in enumerate(want):
        assert out[i]["x_bucket"] == (None if pd.isna(w) else int(w)), (values[i], w)


def test_zscore_constant_and_ratio_zero(spark):
    df = spark.createDataFrame([(0, 3.0, 0.0), (1, 3.0, 2.0)], "rid long, x double, y double")
    out = by_rid(run_features(df, [
        {"step_type": "numeric_scale", "input_selector": sel("x")},
        {"step_type": "ratio_feature", "input_selector": sel("x", "y")}], rid="rid"))
    assert out[0]["x_scaled"] == 0.0
    assert out[0]["x_y_ratio"] is None and out[1]["x_y_ratio"] == 1.5


def test_astral_and_unicode_text(spark):
    s = "a𝄞a² Ⅻ"
    df = spark.createDataFrame([(0, s), (1, ""), (2, None)], "rid long, t string")
    out = by_rid(run_features(df, [
        {"step_type": "text_length", "input_selector": sel("t")},
        {"step_type": "byte_length", "input_selector": sel("t")},
        {"step_type": "unique_char_ratio", "input_selector": sel("t")},
        {"step_type": "char_composition", "input_selector": sel("t")},
        {"step_type": "shannon_entropy", "input_selector": sel("t")}], rid="rid"))
    assert out[0]["t_length"] == len(s)
    assert out[0]["t_bytes"] == len(s.encode("utf-8"))
    assert out[0]["t_unique_char_count"] == len(set(s))
    assert out[0]["t_digit_ratio"] == pytest.approx(sum(c.isdigit() for c in s) / len(s))
    assert out[0]["t_upper_ratio"] == pytest.approx(sum(c.isupper() for c in s) / len(s))
    assert out[1]["t_entropy"] == 0.0 and out[2]["t_entropy"] == 0.0
    assert out[2]["t_length"] is None and out[2]["t_bytes"] == 0


def test_ipv4_private_matches_stdlib(spark):
    random.seed(1)
    nets = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
            "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "203.0.113.0/24", "240.0.0.0/4"]
    addrs = ["192.0.0.9", "192.0.0.10", "192.0.0.170", "192.0.0.171", "255.255.255.255", "8.8.8.8", "01.2.3.4",
             "256.1.1.1", "1.2.3", "", "::1", "fe80::1", "2001:db8::5", "::ffff:10.0.0.1", "not-an-ip"]
    for n in nets:
        net = ipaddress.ip_network(n)
        for _ in range(5):
            addrs.append(str(net.network_address + random.randrange(net.num_addresses)))
    for _ in range(200):
        addrs.append(".".join(str(random.randrange(256)) for _ in range(4)))
    df = spark.createDataFrame(list(enumerate(addrs)), "rid long, ip string")
    out = by_rid(run_features(df, [{"step_type": "ip_features", "input_selector": sel("ip")}], rid="rid"))
    for i, a in enumerate(addrs):
        try:
            p = ipaddress.ip_address(a)
        except ValueError:
            p = None
        assert out[i]["ip_is_private"] == (1 if p and p.is_private else 0), a
        assert out[i]["ip_is_loopback"] == (1 if p and p.is_loopback else 0), a
        assert out[i]["ip_ip_version"] == (p.version if p else None), a


def test_path_and_status(spark):
    vals = ["https://h.example/a/b.HTML;p=1?x=1", "/api/v1/x.tar.gz?q", "http://h", "rel/path.", None, "-150"]
    df = spark.createDataFrame(list(enumerate(vals)), "rid long, p string")
    out = by_rid(run_features(df, [{"step_type": "path_features", "input_selector": sel("p")},
                                   {"step_type": "status_category", "input_selector": sel("p")}], rid="rid"))
    assert (out[0]["p_depth"], out[0]["p_extension"], out[0]["p_has_query"]) == (2, "html", 1)
    assert (out[1]["p_depth"], out[1]["p_extension"]) == (3, "gz")
    assert (out[2]["p_depth"], out[2]["p_extension"]) == (0, None)
    assert out[3]["p_extension"] is None
    assert out[4]["p_depth"] == 0 and out[4]["p_has_query"] == 0
    assert out[5]["p_category"] == "-2xx"


def test_boolean_flag_nulls(spark):
    df = spark.createDataFrame([(0, None), (1, "Admin panel"), (2, "x")], "rid long, s string")
    out = by_rid(run_features(df, [
        {"step_type": "boolean_flag", "input_selector": sel("s"), "params": {"operator": "contains", "value": "admin"},
         "output_mode": {"output_column": "c"}},
        {"step_type": "boolean_flag", "input_selector": sel("s"), "params": {"operator": "eq", "value": "x"},
         "output_mode": {"output_column": "e"}},
        {"step_type": "boolean_flag", "input_selector": sel("s"), "params": {"operator": "gt", "value": "1"},
         "output_mode": {"output_column": "g"}}], rid="rid"))
    assert (out[0]["c"], out[1]["c"]) == (0, 1)
    assert out[0]["e"] is None and out[2]["e"] == 1
    assert out[0]["g"] == 0


def test_filters_drop_nulls_and_dedup_keeps_first(spark):
    df = spark.createDataFrame([(0, None, "a"), (1, "x", "a"), (2, "y", "a"), (3, "x", "b")],
                               "rid long, s string, k string")
    out = run_preprocess(df, [{"step_type": "filter_rows", "input_selector": sel("s"),
                               "params": {"operator": "ne", "value": "y"}}], rid="rid")
    assert sorted(r["rid"] for r in out.collect()) == [1, 3]
    out = run_preprocess(df, [{"step_type": "drop_duplicates", "params": {"subset": ["k"]}}], rid="rid")
    assert sorted(r["rid"] for r in out.collect()) == [0, 3]


def test_cast_int_fractional_fails(spark):
    df = spark.createDataFrame([(0, "1.5"), (1, "2")], "rid long, s string")
    out = run_preprocess(df, [{"step_type": "cast_type", "input_selector": sel("s"),
                               "params": {"target_type": "int"}}], rid="rid")
    with pytest.raises(Exception):
        out.collect()
