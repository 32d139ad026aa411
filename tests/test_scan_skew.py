"""Ordered-group features under skew: one key holds a third of the rows and spans many
range partitions; results must equal a brute-force pandas computation."""
import datetime as dt
import random

import pandas as pd

from logweave import run_features


def brute(pdf, keys, tcol, target, minutes):
    pdf = pdf.copy()
    pdf["__t"] = pd.to_datetime(pdf[tcol])
    pdf = pdf.sort_values(keys + ["__t", "rid"], na_position="last", kind="mergesort")
    out = {}
    gk = pdf[keys].astype("string").fillna("__null__").agg("|".join, axis=1)
    prev_key, order, prev_t, prev_v = None, 0, None, None
    rows = list(zip(pdf["rid"], gk, pdf["__t"], pdf[target].astype("string").fillna("__missing__")))
    for i, (rid, k, t, v) in enumerate(rows):
        same = k == prev_key
        order = order + 1 if same else 1
        prev = (t - prev_t).total_seconds() if same and pd.notna(t) and pd.notna(prev_t) else None
        nxt_row = rows[i + 1] if i + 1 < len(rows) else None
        nxt = None
        if nxt_row is not None and nxt_row[1] == k and pd.notna(t) and pd.notna(nxt_row[2]):
            nxt = (nxt_row[2] - t).total_seconds()
        chg = 1 if same and v != prev_v else 0
        out[rid] = {"ord": order, "prev": prev, "next": nxt, "chg": chg}
        prev_key, prev_t, prev_v = k, t, v
    return out


def test_hot_key_many_partitions(spark):
    random.seed(7)
    base = dt.datetime(2024, 1, 1)
    data = []
    for rid in range(3000):
        hot = rid % 3 == 0
        key = "hot" if hot else (None if rid % 17 == 0 else f"k{rid % 40}")
        t = None if rid % 29 == 0 else base + dt.timedelta(seconds=random.randint(0, 3600 * 24))
        if rid % 11 == 0 and t is not None:
            t = base  # ties in time, broken by row id
        data.append((rid, key, t, random.choice(["a", "b", None])))
    df = spark.createDataFrame(data, "rid long, k string, t timestamp, v string")
    g = {"mode": "explicit", "columns": ["k"]}
    steps = [
        {"step_type": "group_event_order", "input_selector": g, "params": {"time_column": "t"},
         "output_mode": {"output_column": "ord"}},
        {"step_type": "time_since_previous_event", "input_selector": g, "params": {"time_column": "t"},
         "output_mode": {"output_column": "prev"}},
        {"step_type": "time_until_next_event", "input_selector": g, "params": {"time_column": "t"},
         "output_mode": {"output_column": "next"}},
        {"step_type": "group_value_change_flag", "input_selector": g,
         "params": {"time_column": "t", "target_column": "v"}, "output_mode": {"output_column": "chg"}},
    ]
    # 37 range partitions: the hot key (1000 rows) crosses many partition boundaries
    got = {r["rid"]: r.asDict() for r in run_features(df, steps, rid="rid", num_partitions=37).collect()}
    want = brute(pd.DataFrame(data, columns=["rid", "k", "t", "v"]), ["k"], "t", "v", 15)
    assert len(got) == 3000
    for rid, w in want.items():
        g_ = got[rid]
        assert g_["ord"] == w["ord"], rid
        assert (g_["prev"] is None) == (w["prev"] is None) and (w["prev"] is None or abs(g_["prev"] - w["prev"]) < 1e-6)
        assert (g_["next"] is None) == (w["next"] is None) and (w["next"] is None or abs(g_["next"] - w["next"]) < 1e-6)
        assert g_["chg"] == w["chg"], rid


def test_window_changes_multi_key(spark):
    base = dt.datetime(2024, 1, 1)
    data = [(i, "a" if i % 2 else "b", None if i % 5 == 0 else "x", base + dt.timedelta(minutes=i),
             ["s1", "s2", "s2", None][i % 4]) for i in range(200)]
    df = spark.createDataFrame(data, "rid long, k1 string, k2 string, t timestamp, v string")
    out = run_features(df, [{"step_type": "window_status_change_count",
                             "input_selector": {"mode": "explicit", "columns": ["k1", "k2"]},
                             "params": {"time_column": "t", "target_column": "v", "window_minutes": 30},
                             "output_mode": {"output_column": "wc"}}], rid="rid", num_partitions=13)
    got = {r["rid"]: r["wc"] for r in out.collect()}
    pdf = pd.DataFrame(data, columns=["rid", "k1", "k2", "t", "v"])
    pdf["b"] = pdf["t"].dt.floor("30min")
    pdf["vv"] = pdf["v"].fillna("__missing__")
    pdf = pdf.sort_values(["k1", "k2", "t", "rid"], na_position="last")
    keys = [pdf["k1"], pdf["k2"].fillna("__null__"), pdf["b"]]
    pdf["f"] = (pdf.groupby(keys)["vv"].shift(1).notna() & (pdf.groupby(keys)["vv"].shift(1) != pdf["vv"])).astype(int)
    pdf["want"] = pdf.groupby(keys)["f"].transform("sum")
    for rid, w in zip(pdf["rid"], pdf["want"]):
        assert got[rid] == w


def test_one_scan_many_targets_and_buckets(spark):
    base = dt.datetime(2024, 1, 1)
    random.seed(11)
    data = [(i, random.choice(["a", "b", None]), base + dt.timedelta(minutes=random.randint(0, 600)),
             random.choice(["x", "y", None]), random.choice(["p", "q"])) for i in range(600)]
    df = spark.createDataFrame(data, "rid long, k string, t timestamp, v string, w string")
    g = {"mode": "explicit", "columns": ["k"]}
    steps = [{"step_type": "group_value_change_flag", "input_selector": g,
              "params": {"time_column": "t", "target_column": tgt}, "output_mode": {"output_column": f"chg_{tgt}"}}
             for tgt in ("v", "w")]
    steps += [{"step_type": "window_status_change_count", "input_selector": g,
               "params": {"time_column": "t", "target_column": tgt, "window_minutes": m},
               "output_mode": {"output_column": f"wc_{tgt}_{m}"}} for tgt, m in (("v", 30), ("w", 60), ("v", 60))]
    got = {r["rid"]: r.asDict() for r in run_features(df, steps, rid="rid", num_partitions=11).collect()}
    pdf = pd.DataFrame(data, columns=["rid", "k", "t", "v", "w"]).sort_values(["k", "t", "rid"], na_position="last")
    kk = pdf["k"].fillna("__null__")
    for tgt in ("v", "w"):
        val = pdf[tgt].fillna("__missing__")
        prev = val.groupby(kk).shift(1)
        pdf[f"chg_{tgt}"] = (prev.notna() & (prev != val)).astype(int)
    for tgt, m in (("v", 30), ("w", 60), ("v", 60)):
        val = pdf[tgt].fillna("__missing__")
        b = pdf["t"].dt.floor(f"{m}min")
        prev = val.groupby([kk, b]).shift(1)
        flag = (prev.notna() & (prev != val)).astype(int)
        pdf[f"wc_{tgt}_{m}"] = flag.groupby([kk, b]).transform("sum")
    for _, r in pdf.iterrows():
        g_ = got[r["rid"]]
        for c in ("chg_v", "chg_w", "wc_v_30", "wc_w_60", "wc_v_60"):
            assert g_[c] == r[c], (r["rid"], c)


def test_character_statistics_hold_few_characters_at_once(monkeypatch):
    """A batch of long texts, or one very long text, is counted in pieces: memory follows the piece, not the batch."""
    import tracemalloc

    import pandas as pd

    from logweave.functions import text as tx
    profile = tx._char_profile.func
    texts = pd.Series(["aé中😀 1" * 40_000] + ["ab C9" * 600] * 2_000 + ["", None])
    tracemalloc.start()
    whole = profile(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * sum(len(t or "") for t in texts)
    assert whole.iloc[0].tolist()[:1] == [240_000] and whole.iloc[-1].tolist() == [0] * 8
    monkeypatch.setattr(tx, "PIECE", 1000)
    pd.testing.assert_frame_equal(profile(texts[:50]), whole[:50], check_exact=True)
