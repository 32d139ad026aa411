"""Registered queries for training-input selection, the advisor, models, result
analysis and drill-down (TSL-*, ADV-*, TRN-*, RES-*, DRL-*)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import charclass as cc
from ..ml import models as ml
from ..ml.predictions import analysis_bundle, prediction_table
from ..operators import advisor as adv
from ..operators import analysis as an
from ..operators import drilldown as dd
from ..operators.selection import feature_matrix, feature_vectors, select_training_columns, selection_frame
from ..plans.chain import run_features
from ..plans.training_input import choice_frame, choose_training_columns
from .common import logs, round6, table, with_logs
from .q_features import FLOW_STEPS
from .registry import query

# ------------------------------------------------------------- scored events

SCORE_EXPR = ("value / 50.0 + CASE WHEN event_type = 'error' THEN 0.5 ELSE 0.0 END + "
              "user_id_event_time_1440m_count / 10.0")


def scored(spark, d):
    """A prediction table over the logs view: flow features + a fixed score formula."""
    feats = run_features(logs(spark, d), FLOW_STEPS, rid="row_id")
    return feats.selectExpr(
        "row_id", "source_ip", "dest_ip", "protocol", "path", "event_type", "user_id", "event_time",
        "user_id_group_count", "user_id_event_time_1440m_count", "user_id_event_time_1440m_spike",
        "CAST(row_id AS STRING) AS source_row_id", "row_id AS sample_index", "label AS actual_label",
        f"{SCORE_EXPR} AS anomaly_score").selectExpr(
        "*", "CASE WHEN anomaly_score >= 1.1 THEN 'anomaly' ELSE 'normal' END AS predicted_label")


_BK = "(epoch_us(event_time) // 86400000000::BIGINT)"
SCORED_CTE = (
    "scored0 AS (SELECT row_id, source_ip, dest_ip, protocol, path, event_type, user_id, event_time, "
    "count(*) OVER (PARTITION BY user_id) AS user_id_group_count, "
    f"count(*) OVER (PARTITION BY user_id, {_BK}) AS user_id_event_time_1440m_count, "
    f"CAST(count(*) OVER (PARTITION BY user_id, {_BK}) >= 3 AS BIGINT) AS user_id_event_time_1440m_spike, "
    "CAST(row_id AS VARCHAR) AS source_row_id, row_id AS sample_index, value, label AS actual_label FROM logs), "
    f"scored AS (SELECT * EXCLUDE (value), {SCORE_EXPR} AS anomaly_score, "
    f"CASE WHEN {SCORE_EXPR} >= 1.1 THEN 'anomaly' ELSE 'normal' END AS predicted_label FROM scored0)")


def with_scored(sql: str) -> str:
    return with_logs("").rstrip() + ", " + SCORED_CTE + "\n" + sql


PRED_COLS = ["sample_index", "source_row_id", "source_ip", "user_id", "user_id_group_count",
             "user_id_event_time_1440m_count", "user_id_event_time_1440m_spike", "actual_label", "predicted_label",
             "anomaly_score"]


@query("pred_table", with_scored(f"SELECT {', '.join(PRED_COLS)} FROM scored"))
def pred_table(spark, d):
    made = prediction_table(scored(spark, d), "row_id", ["user_id_group_count"], ["source_ip", "user_id"])
    return made.select(*PRED_COLS)


@query("pred_layout", with_scored("SELECT CAST(0 AS BIGINT) AS first_index, count(*) - 1 AS last_index, count(*) AS n, "
                                  "'sample_index,source_row_id,source_ip,actual_label,predicted_label,anomaly_score,"
                                  "user_id_group_count' AS head FROM scored"))
def pred_layout(spark, d):
    """TRN-14: the index is dense and the columns come in the display order."""
    made = prediction_table(scored(spark, d), "row_id", ["user_id_group_count"], ["source_ip"])
    return made.agg(F.min("sample_index").alias("first_index"), F.max("sample_index").alias("last_index"),
                    F.count_distinct("sample_index").alias("n"), F.lit(",".join(made.columns[:7])).alias("head"))


@query("pred_preview", with_scored(
    "SELECT sample_index, source_ip, anomaly_score, predicted_label FROM scored "
    "ORDER BY anomaly_score DESC, sample_index LIMIT 50"))
def pred_preview(spark, d):
    return an.prediction_preview(scored(spark, d), 50).select("sample_index", "source_ip", "anomaly_score",
                                                              "predicted_label")


_HASH = an.pseudo_random_order_sql("sample_index")
_SAMPLE_CTE = (
    "cnt AS (SELECT count(*) FILTER (WHERE predicted_label = 'anomaly') AS a, "
    "count(*) FILTER (WHERE predicted_label <> 'anomaly' OR predicted_label IS NULL) AS n FROM scored), "
    "t0 AS (SELECT a, n, CAST(round_even(600.0 * a / (a + n), 0) AS BIGINT) AS a0 FROM cnt), "
    "t1 AS (SELECT a, n, CASE WHEN a > 0 AND a0 = 0 THEN 1 ELSE a0 END AS a1 FROM t0), "
    "t2 AS (SELECT a, n, a1, 600 - a1 AS n1 FROM t1), "
    "t3 AS (SELECT a, n, CASE WHEN n > 0 AND n1 = 0 THEN 599 ELSE a1 END AS a2, "
    "CASE WHEN n > 0 AND n1 = 0 THEN 1 ELSE n1 END AS n2 FROM t2), "
    "t4 AS (SELECT a, n, least(a2, a) AS a3, least(n2, n) AS n3 FROM t3), "
    "t5 AS (SELECT a, n, a3, n3, 600 - a3 - n3 AS rem, (a / (a + n) > n / (a + n) OR (a = n AND a - a3 >= n - n3)) "
    "AS a_first FROM t4), "
    "t6 AS (SELECT a, n, CASE WHEN rem <= 0 THEN a3 WHEN a_first THEN a3 + least(a - a3, rem) "
    "ELSE a3 + least(a - a3, greatest(rem - least(n - n3, rem), 0)) END AS at, "
    "CASE WHEN rem <= 0 THEN n3 WHEN a_first THEN n3 + least(n - n3, greatest(rem - least(a - a3, rem), 0)) "
    "ELSE n3 + least(n - n3, rem) END AS nt FROM t5), "
    "samp AS (SELECT s.* FROM scored s, cnt WHERE cnt.a + cnt.n <= 600 UNION ALL "
    "SELECT x.* EXCLUDE (rk) FROM (SELECT s.*, row_number() OVER (ORDER BY anomaly_score DESC, sample_index) AS rk "
    "FROM scored s WHERE predicted_label = 'anomaly') x, t6, cnt WHERE cnt.a + cnt.n > 600 AND rk <= t6.at "
    "UNION ALL SELECT x.* EXCLUDE (rk) FROM (SELECT s.*, row_number() OVER (ORDER BY "
    f"{_HASH}, sample_index) AS rk FROM scored s WHERE predicted_label <> 'anomaly') x, t6, cnt "
    "WHERE cnt.a + cnt.n > 600 AND rk <= t6.nt)")


def with_sample(sql: str) -> str:
    return with_scored("").rstrip() + ", " + _SAMPLE_CTE + "\n" + sql


@query("strat_sample", with_sample("SELECT sample_index, anomaly_score, predicted_label FROM samp"))
def strat_sample(spark, d):
    return an.stratified_sample(scored(spark, d), 600).select("sample_index", "anomaly_score", "predicted_label")


@query("score_points", with_sample(
    "SELECT sample_index, round(anomaly_score, 6) AS anomaly_score, predicted_label, actual_label FROM samp"))
def score_points_q(spark, d):
    return round6(an.score_points(an.stratified_sample(scored(spark, d), 600)).withColumn(
        "anomaly_score", F.col("anomaly_score")))


def _hist_sql(bins: int = 16) -> str:
    step = f"((r.hi - r.lo) / {float(bins)})"
    idx = " + ".join(f"CAST(s.anomaly_score >= {float(i)} * {step} + r.lo AS INTEGER)" for i in range(1, bins))
    edge = (lambda b: f"CASE WHEN {b} = {bins} THEN r.hi ELSE CAST({b} AS DOUBLE) * {step} + r.lo END")
    return (
        "rng AS (SELECT lo, CASE WHEN abs(hi0 - lo) <= 1e-8 + 1e-5 * abs(hi0) THEN lo + 1.0 ELSE hi0 END AS hi "
        "FROM (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi0 FROM scored)), "
        f"cnts AS (SELECT CAST({idx} AS INTEGER) AS bin, count(*) FILTER (WHERE s.predicted_label <> 'anomaly' OR "
        "s.predicted_label IS NULL) AS normal_count, count(*) FILTER (WHERE s.predicted_label = 'anomaly') "
        "AS anomaly_count FROM scored s, rng r WHERE s.anomaly_score >= r.lo AND s.anomaly_score <= r.hi GROUP BY 1)\n"
        f"SELECT g.bin, printf('%.2f - %.2f', {edge('g.bin')}, {edge('g.bin + 1')}) AS bucket_label, "
        f"round({edge('g.bin')}, 6) AS range_start, round({edge('g.bin + 1')}, 6) AS range_end, "
        "CAST(coalesce(c.normal_count, 0) AS BIGINT) AS normal_count, "
        "CAST(coalesce(c.anomaly_count, 0) AS BIGINT) AS anomaly_count "
        f"FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})) g CROSS JOIN rng r "
        "LEFT JOIN cnts c ON g.bin = c.bin")


@query("score_hist", with_scored("").rstrip() + ", " + _hist_sql(16))
def score_hist(spark, d):
    return round6(an.score_histogram(scored(spark, d), 16))


@query("pca_2d")
def pca_2d(spark, d):
    return an.embedding_points(scored(spark, d), ["user_id_group_count", "user_id_event_time_1440m_count", "protocol"])


@query("pca_pair", with_scored(
    "SELECT * FROM (SELECT sample_index, predicted_label, round(anomaly_score, 6) AS anomaly_score, actual_label, "
    "round(sx * (ex * (p - mp) + ey * (q - mq)), 6) AS x, round(sy * (ey * (p - mp) - ex * (q - mq)), 6) AS y FROM "
    "(SELECT *, CASE WHEN (CASE WHEN abs(ex) >= abs(ey) THEN ex ELSE ey END) >= 0 THEN 1 ELSE -1 END AS sx, "
    "CASE WHEN (CASE WHEN abs(ey) >= abs(ex) THEN ey ELSE -ex END) >= 0 THEN 1 ELSE -1 END AS sy FROM "
    "(SELECT mp, mq, cos(t) AS ex, sin(t) AS ey FROM (SELECT avg(user_id_group_count) AS mp, "
    "avg(user_id_event_time_1440m_count) AS mq, 0.5 * atan2(2 * covar_samp(user_id_group_count, "
    "user_id_event_time_1440m_count), var_samp(user_id_group_count) - var_samp(user_id_event_time_1440m_count)) AS t "
    "FROM scored))), (SELECT *, user_id_group_count AS p, user_id_event_time_1440m_count AS q FROM scored))"))
def pca_pair(spark, d):
    """RES-6 on two columns, where the axes have a closed form."""
    return round6(an.embedding_points(scored(spark, d), ["user_id_group_count", "user_id_event_time_1440m_count"]))


@query("analysis_bundle", with_sample(
    "SELECT count(*) AS sample_size, count(*) FILTER (WHERE predicted_label = 'anomaly') AS anomaly_count, "
    "count(*) AS n_points, count(*) AS n_projected, CAST(16 AS BIGINT) AS n_bins, CAST(1 AS BIGINT) AS n_spike_signals, "
    "CAST(2 AS BIGINT) AS n_count_signals FROM samp"))
def analysis_bundle_q(spark, d):
    """RES-9: one row that sums up the parts of the bundle."""
    made = prediction_table(scored(spark, d), "row_id", ["user_id_group_count"])
    parts = analysis_bundle(made, ["user_id_group_count", "user_id_event_time_1440m_count", "protocol"])
    out = parts["summary"]
    for name, part in (("n_points", "score_points"), ("n_projected", "embedding_points"), ("n_bins", "score_histogram"),
                       ("n_spike_signals", "spike_signal_summaries"), ("n_count_signals", "count_signal_summaries")):
        out = out.crossJoin(parts[part].agg(F.count("*").alias(name)))
    return out


def _signal_sql(cols: list[str], kind: str) -> str:
    parts = []
    for i, c in enumerate(cols):
        a, n = "predicted_label = 'anomaly'", "(predicted_label <> 'anomaly' OR predicted_label IS NULL)"
        parts.append(
            f"SELECT {i} AS pos, '{c}' AS \"column\", '{kind}' AS signal_type, "
            f"round(avg({c}) FILTER (WHERE {a}), 4) AS anomaly_mean, round(avg({c}) FILTER (WHERE {n}), 4) AS normal_mean, "
            f"round(CAST(max({c}) FILTER (WHERE {a}) AS DOUBLE), 4) AS anomaly_max, "
            f"round(CAST(max({c}) FILTER (WHERE {n}) AS DOUBLE), 4) AS normal_max, "
            f"count(*) FILTER (WHERE {a} AND coalesce({c}, 0) > 0) AS anomaly_active_count, "
            f"count(*) FILTER (WHERE {n} AND coalesce({c}, 0) > 0) AS normal_active_count, "
            f"CASE WHEN count(*) FILTER (WHERE {a}) > 0 THEN round(count(*) FILTER (WHERE {a} AND coalesce({c}, 0) > 0) "
            f"/ count(*) FILTER (WHERE {a}), 4) END AS anomaly_active_rate, "
            f"CASE WHEN count(*) FILTER (WHERE {n}) > 0 THEN round(count(*) FILTER (WHERE {n} AND coalesce({c}, 0) > 0) "
            f"/ count(*) FILTER (WHERE {n}), 4) END AS normal_active_rate FROM scored")
    key = "anomaly_active_rate" if kind == "spike_flag" else "anomaly_mean"
    return with_scored(f"SELECT * EXCLUDE (pos) FROM ({' UNION ALL '.join(parts)}) "
                       f"ORDER BY coalesce({key}, 0.0) DESC, pos LIMIT 8")


@query("signal_spike", _signal_sql(["user_id_event_time_1440m_spike"], "spike_flag"))
def signal_spike(spark, d):
    return an.signal_summaries(scored(spark, d), "spike_flag")


@query("signal_count", _signal_sql(["user_id_group_count", "user_id_event_time_1440m_count"], "count_metric"))
def signal_count(spark, d):
    return an.signal_summaries(scored(spark, d), "count_metric")


@query("top_rows", with_scored(
    "SELECT sample_index, anomaly_score, predicted_label FROM scored WHERE predicted_label = 'anomaly' "
    "OR NOT EXISTS (SELECT 1 FROM scored WHERE predicted_label = 'anomaly') "
    "ORDER BY anomaly_score DESC, sample_index LIMIT 5"))
def top_rows_q(spark, d):
    return an.top_rows(scored(spark, d), 5).select("sample_index", "anomaly_score", "predicted_label")


def _json_list(items: str) -> str:
    """SQL for the JSON text of a list of names."""
    return f"CASE WHEN len({items}) = 0 THEN '[]' ELSE '[\"' || array_to_string({items}, '\", \"') || '\"]' END"


@query("explain_payload", with_scored(
    "SELECT 'mode: unsupervised' || chr(10) || 'algorithm: fixed_score' || chr(10) || "
    "'feature_columns: [''user_id_event_time_1440m_count'']' || chr(10) || 'Top rows: [' || string_agg("
    "'{\"sample_index\":' || sample_index || ',\"source_ip\":\"' || source_ip || '\",\"anomaly_score\":' || anomaly_score || "
    "',\"predicted_label\":\"' || predicted_label || '\"}', ',' ORDER BY sample_index) || ']' AS payload FROM (SELECT * FROM "
    "scored WHERE predicted_label = 'anomaly' OR NOT EXISTS (SELECT 1 FROM scored WHERE predicted_label = 'anomaly') "
    "ORDER BY anomaly_score DESC, sample_index LIMIT 5)"))
def explain_payload(spark, d):
    facts = {"mode": "unsupervised", "algorithm": "fixed_score", "feature_columns": ["user_id_event_time_1440m_count"]}
    return an.explanation_payload(scored(spark, d).select("sample_index", "source_ip", "anomaly_score",
                                                          "predicted_label"), facts, 5)


_CONTENT_SPARK = ("CASE WHEN turn % 3 = 0 THEN concat('<think>', substr(text, 1, 40), '</think>', text) "
                  "WHEN turn % 3 = 1 THEN concat('<THINK>\n', role, '\n</Think> ok ', text, ' <think> </think>') "
                  "ELSE text END AS content")
_SP = cc.space_body()


@query("split_reasoning",
       "SELECT conv_id, turn, CASE WHEN len(b) > 0 THEN array_to_string(b, chr(10) || chr(10)) END AS content_reasoning, "
       f"regexp_replace(regexp_replace(content, '(?is)<think>(.*?)</think>', '', 'g'), '^[{_SP}]+|[{_SP}]+$', '', 'g') "
       "AS content_answer FROM (SELECT conv_id, turn, content, list_filter(list_transform(regexp_extract_all(content, "
       f"'(?is)<think>(.*?)</think>', 1), lambda x: regexp_replace(x, '^[{_SP}]+|[{_SP}]+$', '', 'g')), "
       "lambda x: x <> '') AS b FROM (SELECT conv_id, turn, "
       + _CONTENT_SPARK.replace("'<THINK>\n'", "'<THINK>' || chr(10)").replace("'\n</Think> ok '",
                                                                                "chr(10) || '</Think> ok '")
       + " FROM conversations))")
def split_reasoning_q(spark, d):
    conv = table(spark, d, "conversations").selectExpr("conv_id", "turn", _CONTENT_SPARK)
    return an.split_reasoning(conv, "content").select("conv_id", "turn", "content_reasoning", "content_answer")


# ----------------------------------------------------------------- drill-down

SIGNAL = "user_id_event_time_1440m_count"


@query("drill_samples", with_scored(
    f"SELECT sample_index, source_ip, {SIGNAL}, anomaly_score FROM scored WHERE {SIGNAL} > 0 "
    f"ORDER BY {SIGNAL} DESC, sample_index LIMIT 8"))
def drill_samples(spark, d):
    return dd.signal_samples(scored(spark, d), SIGNAL, "sample_index").select("sample_index", "source_ip", SIGNAL,
                                                                               "anomaly_score")


def _selected(spark, d):
    pred = scored(spark, d)
    row = dd.signal_samples(pred, SIGNAL, "sample_index").first().asDict()
    return pred, row


_COMPARABLE = ["source_ip", "dest_ip", "protocol", "path"]


_SEL = f"sel AS (SELECT * FROM scored WHERE {SIGNAL} > 0 ORDER BY {SIGNAL} DESC, sample_index LIMIT 1)"


@query("drill_matches", with_scored("").rstrip() + ", " + _SEL + "\nSELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}=' || CAST(sel.{c} AS VARCHAR) AS label, (SELECT count(*) FROM scored s "
    f"WHERE coalesce(trim(CAST(s.{c} AS VARCHAR)), '') = trim(CAST(sel.{c} AS VARCHAR))) AS count FROM sel "
    f"WHERE sel.{c} IS NOT NULL AND trim(CAST(sel.{c} AS VARCHAR)) <> ''" for i, c in enumerate(_COMPARABLE))
    + ") WHERE count > 1 ORDER BY position LIMIT 6")
def drill_matches(spark, d):
    pred, row = _selected(spark, d)
    return dd.sample_matches(pred, row, _COMPARABLE)


_SCORED_ORDER = ["row_id", "source_ip", "dest_ip", "protocol", "path", "event_type", "user_id", "event_time",
                 "user_id_group_count", "user_id_event_time_1440m_count", "user_id_event_time_1440m_spike",
                 "source_row_id", "sample_index", "anomaly_score", "predicted_label", "actual_label"]


def _drill_window_sql() -> str:
    base = dd.signal_base(SIGNAL)
    cands = [c for c in dd.ANCHOR_PREFERRED if c in _SCORED_ORDER]
    cands += [c for c in _SCORED_ORDER if base and base in c and c not in cands]

    def txt(t, c):
        return f"trim(CAST({t}.{c} AS VARCHAR))"

    counts = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS name, (SELECT count(*) FROM scored s WHERE coalesce({txt('s', c)}, '') = "
        f"{txt('sel', c)}) AS cnt FROM sel WHERE sel.{c} IS NOT NULL AND {txt('sel', c)} <> ''"
        for i, c in enumerate(cands))
    mismatch = " OR ".join(f"(a.name = '{c}' AND coalesce({txt('s', c)}, '') <> {txt('sel', c)})" for c in cands)
    win = ("win AS (SELECT s.* FROM scored s, sel WHERE s.event_time IS NOT NULL AND "
           "epoch_us(s.event_time) // 86400000000::BIGINT = epoch_us(sel.event_time) // 86400000000::BIGINT "
           f"AND NOT EXISTS (SELECT 1 FROM anchors a WHERE {mismatch}))")
    after = "(w.event_time > sel.event_time OR (w.event_time = sel.event_time AND w.sample_index > sel.sample_index))"
    before = "(w.event_time < sel.event_time OR (w.event_time = sel.event_time AND w.sample_index < sel.sample_index))"
    rows = (f"SELECT -row_number() OVER (ORDER BY w.event_time DESC, w.sample_index DESC) AS rp, w.* FROM win w, sel "
            f"WHERE {before} QUALIFY row_number() OVER (ORDER BY w.event_time DESC, w.sample_index DESC) <= 2 "
            "UNION ALL SELECT 0 AS rp, w.* FROM win w, sel WHERE w.sample_index = sel.sample_index "
            f"UNION ALL SELECT row_number() OVER (ORDER BY w.event_time, w.sample_index) AS rp, w.* FROM win w, sel "
            f"WHERE {after} QUALIFY row_number() OVER (ORDER BY w.event_time, w.sample_index) <= 2")
    return (with_scored("").rstrip() + f", {_SEL}, anchors AS (SELECT * FROM ({counts}) WHERE cnt > 1 "
            f"ORDER BY cnt DESC, pos LIMIT 2), {win}, picked AS ({rows})\n"
            "SELECT CAST(rp AS INTEGER) AS relative_position, sample_index, anomaly_score, predicted_label, "
            "(SELECT coalesce(string_agg(name, ',' ORDER BY cnt DESC, pos), '') FROM anchors) AS anchor_columns "
            "FROM picked")


@query("drill_window", _drill_window_sql())
def drill_window(spark, d):
    pred, row = _selected(spark, d)
    anchors = dd.anchor_columns(pred, row, SIGNAL)
    detail = dd.window_detail(pred, row, SIGNAL, "sample_index", anchors=anchors)
    return detail.select("relative_position", "sample_index", "anomaly_score", "predicted_label",
                         F.lit(",".join(anchors)).alias("anchor_columns"))


def _drill_rows_sql() -> str:
    head = _drill_window_sql().split(", picked AS (")[0]
    day = "epoch_us(sel.event_time) // 86400000000::BIGINT"
    return (head + "\nSELECT row_number() OVER (ORDER BY w.event_time, w.sample_index) AS position, count(*) OVER () AS "
            f"window_rows, CAST({day} * 86400 AS BIGINT) AS start_s, CAST(({day} + 1) * 86400 AS BIGINT) AS end_s, "
            "w.sample_index = sel.sample_index AS is_selected, w.sample_index FROM win w, sel")


@query("drill_window_rows", _drill_rows_sql())
def drill_window_rows(spark, d):
    pred, row = _selected(spark, d)
    return dd.window_rows(pred, row, SIGNAL, "sample_index").select(
        "position", "window_rows", F.unix_seconds("window_start").alias("start_s"),
        F.unix_seconds("window_end").alias("end_s"), "is_selected", "sample_index")


def _drill_context_sql() -> str:
    base = dd.signal_base(SIGNAL)
    preferred = [c for c in dd.DEFAULT_CONTEXT if c in _SCORED_ORDER]
    extra = [c for c in _SCORED_ORDER if c not in preferred and not c.startswith("__") and base and base in c]
    entries = " UNION ALL ".join(
        f"SELECT {i} AS k, '{c}' AS label, CAST(sel.{c} AS VARCHAR) AS value FROM sel "
        f"WHERE sel.{c} IS NOT NULL AND trim(CAST(sel.{c} AS VARCHAR)) <> ''" for i, c in enumerate(preferred + extra))
    win_sql = _drill_window_sql()
    head = win_sql.split(", win AS (")[0]          # logs, scored, sel and anchors CTEs
    return (head + f", ctx AS (SELECT * FROM ({entries}) ORDER BY k LIMIT 8)\n"
            "SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS position, label, value, "
            "label IN (SELECT name FROM anchors) AS is_anchor FROM ctx")


@query("drill_context", _drill_context_sql())
def drill_context(spark, d):
    pred, row = _selected(spark, d)
    pairs = dd.sample_context(row, SIGNAL)
    anchors = dd.anchor_columns(pred, row, SIGNAL)
    return spark.createDataFrame([(i, k, v, k in anchors) for i, (k, v) in enumerate(pairs)],
                                 "position int, label string, value string, is_anchor boolean")


# ------------------------------------------------------------------- models

def _docs_labeled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")


@query("clf_metrics", "WITH p AS (SELECT CAST(quality AS VARCHAR) AS a, CASE WHEN n_chars > 2000 THEN '1' ELSE '0' END "
       "AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT a, p, count(*) AS cnt FROM p GROUP BY 1, 2), "
       "k AS (SELECT a AS c FROM c UNION SELECT p FROM c), s AS (SELECT k.c, "
       "coalesce(sum(cnt) FILTER (WHERE a = k.c AND p = k.c), 0) AS tp, "
       "coalesce(sum(cnt) FILTER (WHERE p = k.c AND a <> k.c), 0) AS fp, "
       "coalesce(sum(cnt) FILTER (WHERE a = k.c AND p <> k.c), 0) AS fn FROM k, c GROUP BY k.c), "
       "m AS (SELECT tp, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, "
       "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM s) "
       "SELECT round(sum(tp) / (SELECT sum(cnt) FROM c), 4) AS accuracy, round(avg(pr), 4) AS precision_macro, "
       "round(avg(rc), 4) AS recall_macro, round(avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END), 4) "
       "AS f1_macro FROM m")
def clf_metrics(spark, d):
    pred = _docs_labeled(spark, d).select(F.col("quality").cast("string").alias("actual_label"),
                                          F.when(F.col("n_chars") > 2000, "1").otherwise("0").alias("predicted_label"))
    return ml.classification_metrics(pred)


@query("binary_labels", with_logs(
    "SELECT row_id, CAST(lower(trim(coalesce(CAST(label AS VARCHAR), 'None'))) IN "
    "('1', 'true', 'yes', 'anomaly', 'attack', 'malicious', 'abnormal') AS BIGINT) AS label_binary FROM logs"))
def binary_labels_q(spark, d):
    return logs(spark, d).select("row_id", ml.binary_labels(F.col("label")).alias("label_binary"))


@query("anomaly_metrics", with_scored(
    "SELECT count(*) AS rows, CAST(sum(CAST(predicted_label = 'anomaly' AS BIGINT)) AS BIGINT) AS anomaly_count, "
    "round(avg(CAST(predicted_label = 'anomaly' AS BIGINT)), 4) AS anomaly_ratio, round(min(anomaly_score), 4) "
    "AS score_min, round(max(anomaly_score), 4) AS score_max, round(avg(anomaly_score), 4) AS score_mean, "
    "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision, "
    "round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall, "
    "round(CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0.0 END, 4) AS f1 FROM scored, "
    "(SELECT count(*) FILTER (WHERE y AND l) AS tp, count(*) FILTER (WHERE NOT y AND l) AS fp, "
    "count(*) FILTER (WHERE y AND NOT l) AS fn FROM (SELECT actual_label = 'anomaly' AS y, "
    "predicted_label = 'anomaly' AS l FROM scored)) GROUP BY tp, fp, fn"))
def anomaly_metrics_q(spark, d):
    return ml.anomaly_metrics(scored(spark, d))


def _train(spark, d, algo, **params):
    df = _docs_labeled(spark, d)
    _, pred, _ = ml.train_supervised(df, ["n_chars", "lang", "source", "toxic"], "quality", algo, "doc_id", params,
                                     context_columns=["doc_id"])
    return pred.drop("__rid")


@query("train_lr")
def train_lr(spark, d):
    return _train(spark, d, "logistic_regression")


@query("train_rf")
def train_rf(spark, d):
    return _train(spark, d, "random_forest")


@query("train_svm")
def train_svm(spark, d):
    return _train(spark, d, "svm", kernel="linear")


@query("train_svm_rbf")
def train_svm_rbf(spark, d):
    return _train(spark, d, "svm", kernel="rbf")


@query("model_round_trip", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing "
       "FROM documents JOIN labels USING (doc_id)")
def model_round_trip(spark, d):
    """TRN-15: a saved and reloaded classifier scores every row as the fitted one does."""
    from pyspark.ml.classification import LogisticRegressionModel

    from ..session import ensure_checkpoint_dir
    features = ["n_chars", "lang", "source", "toxic"]
    docs = _docs_labeled(spark, d)
    model, _, _ = ml.train_supervised(docs, features, "quality", "logistic_regression", "doc_id")
    again = LogisticRegressionModel.load(ml.save_model(model, ensure_checkpoint_dir(spark)))
    rows = feature_vectors(docs, features)
    both = model.transform(rows).select("doc_id", F.col("probability").alias("p")).join(
        again.transform(rows).select("doc_id", F.col("probability").alias("q")), "doc_id", "full")
    return both.agg(F.count("*").alias("rows"), F.count_if(~F.col("p").eqNullSafe(F.col("q"))).alias("differing"))


@query("train_metrics")
def train_metrics(spark, d):
    _, _, metrics = ml.train_supervised(_docs_labeled(spark, d), ["n_chars", "lang", "source", "toxic"], "quality",
                                        "logistic_regression", "doc_id")
    return metrics


@query("split_stratified",
       f"WITH r AS (SELECT quality, count(*) OVER (PARTITION BY quality) AS n, row_number() OVER (PARTITION BY quality "
       f"ORDER BY {an.pseudo_random_order_sql('doc_id + 42')}) AS rk, doc_id FROM documents JOIN labels USING (doc_id)) "
       "SELECT doc_id, quality, rk <= greatest(least(CAST(round(0.3 * n) AS BIGINT), n - 1), CASE WHEN n > 1 THEN 1 ELSE 0 END) "
       "AS is_test FROM r")
def split_stratified(spark, d):
    return ml.stratified_split(_docs_labeled(spark, d), "doc_id", "quality").select(
        "doc_id", "quality", F.col("__is_test").alias("is_test"))


@query("iforest_scores")
def iforest_scores(spark, d):
    feats = run_features(logs(spark, d), FLOW_STEPS, rid="row_id")
    return ml.isolation_forest(feats, ["value", "status_code", "dest_port", "user_id_event_time_1440m_count",
                                       "protocol"], "row_id", n_trees=100)


# ----------------------------------------------------- selection & advisor

def _selection_input(spark, d):
    return logs(spark, d).withColumn("value_copy", F.col("value")).withColumn("label_copy", F.col("label")) \
        .withColumn("session_token", F.concat(F.lit("s-"), F.col("row_id").cast("string"))) \
        .withColumn("constant_field", F.lit("x")).withColumn("empty_field", F.lit(None).cast("double"))


_SEL_INPUT = [  # (name, numeric) of the selection input, in order (row_id is the row key)
    ("event_time", False), ("user_id", True), ("event_type", False), ("value", True), ("source_ip", False),
    ("dest_ip", False), ("src_port", True), ("dest_port", True), ("protocol", False), ("status_code", True),
    ("path", False), ("label", False), ("value_copy", True), ("label_copy", False), ("session_token", False),
    ("constant_field", False), ("empty_field", True)]


def _selection_sql(target: str = "label", dataset_label: str = "label", max_card: int = 50,
                   sample_limit: int | None = None, generated: bool = False) -> str:
    from ..operators.columns import normalize_name
    from ..operators.selection import RESERVED_TRAINING_COLUMNS, is_identifier, is_label_like, is_raw_text

    def txt(c):
        return f"coalesce(CAST({c} AS VARCHAR), '__missing__')"

    names = [c for c, _ in _SEL_INPUT]
    aggs = []
    for i, (c, _) in enumerate(_SEL_INPUT):
        aggs += [f"count({c}) AS n{i}", f"count(DISTINCT {c}) AS d{i}", f"count(DISTINCT CAST({c} AS VARCHAR)) AS t{i}",
                 f"bool_and({txt(c)} = {txt(target)}) AS eqt{i}"]
        aggs += [f"bool_and({txt(c)} = {txt(names[j])}) AS eq{i}_{j}" for j in range(i)]
    reasons = []
    for i, (c, numeric) in enumerate(_SEL_INPUT):
        norm = normalize_name(c)
        static = None
        if c in RESERVED_TRAINING_COLUMNS:
            static = "reserved_training_column"
        elif c == target:
            static = "target_column"
        elif generated:
            static = None
        elif is_label_like(norm) and c not in {target, dataset_label}:
            static = "label_like_column"
        elif is_identifier(norm) and not numeric:
            static = "identifier_column"
        elif is_raw_text(norm) and not numeric:
            static = "raw_text_column"
        if static:
            reasons.append(f"'{static}' AS r{i}")
            continue
        stage = "after_generation" if generated else "column"
        whens = [f"WHEN n{i} = 0 THEN 'empty_{stage}'", f"WHEN d{i} <= 1 THEN 'constant_{stage}'",
                 f"WHEN eqt{i} THEN 'duplicates_target_column'"]
        whens += [f"WHEN r{j} IS NULL AND eq{i}_{j} THEN 'duplicates_feature:{names[j]}'" for j in range(i)]
        if not numeric and not generated:
            whens.append(f"WHEN t{i} > {max_card} THEN 'high_cardinality:' || CAST(t{i} AS VARCHAR) || '>{max_card}'")
        reasons.append(f"CASE {' '.join(whens)} END AS r{i}")
    rows = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS \"column\", r{i} IS NULL AS used, r{i} AS reason FROM rs"
                              for i, (c, _) in enumerate(_SEL_INPUT))
    src = ("SELECT *, value AS value_copy, label AS label_copy, 's-' || CAST(row_id AS VARCHAR) AS session_token, "
           "'x' AS constant_field, CAST(NULL AS DOUBLE) AS empty_field FROM logs")
    if sample_limit:
        # the advisor's deterministic sample: the same id permutation as the Spark side
        src += f" ORDER BY {an.pseudo_random_order_sql('row_id')}, row_id LIMIT {int(sample_limit)}"
    # one step per reason: a reason that names earlier ones would otherwise be expanded over and over
    steps = "".join(f", rs{i} AS MATERIALIZED (SELECT *, {r} FROM {f'rs{i - 1}' if i else 'agg'})" for i, r in enumerate(reasons))
    return with_logs("").rstrip() + f", src AS MATERIALIZED ({src}), agg AS MATERIALIZED (SELECT {', '.join(aggs)} FROM src)" \
        f"{steps}, rs AS MATERIALIZED (SELECT * FROM rs{len(reasons) - 1})\n{rows}"


@query("select_features_safe", _selection_sql())
def select_features_safe(spark, d):
    df = _selection_input(spark, d)
    sel = select_training_columns(df, None, target="label", dataset_label="label", rid="row_id")
    return selection_frame(df, sel)


@query("select_features_generated", _selection_sql(generated=True))
def select_features_generated(spark, d):
    """TSL-3: the rules for generated features (no name, text or cardinality rule)."""
    df = _selection_input(spark, d)
    return selection_frame(df, select_training_columns(df, None, target="label", rid="row_id", generated=True))


_CANDIDATES = ["value_copy", "empty_field", "value_again", "one", "label_code"]


def _choice_input(spark, d):
    return _selection_input(spark, d).withColumns({
        "value_again": F.col("value"), "one": F.lit(1), "label_code": F.col("label").cast("string") == "x"})


def _choice_sql() -> str:
    """Reasons of the candidates from the data, all other columns excluded; used ones first, then the others by schema."""
    facts = ("SELECT count(value) AS n, count(DISTINCT value) AS k, count(DISTINCT (label = 'x')) AS l, count(label) AS m FROM logs")
    value = "CASE WHEN n = 0 THEN 'empty_after_generation' WHEN k < 2 THEN 'constant_after_generation' END"
    rows = [("value_copy", value), ("empty_field", "'empty_after_generation'"),
            ("value_again", f"coalesce({value}, 'duplicates_feature:value_copy')"), ("one", "'constant_after_generation'"),
            ("label_code", "CASE WHEN m = 0 THEN 'empty_after_generation' WHEN l < 2 THEN 'constant_after_generation' END")]
    others = [c for c, _ in _SEL_INPUT if c not in _CANDIDATES]
    rows += [(c, "'not_in_training_candidates'") for c in others]
    return with_logs(" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", ({r}) IS NULL AS used, {r} AS reason, 'feature_pipeline_candidates' AS source FROM ({facts})"
        for c, r in rows))


@query("select_features_pipeline", _choice_sql())
def select_features_pipeline(spark, d):
    """TSL-1, TSL-5: candidates of a feature pipeline found from the schema, other columns excluded, the source recorded."""
    df = _choice_input(spark, d)
    choice = choose_training_columns(df, target="label", rid="row_id", feature_pipeline={},
                                     dataset_columns=logs(spark, d).columns)
    return choice_frame(df, choice).drop("position")


@query("retrain_versions", "SELECT 2 AS runs, TRUE AS same_columns, TRUE AS first_kept, count(*) AS rows_seen "
       "FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def retrain_versions(spark, d):
    """TRN-15: a configuration trained on the table, then on a version of it with lengths counted anew; both runs stay."""
    from ..ml import runs
    from ..session import ensure_checkpoint_dir
    docs = _docs_labeled(spark, d)
    base = ensure_checkpoint_dir(spark)
    config = {"algorithm": "logistic_regression", "target": "quality", "rid": "doc_id",
              "selection": {"requested": ["n_chars", "lang", "source", "toxic"]}}
    first = runs.train_run(docs, config, base)
    before = spark.read.parquet(f"{first}/predictions").count()
    second = runs.retrain(docs.withColumn("n_chars", F.length("text")), first, base)
    kept = spark.read.parquet(f"{first}/predictions").count() == before
    one, two = (runs.read_run(spark, p)["choice"]["used_feature_columns"] for p in (first, second))
    seen = spark.read.parquet(f"{second}/metrics").select((F.col("train_rows") + F.col("test_rows")).alias("rows_seen"))
    return seen.select(F.lit(2).alias("runs"), F.lit(one == two).alias("same_columns"), F.lit(kept).alias("first_kept"), "rows_seen")


@query("feature_matrix", with_logs(
    "SELECT row_id, coalesce(value, 0.0) AS value, " + ", ".join(
        f"CAST(coalesce(protocol, 'missing') = '{v}' AS DOUBLE) AS \"protocol_{v}\"" for v in ["TCP", "icmp", "udp"])
    + ", CAST(0.0 AS DOUBLE) AS protocol_nan, " + ", ".join(
        f"CAST(coalesce(event_type, 'missing') = '{v}' AS DOUBLE) AS \"event_type_{v}\""
        for v in ["click", "error", "purchase", "signup", "view"]) + ", CAST(0.0 AS DOUBLE) AS event_type_nan FROM logs"))
def feature_matrix_q(spark, d):
    mat, _ = feature_matrix(logs(spark, d), ["value", "protocol", "event_type"], keep=[F.col("row_id")])
    return mat


def _advisor_sql() -> str:
    """Per-field advice in SQL over all rows."""
    from ..operators.advisor import infer_tracking_type

    sel = _selection_sql()
    head, rows_sql = sel.rsplit("\n", 1)
    parts = []
    for i, (c, numeric) in enumerate(_SEL_INPUT):
        is_dt = c == "event_time"
        track = infer_tracking_type(c)
        track_sql = f"'{track}'" if track else "NULL"
        ratio = f"(SELECT count(*) FILTER (WHERE {c} IS NULL) / count(*) FROM src)"
        castable = "false" if (c == "label" or numeric or is_dt) else (
            f"(SELECT count({c}) > 0 AND count(*) FILTER (WHERE TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NOT NULL) "
            f"/ count({c}) >= 0.9 FROM src)")
        castable_dt = "false" if (c == "label" or numeric or is_dt) else (
            f"(SELECT count({c}) > 0 AND count(*) FILTER (WHERE TRY_CAST(CAST({c} AS VARCHAR) AS TIMESTAMP) IS NOT NULL) "
            f"/ count({c}) >= 0.9 FROM src)")
        r = f"r{i}"
        leak = f"{r} IN ('target_column', 'label_like_column', 'duplicates_target_column')"
        status = (f"CASE WHEN {leak} THEN 'suspected_label_leak' WHEN {r} = 'identifier_column' THEN 'suspected_id' "
                  f"WHEN {r} = 'raw_text_column' THEN 'raw_text' WHEN starts_with({r}, 'high_cardinality') "
                  f"THEN 'high_cardinality_risk' WHEN {r} IN ('empty_column', 'constant_column') THEN 'suggest_delete' "
                  f"WHEN {ratio} >= 0.98 THEN 'suggest_delete' WHEN {castable} OR {castable_dt} THEN 'suggest_convert' "
                  f"WHEN {ratio} >= 0.3 THEN 'high_missing' ELSE 'recommended_keep' END")
        code = (f"CASE WHEN {leak} OR {r} IN ('identifier_column', 'raw_text_column', 'empty_column', "
                f"'constant_column') THEN {r} WHEN starts_with({r}, 'high_cardinality') THEN 'high_cardinality' "
                f"WHEN {ratio} >= 0.98 THEN 'empty_column' WHEN {castable} THEN 'cast_numeric' "
                f"WHEN {castable_dt} THEN 'cast_datetime' WHEN {ratio} >= 0.3 THEN 'high_missing' ELSE 'keep' END")
        action = (f"CASE WHEN {leak} THEN 'drop_from_training' WHEN {r} = 'identifier_column' THEN "
                  f"{'\'move_to_feature_engineering\'' if track else '\'exclude_column\''} "
                  f"WHEN {r} = 'raw_text_column' OR starts_with({r}, 'high_cardinality') THEN "
                  f"'move_to_feature_engineering' WHEN {r} IN ('empty_column', 'constant_column') OR {ratio} >= 0.98 "
                  f"THEN 'exclude_column' WHEN {castable} THEN 'cast_numeric' WHEN {castable_dt} THEN 'cast_datetime' "
                  f"WHEN {ratio} >= 0.3 THEN 'fill_null' ELSE 'keep' END")
        conf = (f"CASE WHEN {r} IS NULL AND {ratio} < 0.98 AND ({castable} OR {castable_dt} OR {ratio} >= 0.3) "
                f"THEN 'medium' ELSE 'high' END")
        parts.append(f"SELECT {i} AS position, '{c}' AS field, {status} AS status, {code} AS reason_code, "
                     f"{action} AS recommended_action, {conf} AS confidence, round({ratio}, 6) AS null_ratio, "
                     f"{track_sql} AS tracking_type FROM rs")
    return head + "\n" + " UNION ALL ".join(parts)


def _advisor_groups_sql() -> str:
    head, rows = _advisor_sql().rsplit("\n", 1)
    issue = ("CASE WHEN recommended_action = 'keep' THEN 'direct_trainable' "
             "WHEN recommended_action IN ('fill_null', 'cast_numeric', 'cast_datetime') THEN 'needs_cleaning' "
             "WHEN recommended_action = 'move_to_feature_engineering' THEN 'route_to_features' "
             "WHEN recommended_action IN ('exclude_column', 'drop_from_training') THEN 'remove_from_output' END")
    group_action = ("CASE issue_type WHEN 'direct_trainable' THEN 'keep' WHEN 'needs_cleaning' THEN 'clean_first' "
                    "WHEN 'route_to_features' THEN 'move_to_feature_engineering' ELSE 'exclude_or_drop' END")
    return (head + f", adv AS ({rows}), grp AS (SELECT {issue} AS issue_type, field, position FROM adv)\n"
            f"SELECT issue_type, string_agg(field, ',' ORDER BY position) AS fields, {group_action} "
            "AS recommended_action FROM grp WHERE issue_type IS NOT NULL GROUP BY issue_type")


def _advice(spark, d):
    return adv.analyze(_selection_input(spark, d), target="label", dataset_label="label", rid="row_id")


@query("advisor_fields", _advisor_sql())
def advisor_fields(spark, d):
    res = _advice(spark, d)
    rows = [(i, a["field"], a["status"], a["reason_code"], a["recommended_action"], a["confidence"],
             float(a["null_ratio"]), a["tracking_type"]) for i, a in enumerate(res["field_advice"])]
    out = spark.createDataFrame(rows, "position int, field string, status string, reason_code string, "
                                      "recommended_action string, confidence string, null_ratio double, "
                                      "tracking_type string")
    return round6(out)


def _computed_once(sql: str) -> str:
    """The shared tables of the advisor SQL, each computed once however often it is referenced."""
    for name in ("adv", "facts", "sel", "m", "k", "s"):
        sql = sql.replace(f", {name} AS (", f", {name} AS MATERIALIZED (")
    return sql


def _ranks_sql() -> tuple[str, str, str]:
    """(CTEs up to ``facts``, SQL of the time points, SQL of the target points) of a column of the selection input."""
    head, rows = _advisor_sql().rsplit("\n", 1)
    when = r"(167[89]|16[89]\d|1[789]\d\d|2[01]\d\d|22[0-5]\d|226[0-2])"
    facts = " UNION ALL ".join(
        f"SELECT '{c}' AS name, {str(numeric).lower()} AS is_number, {str(c == 'event_time').lower()} AS is_time, "
        f"(SELECT coalesce(count(*) FILTER (WHERE TRY_CAST(CAST({c} AS VARCHAR) AS TIMESTAMP) IS NOT NULL OR "
        f"regexp_full_match(CAST({c} AS VARCHAR), '{when}')) / nullif(count({c}), 0), 0) FROM src) AS parsed, t{i} AS card FROM agg"
        for i, (c, numeric) in enumerate(_SEL_INPUT))

    def hinted(hints):
        name = "regexp_replace(lower(f.name), '[^a-z0-9]', '', 'g')"
        return "(" + " OR ".join(f"contains({name}, '{h}')" for h in hints) + ")"
    times = (f"(3 * CAST({hinted(adv.TIME_NAME_HINTS)} AS INTEGER) + CASE WHEN f.is_time THEN 5 "
             "WHEN f.parsed >= 0.9 THEN 2 ELSE 0 END)")
    targets = (f"(3 * CAST({hinted(adv.TRACKING_TARGET_HINTS)} AS INTEGER) + "
               "CAST(f.is_number OR f.card BETWEEN 2 AND 200 AS INTEGER))")
    return head + f", adv AS ({rows}), facts AS ({facts})", times, targets


def _handoff_sql() -> str:
    head, times, targets = _ranks_sql()

    def top(points, k, skip):
        return (f"coalesce((SELECT list(f.name ORDER BY {points} DESC, f.name) FROM facts f WHERE {points} > 0 "
                f"AND NOT ({skip})), [])[1:{k}]")
    record = "".join(f" || ', \"{name}\": ' || {value}" for name, value in (
        ("task_category", "'\"' || kind || '\"'"), ("tracking_type", "'\"' || tracking || '\"'"),
        ("recommended_group_key", "'\"' || field || '\"'"),
        ("recommended_time_columns", _json_list("use_times")), ("recommended_target_columns", _json_list("use_targets")),
        ("recipe_ids", _json_list("recipes")), ("reason_code", "'\"' || reason_code || '\"'")))
    return head + (
        f", m AS (SELECT field, reason_code, tracking_type, {top(times, 3, 'f.name = a.field')} AS times FROM adv a "
        "WHERE recommended_action = 'move_to_feature_engineering'), k AS (SELECT *, CASE WHEN tracking_type IS NOT NULL "
        "AND len(times) > 0 THEN 'behavior_tracking' WHEN reason_code = 'raw_text_column' THEN 'text_complexity' "
        "WHEN reason_code = 'high_cardinality' THEN 'high_cardinality' END AS kind FROM m), r AS (SELECT *, "
        "CASE kind WHEN 'text_complexity' THEN 'raw_text_column' ELSE kind END AS issue, "
        "CASE kind WHEN 'behavior_tracking' THEN tracking_type ELSE '' END AS tracking, "
        "CASE kind WHEN 'text_complexity' THEN [] ELSE times END AS use_times, CASE kind WHEN 'text_complexity' THEN [] "
        f"WHEN 'behavior_tracking' THEN {top(targets, 5, 'f.name = k.field OR f.name = k.times[1]')} "
        f"ELSE {top(targets, 5, 'f.name = k.field')} END AS use_targets, CASE kind WHEN 'text_complexity' THEN "
        "['text_complexity_core'] WHEN 'high_cardinality' THEN ['high_cardinality_frequency', 'high_cardinality_window'] "
        "ELSE ['behavior_tracking_base', CASE tracking_type WHEN 'flow' THEN 'behavior_tracking_sequence' "
        "ELSE 'behavior_tracking_window' END] END AS recipes FROM k WHERE kind IS NOT NULL)\n"
        f"SELECT field, '{{\"issue_type\": \"' || issue || '\"'{record} || '}}' AS feature_handoff FROM r")


def _steps_sql() -> str:
    head, rows = _advisor_sql().rsplit("\n", 1)
    numeric = ", ".join(f"'{c}'" for c, number in _SEL_INPUT if number)

    def fields(where):
        return f"coalesce((SELECT list(field ORDER BY position) FROM adv WHERE {where}), [])"
    kinds = [("fill-null-numeric", "advisor_fill_null_numeric", "fill_null",
              fields(f"recommended_action = 'fill_null' AND field IN ({numeric})"), '{"value": "0"}'),
             ("fill-null-text", "advisor_fill_null_text", "fill_null",
              fields(f"recommended_action = 'fill_null' AND field NOT IN ({numeric})"), '{"value": "missing"}'),
             ("cast-numeric", "advisor_cast_numeric", "cast_type", fields("recommended_action = 'cast_numeric'"),
              '{"target_type": "float"}'),
             ("cast-datetime", "advisor_cast_datetime", "cast_type", fields("recommended_action = 'cast_datetime'"),
              '{"target_type": "datetime"}'),
             ("exclude-columns", "advisor_select_columns", "select_columns",
              "CASE WHEN EXISTS (SELECT 1 FROM adv WHERE recommended_action = 'exclude_column') THEN "
              + fields("recommended_action <> 'exclude_column'") + " ELSE [] END", "{}")]
    table_sql = " UNION ALL ".join(f"SELECT '{rec}' AS recommendation_id, '{sid}' AS sid, '{step}' AS kind, {cols} AS cols, "
                                   f"'{params}' AS params" for rec, sid, step, cols, params in kinds)
    return head + (f", adv AS ({rows}), s AS ({table_sql})\nSELECT recommendation_id, '{{\"step_id\": \"' || sid || "
                   "'\", \"step_type\": \"' || kind || '\", \"enabled\": true, \"input_selector\": {\"mode\": \"explicit\", "
                   f"\"columns\": ' || {_json_list('cols')} || '}}, \"params\": ' || params || "
                   "', \"output_mode\": {\"mode\": \"inplace\"}}' AS step FROM s WHERE len(cols) > 0")


def _rankings_sql() -> str:
    head, times, targets = _ranks_sql()
    parts = [f"SELECT * FROM (SELECT '{kind}' AS kind, CAST(row_number() OVER (ORDER BY {points} DESC, f.name) AS INTEGER) "
             f"AS position, f.name AS field FROM facts f WHERE {points} > 0 AND f.name <> 'user_id') WHERE position <= {k}"
             for kind, points, k in (("time", times, 3), ("target", targets, 5))]
    return head + "\n" + " UNION ALL ".join(parts)


def _summary_sql() -> str:
    head, rows = _advisor_sql().rsplit("\n", 1)
    risky = "recommended_action IN ('drop_from_training', 'exclude_column', 'move_to_feature_engineering')"
    used = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS name, r{i} IS NULL AS used FROM rs"
                              for i, (c, _) in enumerate(_SEL_INPUT))
    return head + (f", adv AS ({rows}), sel AS ({used})\nSELECT count(*) FILTER (WHERE recommended_action = 'keep') "
                   f"AS direct_trainable_fields, count(*) FILTER (WHERE {risky}) AS high_risk_fields, count(*) FILTER "
                   f"(WHERE recommended_action <> 'keep' AND NOT {risky}) AS pending_fields, count(*) AS total_fields, "
                   "'label' AS target_column, (SELECT string_agg(name, ',' ORDER BY position) FROM sel WHERE used) "
                   "AS suggested_training_columns, (SELECT string_agg(name, ',' ORDER BY position) FROM sel WHERE NOT used) "
                   "AS excluded_training_columns FROM adv")


@query("advisor_rankings", _computed_once(_rankings_sql()))
def advisor_rankings(spark, d):
    """ADV-5/6: the best time and target columns to track users by."""
    df = _selection_input(spark, d)
    facts = adv.field_facts(df, [c for c, _ in _SEL_INPUT])
    ranked = [("time", adv.find_time_columns(facts, "user_id")), ("target", adv.find_target_columns(facts, {"user_id"}))]
    return spark.createDataFrame([(kind, k, c) for kind, names in ranked for k, c in enumerate(names, 1)],
                                 "kind string, position int, field string")


@query("advisor_summary", _computed_once(_summary_sql()))
def advisor_summary(spark, d):
    """ADV-10: the summary over all fields."""
    res = _advice(spark, d)["summary"]
    row = [",".join(v) if isinstance(v, list) else v for v in res.values()]
    return spark.createDataFrame([row], ", ".join(
        f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in res.items()))


@query("advisor_handoff", _computed_once(_handoff_sql()))
def advisor_handoff(spark, d):
    res = _advice(spark, d)
    rows = [(a["field"], json.dumps(a["feature_handoff"], ensure_ascii=False)) for a in res["field_advice"]
            if a["feature_handoff"]]
    return spark.createDataFrame(rows, "field string, feature_handoff string")


@query("advisor_groups", _advisor_groups_sql())
def advisor_groups(spark, d):
    res = _advice(spark, d)
    rows = [(g["issue_type"], ",".join(g["fields"]), g["recommended_action"]) for g in res["issue_groups"]]
    return spark.createDataFrame(rows, "issue_type string, fields string, recommended_action string")


@query("advisor_steps", _computed_once(_steps_sql()))
def advisor_steps(spark, d):
    res = _advice(spark, d)
    steps = [(s_["recommendation_id"], json.dumps(s_["step"])) for s_ in res["recommended_steps"]]
    return spark.createDataFrame(steps, "recommendation_id string, step string")


_LOF_SQL = (
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), "
    "pairs AS (SELECT a.vec_id AS rid, b.vec_id AS nbr, list_distance(a.x, b.x) AS dist FROM e a, e b "
    "WHERE a.vec_id <> b.vec_id), "
    "nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, nbr) AS rk FROM pairs) "
    "WHERE rk <= 20), kd AS (SELECT rid, max(dist) AS kdist FROM nn GROUP BY rid), "
    "lrd AS (SELECT nn.rid, 1.0 / (avg(greatest(nn.dist, kd.kdist)) + 1e-10) AS lrd FROM nn JOIN kd ON nn.nbr = kd.rid "
    "GROUP BY nn.rid), lof AS (SELECT nn.rid, avg(l2.lrd) / l1.lrd AS lof FROM nn JOIN lrd l2 ON nn.nbr = l2.rid "
    "JOIN lrd l1 ON nn.rid = l1.rid GROUP BY nn.rid, l1.lrd) SELECT rid AS vec_id, round(lof, 6) AS anomaly_score "
    "FROM lof")


@query("lof_scores", _LOF_SQL)
def lof_scores(spark, d):
    """TRN-9 on the embeddings: exact k-NN (k = 20) LOF; the oracle is a brute-force all-pairs SQL."""
    from ..ml.lof import local_outlier_factor
    out = local_outlier_factor(table(spark, d, "embeddings"), "vec_id", "embedding", 20)
    return round6(out.select("vec_id", "anomaly_score"))


@query("lof_labels", "SELECT *, CASE WHEN anomaly_score > quantile_disc(anomaly_score, 0.9) OVER () THEN 'anomaly' "
                     f"ELSE 'normal' END AS predicted_label FROM ({_LOF_SQL})")
def lof_labels(spark, d):
    from ..ml.lof import local_outlier_factor
    # the oracle's quantile is one of the rounded scores
    return round6(local_outlier_factor(table(spark, d, "embeddings"), "vec_id", "embedding", 20, digits=6))


@query("ocsvm_scores")
def ocsvm_scores(spark, d):
    """TRN-8 on the logs features (random Fourier features + linear one-class primal)."""
    from ..ml.one_class import one_class_svm
    feats = run_features(logs(spark, d), FLOW_STEPS, rid="row_id")
    return one_class_svm(feats, ["value", "status_code", "dest_port", "user_id_event_time_1440m_count", "protocol"],
                         "row_id", nu=0.1)
