"""Registered queries for preprocess steps (PRE-*), field mapping, chains,
built-in templates and recipe generators (PIP-1..14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import charclass as cc
from ..operators.preprocess import apply_field_mapping
from ..plans.chain import preview_step, run_features, run_preprocess
from ..plans.templates import behavior_tracking_steps, quick_task_steps, template_steps
from .common import logs, round6, table, with_logs
from .q_features import ORACLE_PATTERNS, _ip_sql, _path_sql, _port_sql, _q
from .registry import query


def _sel(cols):
    return {"mode": "explicit", "columns": list(cols)}


def _pre(df, steps, rid, keep):
    out = run_preprocess(df, steps, rid=rid)
    return round6(out.select(*[c for c in keep if c in out.columns]))


# ---------------------------------------------------------------- preprocess steps

@query("pre_fill_null", with_logs("SELECT row_id, coalesce(dest_ip, 'missing') AS dest_ip FROM logs"))
def pre_fill_null(spark, d):
    return _pre(logs(spark, d), [{"step_type": "fill_null", "input_selector": _sel(["dest_ip"]),
                                  "params": {"value": "missing"}}], "row_id", ["row_id", "dest_ip"])


@query("pre_cast", with_logs(
    "SELECT row_id, CAST(status_code AS VARCHAR) AS status_text, "
    "CAST(TRY_CAST(CAST(status_code AS VARCHAR) AS DOUBLE) AS BIGINT) AS status_int, "
    "CAST(src_port AS DOUBLE) AS src_port_float, TRY_CAST(path AS DOUBLE) AS path_float, "
    "CAST(TRY_CAST(CAST(user_id AS VARCHAR) AS DOUBLE) AS BIGINT) AS user_id FROM logs"))
def pre_cast(spark, d):
    steps = [
        {"step_type": "cast_type", "input_selector": _sel(["status_code"]), "params": {"target_type": "string"},
         "output_mode": {"mode": "new_column", "output_column": "status_text"}},
        {"step_type": "cast_type", "input_selector": _sel(["status_text"]), "params": {"target_type": "int"},
         "output_mode": {"mode": "new_column", "output_column": "status_int"}},
        {"step_type": "cast_type", "input_selector": _sel(["src_port"]), "params": {"target_type": "float"},
         "output_mode": {"mode": "new_column", "output_column": "src_port_float"}},
        {"step_type": "cast_type", "input_selector": _sel(["path"]), "params": {"target_type": "float"},
         "output_mode": {"mode": "new_column", "output_column": "path_float"}},
        {"step_type": "cast_type", "input_selector": _sel(["user_id"]), "params": {"target_type": "int"}},
    ]
    return _pre(logs(spark, d), steps, "row_id",
                ["row_id", "status_text", "status_int", "src_port_float", "path_float", "user_id"])


@query("pre_cast_datetime", with_logs(
    "SELECT row_id, strftime(TRY_CAST(CAST(event_time AS VARCHAR) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS t_text, "
    "strftime(event_time, '%Y/%m/%d %H') AS hour_text FROM logs"))
def pre_cast_datetime(spark, d):
    steps = [
        {"step_type": "cast_type", "input_selector": _sel(["event_time"]), "params": {"target_type": "string"},
         "output_mode": {"mode": "new_column", "output_column": "t_text"}},
        {"step_type": "cast_type", "input_selector": _sel(["t_text"]), "params": {"target_type": "datetime"}},
        {"step_type": "normalize_datetime", "input_selector": _sel(["t_text"])},
        {"step_type": "normalize_datetime", "input_selector": _sel(["event_time"]),
         "params": {"output_format": "%Y/%m/%d %H"},
         "output_mode": {"mode": "new_column", "output_column": "hour_text"}},
    ]
    return _pre(logs(spark, d), steps, "row_id", ["row_id", "t_text", "hour_text"])


_SP = cc.space_body()


@query("pre_trim_lower", f"SELECT conv_id, turn, regexp_replace(text, '^[{_SP}]+|[{_SP}]+$', '', 'g') AS text_clean, "
                         "lower(role) AS role FROM conversations")
def pre_trim_lower(spark, d):
    steps = [{"step_type": "trim_text", "input_selector": _sel(["text"]),
              "output_mode": {"mode": "new_column", "suffix": "_clean"}},
             {"step_type": "lowercase", "input_selector": _sel(["role"])}]
    conv = table(spark, d, "conversations").withColumn("__rid", F.col("conv_id") * 1000 + F.col("turn"))
    return _pre(conv, steps, "__rid", ["conv_id", "turn", "text_clean", "role"])


@query("pre_rename", with_logs("SELECT row_id, event_type AS kind, value AS amount FROM logs"))
def pre_rename(spark, d):
    steps = [{"step_type": "rename_columns", "params": {"rename_map": {"event_type": "kind", "value": "amount",
                                                                       "missing_col": "x", "path": " "}}}]
    return _pre(logs(spark, d), steps, "row_id", ["row_id", "kind", "amount"])


FILTERS = {
    "eq": ("event_type", "error", "CAST(event_type AS VARCHAR) = 'error'"),
    "ne": ("dest_ip", "172.16.0.10", "CAST(dest_ip AS VARCHAR) <> '172.16.0.10'"),
    "contains": ("path", "ADMIN|assets", "coalesce(regexp_matches(path, '(?i)ADMIN|assets'), false)"),
    "gt": ("value", "40", "coalesce(TRY_CAST(value AS DOUBLE) > 40, false)"),
    "gte": ("status_code", 404, "coalesce(TRY_CAST(status_code AS DOUBLE) >= 404, false)"),
    "lt": ("value", "1.5", "coalesce(TRY_CAST(value AS DOUBLE) < 1.5, false)"),
    "lte": ("user_id", "10", "coalesce(TRY_CAST(user_id AS DOUBLE) <= 10, false)"),
    "is_null": ("dest_ip", None, "dest_ip IS NULL"),
    "not_null": ("dest_ip", None, "dest_ip IS NOT NULL"),
}


def _filter_query(op, col, value, cond):
    @query(f"pre_filter_{op}", with_logs(f"SELECT row_id, {col} FROM logs WHERE {cond}"))
    def _q_(spark, d):
        return _pre(logs(spark, d), [{"step_type": "filter_rows", "input_selector": _sel([col]),
                                      "params": {"operator": op, "value": value}}], "row_id", ["row_id", col])
    return _q_


for _op, (_col, _val, _cond) in FILTERS.items():
    _filter_query(_op, _col, _val, _cond)


@query("pre_dedup", with_logs(
    "SELECT min(row_id) AS row_id, user_id, event_type FROM logs GROUP BY user_id, event_type"))
def pre_dedup(spark, d):
    return _pre(logs(spark, d), [{"step_type": "drop_duplicates", "params": {"subset": ["user_id", "event_type"]}}],
                "row_id", ["row_id", "user_id", "event_type"])


@query("pre_select_dedup", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def pre_select_dedup(spark, d):
    steps = [{"step_type": "select_columns", "params": {"columns": ["c_nationkey", "c_mktsegment", "nope"]}},
             {"step_type": "drop_duplicates"}]
    return _pre(table(spark, d, "customer"), steps, "c_custkey", ["c_nationkey", "c_mktsegment"])


@query("apply_mapping", with_logs(
    "SELECT row_id, event_type AS method, value AS request_duration, path, source_ip AS host FROM logs"))
def apply_mapping_q(spark, d):
    df = apply_field_mapping(logs(spark, d), {"method": "event_type", "request_duration": "value",
                                              "host": "source_ip", "label": None, "user_agent": "absent"})
    return round6(df.select("row_id", "method", "request_duration", "path", "host"))


# ------------------------------------------------------------------------ chains

@query("chain_preprocess", with_logs(
    "SELECT row_id, lower(protocol) AS protocol, coalesce(dest_ip, 'missing') AS dest_ip, "
    "CAST(value AS VARCHAR) AS value_text, status_code FROM logs "
    "WHERE CAST(status_code AS VARCHAR) <> '404' AND coalesce(regexp_matches(lower(protocol), '(?i)^(tcp|udp)$'), "
    "false)"))
def chain_preprocess(spark, d):
    steps = [
        {"step_type": "lowercase", "input_selector": _sel(["protocol"])},
        {"step_type": "fill_null", "input_selector": _sel(["dest_ip"]), "params": {"value": "missing"}},
        {"step_type": "filter_rows", "input_selector": _sel(["status_code"]), "params": {"operator": "ne",
                                                                                        "value": "404"}},
        {"step_type": "trim_text", "enabled": False, "input_selector": _sel(["path"])},
        {"step_type": "filter_rows", "input_selector": _sel(["protocol"]),
         "params": {"operator": "contains", "value": "^(tcp|udp)$"}},
        {"step_type": "cast_type", "input_selector": _sel(["value"]), "params": {"target_type": "string"},
         "output_mode": {"mode": "new_column", "output_column": "value_text"}},
        {"step_type": "select_columns", "params": {"columns": ["row_id", "protocol", "dest_ip", "value_text",
                                                               "status_code"]}},
    ]
    out = run_preprocess(logs(spark, d), steps, rid="row_id")
    return round6(out)


def _entropy_sql(expr: str) -> str:
    return (f"CASE WHEN length(coalesce({expr}, '')) = 0 THEN 0.0 ELSE "
            f"(SELECT entropy(ch) FROM unnest(string_split({expr}, '')) AS u(ch)) END")


def _ratio_sql(expr: str, klass: str) -> str:
    t = f"coalesce({expr}, '')"
    return f"CASE WHEN length({t}) = 0 THEN 0.0 ELSE len(regexp_extract_all({t}, '{_q(klass)}')) / length({t}) END"


def _comp_sql(expr: str, prefix: str) -> str:
    t = f"coalesce({expr}, '')"
    special = (f"CASE WHEN length({t}) = 0 THEN 0.0 ELSE (length({t}) - len(regexp_extract_all({t}, "
               f"'{_q(cc.alnum_or_space_class())}'))) / length({t}) END")
    return ", ".join([
        f"round({_ratio_sql(expr, cc.digit_class())}, 6) AS {prefix}_digit_ratio",
        f"round({_ratio_sql(expr, cc.alpha_class())}, 6) AS {prefix}_alpha_ratio",
        f"round({_ratio_sql(expr, cc.upper_class('duckdb'))}, 6) AS {prefix}_upper_ratio",
        f"round({_ratio_sql(expr, cc.space_class())}, 6) AS {prefix}_whitespace_ratio",
        f"round({special}, 6) AS {prefix}_special_ratio",
    ])


def _bucket5_sql(x: str, name: str) -> str:
    lo = "(CASE WHEN mn = mx THEN mn - CASE WHEN mn <> 0 THEN abs(mn) * 0.001 ELSE 0.001 END ELSE mn END)"
    hi = "(CASE WHEN mn = mx THEN mx + CASE WHEN mx <> 0 THEN abs(mx) * 0.001 ELSE 0.001 END ELSE mx END)"
    step = f"(({hi} - {lo}) / 5.0)"
    terms = " + ".join(f"CAST(({float(i)} * {step} + {lo}) < {x} AS BIGINT)" for i in range(1, 5))
    return f"CASE WHEN {x} IS NOT NULL AND mn IS NOT NULL THEN CAST({terms} AS BIGINT) END AS {name}"


NGINX_MAPPING = {"method": "event_type", "user_agent": "protocol", "bytes_sent": "src_port",
                 "request_duration": "value"}

_NGINX_SQL = with_logs(
    "SELECT l.row_id, " + _path_sql("path", "l.path") + ", "
    "CASE WHEN l.status_code IS NOT NULL THEN concat(CAST(floor(l.status_code / 100) AS BIGINT), 'xx') END "
    "AS status_code_category, CAST(coalesce(k.code, -1) AS BIGINT) AS method_code, "
    "CAST(length(l.protocol) AS BIGINT) AS user_agent_length, round(" + _entropy_sql("l.path") + ", 6) AS path_entropy, "
    + _comp_sql("l.protocol", "user_agent") + ", "
    "CAST(coalesce(regexp_matches(l.path, '(?i)admin'), false) AS BIGINT) AS path_has_admin, "
    "(SELECT " + _bucket5_sql("CAST(l.src_port AS DOUBLE)", "b") + " FROM (SELECT CAST(min(src_port) AS DOUBLE) AS mn, "
    "CAST(max(src_port) AS DOUBLE) AS mx FROM logs)) AS bytes_sent_bucket, "
    "(SELECT " + _bucket5_sql("l.value", "b") + " FROM (SELECT min(value) AS mn, max(value) AS mx FROM logs)) "
    "AS request_duration_bucket "
    "FROM logs l LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM "
    "(SELECT DISTINCT event_type AS v FROM logs WHERE event_type IS NOT NULL)) k ON l.event_type = k.v")


@query("chain_nginx", _NGINX_SQL)
def chain_nginx(spark, d):
    base = apply_field_mapping(logs(spark, d), NGINX_MAPPING)
    out = run_features(base, template_steps("nginx_access"), rid="row_id")
    new = [c for c in out.columns if c not in base.columns]
    return round6(out.select("row_id", *new))


_KW = ["error", "exception", "failed", "timeout", "denied"]


def _kw_sql(expr: str, kws) -> str:
    t = f"lower(coalesce({expr}, ''))"
    return " + ".join(f"CAST((length({t}) - length(replace({t}, '{k}', ''))) / {len(k)} AS BIGINT)" for k in kws)


@query("chain_runtime", "SELECT doc_id, CAST(length(text) AS BIGINT) AS raw_message_length, "
                        f"round({_entropy_sql('text')}, 6) AS raw_message_entropy, "
                        f"CAST({_kw_sql('text', _KW)} AS BIGINT) AS raw_message_keyword_hits, "
                        + ", ".join(f"CAST(coalesce(regexp_matches(text, '{_q(ORACLE_PATTERNS[n])}'), false) AS BIGINT) "
                                    f"AS raw_message_has_{n}" for n in ["ip", "url", "hash", "base64_like", "email"])
                        + ", count(*) OVER (PARTITION BY source) AS host_freq, "
                        "count(*) OVER (PARTITION BY lang) AS process_name_freq FROM documents")
def chain_runtime(spark, d):
    base = apply_field_mapping(table(spark, d, "documents"),
                               {"raw_message": "text", "host": "source", "process_name": "lang"})
    out = run_features(base, template_steps("program_runtime"), rid="doc_id")
    new = [c for c in out.columns if c not in base.columns]
    return round6(out.select("doc_id", *new))


@query("chain_nta", with_logs(
    f"SELECT row_id, {_ip_sql('source_ip')}, {_ip_sql('dest_ip')}, {_port_sql('src_port')}, {_port_sql('dest_port')}, "
    "CAST(CASE lower(protocol) WHEN 'tcp' THEN 1 WHEN 'udp' THEN 2 WHEN 'icmp' THEN 3 ELSE 0 END AS BIGINT) "
    "AS protocol_code, count(*) OVER (PARTITION BY source_ip, dest_ip) AS flow_pair_count FROM logs"))
def chain_nta(spark, d):
    base = logs(spark, d)
    out = run_features(base, template_steps("nta_flow"), rid="row_id")
    new = [c for c in out.columns if c not in base.columns]
    return round6(out.select("row_id", *new))


# ----------------------------------------------------------------------- recipes

def _bk(m: int, t: str = "event_time") -> str:
    return f"(epoch_us({t}) // {m * 60_000_000}::BIGINT)"


_W = "PARTITION BY source_ip ORDER BY event_time ASC NULLS LAST, row_id"


@query("recipe_behavior", with_logs(
    "SELECT row_id, source_ip_event_count, round(source_ip_duration_seconds, 6) AS source_ip_duration_seconds, "
    "source_ip_dest_ip_unique_count, source_ip_15m_count, source_ip_15m_spike, source_ip_dest_ip_15m_unique_count, "
    "source_ip_event_order, round(source_ip_seconds_since_previous, 6) AS source_ip_seconds_since_previous, "
    "round(source_ip_seconds_until_next, 6) AS source_ip_seconds_until_next, source_ip_dest_ip_changed, "
    "CAST(sum(bchg) OVER (PARTITION BY source_ip, b) AS BIGINT) AS source_ip_dest_ip_15m_change_count FROM ("
    "SELECT x.*, CASE WHEN bp IS NOT NULL AND bp <> v THEN 1 ELSE 0 END AS bchg FROM ("
    "SELECT l.row_id, l.source_ip, l.b, l.v, count(*) OVER (PARTITION BY l.source_ip) AS source_ip_event_count, "
    "(epoch_us(max(l.event_time) OVER (PARTITION BY l.source_ip)) - epoch_us(min(l.event_time) OVER "
    "(PARTITION BY l.source_ip))) / 1e6 AS source_ip_duration_seconds, g.u AS source_ip_dest_ip_unique_count, "
    "count(*) OVER (PARTITION BY l.source_ip, l.b) AS source_ip_15m_count, "
    "CAST(count(*) OVER (PARTITION BY l.source_ip, l.b) >= 6 AS BIGINT) AS source_ip_15m_spike, "
    "w.u AS source_ip_dest_ip_15m_unique_count, "
    "row_number() OVER (PARTITION BY l.source_ip ORDER BY l.event_time ASC NULLS LAST, l.row_id) "
    "AS source_ip_event_order, (epoch_us(l.event_time) - epoch_us(lag(l.event_time) OVER (PARTITION BY l.source_ip "
    "ORDER BY l.event_time ASC NULLS LAST, l.row_id))) / 1e6 AS source_ip_seconds_since_previous, "
    "(epoch_us(lead(l.event_time) OVER (PARTITION BY l.source_ip ORDER BY l.event_time ASC NULLS LAST, l.row_id)) "
    "- epoch_us(l.event_time)) / 1e6 AS source_ip_seconds_until_next, "
    "CAST(CASE WHEN lag(l.v) OVER (PARTITION BY l.source_ip ORDER BY l.event_time ASC NULLS LAST, l.row_id) "
    "IS NOT NULL AND lag(l.v) OVER (PARTITION BY l.source_ip ORDER BY l.event_time ASC NULLS LAST, l.row_id) <> l.v "
    "THEN 1 ELSE 0 END AS BIGINT) AS source_ip_dest_ip_changed, "
    "lag(l.v) OVER (PARTITION BY l.source_ip, l.b ORDER BY l.event_time ASC NULLS LAST, l.row_id) AS bp "
    f"FROM (SELECT *, {_bk(15)} AS b, coalesce(dest_ip, '__missing__') AS v FROM logs) l "
    "JOIN (SELECT source_ip, count(DISTINCT dest_ip) AS u FROM logs GROUP BY 1) g ON l.source_ip = g.source_ip "
    f"JOIN (SELECT source_ip, {_bk(15)} AS b, count(DISTINCT dest_ip) AS u FROM logs GROUP BY 1, 2) w "
    "ON l.source_ip = w.source_ip AND l.b = w.b) x)"))
def recipe_behavior(spark, d):
    base = logs(spark, d)
    steps = behavior_tracking_steps("source_ip", "event_time", ["dest_ip"], {"base", "window", "sequence"}, "flow",
                                    base.columns)
    out = run_features(base, steps, rid="row_id")
    new = [c for c in out.columns if c not in base.columns]
    return round6(out.select("row_id", *new))


@query("recipe_text", "SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length, "
                      "CAST(strlen(coalesce(text, '')) AS BIGINT) AS text_bytes, "
                      "CAST(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_\\-.:/]+')) AS BIGINT) "
                      f"AS text_tokens, round({_entropy_sql('text')}, 6) AS text_entropy, "
                      f"CAST({_kw_sql('text', ['error', 'failed', 'timeout', 'exception', 'denied'])} AS BIGINT) "
                      "AS text_keyword_hits, "
                      + ", ".join(f"CAST(coalesce(regexp_matches(text, '{_q(p)}'), false) AS BIGINT) AS text_has_{n}"
                                  for n, p in ORACLE_PATTERNS.items()) + " FROM documents")
def recipe_text(spark, d):
    base = table(spark, d, "documents")
    out = run_features(base, quick_task_steps("text_complexity", ["text"], base.columns), rid="doc_id")
    new = [c for c in out.columns if c not in base.columns]
    return round6(out.select("doc_id", *new))


@query("recipe_cardinality", with_logs(
    "SELECT l.row_id, count(*) OVER (PARTITION BY l.dest_ip) AS dest_ip_freq, "
    f"count(*) OVER (PARTITION BY l.dest_ip, {_bk(15, 'l.event_time')}) AS dest_ip_event_time_15m_count, "
    f"CAST(count(*) OVER (PARTITION BY l.dest_ip, {_bk(15, 'l.event_time')}) >= 10 AS BIGINT) "
    "AS dest_ip_event_time_15m_spike, w.u AS dest_ip_source_ip_event_time_15m_target_unique_count FROM logs l "
    f"JOIN (SELECT dest_ip, {_bk(15)} AS b, count(DISTINCT source_ip) AS u FROM logs GROUP BY 1, 2) w "
    f"ON l.dest_ip IS NOT DISTINCT FROM w.dest_ip AND {_bk(15, 'l.event_time')} = w.b"))
def recipe_cardinality(spark, d):
    base = logs(spark, d)
    steps = quick_task_steps("high_cardinality", ["dest_ip"], base.columns, ["source_ip"], "event_time")
    out = run_features(base, steps, rid="row_id")
    new = [c for c in out.columns if c not in base.columns]
    return round6(out.select("row_id", *new))


@query("recipe_time", with_logs(
    "SELECT row_id, CAST(hour(event_time) AS BIGINT) AS event_time_hour, "
    "CAST(isodow(event_time) - 1 AS BIGINT) AS event_time_dayofweek, "
    "CAST(CASE WHEN isodow(event_time) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS event_time_is_weekend, "
    f"count(*) OVER (PARTITION BY user_id, {_bk(15)}) AS user_id_event_time_15m_count, "
    f"CAST(count(*) OVER (PARTITION BY user_id, {_bk(15)}) >= 10 AS BIGINT) AS user_id_event_time_15m_spike FROM logs"))
def recipe_time(spark, d):
    base = logs(spark, d)
    steps = quick_task_steps("time_behavior", ["event_time"], base.columns, ["user_id"], "event_time")
    out = run_features(base, steps, rid="row_id")
    new = [c for c in out.columns if c not in base.columns]
    return round6(out.select("row_id", *new))


@query("recipe_numeric", with_logs(
    "SELECT row_id, " + _bucket5_sql("value", "value_bucket") + ", round(CASE WHEN value IS NULL THEN NULL "
    "WHEN sd IS NULL OR sd = 0 THEN 0.0 ELSE (value - mu) / sd END, 6) AS value_scaled FROM logs, "
    "(SELECT min(value) AS mn, max(value) AS mx, avg(value) AS mu, stddev_samp(value) AS sd FROM logs)"))
def recipe_numeric(spark, d):
    base = logs(spark, d)
    out = run_features(base, quick_task_steps("numeric_statistics", ["value"], base.columns), rid="row_id")
    new = [c for c in out.columns if c not in base.columns]
    return round6(out.select("row_id", *new))


@query("step_diff", with_logs(
    "SELECT row_id, user_id, event_type, count(*) OVER (PARTITION BY user_id) AS user_id_group_count "
    "FROM logs ORDER BY row_id LIMIT 20"))
def step_diff(spark, d):
    base = logs(spark, d).select("row_id", "user_id", "event_type")
    steps = [{"step_type": "text_length", "enabled": False, "input_selector": _sel(["event_type"])},
             {"step_type": "group_frequency", "input_selector": _sel(["user_id"])}]
    diff = preview_step(base, steps, 1, kind="feature", limit=20, rid="row_id")
    assert diff["added_columns"] == ["user_id_group_count"], diff["added_columns"]
    return diff["after_rows"]


@query("step_diff_summary", with_logs(
    "SELECT count(*) AS before_count, count(*) FILTER (WHERE event_type = 'error') AS after_count, '' AS added_columns, "
    "'' AS removed_columns, (SELECT string_agg(row_id, ',' ORDER BY row_id) FROM (SELECT row_id FROM logs ORDER BY row_id "
    "LIMIT 20)) AS before_rows FROM logs"))
def step_diff_summary(spark, d):
    """PIP-3: counts, column changes and before-rows of a step that filters rows."""
    steps = [{"step_type": "filter_rows", "input_selector": _sel(["event_type"]),
              "params": {"operator": "eq", "value": "error"}}]
    diff = preview_step(logs(spark, d).select("row_id", "event_type"), steps, 0, kind="preprocess", limit=20, rid="row_id")
    rows = ",".join(str(r["row_id"]) for r in diff["before_rows"].collect())
    return spark.createDataFrame([(diff["before_count"], diff["after_count"], ",".join(diff["added_columns"]),
                                   ",".join(diff["removed_columns"]), rows)],
                                 "before_count long, after_count long, added_columns string, removed_columns string, "
                                 "before_rows string")
