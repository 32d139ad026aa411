"""Registered queries for sources, sinks and profiling (SRC-*, PRF-*).

Raw text inputs (access lines, application log lines, CSV files) are derived
by Spark from the driver tables, so the work grows with the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.preprocess import apply_import_cleaning
from ..operators.profile import profile_columns
from ..session import ensure_checkpoint_dir
from ..sources import readers as rd
from .common import logs, round6, table, with_logs
from .registry import query

# ----------------------------------------------------------------- raw lines

_NGINX_LINE_SPARK = (
    "CASE WHEN row_id % 13 = 0 THEN concat('garbage line ', CAST(row_id AS STRING)) ELSE concat(source_ip, "
    "' - - [', date_format(event_time, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"', upper(event_type), ' ', path, "
    "' HTTP/1.1\" ', CAST(status_code AS STRING), ' ', CASE WHEN row_id % 9 = 0 THEN '-' ELSE "
    "CAST(src_port AS STRING) END, CASE WHEN row_id % 5 = 0 THEN '' ELSE concat(' \"', CASE WHEN row_id % 2 = 0 "
    "THEN '-' ELSE '' END, '\" \"', protocol, '/1.0 (x)\"') END) END AS line")
_NGINX_LINE_SQL = (
    "CASE WHEN row_id % 13 = 0 THEN concat('garbage line ', CAST(row_id AS VARCHAR)) ELSE concat(source_ip, "
    "' - - [', strftime(event_time, '%d/%b/%Y:%H:%M:%S'), ' +0000] \"', upper(event_type), ' ', path, "
    "' HTTP/1.1\" ', CAST(status_code AS VARCHAR), ' ', CASE WHEN row_id % 9 = 0 THEN '-' ELSE "
    "CAST(src_port AS VARCHAR) END, CASE WHEN row_id % 5 = 0 THEN '' ELSE concat(' \"', CASE WHEN row_id % 2 = 0 "
    "THEN '-' ELSE '' END, '\" \"', protocol, '/1.0 (x)\"') END) END AS line")

_GEN_LINE_SPARK = (
    "CASE row_id % 4 WHEN 0 THEN concat(date_format(event_time, 'yyyy-MM-dd HH:mm:ss'), ' ', upper(event_type), "
    "' svc-', CAST(user_id AS STRING), ' value ', CAST(value AS STRING)) "
    "WHEN 1 THEN concat(date_format(event_time, 'yyyy/MM/dd HH:mm:ss'), ',123 INFO value=', CAST(value AS STRING)) "
    "WHEN 2 THEN concat('no timestamp here: WARNING disk ', path) "
    "ELSE concat('plain text line ', CAST(row_id AS STRING)) END AS line")
_GEN_LINE_SQL = (
    "CASE row_id % 4 WHEN 0 THEN concat(strftime(event_time, '%Y-%m-%d %H:%M:%S'), ' ', upper(event_type), "
    "' svc-', CAST(user_id AS VARCHAR), ' value ', CAST(value AS VARCHAR)) "
    "WHEN 1 THEN concat(strftime(event_time, '%Y/%m/%d %H:%M:%S'), ',123 INFO value=', CAST(value AS VARCHAR)) "
    "WHEN 2 THEN concat('no timestamp here: WARNING disk ', path) "
    "ELSE concat('plain text line ', CAST(row_id AS VARCHAR)) END AS line")


def nginx_lines(spark, d):
    return logs(spark, d).selectExpr("row_id", _NGINX_LINE_SPARK)


def generic_lines(spark, d):
    return logs(spark, d).selectExpr("row_id", _GEN_LINE_SPARK)


_NG = (r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+([^"]+)"\s+(\d{3})\s+(\S+)'
       r'(?:\s+"([^"]*)"\s+"([^"]*)")?')
_NG_TAIL = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+([^"]+)"\s+(\d{3})\s+(\S+)\s+"[^"]*"\s+"[^"]*"'


def _ng(i: int) -> str:
    return f"regexp_extract(line, '{_NG}', {i})"


def _scalar(e: str) -> str:
    return f"CASE WHEN regexp_full_match({e}, '[0-9]+') THEN TRY_CAST({e} AS BIGINT) END"


_PARSE_NGINX_SQL = with_logs(
    "SELECT row_id, " + ", ".join([
        f"CASE WHEN m THEN {_ng(1)} END AS remote_addr", f"CASE WHEN m THEN {_ng(2)} END AS event_time",
        f"CASE WHEN m THEN {_ng(3)} END AS method", f"CASE WHEN m THEN {_ng(4)} END AS path",
        f"CASE WHEN m THEN {_ng(5)} END AS protocol", f"CASE WHEN m THEN {_scalar(_ng(6))} END AS status_code",
        f"CASE WHEN m THEN {_scalar(_ng(7))} END AS bytes_sent",
        f"CASE WHEN m AND t THEN {_ng(8)} END AS referer", f"CASE WHEN m AND t THEN {_ng(9)} END AS user_agent",
        "CASE WHEN m THEN 'nginx_access' ELSE 'generic_log' END AS log_type", "line AS raw_line"]) +
    f" FROM (SELECT row_id, line, regexp_matches(line, '{_NG}') AS m, regexp_matches(line, '{_NG_TAIL}') AS t "
    f"FROM (SELECT row_id, {_NGINX_LINE_SQL} FROM logs))")


@query("parse_nginx", _PARSE_NGINX_SQL)
def parse_nginx_q(spark, d):
    return rd.parse_nginx(nginx_lines(spark, d))


_GEN = r"^(\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)\s+([A-Z]+)\s+(?:([\w.\-]+)\s+)?(.*)$"
_LVL = r"\b(INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL|CRITICAL)\b"


def _gen_sql(src: str) -> str:
    g = lambda i: f"regexp_extract(line, '{_GEN}', {i})"
    return (
        f"SELECT CASE WHEN m THEN {g(1)} END AS event_time, "
        f"CASE WHEN m THEN {g(2)} ELSE nullif(regexp_extract(line, '{_LVL}', 1), '') END AS level, "
        f"CASE WHEN m THEN nullif({g(3)}, '') END AS source, CASE WHEN m THEN {g(4)} ELSE line END AS message, "
        f"'generic_log' AS log_type, line AS raw_line FROM (SELECT *, regexp_matches(line, '{_GEN}') AS m FROM {src})")


@query("parse_generic", with_logs(
    "SELECT * FROM (" + _gen_sql(f"(SELECT row_id, {_GEN_LINE_SQL} FROM logs)").replace(
        "SELECT CASE WHEN m", "SELECT row_id, CASE WHEN m", 1) + ")"))
def parse_generic_q(spark, d):
    return rd.parse_generic(generic_lines(spark, d))


@query("detect_log_format", with_logs(
    "SELECT 'access' AS input, count(*) AS sample_size, count(*) FILTER (WHERE regexp_matches(line, "
    f"'{_NG}')) AS nginx_matches FROM (SELECT row_id, {_NGINX_LINE_SQL} FROM logs ORDER BY row_id LIMIT 10) "
    "UNION ALL SELECT 'app' AS input, count(*), count(*) FILTER (WHERE regexp_matches(line, "
    f"'{_NG}')) FROM (SELECT row_id, {_GEN_LINE_SQL} FROM logs ORDER BY row_id LIMIT 10)"))
def detect_log_format(spark, d):
    a = rd.detect_format(nginx_lines(spark, d), rid="row_id").select(F.lit("access").alias("input"), "sample_size",
                                                                     "nginx_matches")
    b = rd.detect_format(generic_lines(spark, d), rid="row_id").select(F.lit("app").alias("input"), "sample_size",
                                                                       "nginx_matches")
    return a.unionByName(b)


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("read_text_log", with_logs(
    "SELECT * FROM (" + _gen_sql(f"(SELECT row_id, {_GEN_LINE_SQL} FROM logs)") + ")"))
def read_text_log_q(spark, d):
    """Writes the derived application lines (plus blank/indented noise) as a text file, reads them back."""
    lines = generic_lines(spark, d).selectExpr(
        "CASE WHEN row_id % 7 = 0 THEN concat('   ', line, '\\t') ELSE line END AS value") \
        .unionByName(logs(spark, d).where("row_id % 50 = 0").selectExpr("'   ' AS value"))
    path = _scratch(spark, "textlog")
    lines.write.mode("errorifexists").text(path)
    out = rd.read_text_log(spark, path)
    return out.drop("__row_id")


@query("read_csv", with_logs(
    "SELECT row_id, user_id, event_type, value, dest_ip, CASE WHEN row_id % 7 = 0 THEN NULL ELSE protocol END "
    "AS proto FROM logs"))
def read_csv_q(spark, d):
    src = logs(spark, d).selectExpr("row_id AS ` row_id`", "user_id AS `user  id`", "event_type AS `event type`",
                                    "value", "dest_ip",
                                    "CASE WHEN row_id % 7 = 0 THEN 'N/A' ELSE protocol END AS proto")
    path = _scratch(spark, "csv")
    src.write.mode("errorifexists").option("header", True).csv(path)
    df = rd.read_csv(spark, path)
    return df.select("row_id", "user_id", "event_type", "value", "dest_ip", "proto")


@query("projected_copy", with_logs("SELECT row_id, user_id, event_type AS kind FROM logs"))
def projected_copy_q(spark, d):
    path = rd.projected_copy(logs(spark, d), _scratch(spark, "copies"), include=["row_id", "user_id", "event_type", "path"], exclude=["path"],
                             rename={"event_type": "kind"})
    return spark.read.parquet(path)


@query("preview_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def preview_scan(spark, d):
    return rd.read_parquet(spark, f"{d}/orders.parquet", limit=500, order_by="o_orderkey") \
        .select("o_orderkey", "o_custkey", "o_totalprice")


@query("staging_preview", with_logs(
    "SELECT row_id, user_id, event_type AS kind FROM logs ORDER BY row_id LIMIT 20"))
def staging_preview(spark, d):
    cleaned = apply_import_cleaning(logs(spark, d), include=["row_id", "user_id", "event_type"],
                                    rename={"event_type": "kind"})
    return cleaned.orderBy("row_id").limit(20)


@query("json_records", "SELECT CAST(to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, "
                       "'o_orderstatus': o_orderstatus, 'o_totalprice': o_totalprice, "
                       "'o_orderdate': epoch_ms(o_orderdate), 'o_orderpriority': o_orderpriority}) AS VARCHAR) "
                       "AS record FROM orders")
def json_records_q(spark, d):
    return rd.json_records(table(spark, d, "orders"))


# -------------------------------------------------------------------- profile

_LOG_COLS = [  # (name, Spark type name, numeric, text form in SQL)
    ("row_id", "bigint", True, "CAST(row_id AS VARCHAR)"),
    ("event_time", "timestamp_ntz", False, "CAST(event_time AS VARCHAR)"),
    ("user_id", "bigint", True, "CAST(user_id AS VARCHAR)"),
    ("event_type", "string", False, "event_type"),
    ("value", "double", True, "CAST(value AS VARCHAR)"),
    ("source_ip", "string", False, "source_ip"),
    ("dest_ip", "string", False, "dest_ip"),
    ("src_port", "bigint", True, "CAST(src_port AS VARCHAR)"),
    ("dest_port", "int", True, "CAST(dest_port AS VARCHAR)"),
    ("protocol", "string", False, "protocol"),
    ("status_code", "int", True, "CAST(status_code AS VARCHAR)"),
    ("path", "string", False, "path"),
    ("label", "string", False, "label"),
]


def _profile_sql() -> str:
    parts = []
    for i, (name, dtype, numeric, txt) in enumerate(_LOG_COLS):
        lname = name.lower()
        name_ts = any(h in lname for h in ["time", "timestamp", "date", "datetime", "event_time"])
        is_label = lname in {"label", "labels", "is_anomaly", "anomaly", "target", "class", "y"} or lname.endswith(
            "_label")
        avgl = "NULL" if numeric else f"coalesce(avg(length({txt})), 0.0)"
        parse_ok = f"(TRY_CAST(v AS TIMESTAMP) IS NOT NULL OR regexp_full_match(v, '[0-9]{{4}}'))"
        ts_rule = "true" if name_ts else (
            f"(SELECT count(*) > 0 AND count(*) FILTER (WHERE regexp_matches(v, '[0-9]')) = count(*) AND "
            f"count(*) FILTER (WHERE {parse_ok}) / count(*) >= 0.8 FROM (SELECT {txt} AS v FROM logs "
            f"WHERE {name} IS NOT NULL ORDER BY row_id LIMIT 20))")
        cat = "false" if numeric else (f"(count(DISTINCT {name}) <= 30 OR count(DISTINCT {name}) <= "
                                       f"greatest(5.0, count(*) * 0.2))")
        text = "false" if numeric else (f"(coalesce(avg(length({txt})), 0.0) >= 24 OR "
                                        f"{'true' if ('message' in lname or 'raw' in lname) else 'false'})")
        samples = (f"(SELECT string_agg(v, '|' ORDER BY r) FROM (SELECT {txt} AS v, row_id AS r FROM logs "
                   f"WHERE {name} IS NOT NULL ORDER BY row_id LIMIT 5))")
        label_lit = "'label'" if is_label else "NULL"
        num_lit = "'numeric'" if numeric else "NULL"
        roles = (f"concat_ws(',', CASE WHEN {ts_rule} THEN 'timestamp' END, {label_lit}, {num_lit}, "
                 f"CASE WHEN {cat} THEN 'categorical' END, CASE WHEN {text} THEN 'text' END)")
        parts.append(
            f"SELECT {i} AS position, '{name}' AS name, '{dtype}' AS dtype, count(*) FILTER (WHERE {name} IS NULL) "
            f"AS null_count, count({name}) AS non_null_count, "
            f"round(CAST({avgl} AS DOUBLE), 6) AS avg_length, {samples} AS sample_values, {roles} AS candidate_roles "
            "FROM logs")
    return with_logs(" UNION ALL ".join(parts))


@query("column_profile", _profile_sql())
def column_profile(spark, d):
    # every column is profiled, the source key included; it also orders the samples
    full = profile_columns(logs(spark, d).withColumn("__rid", F.col("row_id")), rid="__rid")
    return round6(full.select("position", "name", "dtype", "null_count", "non_null_count", "avg_length", F.array_join("sample_values", "|").alias("sample_values"),
                              F.array_join("candidate_roles", ",").alias("candidate_roles")))
