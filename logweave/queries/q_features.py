"""Registered queries for row-wise features, dataset statistics, sequences and
tumbling windows (FTR-*, AGG-*, WIN-*, TWN-*), each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import charclass as cc
from ..functions import text as tx
from ..plans.chain import run_features
from .common import logs, round6, table, with_logs
from .registry import query


def _sel(mode_cols):
    return {"mode": "explicit", "columns": list(mode_cols)}


def _feat(df, steps, rid, keep):
    out = run_features(df, steps, rid=rid)
    new = [c for c in out.columns if c not in df.columns]
    return round6(out.select(*keep, *new))


def _q(s: str) -> str:
    return s.replace("'", "''")


# ------------------------------------------------------------------ text (documents)

DOC_TEXT = "coalesce(text, '')"


@query("ft_text_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length FROM documents")
def ft_text_length(spark, d):
    return _feat(table(spark, d, "documents"), [{"step_type": "text_length", "input_selector": _sel(["text"])}],
                 "doc_id", ["doc_id"])


@query("ft_select", with_logs("SELECT row_id, user_id, path FROM logs"))
def ft_select(spark, d):
    """FTR-1: only the listed columns (and the row key) stay."""
    return run_features(logs(spark, d), [{"step_type": "select_features", "input_selector": _sel(["user_id", "path"])}],
                        rid="row_id")


@query("ft_byte_length", f"SELECT doc_id, CAST(strlen({DOC_TEXT}) AS BIGINT) AS text_bytes FROM documents")
def ft_byte_length(spark, d):
    return _feat(table(spark, d, "documents"), [{"step_type": "byte_length", "input_selector": _sel(["text"])}],
                 "doc_id", ["doc_id"])


@query("ft_tokens", f"SELECT doc_id, CAST(len(regexp_extract_all({DOC_TEXT}, '{_q(tx.token_regex())}')) AS BIGINT)"
                    " AS text_tokens FROM documents")
def ft_tokens(spark, d):
    return _feat(table(spark, d, "documents"), [{"step_type": "token_count", "input_selector": _sel(["text"])}],
                 "doc_id", ["doc_id"])


@query("ft_entropy", "SELECT doc_id, round(CASE WHEN length(coalesce(text, '')) = 0 THEN 0.0 ELSE "
                     "(SELECT entropy(ch) FROM unnest(string_split(text, '')) AS u(ch)) END, 6) AS text_entropy "
                     "FROM documents")
def ft_entropy(spark, d):
    return _feat(table(spark, d, "documents"),
                 [{"step_type": "shannon_entropy", "input_selector": _sel(["text"])}], "doc_id", ["doc_id"])


def _ratio_sql(klass: str, name: str) -> str:
    cnt = f"len(regexp_extract_all({DOC_TEXT}, '{_q(klass)}'))"
    return (f"round(CASE WHEN length({DOC_TEXT}) = 0 THEN 0.0 ELSE {cnt} / length({DOC_TEXT}) END, 6) "
            f"AS text_{name}")


_SPECIAL_SQL = (f"round(CASE WHEN length({DOC_TEXT}) = 0 THEN 0.0 ELSE (length({DOC_TEXT}) - "
                f"len(regexp_extract_all({DOC_TEXT}, '{_q(cc.alnum_or_space_class())}'))) / length({DOC_TEXT}) END, 6)"
                " AS text_special_ratio")


@query("ft_char_comp", "SELECT doc_id, " + ", ".join([
    _ratio_sql(cc.digit_class(), "digit_ratio"), _ratio_sql(cc.alpha_class(), "alpha_ratio"),
    _ratio_sql(cc.upper_class("duckdb"), "upper_ratio"), _ratio_sql(cc.space_class(), "whitespace_ratio"),
    _SPECIAL_SQL]) + " FROM documents")
def ft_char_comp(spark, d):
    return _feat(table(spark, d, "documents"),
                 [{"step_type": "char_composition", "input_selector": _sel(["text"])}], "doc_id", ["doc_id"])


@query("ft_unique_chars",
       f"SELECT doc_id, CAST(CASE WHEN length({DOC_TEXT}) = 0 THEN 0 ELSE len(list_distinct(string_split(text, ''))) "
       f"END AS BIGINT) AS text_unique_char_count, round(CASE WHEN length({DOC_TEXT}) = 0 THEN 0.0 ELSE "
       f"len(list_distinct(string_split(text, ''))) / length(text) END, 6) AS text_unique_char_ratio FROM documents")
def ft_unique_chars(spark, d):
    return _feat(table(spark, d, "documents"),
                 [{"step_type": "unique_char_ratio", "input_selector": _sel(["text"])}], "doc_id", ["doc_id"])


KEYWORDS = ["the", "und", "le", "error", "password"]
_kw_terms = " + ".join(
    f"CAST((length(lower({DOC_TEXT})) - length(replace(lower({DOC_TEXT}), '{k}', ''))) / {len(k)} AS BIGINT)"
    for k in KEYWORDS)


@query("ft_keywords", f"SELECT doc_id, CAST({_kw_terms} AS BIGINT) AS text_keyword_hits FROM documents")
def ft_keywords(spark, d):
    return _feat(table(spark, d, "documents"),
                 [{"step_type": "keyword_count", "input_selector": _sel(["text"]), "params": {"keywords": KEYWORDS}}],
                 "doc_id", ["doc_id"])


REGEXES = [{"name": "digits", "pattern": "[0-9]+"}, {"name": "secret", "pattern": "(api|secret)[_-]?key"}]


@query("ft_regex", "SELECT doc_id, " + ", ".join(
    f"CAST(len(regexp_extract_all({DOC_TEXT}, '(?i){_q(r['pattern'])}')) AS BIGINT) AS text_{r['name']}_hits"
    for r in REGEXES) + " FROM documents")
def ft_regex(spark, d):
    return _feat(table(spark, d, "documents"),
                 [{"step_type": "regex_match_count", "input_selector": _sel(["text"]),
                   "params": {"patterns": REGEXES}}], "doc_id", ["doc_id"])


# RE2 has an ASCII-only \\b; the oracle spells out Python's Unicode word boundary
# around each fixed pattern (W = Python word chars).
_W = "\\p{L}\\p{N}_"
_NS, _NE = f"(?:^|[^{_W}])", f"(?:$|[^{_W}])"
_B64 = "[A-Za-z0-9+/]"
ORACLE_PATTERNS = {
    "ip": f"{_NS}(?:\\p{{Nd}}{{1,3}}\\.){{3}}\\p{{Nd}}{{1,3}}{_NE}",
    "url": f"(?i)https?://[^{cc.space_body()}]+",
    "hash": f"{_NS}[a-fA-F0-9]{{32,64}}{_NE}",
    "hex_like": f"{_NS}(?:0x)?[a-fA-F0-9]{{8,}}{_NE}",
    "base64_like": (f"(?:{_NS}[A-Za-z0-9]|[{_W}][+/])(?:{_B64}{{14,}}(?:[A-Za-z0-9]{_NE}|[+/][{_W}])"
                    f"|{_B64}{{15,}}={{1,2}}[{_W}])"),
    "email": (f"(?:{_NS}[A-Za-z0-9_]|[{_W}][.%+-])[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}{_NE}"),
}


@query("ft_patterns", "SELECT doc_id, " + ", ".join(
    f"CAST(coalesce(regexp_matches(text, '{_q(p)}'), false) AS BIGINT) AS text_has_{n}"
    for n, p in ORACLE_PATTERNS.items()) + " FROM documents")
def ft_patterns(spark, d):
    return _feat(table(spark, d, "documents"),
                 [{"step_type": "pattern_flags", "input_selector": _sel(["text"])}], "doc_id", ["doc_id"])


# ------------------------------------------------------------------ logs: row-wise

@query("ft_time_parts", with_logs(
    "SELECT row_id, CAST(hour(event_time) AS BIGINT) AS event_time_hour, "
    "CAST(isodow(event_time) - 1 AS BIGINT) AS event_time_dayofweek, "
    "CAST(CASE WHEN isodow(event_time) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS event_time_is_weekend FROM logs"))
def ft_time_parts(spark, d):
    return _feat(logs(spark, d), [{"step_type": "derive_time_parts", "input_selector": _sel(["event_time"])}],
                 "row_id", ["row_id"])


@query("ft_ratio", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity, 0), 6) "
                   "AS l_extendedprice_l_quantity_ratio FROM lineitem")
def ft_ratio(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity") \
        .withColumn("__rid", F.col("l_orderkey") * 16 + F.col("l_linenumber"))
    out = _feat(li, [{"step_type": "ratio_feature", "input_selector": _sel(["l_extendedprice", "l_quantity"])}],
                "__rid", ["l_orderkey", "l_linenumber"])
    return out.withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


@query("ft_diff", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_tax, 6) "
                  "AS l_extendedprice_l_tax_diff FROM lineitem")
def ft_diff(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax") \
        .withColumn("__rid", F.col("l_orderkey") * 16 + F.col("l_linenumber"))
    return _feat(li, [{"step_type": "difference_feature", "input_selector": _sel(["l_extendedprice", "l_tax"])}],
                 "__rid", ["l_orderkey", "l_linenumber"])


@query("ft_concat", with_logs(
    "SELECT row_id, concat_ws('|', coalesce(source_ip, ''), coalesce(dest_ip, ''), coalesce(protocol, '')) "
    "AS source_ip_dest_ip_protocol_concat FROM logs"))
def ft_concat(spark, d):
    return _feat(logs(spark, d), [{"step_type": "concat_fields",
                                   "input_selector": _sel(["source_ip", "dest_ip", "protocol"])}], "row_id", ["row_id"])


@query("ft_equal", with_logs(
    "SELECT row_id, CAST(CAST(src_port AS VARCHAR) IS NOT DISTINCT FROM CAST(dest_port AS VARCHAR) AS BIGINT) "
    "AS src_port_dest_port_equal, CAST(dest_ip IS NOT DISTINCT FROM source_ip AS BIGINT) AS ip_same FROM logs"))
def ft_equal(spark, d):
    return _feat(logs(spark, d), [
        {"step_type": "equality_flag", "input_selector": _sel(["src_port", "dest_port"])},
        {"step_type": "equality_flag", "input_selector": _sel(["dest_ip", "source_ip"]),
         "output_mode": {"output_column": "ip_same"}}], "row_id", ["row_id"])


def _ip_sql(c: str) -> str:
    oct_ = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    valid = f"regexp_full_match({c}, '{oct_}\\.{oct_}\\.{oct_}\\.{oct_}')"
    parts = f"string_split({c}, '.')"
    num = (f"(CAST({parts}[1] AS BIGINT) * 16777216 + CAST({parts}[2] AS BIGINT) * 65536 + "
           f"CAST({parts}[3] AS BIGINT) * 256 + CAST({parts}[4] AS BIGINT))")
    from ..functions.network import IPV4_PRIVATE_EXCEPTIONS, IPV4_PRIVATE_NETS, _cidr_bounds
    priv = " OR ".join(f"{num} BETWEEN {lo} AND {hi}" for lo, hi in map(_cidr_bounds, IPV4_PRIVATE_NETS))
    exc = " OR ".join(f"{num} BETWEEN {lo} AND {hi}" for lo, hi in map(_cidr_bounds, IPV4_PRIVATE_EXCEPTIONS))
    return (f"CAST(CASE WHEN coalesce({valid}, false) AND ({priv}) AND NOT ({exc}) THEN 1 ELSE 0 END AS BIGINT) "
            f"AS {c}_is_private, "
            f"CAST(CASE WHEN coalesce({valid}, false) AND {num} BETWEEN 2130706432 AND 2147483647 THEN 1 ELSE 0 END "
            f"AS BIGINT) AS {c}_is_loopback, "
            f"CAST(CASE WHEN coalesce({valid}, false) THEN 4 END AS BIGINT) AS {c}_ip_version")


@query("ft_ip", with_logs(f"SELECT row_id, {_ip_sql('source_ip')}, {_ip_sql('dest_ip')} FROM logs"))
def ft_ip(spark, d):
    return _feat(logs(spark, d), [{"step_type": "ip_features", "input_selector": _sel(["source_ip", "dest_ip"])}],
                 "row_id", ["row_id"])


def _port_sql(c: str) -> str:
    x = f"TRY_CAST({c} AS DOUBLE)"
    return (f"CAST(coalesce({x} < 1024, false) AS BIGINT) AS {c}_is_well_known, "
            f"CAST(coalesce({x} >= 1024 AND {x} < 49152, false) AS BIGINT) AS {c}_is_registered, "
            f"CAST(coalesce({x} >= 49152, false) AS BIGINT) AS {c}_is_dynamic")


@query("ft_port", with_logs(f"SELECT row_id, {_port_sql('src_port')}, {_port_sql('dest_port')} FROM logs"))
def ft_port(spark, d):
    return _feat(logs(spark, d), [{"step_type": "port_features", "input_selector": _sel(["src_port", "dest_port"])}],
                 "row_id", ["row_id"])


def _path_sql(c: str, src: str) -> str:
    s = f"coalesce({src}, '')"
    raw = f"regexp_extract({s}, '^https?://[^/?#]*([^?#]*)', 1)"
    nop = f"regexp_replace({raw}, ';[^/]*$', '')"
    p = (f"(CASE WHEN starts_with({s}, 'http://') OR starts_with({s}, 'https://') THEN "
         f"(CASE WHEN {nop} = '' THEN '/' ELSE {nop} END) ELSE split_part({s}, '?', 1) END)")
    seg = f"(string_split({p}, '/')[-1])"
    return (f"CAST(len(list_filter(string_split({p}, '/'), lambda x: x <> '')) AS BIGINT) AS {c}_depth, "
            f"CASE WHEN strpos({seg}, '.') > 0 THEN nullif(lower(string_split({seg}, '.')[-1]), '') END "
            f"AS {c}_extension, "
            f"CAST(CASE WHEN strpos({s}, '?') > 0 THEN 1 ELSE 0 END AS BIGINT) AS {c}_has_query")


@query("ft_path", "SELECT page_id, " + _path_sql("url", "url") + " FROM pages")
def ft_path(spark, d):
    return _feat(table(spark, d, "pages").select("page_id", "url"),
                 [{"step_type": "path_features", "input_selector": _sel(["url"])}], "page_id", ["page_id"])


@query("ft_path_logs", with_logs("SELECT row_id, " + _path_sql("path", "path") + " FROM logs"))
def ft_path_logs(spark, d):
    return _feat(logs(spark, d), [{"step_type": "path_features", "input_selector": _sel(["path"])}],
                 "row_id", ["row_id"])


@query("ft_status", with_logs(
    "SELECT row_id, CASE WHEN status_code IS NOT NULL THEN concat(CAST(floor(status_code / 100) AS BIGINT), 'xx') "
    "END AS status_code_category FROM logs"))
def ft_status(spark, d):
    return _feat(logs(spark, d), [{"step_type": "status_category", "input_selector": _sel(["status_code"])}],
                 "row_id", ["row_id"])


@query("ft_value_map", with_logs(
    "SELECT row_id, CAST(CASE lower(protocol) WHEN 'tcp' THEN 1 WHEN 'udp' THEN 2 WHEN 'icmp' THEN 3 ELSE 0 END "
    "AS BIGINT) AS protocol_code, CAST(CASE lower(event_type) WHEN 'error' THEN 4 WHEN 'purchase' THEN 2 ELSE 0 END "
    "AS BIGINT) AS event_type_mapped FROM logs"))
def ft_value_map(spark, d):
    return _feat(logs(spark, d), [
        {"step_type": "value_map", "input_selector": _sel(["protocol"]),
         "params": {"mapping": {"tcp": 1, "udp": 2, "icmp": 3}, "default_value": 0},
         "output_mode": {"suffix": "_code"}},
        {"step_type": "value_map", "input_selector": _sel(["event_type"]),
         "params": {"mapping": {"ERROR": 4, "Purchase": 2}, "default_value": 0}}], "row_id", ["row_id"])


@query("ft_flags", with_logs(
    "SELECT row_id, CAST(coalesce(regexp_matches(path, '(?i)ADMIN'), false) AS BIGINT) AS path_has_admin, "
    "CAST(CAST(dest_ip AS VARCHAR) = '172.16.0.10' AS BIGINT) AS dest_ip_flag, "
    "CAST(coalesce(TRY_CAST(value AS DOUBLE) > 25, false) AS BIGINT) AS value_flag, "
    "CAST(coalesce(TRY_CAST(status_code AS DOUBLE) < 300, false) AS BIGINT) AS status_ok, "
    "CAST(dest_ip IS NULL AS BIGINT) AS dest_missing, CAST(dest_ip IS NOT NULL AS BIGINT) AS dest_present, "
    "CAST(CAST(event_type AS VARCHAR) <> 'view' AS BIGINT) AS event_type_flag FROM logs"))
def ft_flags(spark, d):
    return _feat(logs(spark, d), [
        {"step_type": "boolean_flag", "input_selector": _sel(["path"]),
         "params": {"operator": "contains", "value": "ADMIN"}, "output_mode": {"output_column": "path_has_admin"}},
        {"step_type": "boolean_flag", "input_selector": _sel(["dest_ip"]),
         "params": {"operator": "eq", "value": "172.16.0.10"}},
        {"step_type": "boolean_flag", "input_selector": _sel(["value"]), "params": {"operator": "gt", "value": "25"}},
        {"step_type": "boolean_flag", "input_selector": _sel(["status_code"]),
         "params": {"operator": "lt", "value": 300}, "output_mode": {"output_column": "status_ok"}},
        {"step_type": "boolean_flag", "input_selector": _sel(["dest_ip"]), "params": {"operator": "is_null"},
         "output_mode": {"output_column": "dest_missing"}},
        {"step_type": "boolean_flag", "input_selector": _sel(["dest_ip"]), "params": {"operator": "not_null"},
         "output_mode": {"output_column": "dest_present"}},
        {"step_type": "boolean_flag", "input_selector": _sel(["event_type"]),
         "params": {"operator": "ne", "value": "view"}}], "row_id", ["row_id"])


# ------------------------------------------------------------- dataset statistics

@query("agg_freq", with_logs(
    "SELECT row_id, count(*) OVER (PARTITION BY dest_ip) AS dest_ip_freq, "
    "count(*) OVER (PARTITION BY event_type) AS event_type_freq FROM logs"))
def agg_freq(spark, d):
    return _feat(logs(spark, d), [{"step_type": "frequency_encode",
                                   "input_selector": _sel(["dest_ip", "event_type"])}], "row_id", ["row_id"])


@query("agg_code", "SELECT c_custkey, CAST(coalesce(k.code, -1) AS BIGINT) AS c_mktsegment_code, "
                   "CAST(coalesce(n.code, -1) AS BIGINT) AS c_nationkey_code FROM customer c "
                   "LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM "
                   "(SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_mktsegment IS NOT NULL)) k "
                   "ON c.c_mktsegment = k.v "
                   "LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM "
                   "(SELECT DISTINCT c_nationkey AS v FROM customer WHERE c_nationkey IS NOT NULL)) n "
                   "ON c.c_nationkey = n.v")
def agg_code(spark, d):
    return _feat(table(spark, d, "customer"), [{"step_type": "category_encode",
                                                "input_selector": _sel(["c_mktsegment", "c_nationkey"])}],
                 "c_custkey", ["c_custkey"])


def _bucket_sql(x: str, bins: int, name: str, frm: str) -> str:
    lo = f"(CASE WHEN s.mn = s.mx THEN s.mn - CASE WHEN s.mn <> 0 THEN abs(s.mn) * 0.001 ELSE 0.001 END ELSE s.mn END)"
    hi = f"(CASE WHEN s.mn = s.mx THEN s.mx + CASE WHEN s.mx <> 0 THEN abs(s.mx) * 0.001 ELSE 0.001 END ELSE s.mx END)"
    step = f"(({hi} - {lo}) / {float(bins)})"
    terms = " + ".join(f"CAST(({float(i)} * {step} + {lo}) < t.{x} AS BIGINT)" for i in range(1, bins))
    return (f"CASE WHEN t.{x} IS NOT NULL AND s.mn IS NOT NULL THEN CAST({terms} AS BIGINT) END AS {name}"), \
        f"(SELECT min({x}) AS mn, max({x}) AS mx FROM {frm}) s"


_b1, _s1 = _bucket_sql("l_extendedprice", 5, "l_extendedprice_bucket", "lineitem")


@query("agg_bucket", f"SELECT t.l_orderkey, t.l_linenumber, {_b1} FROM lineitem t, {_s1}")
def agg_bucket(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice") \
        .withColumn("__rid", F.col("l_orderkey") * 16 + F.col("l_linenumber"))
    return _feat(li, [{"step_type": "numeric_bucket", "input_selector": _sel(["l_extendedprice"]),
                       "params": {"bins": 5}}], "__rid", ["l_orderkey", "l_linenumber"])


_b2, _s2 = _bucket_sql("c_acctbal", 7, "c_acctbal_bucket", "customer")


@query("agg_bucket7", f"SELECT t.c_custkey, {_b2} FROM customer t, {_s2}")
def agg_bucket7(spark, d):
    return _feat(table(spark, d, "customer"), [{"step_type": "numeric_bucket", "input_selector": _sel(["c_acctbal"]),
                                                "params": {"bins": 7}}], "c_custkey", ["c_custkey"])


@query("agg_zscore", "SELECT t.o_orderkey, round(CASE WHEN t.o_totalprice IS NULL THEN NULL "
                     "WHEN s.sd IS NULL OR s.sd = 0 THEN 0.0 ELSE (t.o_totalprice - s.mu) / s.sd END, 6) "
                     "AS o_totalprice_scaled FROM orders t, (SELECT avg(o_totalprice) AS mu, "
                     "stddev_samp(o_totalprice) AS sd FROM orders) s")
def agg_zscore(spark, d):
    return _feat(table(spark, d, "orders"), [{"step_type": "numeric_scale", "input_selector": _sel(["o_totalprice"])}],
                 "o_orderkey", ["o_orderkey"])


@query("agg_minmax", "SELECT t.p_partkey, round(CASE WHEN t.p_retailprice IS NULL THEN NULL "
                     "WHEN s.mx = s.mn THEN 0.0 ELSE (t.p_retailprice - s.mn) / (s.mx - s.mn) END, 6) "
                     "AS p_retailprice_scaled, round(CASE WHEN s2.mx = s2.mn THEN 0.0 ELSE "
                     "(t.p_size - s2.mn) / (s2.mx - s2.mn) END, 6) AS p_size_scaled FROM part t, "
                     "(SELECT min(p_retailprice) AS mn, max(p_retailprice) AS mx FROM part) s, "
                     "(SELECT CAST(min(p_size) AS DOUBLE) AS mn, CAST(max(p_size) AS DOUBLE) AS mx FROM part) s2")
def agg_minmax(spark, d):
    return _feat(table(spark, d, "part"), [{"step_type": "numeric_scale", "input_selector": _sel(["p_retailprice",
                                                                                                  "p_size"]),
                                            "params": {"method": "minmax"}}], "p_partkey", ["p_partkey"])


@query("agg_group_freq", with_logs(
    "SELECT row_id, count(*) OVER (PARTITION BY source_ip, dest_ip) AS source_ip_dest_ip_group_count FROM logs"))
def agg_group_freq(spark, d):
    return _feat(logs(spark, d), [{"step_type": "group_frequency", "input_selector": _sel(["source_ip", "dest_ip"])}],
                 "row_id", ["row_id"])


@query("agg_group_unique", with_logs(
    "SELECT l.row_id, g.u AS source_ip_dest_ip_unique_count FROM logs l JOIN (SELECT source_ip, "
    "count(DISTINCT dest_ip) AS u FROM logs GROUP BY source_ip) g ON l.source_ip IS NOT DISTINCT FROM g.source_ip"))
def agg_group_unique(spark, d):
    return _feat(logs(spark, d), [{"step_type": "group_unique_count", "input_selector": _sel(["source_ip"]),
                                   "params": {"target_column": "dest_ip"}}], "row_id", ["row_id"])


@query("agg_duration", with_logs(
    "SELECT l.row_id, round(g.dur, 6) AS user_id_event_type_event_time_duration_seconds FROM logs l JOIN "
    "(SELECT user_id, event_type, (epoch_us(max(event_time)) - epoch_us(min(event_time))) / 1e6 AS dur "
    "FROM logs GROUP BY user_id, event_type) g ON l.user_id = g.user_id AND l.event_type = g.event_type"))
def agg_duration(spark, d):
    return _feat(logs(spark, d), [{"step_type": "group_duration", "input_selector": _sel(["user_id", "event_type"]),
                                   "params": {"time_column": "event_time"}}], "row_id", ["row_id"])


# ------------------------------------------------------------------- sequences

_SEQ_W = "(PARTITION BY source_ip ORDER BY event_time ASC NULLS LAST, row_id)"


@query("seq_order", with_logs(
    f"SELECT row_id, row_number() OVER {_SEQ_W} AS source_ip_event_time_event_order FROM logs"))
def seq_order(spark, d):
    return _feat(logs(spark, d), [{"step_type": "group_event_order", "input_selector": _sel(["source_ip"]),
                                   "params": {"time_column": "event_time"}}], "row_id", ["row_id"])


@query("seq_prev", with_logs(
    f"SELECT row_id, round((epoch_us(event_time) - epoch_us(lag(event_time) OVER {_SEQ_W})) / 1e6, 6) "
    "AS source_ip_event_time_seconds_since_previous FROM logs"))
def seq_prev(spark, d):
    return _feat(logs(spark, d), [{"step_type": "time_since_previous_event", "input_selector": _sel(["source_ip"]),
                                   "params": {"time_column": "event_time"}}], "row_id", ["row_id"])


@query("seq_next", with_logs(
    f"SELECT row_id, round((epoch_us(lead(event_time) OVER {_SEQ_W}) - epoch_us(event_time)) / 1e6, 6) "
    "AS source_ip_event_time_seconds_until_next FROM logs"))
def seq_next(spark, d):
    return _feat(logs(spark, d), [{"step_type": "time_until_next_event", "input_selector": _sel(["source_ip"]),
                                   "params": {"time_column": "event_time"}}], "row_id", ["row_id"])


@query("seq_change", with_logs(
    "SELECT row_id, CAST(CASE WHEN p IS NOT NULL AND p <> v THEN 1 ELSE 0 END AS BIGINT) "
    "AS source_ip_dest_ip_event_time_value_changed FROM (SELECT row_id, coalesce(dest_ip, '__missing__') AS v, "
    f"lag(coalesce(dest_ip, '__missing__')) OVER {_SEQ_W} AS p FROM logs)"))
def seq_change(spark, d):
    return _feat(logs(spark, d), [{"step_type": "group_value_change_flag", "input_selector": _sel(["source_ip"]),
                                   "params": {"time_column": "event_time", "target_column": "dest_ip"}}],
                 "row_id", ["row_id"])


# -------------------------------------------------------------- tumbling windows

def _bk(m: int) -> str:
    return f"(epoch_us(event_time) // {m * 60_000_000}::BIGINT)"


@query("tw_count", with_logs(
    f"SELECT row_id, count(*) OVER (PARTITION BY source_ip, {_bk(60)}) AS source_ip_event_time_60m_count, "
    f"count(*) OVER (PARTITION BY {_bk(15)}) AS event_time_15m_count FROM logs"))
def tw_count(spark, d):
    return _feat(logs(spark, d), [
        {"step_type": "time_window_count", "input_selector": _sel(["source_ip"]),
         "params": {"time_column": "event_time", "window_minutes": 60}},
        {"step_type": "time_window_count", "params": {"time_column": "event_time"}}], "row_id", ["row_id"])


@query("tw_unique", with_logs(
    f"SELECT l.row_id, g.u AS event_type_event_time_180m_unique_count FROM (SELECT *, {_bk(180)} AS b FROM logs) l "
    f"JOIN (SELECT {_bk(180)} AS b, count(DISTINCT event_type) AS u FROM logs GROUP BY 1) g ON l.b = g.b"))
def tw_unique(spark, d):
    return _feat(logs(spark, d), [{"step_type": "window_unique_count",
                                   "params": {"time_column": "event_time", "target_column": "event_type",
                                              "window_minutes": 180}}], "row_id", ["row_id"])


@query("tw_target_unique", with_logs(
    f"SELECT l.row_id, g.u AS source_ip_dest_ip_event_time_1440m_target_unique_count FROM "
    f"(SELECT *, {_bk(1440)} AS b FROM logs) l JOIN (SELECT source_ip, {_bk(1440)} AS b, "
    f"count(DISTINCT dest_ip) AS u FROM logs GROUP BY 1, 2) g ON l.source_ip = g.source_ip AND l.b = g.b"))
def tw_target_unique(spark, d):
    return _feat(logs(spark, d), [{"step_type": "window_target_unique_count", "input_selector": _sel(["source_ip"]),
                                   "params": {"time_column": "event_time", "target_column": "dest_ip",
                                              "window_minutes": 1440}}], "row_id", ["row_id"])


@query("tw_changes", with_logs(
    "SELECT row_id, CAST(sum(f) OVER (PARTITION BY source_ip, b) AS BIGINT) "
    "AS source_ip_event_type_event_time_1440m_status_change_count FROM (SELECT row_id, source_ip, b, "
    "CASE WHEN p IS NOT NULL AND p <> v THEN 1 ELSE 0 END AS f FROM (SELECT row_id, source_ip, b, v, "
    "lag(v) OVER (PARTITION BY source_ip, b ORDER BY event_time ASC NULLS LAST, row_id) AS p FROM "
    f"(SELECT *, {_bk(1440)} AS b, coalesce(event_type, '__missing__') AS v FROM logs)))"))
def tw_changes(spark, d):
    return _feat(logs(spark, d), [{"step_type": "window_status_change_count", "input_selector": _sel(["source_ip"]),
                                   "params": {"time_column": "event_time", "target_column": "event_type",
                                              "window_minutes": 1440}}], "row_id", ["row_id"])


@query("tw_spike", with_logs(
    f"SELECT row_id, CAST(count(*) OVER (PARTITION BY user_id, {_bk(1440)}) >= 3 AS BIGINT) "
    "AS user_id_event_time_1440m_spike FROM logs"))
def tw_spike(spark, d):
    return _feat(logs(spark, d), [{"step_type": "window_spike_flag", "input_selector": _sel(["user_id"]),
                                   "params": {"time_column": "event_time", "window_minutes": 1440,
                                              "threshold": 3}}], "row_id", ["row_id"])


# ------------------------------------------------------------ flagship (entry)

FLOW_STEPS = [
    {"step_type": "group_frequency", "input_selector": _sel(["user_id"])},
    {"step_type": "time_window_count", "input_selector": _sel(["user_id"]),
     "params": {"time_column": "event_time", "window_minutes": 1440}},
    {"step_type": "window_spike_flag", "input_selector": _sel(["user_id"]),
     "params": {"time_column": "event_time", "window_minutes": 1440, "threshold": 3}},
]


@query("flow_activity", with_logs(
    f"SELECT row_id, user_id, count(*) OVER (PARTITION BY user_id) AS user_id_group_count, "
    f"count(*) OVER (PARTITION BY user_id, {_bk(1440)}) AS user_id_event_time_1440m_count, "
    f"CAST(count(*) OVER (PARTITION BY user_id, {_bk(1440)}) >= 3 AS BIGINT) AS user_id_event_time_1440m_spike "
    "FROM logs"))
def flow_activity(spark, d):
    return _feat(logs(spark, d), FLOW_STEPS, "row_id", ["row_id", "user_id"])
