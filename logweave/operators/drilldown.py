"""Signal drill-down over the whole prediction table (DRL-1..8).

The reference computes these in the browser on <= 50 preview rows; here they
run on every row.  A selected sample is identified by its row key; each step
is a filter + bounded top-k or a single aggregate, never a per-group window.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..rowid import with_dense_index
from ..functions.text import py_strip

DEFAULT_CONTEXT = ["event_time", "source_ip", "dest_ip", "host", "source_host", "dest_host", "process_name",
                   "protocol", "method", "path", "status_code"]
DEFAULT_COMPARABLE = ["source_ip", "dest_ip", "host", "process_name", "protocol", "method", "path", "status_code"]
ANCHOR_PREFERRED = ["source_ip", "dest_ip", "host", "source_host", "dest_host", "process_name", "protocol", "method",
                    "path"]
TIME_PREFERRED = ["event_time", "timestamp", "time", "log_time"]


def signal_base(signal_column: str) -> str:
    """DRL-4."""
    s = re.sub(r"_(\d+)m_(unique_count|count|spike)$", "", signal_column, flags=re.IGNORECASE)
    return re.sub(r"_(group_count|unique_count|count|spike)$", "", s, flags=re.IGNORECASE)


def window_minutes(signal_column: str) -> int | None:
    m = re.search(r"_(\d+)m_(?:unique_count|count|spike)$", signal_column, flags=re.IGNORECASE)
    if not m:
        return None
    v = int(m.group(1))
    return v if v > 0 else None


def _display(c: str):
    """Trimmed text, '' for null/blank (the UI's comparable form)."""
    return F.coalesce(py_strip(F.col(c).cast("string")), F.lit(""))


def signal_samples(pred: DataFrame, signal: str, key: str, limit: int = 8) -> DataFrame:
    """DRL-1: rows with signal > 0, largest first (ties in row order)."""
    v = F.col(signal).try_cast("double")
    return pred.where(v > 0).orderBy(v.desc(), F.col(key)).limit(limit)


def sample_context(row: dict[str, Any], signal: str, context_columns: list[str] | None = None) -> list[tuple[str, str]]:
    """DRL-2: up to 8 (label, value) pairs from the preferred columns, then signal-related columns."""
    preferred = context_columns or DEFAULT_CONTEXT
    base = signal_base(signal)

    def shown(v):
        return v is not None and str(v).strip() != ""

    out = [(c, str(row[c])) for c in preferred if c in row and shown(row[c])]
    for c, v in row.items():
        if len(out) >= 8:
            break
        if c in preferred or c.startswith("__") or not shown(v):
            continue
        if base and base in c:
            out.append((c, str(v)))
    return out[:8]


def sample_matches(pred: DataFrame, row: dict[str, Any], columns: list[str] | None = None,
                   limit: int = 6) -> DataFrame:
    """DRL-3: for each comparable column, rows sharing the sample's value; keep counts > 1 (one aggregate)."""
    cols = [(i, c) for i, c in enumerate(columns or DEFAULT_COMPARABLE)
            if c in pred.columns and row.get(c) is not None and str(row[c]).strip() != ""]
    spark = pred.sparkSession
    if not cols:
        return spark.createDataFrame([], "position int, label string, count long")
    counts = pred.agg(*[F.count_if(_display(c) == F.lit(str(row[c]).strip())).alias(f"c{i}") for i, c in cols])
    entries = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f"{c}={row[c]}").alias("label"),
                                 F.col(f"c{i}").alias("count")) for i, c in cols])
    return counts.select(F.explode(entries).alias("e")).select("e.*").where(F.col("count") > 1) \
        .orderBy("position").limit(limit)


def anchor_columns(pred: DataFrame, row: dict[str, Any], signal: str) -> list[str]:
    """DRL-5: candidate columns ranked by match count (> 1), top 2."""
    base = signal_base(signal)
    cands = [c for c in ANCHOR_PREFERRED if c in row and row[c] is not None and str(row[c]).strip() != ""]
    for c in row:
        if base and base in c and row[c] is not None and str(row[c]).strip() != "" and c not in cands:
            cands.append(c)
    cands = [c for c in cands if c in pred.columns]
    if not cands:
        return []
    r = pred.agg(*[F.count_if(_display(c) == F.lit(str(row[c]).strip())).alias(f"c{i}")
                   for i, c in enumerate(cands)]).first()
    ranked = [(c, r[f"c{i}"]) for i, c in enumerate(cands) if r[f"c{i}"] > 1]
    ranked.sort(key=lambda x: -x[1])
    return [c for c, _ in ranked[:2]]


def time_column(row: dict[str, Any]) -> str | None:
    """DRL-8."""
    for c in TIME_PREFERRED:
        if row.get(c) is not None:
            return c
    return next((c for c in row if "time" in c.lower() and row[c] is not None), None)


def _window(pred: DataFrame, row: dict[str, Any], signal: str, anchors: list[str]):
    """(time column, rows of the sample's tumbling window, window start, window end), or None."""
    tcol = time_column(row)
    minutes = window_minutes(signal)
    if not tcol or not minutes:
        return None
    t = F.col(tcol).cast("timestamp")
    width = minutes * 60
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.lit(row[tcol]).cast("timestamp")) / width) * width)
    end = start + F.expr(f"INTERVAL {width} SECONDS")
    cond = t.isNotNull() & (t >= start) & (t < end)
    for c in anchors:
        cond = cond & (_display(c) == F.lit(str(row[c]).strip()))
    return tcol, pred.where(cond), start, end


def window_rows(pred: DataFrame, row: dict[str, Any], signal: str, key: str, anchors: list[str] | None = None) -> DataFrame | None:
    """DRL-6: all rows of the sample's window that share its anchor values, in time order: ``position`` (from 1),
    ``window_rows`` (their number), ``window_start``, ``window_end``, ``is_selected``."""
    anchors = anchor_columns(pred, row, signal) if anchors is None else anchors
    found = _window(pred, row, signal, anchors)
    if found is None:
        return None
    tcol, window, start, end = found
    rows = with_dense_index(window, [F.col(tcol).cast("timestamp"), F.col(key)], "__i")
    total = rows.agg(F.count("*").alias("window_rows"))
    cols = [c for c in dict.fromkeys([key, tcol, *anchors, signal, "anomaly_score", "predicted_label", "actual_label"])
            if c in pred.columns]
    return rows.crossJoin(F.broadcast(total)).select(
        (F.col("__i") + 1).alias("position"), "window_rows", start.alias("window_start"), end.alias("window_end"),
        (F.col(key) == F.lit(row[key])).alias("is_selected"), *cols)


def window_detail(pred: DataFrame, row: dict[str, Any], signal: str, key: str, anchors: list[str] | None = None,
                  neighbours: int = 2) -> DataFrame | None:
    """DRL-6/7: rows of the sample's tumbling window sharing its anchor values, with the
    position relative to the sample (-2..+2 neighbourhood flagged)."""
    anchors = anchor_columns(pred, row, signal) if anchors is None else anchors
    found = _window(pred, row, signal, anchors)
    if found is None:
        return None
    tcol, window, _, _ = found
    t = F.col(tcol).cast("timestamp")
    sel_t = F.lit(row[tcol]).cast("timestamp")
    sel_key = row[key]
    before_sel = (t < sel_t) | ((t == sel_t) & (F.col(key) < F.lit(sel_key)))
    after_sel = (t > sel_t) | ((t == sel_t) & (F.col(key) > F.lit(sel_key)))
    # the windows below run over at most ``neighbours`` rows (after the limit)
    prev = window.where(before_sel).orderBy(t.desc(), F.col(key).desc()).limit(neighbours) \
        .withColumn("__rel", -F.row_number().over(Window.orderBy(F.col(tcol).desc(), F.col(key).desc())))
    nxt = window.where(after_sel).orderBy(t, F.col(key)).limit(neighbours) \
        .withColumn("__rel", F.row_number().over(Window.orderBy(F.col(tcol), F.col(key))))
    cur = window.where(F.col(key) == F.lit(sel_key)).withColumn("__rel", F.lit(0))
    cols = [c for c in dict.fromkeys([key, tcol, *anchors, signal, "anomaly_score", "predicted_label", "actual_label"])
            if c in pred.columns]
    return prev.unionByName(cur).unionByName(nxt).select(F.col("__rel").cast("int").alias("relative_position"), *cols)
