"""Preprocess steps (PRE-1..15) and field mapping (PRF-13/14) compiled to plan fragments."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import timefn as tf
from ..plans.ops import FrameOp, RowOp
from .columns import Step, StepError, dtype_of, preprocess_target, resolve_columns


def _cols(df: DataFrame, step: Step, rid: str) -> list[str]:
    return resolve_columns(df, step, feature=False, hidden=(rid,))


def fill_null_expr(c: Column, dtype: T.DataType, value: Any) -> Column:
    if value is None:
        return c
    if isinstance(dtype, T.BooleanType) and isinstance(value, bool):
        return F.coalesce(c, F.lit(value))
    if isinstance(dtype, T.NumericType) and isinstance(value, (int, float)) and not isinstance(value, bool):
        integral = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        if integral and isinstance(value, int):
            return F.coalesce(c.cast("long"), F.lit(value).cast("long"))
        return F.coalesce(c.cast("double"), F.lit(float(value)))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        parsed = F.lit(str(value)).try_cast(dtype.simpleString())
        return F.coalesce(c, parsed) if not isinstance(value, (int, float)) else F.coalesce(
            c.cast("string"), F.lit(str(value)))
    return F.coalesce(c.cast("string"), F.lit(str(value)))


def cast_expr(c: Column, dtype: T.DataType, target: str | None) -> Column:
    if target == "string":
        return c.cast("string")
    if target == "int":
        d = c.try_cast("double") if not isinstance(dtype, T.NumericType) else c.cast("double")
        fractional = d.isNotNull() & ~F.isnan(d) & (d != F.floor(d))
        return F.when(fractional, F.raise_error(F.lit(
            "cast_type int: cannot safely cast non-equivalent float to int"))).otherwise(
            d.try_cast("long")).cast("long")
    if target == "float":
        return c.try_cast("double")
    if target == "datetime":
        return tf.to_timestamp_any(c, dtype)
    return c


def filter_condition(c: Column, operator: str, value: Any, dtype: T.DataType | None = None) -> Column:
    """Row predicate; comparisons on columns that are already numeric (or text equality on text
    columns) stay plain so the Parquet scan can take them as pushed filters."""
    s = c.cast("string")
    numeric = isinstance(dtype, T.NumericType)
    if operator in ("eq", "ne"):
        # an integral column against an integer's own text: compared as numbers, so the scan takes the filter
        text = str(value)
        integral = isinstance(dtype, T.IntegralType) and text.lstrip("-").isdigit() and str(int(text)) == text
        same = c == F.lit(int(text)) if integral else s == F.lit(text)
        return same if operator == "eq" else ~same
    if operator == "contains":
        return F.coalesce(tx.contains_ci(c, str(value)), F.lit(False))
    if operator in ("gt", "gte", "lt", "lte"):
        try:
            lit = float(str(value).strip())
            if lit != lit:
                raise ValueError
        except (TypeError, ValueError):
            return F.lit(False)
        x = c if numeric else c.try_cast("double")
        cmp = {"gt": x > lit, "gte": x >= lit, "lt": x < lit, "lte": x <= lit}[operator]
        # in a filter a null comparison already drops the row; Spark orders NaN above every
        # number while pandas compares it as false (the pushable comparison stays separate)
        if numeric and isinstance(dtype, (T.FloatType, T.DoubleType)):
            return cmp & ~F.isnan(c)
        return cmp if numeric else F.coalesce(cmp, F.lit(False))
    if operator == "is_null":
        return c.isNull()
    if operator == "not_null":
        return c.isNotNull()
    raise StepError(f"Unsupported filter operator: {operator}")


def drop_duplicates(df: DataFrame, subset: list[str] | None, rid: str) -> DataFrame:
    """Keep the first row (smallest row id) per subset.

    An aggregate, not a window: partial aggregation keeps one candidate per key
    per map task, so a hot key never lands whole in one task.
    """
    keys = list(subset) if subset else [c for c in df.columns if c != rid]
    others = [c for c in df.columns if c not in keys]
    if rid not in others:
        raise StepError("drop_duplicates needs the row id column")
    if others == [rid]:
        out = df.groupBy(*keys).agg(F.min(rid).alias(rid))
    else:
        out = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(rid)).alias("__first")) \
            .select(*keys, "__first.*")
    return out.select(*df.columns)


def compile_preprocess_step(df: DataFrame, step: Step, rid: str) -> list:
    st = step.step_type
    p = step.params
    cols = _cols(df, step, rid)
    n = len(cols)
    if st == "fill_null":
        return [RowOp([c], [(preprocess_target(c, step.output_mode, n),
                             fill_null_expr(F.col(c), dtype_of(df, c), p.get("value")))]) for c in cols]
    if st == "cast_type":
        return [RowOp([c], [(preprocess_target(c, step.output_mode, n),
                             cast_expr(F.col(c), dtype_of(df, c), p.get("target_type")))]) for c in cols]
    if st == "trim_text":
        return [RowOp([c], [(preprocess_target(c, step.output_mode, n), tx.py_strip(F.col(c)))]) for c in cols]
    if st == "lowercase":
        return [RowOp([c], [(preprocess_target(c, step.output_mode, n), F.lower(F.col(c).cast("string")))])
                for c in cols]
    if st == "normalize_datetime":
        out_fmt = tf.strftime_to_java(p.get("output_format") or "%Y-%m-%d %H:%M:%S")
        in_fmt = p.get("input_format")
        return [RowOp([c], [(preprocess_target(c, step.output_mode, n),
                             F.date_format(tf.to_timestamp_any(F.col(c), None if in_fmt else dtype_of(df, c),
                                                               fmt=in_fmt), out_fmt))]) for c in cols]
    if st == "rename_columns":
        rmap = p.get("rename_map", {})
        if not isinstance(rmap, dict):
            raise StepError("rename_map must be an object")
        valid = {str(s): str(t) for s, t in rmap.items()
                 if s in df.columns and s != rid and isinstance(t, str) and t.strip()}
        if not valid:
            return []
        return [FrameOp(list(valid), lambda d, v=valid: d.withColumnsRenamed(v), apply_to_pure=True,
                        renames=valid)]
    if st == "filter_rows":
        if not cols:
            return []
        cond = filter_condition(F.col(cols[0]), p.get("operator") or "eq", p.get("value"), dtype_of(df, cols[0]))
        return [FrameOp([cols[0]], lambda d, c=cond: d.filter(c), row_changing=True, apply_to_pure=True)]
    if st == "drop_duplicates":
        subset = cols or [c for c in p.get("subset", []) if c in df.columns]
        return [FrameOp(subset or [c for c in df.columns if c != rid],
                        lambda d, s=subset: drop_duplicates(d, s, rid), row_changing=True, apply_to_pure=True)]
    if st == "select_columns":
        selected = cols or [c for c in p.get("columns", []) if c in df.columns and c != rid]
        if not selected:
            return []
        keep = selected + [rid]
        return [FrameOp(selected, lambda d, k=keep: d.select(*k))]
    raise StepError(f"Unsupported preprocess step: {st}")


def apply_field_mapping(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """PRF-13: copy each mapped source column to its standard name (original kept).

    Entries act one after the other, so a later one reads what an earlier one wrote; the chain is
    resolved on the names and applied as one projection."""
    holds = {c: c for c in df.columns}
    for target, source in (mapping or {}).items():
        if source in holds:
            holds[target] = holds[source]
    assigns = {target: F.col(source) for target, source in holds.items() if target != source}
    return df.withColumns(assigns) if assigns else df


def apply_import_cleaning(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None,
                          rename: dict[str, str] | None = None) -> DataFrame:
    """PRF-14 / SRC-11: include (in order), then exclude, then rename; error when nothing is left."""
    cols = [c for c in (include or []) if c in df.columns] if include else list(df.columns)
    ex = set(exclude or [])
    cols = [c for c in cols if c not in ex]
    if not cols:
        raise StepError("no columns remain after cleaning")
    rmap = {s: t for s, t in (rename or {}).items() if s in cols and isinstance(t, str) and t.strip()}
    return df.select(*[F.col(c).alias(rmap.get(c, c)) for c in cols])
