"""Feature lineage and column classes (PIP-4..6).

Schema-level helpers: they look at column names and types only.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.columns import Step, normalize_name
from ..operators.features import STEP_TASK_CATEGORY

# Fixed value: normalized-name fragments that mark a business-context column.
BUSINESS_CONTEXT_HINTS = (
    "eventtime", "timestamp", "time", "sourceip", "srcip", "destip", "dstip", "host", "hostname", "sourcehost",
    "desthost", "path", "url", "uri", "method", "protocol", "status", "statuscode", "session", "request", "trace",
    "user", "userid", "account", "device", "process", "mailfrom", "rcptto", "helo", "domain", "rawmessage",
    "message", "port",
)
ROW_REFERENCE_NAMES = {"sampleindex", "sourcerowid", "recordid"}

# Fixed value: recipe family of each step type.
_RECIPE_OF = {
    "behavior_tracking_base": {"group_frequency", "group_unique_count", "group_duration", "group_event_order",
                               "time_since_previous_event", "time_until_next_event", "group_value_change_flag"},
    "behavior_tracking_window": {"time_window_count", "window_unique_count", "window_target_unique_count",
                                 "window_status_change_count", "window_spike_flag"},
    "text_complexity_core": {"text_length", "byte_length", "token_count", "shannon_entropy", "char_composition",
                             "unique_char_ratio", "regex_match_count", "pattern_flags", "keyword_count"},
    "high_cardinality_frequency": {"frequency_encode", "category_encode", "concat_fields"},
    "time_behavior_core": {"derive_time_parts"},
    "numeric_statistics_core": {"numeric_bucket", "numeric_scale", "ratio_feature", "difference_feature",
                                "status_category", "value_map"},
}


def recipe_id(step: Step) -> str:
    if step.step_type == "boolean_flag":
        return f"boolean_flag:{step.params.get('operator') or 'flag'}"
    for rid, types in _RECIPE_OF.items():
        if step.step_type in types:
            return rid
    return step.step_type or "feature_recipe"


def lineage_entry(column: str, step: Step) -> dict[str, Any]:
    """PIP-6: source columns (explicit selector columns), task category, recipe id, description."""
    cols = step.input_selector.get("columns")
    sources = [str(c) for c in cols if str(c).strip()] if isinstance(cols, list) else []
    return {
        "source_columns": sources,
        "step_type": step.step_type,
        "task_category": STEP_TASK_CATEGORY.get(step.step_type, "feature_engineering"),
        "recipe_id": recipe_id(step),
        "description": f"{step.step_type} derived from {', '.join(sources)}" if sources
        else f"{step.step_type} derived feature",
        "used_for_training": False,
    }


def _numeric_or_bool(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.BooleanType))


def classify_columns(df: DataFrame, input_columns: list[str],
                     lineage: dict[str, dict[str, Any]] | None = None) -> dict[str, Any]:
    """PIP-4: training candidates (new numeric/bool), business context, analysis-retained."""
    inputs = set(input_columns)
    train, context, retained = [], [], []
    for f in df.schema.fields:
        c = f.name
        norm = normalize_name(c)
        if c not in inputs and _numeric_or_bool(f.dataType):
            train.append(c)
        elif norm in ROW_REFERENCE_NAMES or (c in inputs and (
                any(h in norm for h in BUSINESS_CONTEXT_HINTS)
                or isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType)))):
            context.append(c)
        else:
            retained.append(c)
    lin = {k: dict(v, used_for_training=k in train) for k, v in (lineage or {}).items() if k in df.columns}
    return {"training_candidate_columns": train, "business_context_columns": context,
            "analysis_retained_columns": retained, "feature_lineage": lin}


def resolve_stored_classes(columns: list[str], stored: dict[str, list[str]]) -> dict[str, list[str]]:
    """PIP-5: stored lists win (filtered to present columns); unaccounted columns are analysis-retained."""
    present = set(columns)
    train = [c for c in stored.get("training_candidate_columns", []) if c in present]
    ctx = [c for c in stored.get("business_context_columns", []) if c in present]
    ret = [c for c in stored.get("analysis_retained_columns", []) if c in present]
    seen = set(train) | set(ctx) | set(ret)
    return {"training_candidate_columns": train, "business_context_columns": ctx,
            "analysis_retained_columns": ret + [c for c in columns if c not in seen]}
