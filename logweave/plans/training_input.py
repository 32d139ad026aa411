"""Which columns a training run uses, and why: from a list, a feature pipeline, a preprocess output or all (TSL-1, TSL-5)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.selection import DEFAULT_MAX_CATEGORICAL_CARDINALITY, select_training_columns
from .lineage import classify_columns, resolve_stored_classes

CLASSES = ("training_candidate_columns", "business_context_columns", "analysis_retained_columns")


def feature_classes(df: DataFrame, stored: dict[str, Any] | None, upstream: list[str] | None) -> dict[str, Any]:
    """TSL-5: the stored classes of a feature pipeline's output; without any, classes from the schema, where a numeric
    column that is not among the ``upstream`` columns is a candidate."""
    stored = stored or {}
    present = set(df.columns)
    if any(c in present for k in CLASSES for c in stored.get(k) or []):
        classes = resolve_stored_classes(df.columns, {k: stored.get(k) or [] for k in CLASSES})
        lineage = {c: v for c, v in (stored.get("feature_lineage") or {}).items() if c in present and isinstance(v, dict)}
        return classes | {"feature_lineage": lineage}
    return classify_columns(df, list(upstream or []))


def choose_training_columns(df: DataFrame, requested: list[str] | None = None, target: str | None = None,
                            dataset_label: str | None = None, rid: str | None = None,
                            feature_pipeline: dict[str, Any] | None = None, preprocess_columns: list[str] | None = None,
                            dataset_columns: list[str] | None = None,
                            max_categorical_cardinality: int = DEFAULT_MAX_CATEGORICAL_CARDINALITY) -> dict[str, Any]:
    """TSL-1: requested columns and where they come from (``selection_source``), then the rules of TSL-2 or TSL-3.

    ``explicit_request``: the ``requested`` columns that exist.  ``feature_pipeline_candidates``: ``feature_pipeline``
    is given (a dictionary of stored classes, perhaps empty), so its candidates are taken and all other columns are
    excluded as ``not_in_training_candidates``.  ``preprocess_pipeline_defaults``: the columns of a preprocess output.
    ``dataset_safe_defaults``: all columns.  Column names only; the rules' facts come from one pass over the data.
    """
    columns = [c for c in df.columns if c != rid]
    rows = df.select(*([F.col(f"`{rid}`")] if rid else []), *(F.col(f"`{c}`") for c in columns))
    classes: dict[str, Any] = {"business_context_columns": [], "feature_lineage": {}}
    if feature_pipeline is not None:
        classes = feature_classes(df.select(*(F.col(f"`{c}`") for c in columns)), feature_pipeline, preprocess_columns or dataset_columns)
    if requested:
        source, wanted = "explicit_request", [c for c in dict.fromkeys(requested) if c in columns]
    elif feature_pipeline is not None:
        source, wanted = "feature_pipeline_candidates", classes["training_candidate_columns"]
    elif preprocess_columns:
        source, wanted = "preprocess_pipeline_defaults", [c for c in dict.fromkeys(preprocess_columns) if c in columns]
    else:
        source, wanted = "dataset_safe_defaults", columns
    if wanted:
        chosen = select_training_columns(rows, wanted, target, dataset_label, rid, max_categorical_cardinality,
                                         generated=feature_pipeline is not None)
    else:  # an empty list would mean all columns there
        chosen = {"requested_feature_columns": [], "used_feature_columns": [], "exclusion_reasons": {},
                  "max_categorical_cardinality": max(int(max_categorical_cardinality), 5)}
    reasons = dict(chosen["exclusion_reasons"])
    if source == "feature_pipeline_candidates":
        others = classes["analysis_retained_columns"] + classes["business_context_columns"]
        reasons = {c: "not_in_training_candidates" for c in others} | reasons
    used = set(chosen["used_feature_columns"])
    lineage = {c: v | {"used_for_training": c in used} for c, v in classes["feature_lineage"].items()}
    return chosen | {"selection_source": source, "exclusion_reasons": reasons, "excluded_feature_columns": list(reasons),
                     "business_context_columns": classes["business_context_columns"], "feature_lineage": lineage}


def choice_frame(df: DataFrame, choice: dict[str, Any]) -> DataFrame:
    """The choice as rows: (position, column, used, reason, source), used columns in their order, then the excluded ones."""
    used = choice["used_feature_columns"]
    rows = [(c, True, None) for c in used] + [(c, False, r) for c, r in choice["exclusion_reasons"].items()]
    return df.sparkSession.createDataFrame([(k, *r, choice["selection_source"]) for k, r in enumerate(rows)],
                                           "position int, column string, used boolean, reason string, source string")
