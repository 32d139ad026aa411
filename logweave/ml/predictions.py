"""The prediction table every model's output is turned into, and the analysis bundle over it (TRN-13/14, RES-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analysis as an
from ..rowid import with_dense_index
from ..session import reliable_checkpoint

ORDERED = ["actual_label", "predicted_label", "anomaly_score", "prediction_proba"]


def prediction_table(scored: DataFrame, rid: str, feature_columns: list[str],
                     context_columns: list[str] | None = None) -> DataFrame:
    """TRN-13/14: sample_index (0, 1, ... in row-id order), source_row_id (text), context columns, labels and
    scores, features, then what else ``scored`` holds.  Written once, in the shared checkpoint folder."""
    drop = [c for c in ("sample_index",) if c in scored.columns and c != rid]
    laid = scored.drop(*drop)
    if "source_row_id" not in laid.columns:
        laid = laid.withColumn("source_row_id", F.col(rid).cast("string"))
    out = with_dense_index(laid, [F.col(rid)], "sample_index")
    columns = ["sample_index", "source_row_id", *(context_columns or []), *ORDERED, *feature_columns, *scored.columns]
    return out.select(*[c for c in dict.fromkeys(columns) if c in out.columns])


def analysis_bundle(pred: DataFrame, feature_columns: list[str], point_limit: int = 600, bins: int = 16) -> dict[str, DataFrame]:
    """RES-9: everything the analysis view of an unsupervised model shows.  Points and projection are drawn on
    the stratified sample, as the feature asks; signals and histogram cover all rows."""
    missing = {"anomaly_score", "predicted_label"} - set(pred.columns)
    if missing:
        raise ValueError(f"not an anomaly prediction table: {sorted(missing)} missing")
    sample = reliable_checkpoint(an.stratified_sample(pred, point_limit))
    is_anomaly = F.col("predicted_label").cast("string") == "anomaly"
    return {"summary": sample.agg(F.count("*").alias("sample_size"), F.count_if(is_anomaly).alias("anomaly_count")),
            "score_points": an.score_points(sample), "score_histogram": an.score_histogram(pred, bins),
            "embedding_points": an.embedding_points(sample, feature_columns),
            "spike_signal_summaries": an.signal_summaries(pred, "spike_flag"),
            "count_signal_summaries": an.signal_summaries(pred, "count_metric")}
