"""Structured Streaming forms of the step chain.

* :func:`apply_rowwise` runs the stateless steps (PRE / FTR row-wise steps,
  row filters, projections) unchanged on a streaming DataFrame.
* :func:`window_counts` is the streaming form of ``time_window_count`` /
  ``window_spike_flag``: a watermarked tumbling-window aggregate emitting one
  row per (group, bucket) once the watermark passes the bucket end.  Buckets
  are epoch-aligned like the batch operator; rows without a time cannot be
  placed in an event-time window and are not counted.
* :func:`window_distinct` is the streaming form of ``window_unique_count`` / ``window_target_unique_count``.
* :func:`logweave.streaming.ordered.ordered_features` is the streaming form of the ordered group steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import Step, StepError
from ..operators.features import compile_feature_step
from ..operators.preprocess import compile_preprocess_step
from ..plans.ops import FrameOp, RowOp


def apply_rowwise(stream: DataFrame, steps: list, kind: str = "feature", rid: str = "__row_id") -> DataFrame:
    """Apply stateless steps to a streaming DataFrame; steps needing dataset-wide state are rejected."""
    compile_fn = compile_feature_step if kind == "feature" else compile_preprocess_step
    df = stream
    for raw in steps:
        step = Step.of(raw)
        if not step.enabled:
            continue
        if step.step_type == "drop_duplicates":
            raise StepError("drop_duplicates needs state across the stream; use dropDuplicatesWithinWatermark")
        for op in compile_fn(df, step, rid):
            if isinstance(op, RowOp):
                if op.pre:
                    df = df.withColumns(dict(op.pre))
                df = df.withColumns(dict(op.assigns))
                if op.pre:
                    df = df.drop(*[c for c, _ in op.pre if c not in dict(op.assigns)])
            elif isinstance(op, FrameOp):
                df = op.fn(df)
            else:
                raise StepError(f"{step.step_type} aggregates over the whole dataset; use window_counts or a batch run")
    return df


def window_counts(stream: DataFrame, group_columns: list[str], time_column: str, window_minutes: int = 15,
                  watermark: str = "10 minutes", threshold: int | None = None) -> DataFrame:
    """Rows per (group, tumbling bucket) with an optional spike flag (count >= threshold)."""
    m = max(int(window_minutes), 1)
    ts = F.col(time_column).cast("timestamp")
    base = stream.withColumn("__event_ts", ts).withWatermark("__event_ts", watermark)
    agg = base.groupBy(*[F.col(c) for c in group_columns], F.window("__event_ts", f"{m} minutes").alias("w")) \
        .agg(F.count(F.lit(1)).alias(f"{m}m_count"))
    out = agg.select(*group_columns, F.col("w.start").alias("bucket_start"), F.col("w.end").alias("bucket_end"),
                     f"{m}m_count")
    if threshold is not None:
        out = out.withColumn(f"{m}m_spike", (F.col(f"{m}m_count") >= max(int(threshold), 1)).cast("long"))
    return out


def window_distinct(stream: DataFrame, group_columns: list[str], time_column: str, target_column: str, window_minutes: int = 15,
                    watermark: str = "10 minutes") -> DataFrame:
    """Exact number of distinct non-null targets per (group, tumbling bucket), once the watermark passes the bucket's end.

    Two aggregates: one state row per (group, bucket, target), so a group that holds a third of the stream is dealt by its
    values, then their number per (group, bucket).  The state of a bucket goes when the watermark passes its end; rows
    without a time or behind the watermark are not counted."""
    m = max(int(window_minutes), 1)
    # names of the two aggregates' own: the columns of the stream may have any name
    keys = [F.col(c).alias(f"__g{i}") for i, c in enumerate(group_columns)]
    rows = stream.select(*keys, F.col(time_column).cast("timestamp").alias("__at"), F.col(target_column).alias("__target"))
    named = [f"__g{i}" for i in range(len(group_columns))]
    values = (rows.withWatermark("__at", watermark).groupBy(*named, F.window("__at", f"{m} minutes").alias("__w"), "__target")
              .agg(F.count(F.lit(1)).alias("__n")))
    counts = (values.groupBy(*named, F.window(F.window_time("__w"), f"{m} minutes").alias("__b"))
              .agg(F.count("__target").alias("__u")))
    return counts.select(*[F.col(g).alias(c) for g, c in zip(named, group_columns)], F.col("__b.start").alias("bucket_start"),
                         F.col("__b.end").alias("bucket_end"), F.col("__u").alias(f"{m}m_unique_count"))
