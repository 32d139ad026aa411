"""Ordered group features on streams (WIN-1..4, TWN-4): the batch steps, each row decided once the watermark has passed it.

Arrivals of a group wait in its state until the watermark passes their time; the passed rows are then in their final order,
since the stream drops whatever comes later than the watermark.  What a group keeps beyond the waiting rows is one row: how many
rows went before, the time and values of the last one, and the changes so far in its last bucket of each width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import timefn as tf
from ..operators.columns import Step, StepError
from ..operators.features import compile_feature_step
from ..plans.ops import ScanOp
from ..session import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _OrderedRows(StatefulProcessor):
    """Rows wait in list state ``rows`` (row id, time, targets); value state ``last`` is the last decided row."""

    def __init__(self, keys, rid, targets, minutes, features, row_schema, last_schema):
        self.keys, self.rid, self.targets, self.features = keys, rid, targets, features
        self.widths = [m * 60_000_000 for m in minutes]
        self.row_schema, self.last_schema = row_schema, last_schema
        self.needs_next = any(kind == "next" for _, kind, _, _ in features)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.row_schema)
        self.last = handle.getValueState("last", self.last_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in self.row_schema]
        for pdf in rows:
            pdf = pdf.iloc[:, -len(names):].set_axis(names, axis=1)  # names of computed columns do not reach the worker
            values = pdf[names].astype(object).where(pdf[names].notna(), None)
            self.rows.appendList([tuple(r) for r in values.itertuples(index=False)])
            self._wake(int(pdf["__t"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        names = [f.name for f in self.row_schema]
        waiting = pd.DataFrame([tuple(r) for r in self.rows.get()], columns=names)
        if waiting.empty:
            return
        waiting = waiting.sort_values(["__t", self.rid], kind="stable", ignore_index=True)
        t = waiting["__t"].to_numpy(np.int64)
        ready = t.copy()
        for w in self.widths:
            ready = np.maximum(ready, (t // w + 1) * w)
        if self.needs_next:
            ready = np.maximum(ready, np.append(t[1:], np.iinfo(np.int64).max))
        done = int(np.searchsorted(ready, watermark, side="right"))
        if done:
            yield self._decide(key, waiting, t, done, int(np.searchsorted(t, watermark, side="right")))
            self.rows.clear()
            if done < len(t):
                self.rows.put([tuple(r) for r in waiting.iloc[done:].itertuples(index=False)])
        if done < len(t) and ready[done] < np.iinfo(np.int64).max:
            self._wake(int(ready[done]))

    def close(self) -> None:
        pass

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000)

    def _decide(self, key, waiting: pd.DataFrame, t: np.ndarray, done: int, settled: int) -> pd.DataFrame:
        """The first ``done`` rows with their features; the first ``settled`` rows are in their final order."""
        state = self.last.get()
        last = dict(zip([f.name for f in self.last_schema], state)) if state is not None else None
        before = np.append([last["t"] if last else 0], t[:settled - 1])
        has_before = np.arange(settled) > (-1 if last else 0)
        changed = []
        for i in range(len(self.targets)):
            v = waiting[f"__v{i}"].to_numpy(object)[:settled]
            changed.append(has_before & (v != np.append([last[f"v{i}"] if last else None], v[:-1])))
        totals, carry = {}, {}
        for j, w in enumerate(self.widths):
            bucket = t[:settled] // w
            same = has_before & (bucket == before // w)
            first = np.searchsorted(bucket, bucket, side="left")
            for i in range(len(self.targets)):
                so_far = np.cumsum(np.append([0], changed[i] & same))
                earlier = last[f"c{i}_{j}"] if last and last["t"] // w == bucket[0] else 0
                end = np.searchsorted(bucket, bucket, side="right")
                totals[i, j] = so_far[end] - so_far[first] + np.where(first == 0, earlier, 0)
                carry[f"c{i}_{j}"] = int(so_far[done] - so_far[first[done - 1]] + (earlier if first[done - 1] == 0 else 0))
        n = last["n"] if last else 0
        out = {k: [key[i]] * done for i, k in enumerate(self.keys)}
        out[self.rid], out["__t"] = waiting[self.rid].iloc[:done].to_numpy(), t[:done]
        for name, kind, i, j in self.features:
            if kind == "order":
                out[name] = n + 1 + np.arange(done)
            elif kind == "prev":
                out[name] = np.where(has_before, (t[:settled] - before) / 1e6, np.nan)[:done]
            elif kind == "next":
                out[name] = (t[1:done + 1] - t[:done]) / 1e6
            elif kind == "changed":
                out[name] = changed[i][:done].astype(np.int64)
            else:
                out[name] = totals[i, j][:done]
        at = done - 1
        self.last.update(tuple([n + done, int(t[at]), *[waiting[f"__v{i}"].iloc[at] for i in range(len(self.targets))],
                                *[carry[f.name] for f in self.last_schema if f.name in carry]]))
        return pd.DataFrame(out)


def ordered_features(stream: DataFrame, steps: list, rid: str, watermark: str = "10 minutes") -> DataFrame:
    """The ordered group steps of a feature chain on a stream: group columns, ``rid``, the time and a column per step.

    ``steps`` are ``group_event_order``, ``time_since_previous_event``, ``time_until_next_event``,
    ``group_value_change_flag`` and ``window_status_change_count`` steps with the same groups and time column, as a batch
    chain takes them; names and values are the batch ones.  ``rid`` tells rows apart and breaks ties of time.

    A row comes out once, when the watermark has passed its time, its buckets have ended and, if the time until the next event
    is asked for, its successor has been passed too: the last row of a group waits for one.  Rows behind the watermark and
    rows without a time are dropped.  State per group: the waiting rows (id, time, targets) and one row; a task
    sorts the waiting rows of one group, so memory follows the watermark's delay and the buckets, not the stream.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    ops = [op for raw in steps if Step.of(raw).enabled for op in compile_feature_step(stream, Step.of(raw), rid)]
    if not ops or not all(isinstance(op, ScanOp) for op in ops):
        raise StepError("ordered_features takes ordered group steps only")
    if len({op.sig for op in ops}) > 1:
        raise StepError("ordered steps on a stream need the same group columns and time column")
    ship_package(stream.sparkSession)
    keys, time_col = list(ops[0].keys), ops[0].time_col
    targets = list(dict.fromkeys(op.target for op in ops if op.target is not None))
    minutes = list(dict.fromkeys(op.bucket_minutes for op in ops if op.bucket_minutes is not None))
    features = [(name, kind, targets.index(op.target) if op.target is not None else None,
                 minutes.index(op.bucket_minutes) if op.bucket_minutes is not None else None)
                for op in ops for name, kind in op.outputs]
    types = {f.name: f.dataType for f in stream.schema.fields}
    row_schema = T.StructType([T.StructField(rid, types[rid]), T.StructField("__t", T.LongType()),
                               *[T.StructField(f"__v{i}", T.StringType()) for i in range(len(targets))]])
    last_schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("t", T.LongType()),
                                *[T.StructField(f"v{i}", T.StringType()) for i in range(len(targets))],
                                *[T.StructField(f"c{i}_{j}", T.LongType())
                                  for j in range(len(minutes)) for i in range(len(targets))]])
    real = {"prev", "next"}
    out_schema = T.StructType([*[T.StructField(k, types[k]) for k in keys], *row_schema.fields[:2],
                               *[T.StructField(name, T.DoubleType() if kind in real else T.LongType()) for name, kind, _, _ in features]])
    at = tf.to_timestamp_any(F.col(time_col), types[time_col])
    narrow = stream.select(*keys, at.alias("__at"), rid, F.unix_micros(at).alias("__t"), *[
        F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias(f"__v{i}") for i, c in enumerate(targets)])
    processor = _OrderedRows(keys, rid, targets, minutes, features, row_schema, last_schema)
    out = (narrow.where("__at IS NOT NULL").withWatermark("__at", watermark).groupBy(*keys)
           .transformWithStateInPandas(processor, out_schema, "append", "eventTime"))
    return out.select(*keys, rid, F.timestamp_micros("__t").alias(time_col), *[name for name, _, _, _ in features])
