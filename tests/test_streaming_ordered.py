"""Ordered features and exact distinct counts on streams equal the batch results once the watermark has passed."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from logweave.operators.columns import StepError
from logweave.plans.chain import run_features
from logweave.streaming import window_distinct
from logweave.streaming.ordered import ROCKSDB, ordered_features

SCHEMA = "row_id long, user string, at timestamp, status string"
START = dt.datetime(2024, 3, 1)


def step(kind, **params):
    return {"step_type": kind, "input_selector": {"mode": "explicit", "columns": ["user"]}, "params": {"time_column": "at", **params}}


STEPS = [step("group_event_order"), step("time_since_previous_event"), step("time_until_next_event"),
         step("group_value_change_flag", target_column="status"),
         step("window_status_change_count", target_column="status", window_minutes=60),
         step("window_status_change_count", target_column="status", window_minutes=7)]


@pytest.fixture()
def stream_store(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def made_rows(count, seed):
    """Rows in shuffled arrival, at most 30 minutes late; ties of time, a null group, null targets, microseconds."""
    chance = random.Random(seed)
    rows = []
    for i in range(count):
        at = START + dt.timedelta(minutes=chance.randrange(600), microseconds=chance.choice([0, 0, 1, 999_999]))
        rows.append((i, chance.choice(["a", "a", "b", None]), at, chance.choice(["up", "down", "down", None])))
    arrival = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=chance.random() * 30))
    end = [(count + i, u, START + dt.timedelta(days=2 + i), "up") for i, u in enumerate(["a", "b", None, "z"])]
    return arrival + end


def write_files(spark, folder, rows, size, first=0):
    for n, k in enumerate(range(0, len(rows), size), first):
        part = spark.createDataFrame(rows[k:k + size], SCHEMA).coalesce(1).toPandas()
        part.to_parquet(os.path.join(folder, f"part-{n:03d}.parquet"), coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(os.path.join(folder, f"part-{n:03d}.parquet"), (1_700_000_000 + n, 1_700_000_000 + n))


def run(frame, checkpoint, out):
    q = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert not q.isActive and q.exception() is None


def test_ordered_features_equal_batch_over_a_restart(spark, stream_store):
    work = tempfile.mkdtemp(prefix="logweave-ordered-")
    src, out, checkpoint = (os.path.join(work, n) for n in ("src", "out", "ck"))
    os.makedirs(src)
    rows = made_rows(240, 5)
    half = 120

    def features():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        return ordered_features(stream, STEPS, "row_id", watermark="31 minutes")

    write_files(spark, src, rows[:half], 60)
    run(features(), checkpoint, out)
    first = spark.read.parquet(out).count()
    assert 0 < first < half  # the last half hour still waits
    write_files(spark, src, rows[half:], 60, first=2)
    run(features(), checkpoint, out)

    batch = run_features(spark.createDataFrame(rows, SCHEMA), STEPS, rid="row_id")
    names = [c for c in batch.columns if c not in SCHEMA and c not in ("user", "at", "status", "row_id")]
    want = {r.row_id: [r.user, *(r[n] for n in names)] for r in batch.collect() if r.at < START + dt.timedelta(days=2)}
    got = spark.read.parquet(out).where(F.col("at") < F.lit(START + dt.timedelta(days=2))).collect()
    assert len(got) == len(want) == 240  # each row once
    assert {r.row_id: [r.user, *(r[n] for n in names)] for r in got} == want


def test_ordered_features_refuse_other_steps(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(StepError):
        ordered_features(df, [{"step_type": "text_length", "input_selector": {"mode": "explicit", "columns": ["user"]}}], "row_id")
    other = {**step("group_event_order"), "input_selector": {"mode": "explicit", "columns": ["status"]}}
    with pytest.raises(StepError):
        ordered_features(df, [STEPS[0], other], "row_id")


def test_window_distinct_equals_batch_and_forgets(spark, stream_store):
    work = tempfile.mkdtemp(prefix="logweave-distinct-")
    src, out, checkpoint = (os.path.join(work, n) for n in ("src", "out", "ck"))
    os.makedirs(src)
    rows = made_rows(240, 9)
    write_files(spark, src, rows, 64)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    run(window_distinct(stream, ["user"], "at", "status", window_minutes=60, watermark="31 minutes"), checkpoint, out)
    got = {(r.user, r.bucket_start): r["60m_unique_count"] for r in spark.read.parquet(out).collect()}
    batch = spark.createDataFrame(rows, SCHEMA).where(F.col("at") < F.lit(START + dt.timedelta(days=2))) \
        .groupBy("user", F.window("at", "60 minutes").alias("w")).agg(F.count_distinct("status").alias("u")).collect()
    want = {(r.user, r.w.start): r.u for r in batch}
    assert {k: v for k, v in got.items() if k[1] < START + dt.timedelta(days=2)} == want
    left = spark.read.format("statestore").option("path", checkpoint).option("operatorId", 1).load()
    assert left.count() <= 4  # only the buckets of the last day are open
