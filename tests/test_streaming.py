import os
import shutil
import tempfile

from pyspark.sql import functions as F

from logweave.streaming import apply_rowwise, window_counts

EVENTS = "/root/testdata/sf0.001/events.parquet"


def _stream(spark):
    schema = spark.read.parquet(EVENTS).schema
    src = tempfile.mkdtemp(prefix="logweave-stream-src-")
    shutil.copy(EVENTS, os.path.join(src, "part-0.parquet"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_rowwise_steps_on_a_stream(spark):
    steps = [{"step_type": "text_length", "input_selector": {"mode": "explicit", "columns": ["event_type"]}},
             {"step_type": "derive_time_parts", "input_selector": {"mode": "explicit", "columns": ["ts"]}},
             {"step_type": "boolean_flag", "input_selector": {"mode": "explicit", "columns": ["event_type"]},
              "params": {"operator": "eq", "value": "error"}}]
    out = apply_rowwise(_stream(spark), steps)
    q = out.writeStream.format("memory").queryName("rowwise_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM rowwise_out")
    batch = spark.read.parquet(EVENTS)
    assert got.count() == batch.count()
    bad = got.where((F.col("event_type_length") != F.length("event_type")) |
                    (F.col("event_type_flag") != (F.col("event_type") == "error").cast("long")))
    assert bad.count() == 0


def test_window_counts_match_batch(spark):
    out = window_counts(_stream(spark), ["user_id"], "ts", window_minutes=1440, watermark="1 day", threshold=3)
    ck = tempfile.mkdtemp(prefix="logweave-stream-ck-")
    q = out.writeStream.format("memory").queryName("wc_out").outputMode("complete") \
        .option("checkpointLocation", os.path.join(ck, "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["user_id"], r["bucket_start"]): r["1440m_count"] for r in spark.sql("SELECT * FROM wc_out").collect()}
    batch = spark.read.parquet(EVENTS).groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1440 minutes")) \
        .count().collect()
    want = {(r["user_id"], r["window"]["start"]): r["count"] for r in batch}
    assert got == want
