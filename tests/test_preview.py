"""A preview runs the plan of each side once and returns counts and first rows of both."""

from pyspark.sql import functions as F

from logweave.plans.chain import preview_step

STEPS = [{"step_type": "text_length", "input_selector": {"mode": "explicit", "columns": ["word"]}},
         {"step_type": "boolean_flag", "input_selector": {"mode": "explicit", "columns": ["word"]},
          "params": {"operator": "eq", "value": "w3"}}]
KEEP = [{"step_type": "filter_rows", "params": {"column": "word", "operator": "contains", "value": "w1"}}]


def test_source_is_read_once_for_each_side(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    source = spark.range(0, 1000, 1, 4).select(F.col("id").alias("rid"), F.concat(F.lit("w"), F.col("id") % 7).alias("word")) \
        .mapInArrow(count, "rid long, word string")
    shown = preview_step(source, STEPS, 1, rid="rid", limit=5)
    assert (shown["before_count"], shown["after_count"]) == (1000, 1000)
    assert [r.rid for r in shown["before_rows"].collect()] == [r.rid for r in shown["after_rows"].collect()] == [0, 1, 2, 3, 4]
    assert shown["added_columns"] == ["word_flag"] and shown["removed_columns"] == []
    assert read.value == 2000


def test_filters_count_what_is_left_and_may_leave_nothing(spark):
    rows = spark.range(0, 70).select(F.col("id").alias("rid"), F.concat(F.lit("w"), F.col("id") % 7).alias("word"))
    shown = preview_step(rows, KEEP, 0, kind="preprocess", rid="rid", limit=50)
    assert (shown["before_count"], shown["after_count"]) == (70, 10)
    assert [r.rid for r in shown["after_rows"].collect()] == list(range(1, 70, 7))
    none = preview_step(rows.where("false"), KEEP, 0, kind="preprocess", rid="rid")
    assert (none["before_count"], none["after_count"], none["after_rows"].count()) == (0, 0, 0)
    assert none["after_rows"].columns == ["rid", "word"]
