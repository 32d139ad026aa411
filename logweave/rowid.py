"""Row-id policy.

Order-sensitive operators (first-row-wins dedup, sequence tie breaks, first
samples) need a stable row id.  Use a source key when the table has one
(``with_row_id(df, key)`` is a no-op if the column exists); otherwise
``monotonically_increasing_id`` gives a unique id in file/partition order
without moving rows (never ``row_number()`` over an unpartitioned window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROW_ID = "__row_id"


def with_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    if name in df.columns:
        return df
    return df.withColumn(name, F.monotonically_increasing_id())


def with_dense_index(df: DataFrame, order: list, name: str) -> DataFrame:
    """``name`` = 0, 1, 2, ... in the given order, without putting all rows into one task.

    The rows are range-partitioned and sorted, written once, and an index is the position in its partition plus
    the number of rows in the partitions before it (one row per partition)."""
    from .session import reliable_checkpoint
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    laid = reliable_checkpoint(laid.withColumn("__part", F.shiftright("__m", 33)))
    sizes = laid.groupBy("__part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    before = sizes.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    low = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(before, "__part").withColumn(name, F.col("__before") + low).drop("__m", "__part", "__before")
