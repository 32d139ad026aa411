"""Decisions per row where ids repeat or are missing: every row gets a key of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rowid import with_dense_index
from .tables import stored


def ids_are_keys(rows: DataFrame, id_col: str = "id") -> bool:
    """Whether no id is null or repeated; counted per id on the cluster, one row at most reaches the driver."""
    return rows.groupBy(id_col).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull()).isEmpty()


def keyed(rows: DataFrame, id_col: str = "id", key: str = "key") -> DataFrame:
    """``rows`` with a dense key in the order of the ids, nulls last, equal ids in any order; written once.

    The rows of one id, or without one, spread over many tasks, however many they are."""
    named = rows.withColumn("__at", F.monotonically_increasing_id())
    return stored(with_dense_index(named, [F.col(id_col).asc_nulls_last(), F.col("__at").asc()], key).drop("__at"))


def decide_per_row(rows: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``decide`` on ``rows`` (column ``id``, bigint, and others), which need not have unique ids.

    ``decide`` takes rows with unique ids and returns id, component_id (an id), kept and others.  Where ids repeat or are
    null it sees row keys instead, which are turned back: of the rows of a component one is kept, that with the
    smallest id (nulls last), and component_id is that id, null if the component has none.
    """
    if ids_are_keys(rows):
        return decide(rows)
    own = keyed(rows)
    out = decide(own.drop("id").withColumnRenamed("key", "id")).withColumnsRenamed({"id": "key", "component_id": "_of"})
    ids = own.select("key", "id")
    top = ids.select(F.col("key").alias("_of"), F.col("id").alias("component_id"))
    columns = [c for c in out.columns if c not in ("key", "_of", "kept")]
    return out.join(ids, "key").join(top, "_of").select("id", *columns, "component_id", "kept")
