"""Connected components of a distributed edge list (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _min_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Nodes are longs; null ends and loops are ignored.  Each round is two aggregations and two joins on
    the edge list and writes its edges to the shared folder; the number of rounds grows with the logarithm
    of the longest path.  Nothing but one row of totals reaches the driver.
    """
    now = (edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
           .filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = stored(now)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _min_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = stored(large)
        low = _min_neighbour(large)
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v")
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = stored(small)
        total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(total) == state:
            break
        state = tuple(total)
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    return (stars.withColumnRenamed("u", "node")
            .unionByName(stars.select(F.col("component").alias("node"), "component").distinct()))
