"""Exact distinct counts for many columns in one pass over long-form cells.

Several ``count(DISTINCT ...)`` in one aggregate make Spark plan an Expand that carries every input row
once per distinct aggregate.  Here each row becomes (column, value) cells, which are deduplicated map-side
first, so a column with few values costs next to nothing in the shuffle.  Every count is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_counts(df: DataFrame, exprs: dict[str, Column]) -> dict[str, int]:
    """Number of distinct non-null values (by their text form) of each named expression."""
    names = list(exprs)
    if not names:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), exprs[n].cast("string").alias("v")) for i, n in enumerate(names)])
    values = df.select(F.explode(cells).alias("x")).select("x.i", "x.v").where("v is not null").distinct()
    found = {r["i"]: r["count"] for r in values.groupBy("i").count().collect()}
    return {n: int(found.get(i, 0)) for i, n in enumerate(names)}
