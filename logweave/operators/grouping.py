"""Group statistics joined back to rows, and a skew-safe ordered scan.

* ``join_group_stats``: ``groupBy(keys).agg(...)`` (map-side partial
  aggregation, so a hot key collapses to one row per map task) joined back with
  null-safe keys.  No broadcast hint: AQE turns the join into a broadcast only
  when the *runtime* size of the aggregate is under the threshold, and
  otherwise splits skewed left partitions (left outer join).
* ``join_global_stats``: one-row dataset aggregate, broadcast (size 1 row).
* ``dense_codes``: 0-based rank of each distinct value in sorted order,
  computed with a range partition + per-partition offsets (no single-task
  window over all distinct values).
* ``segmented_scan``: row number / previous / next / change flags inside
  ordered groups.  Rows are range-partitioned on (keys, time, row id), so a hot
  key is split across many tasks; each task scans its sorted slice in Arrow
  batches, and a per-partition summary (bounded by the partition count, not by
  the data) fixes up runs that cross partition boundaries.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint


def _null_safe_on(left_names: list[str], right_names: list[str]) -> Column:
    conds = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left_names, right_names)]
    return reduce(lambda x, y: x & y, conds) if conds else F.lit(True)


def join_group_stats(df: DataFrame, pure: DataFrame, keys: list[Column],
                     aggs: list[tuple[str, Column]]) -> DataFrame:
    """Attach per-group aggregates (computed on ``pure``) to every row of ``df``.

    ``keys`` are expressions valid on both frames (same rows, same values).
    """
    lk = [f"__gk{i}" for i in range(len(keys))]
    rk = [f"__sk{i}" for i in range(len(keys))]
    stats = pure.groupBy(*[k.alias(n) for k, n in zip(keys, rk)]).agg(
        *[a.alias(n) for n, a in aggs])
    left = df.withColumns(dict(zip(lk, keys)))
    out = left.join(stats, _null_safe_on(lk, rk), "left")
    return out.drop(*lk, *rk)


def join_global_stats(df: DataFrame, pure: DataFrame, aggs: list[tuple[str, Column]]) -> DataFrame:
    stats = pure.agg(*[a.alias(n) for n, a in aggs])
    return df.crossJoin(F.broadcast(stats))  # exactly one row


def _num_scan_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


# ------------------------------------------------------------------ dense codes

def _local_index_batches(batches):
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    pos = 0
    for batch in batches:
        m = batch.num_rows
        idx = pa.array(np.arange(pos, pos + m, dtype=np.int64))
        pos += m
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(m, pid, dtype=np.int64)), idx],
            names=["__val", "__pid", "__lidx"])


def dense_codes(pure: DataFrame, column: str, num_partitions: int | None = None) -> DataFrame:
    """(``__val``, ``__code``): rank of each non-null distinct value, 0-based, sorted ascending."""
    vals = pure.select(F.col(column).alias("__val")).where(F.col("__val").isNotNull()).distinct()
    n = _num_scan_partitions(pure, num_partitions)
    ranged = vals.repartitionByRange(n, "__val").sortWithinPartitions("__val")
    vtype = pure.schema[column].dataType
    schema = T.StructType([T.StructField("__val", vtype), T.StructField("__pid", T.LongType()),
                           T.StructField("__lidx", T.LongType())])
    local = reliable_checkpoint(ranged.mapInArrow(_local_index_batches, schema))
    counts = local.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    return local.join(F.broadcast(offsets), "__pid").select(
        "__val", (F.col("__off") + F.col("__lidx")).alias("__code"))


# --------------------------------------------------------------- segmented scan

def _null_safe_eq(a: pa.Array, b: pa.Array) -> np.ndarray:
    eq = pc.fill_null(pc.equal(a, b), False)
    both_null = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(eq, both_null).to_numpy(zero_copy_only=False)


def _scan_partition(key_names, n_values, n_buckets, combos):
    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        prev = None          # 1-row RecordBatch of the last row seen
        run_id, lord, pos = -1, 0, 0
        held = None          # last computed row waiting for its "next" value

        def shifted(ext, name, off, m):
            col = ext.column(name)
            cur = col.slice(off, m)
            before = col.slice(0, m) if off else pa.concat_arrays([pa.nulls(1, col.type), col.slice(0, m - 1)])
            return cur, before

        for batch in batches:
            m = batch.num_rows
            if m == 0:
                continue
            ext = batch if prev is None else pa.concat_batches([prev, batch])
            off = 0 if prev is None else 1
            # same_prev[i]: row i continues the key of the row before it
            same = np.ones(ext.num_rows - 1, dtype=bool)
            for k in key_names:
                col = ext.column(k)
                same &= _null_safe_eq(col.slice(1), col.slice(0, ext.num_rows - 1))
            same_prev = np.concatenate([[False], same]) if prev is None else same
            new_run = ~same_prev
            runs = run_id + np.cumsum(new_run)
            idx = np.arange(m)
            start = np.where(new_run, idx, -1)
            run_start = np.maximum.accumulate(start)
            lords = np.where(run_start >= 0, idx - run_start + 1, lord + idx + 1)

            t_cur, t_before = shifted(ext, "__t", off, m)
            cols = {"__lprev_t": pc.if_else(pa.array(same_prev), t_before, pa.nulls(m, pa.int64()))}
            differs = []
            for i in range(n_values):
                v_cur, v_before = shifted(ext, f"__v{i}", off, m)
                differs.append(~_null_safe_eq(v_cur, v_before))
                cols[f"__lchg{i}"] = pa.array((same_prev & differs[i]).astype(np.int64))
            bsame = []
            for j in range(n_buckets):
                b_cur, b_before = shifted(ext, f"__b{j}", off, m)
                bsame.append(same_prev & _null_safe_eq(b_cur, b_before))
            for i, j in combos:
                cols[f"__lbchg{i}_{j}"] = pa.array((bsame[j] & differs[i]).astype(np.int64))
            # next within this batch; the last row waits for the next batch
            same_next = np.concatenate([same_prev[1:], [False]])
            t_after = pa.concat_arrays([t_cur.slice(1), pa.nulls(1, pa.int64())])
            cols["__lnext_t"] = pc.if_else(pa.array(same_next), t_after, pa.nulls(m, pa.int64()))
            cols["__pid"] = pa.array(np.full(m, pid, dtype=np.int64))
            cols["__pos"] = pa.array(np.arange(pos, pos + m, dtype=np.int64))
            cols["__run"] = pa.array(runs.astype(np.int64))
            cols["__lord"] = pa.array(lords.astype(np.int64))
            arrays = [batch.column(i) for i in range(batch.num_columns)] + list(cols.values())
            names = list(batch.schema.names) + list(cols.keys())
            out = pa.RecordBatch.from_arrays(arrays, names=names)

            if held is not None:
                # fix the held row's "next" from this batch's first row
                if same_prev[0]:
                    held = held.set_column(held.schema.get_field_index("__lnext_t"), "__lnext_t",
                                           pa.array([t_cur[0].as_py()], pa.int64()))
                yield held
            held = out.slice(m - 1, 1)
            if m > 1:
                yield out.slice(0, m - 1)

            prev = batch.slice(m - 1, 1)
            run_id = int(runs[-1])
            lord = int(lords[-1])
            pos += m
        if held is not None:
            yield held
    return run


def segmented_scan(narrow: DataFrame, key_names: list[str], rid: str, *, n_values: int = 0, n_buckets: int = 0,
                   combos: list[tuple[int, int]] | tuple = (), num_partitions: int | None = None) -> DataFrame:
    """Ordered-group scan over ``narrow`` (rid, keys, ``__t``, ``__v0..``, ``__b0..``).

    Order inside a group: ``__t`` ascending with nulls last, then ``rid``.
    Returns one row per input row with ``__order`` (1-based), ``__prev_t`` and
    ``__next_t`` (epoch micros of the neighbours in the group), ``__chg{i}``
    (value ``i`` differs from the previous row of the group) and, for each
    ``(i, j)`` in ``combos``, ``__bchg{i}_{j}`` (same, when the previous row is
    also in the same bucket ``j``).
    """
    n = _num_scan_partitions(narrow, num_partitions)
    order = [F.col(k).asc_nulls_first() for k in key_names] + [F.col("__t").asc_nulls_last(), F.col(rid).asc()]
    ranged = narrow.repartitionByRange(n, *order).sortWithinPartitions(*order)
    extra = [T.StructField("__lprev_t", T.LongType())]
    extra += [T.StructField(f"__lchg{i}", T.LongType()) for i in range(n_values)]
    extra += [T.StructField(f"__lbchg{i}_{j}", T.LongType()) for i, j in combos]
    extra += [T.StructField("__lnext_t", T.LongType()), T.StructField("__pid", T.LongType()),
              T.StructField("__pos", T.LongType()), T.StructField("__run", T.LongType()),
              T.StructField("__lord", T.LongType())]
    schema = T.StructType(list(narrow.schema.fields) + extra)
    local = reliable_checkpoint(ranged.mapInArrow(_scan_partition(key_names, n_values, n_buckets, list(combos)),
                                                  schema))

    vnames = [f"__v{i}" for i in range(n_values)]
    bnames = [f"__b{j}" for j in range(n_buckets)]
    row_fields = [F.col(k) for k in key_names] + [F.col("__t")] + [F.col(c) for c in vnames + bnames]
    summary = local.groupBy("__pid").agg(
        F.count(F.lit(1)).alias("__n"),
        F.count_if(F.col("__run") == 0).alias("__first_len"),
        F.max("__run").alias("__last_run"),
        F.min_by(F.struct(*row_fields), F.col("__pos")).alias("__fr"),
        F.max_by(F.struct(*row_fields, F.col("__lord")), F.col("__pos")).alias("__lr"),
    )
    # Rows of a key in earlier partitions: sum of the run lengths seen before.
    runs = summary.select("__pid", F.lit(0).alias("__kind"),
                          *[F.col("__fr")[k].alias(f"__rk{i}") for i, k in enumerate(key_names)],
                          F.col("__first_len").alias("__len")).unionByName(
        summary.where(F.col("__last_run") > 0).select(
            "__pid", F.lit(1).alias("__kind"),
            *[F.col("__lr")[k].alias(f"__rk{i}") for i, k in enumerate(key_names)],
            F.col("__lr")["__lord"].alias("__len")))
    rk = [f"__rk{i}" for i in range(len(key_names))]
    # one row per run at a partition edge (<= 2 per partition): bounded by the partition count
    wr = (Window.partitionBy(*rk) if rk else Window.partitionBy(F.lit(0))).orderBy("__pid", "__kind") \
        .rowsBetween(Window.unboundedPreceding, -1)
    carries = runs.withColumn("__carry", F.coalesce(F.sum("__len").over(wr), F.lit(0))) \
        .where(F.col("__kind") == 0).select("__pid", "__carry")

    wp = Window.orderBy("__pid")  # one row per non-empty partition: bounded by the partition count
    prev_lr = F.lag("__lr").over(wp)
    next_fr = F.lead("__fr").over(wp)

    def keys_equal(a, b):
        conds = [a[k].eqNullSafe(b[k]) for k in key_names]
        return reduce(lambda x, y: x & y, conds) if conds else F.lit(True)

    fix = summary.select(
        "__pid", "__n", "__last_run",
        prev_lr.alias("__plr"), F.col("__fr"), next_fr.alias("__nfr"), F.col("__lr"),
    ).select(
        "__pid", "__n", "__last_run",
        (F.col("__plr").isNotNull() & keys_equal(F.col("__plr"), F.col("__fr"))).alias("__prev_same"),
        F.col("__plr")["__t"].alias("__ft_t"),
        *[F.col("__plr")[c].alias(f"__ft{c}") for c in vnames + bnames],
        (F.col("__nfr").isNotNull() & keys_equal(F.col("__lr"), F.col("__nfr"))).alias("__next_same"),
        F.col("__nfr")["__t"].alias("__nt_t"),
    ).join(carries, "__pid", "left")

    j = local.join(F.broadcast(fix), "__pid")
    first_row = (F.col("__pos") == 0) & F.col("__prev_same")
    last_row = (F.col("__pos") == F.col("__n") - 1) & F.col("__next_same")
    outs = {
        "__order": F.col("__lord") + F.when(F.col("__run") == 0, F.coalesce(F.col("__carry"), F.lit(0)))
        .otherwise(F.lit(0)),
        "__prev_t": F.when(first_row, F.col("__ft_t")).otherwise(F.col("__lprev_t")),
        "__next_t": F.when(last_row, F.col("__nt_t")).otherwise(F.col("__lnext_t")),
    }
    for i, v in enumerate(vnames):
        differs = (~F.col(v).eqNullSafe(F.col(f"__ft{v}"))).cast("long")
        outs[f"__chg{i}"] = F.when(first_row, differs).otherwise(F.col(f"__lchg{i}"))
    for i, jb in combos:
        v, b = vnames[i], bnames[jb]
        differs = (~F.col(v).eqNullSafe(F.col(f"__ft{v}"))).cast("long")
        outs[f"__bchg{i}_{jb}"] = F.when(first_row & F.col(b).eqNullSafe(F.col(f"__ft{b}")), differs) \
            .when(F.col("__pos") == 0, F.lit(0).cast("long")).otherwise(F.col(f"__lbchg{i}_{jb}"))
    keep = [rid, *key_names, "__t", *vnames, *bnames]
    return j.select(*keep, *[c.alias(n) for n, c in outs.items()])
