"""Step-chain interpreter (PIP-1..3): JSON steps -> one lazy Spark plan.

Plan-building rules (all decided in Python; Catalyst does the rest):

* Row-wise steps become ``withColumns`` on the output frame.
* Group statistics are computed on a *pure* frame -- the same rows without any
  join-derived columns -- and joined back to the output frame.  Without this,
  each group step would re-evaluate every earlier join on both sides of its
  own join (2^k plan growth; Catalyst does not prune unused left joins).
* Consecutive group steps with the same key set are fused into one
  aggregate + one join; consecutive one-row dataset statistics into one
  broadcast row; ordered-group steps with the same (keys, time, target) into
  one segmented scan.
* When a step needs a column that only exists after a join, the chain is
  sealed with a reliable checkpoint (lineage cut) and continues from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import timefn as tf
from ..operators import grouping as grp
from ..operators.columns import Step, StepError
from ..operators.features import compile_feature_step
from ..operators.preprocess import compile_preprocess_step
from ..rowid import ROW_ID, with_row_id
from ..session import reliable_checkpoint, ship_package
from . import lineage as _lineage
from .ops import CodeOp, FrameOp, GlobalOp, GroupOp, RowOp, ScanOp


@dataclass
class ChainResult:
    frame: DataFrame
    lineage: dict[str, dict[str, Any]] = field(default_factory=dict)


class _Chain:
    def __init__(self, df: DataFrame, rid: str, num_partitions: int | None):
        self.df = df
        self.pure = df
        self.tainted: set[str] = set()
        self.rid = rid
        self.n = num_partitions
        self.counter = 0

    def _fresh(self, base: str) -> str:
        self.counter += 1
        return f"__{base}{self.counter}"

    def seal(self) -> None:
        self.df = reliable_checkpoint(self.df)
        self.pure = self.df
        self.tainted = set()

    def _needs_seal(self, inputs) -> bool:
        return bool(set(inputs) & self.tainted)

    # ---- op handlers
    def row(self, op: RowOp) -> None:
        assigns: dict = {}
        for name, col in op.assigns:
            assigns.pop(name, None)
            assigns[name] = col
        pre = dict(op.pre)

        def apply(d):
            if pre:
                d = d.withColumns(pre)
            d = d.withColumns(assigns)
            return d.drop(*[c for c in pre if c not in assigns]) if pre else d

        self.df = apply(self.df)
        outs = set(assigns)
        if self._needs_seal(op.inputs):
            self.tainted |= outs
        else:
            self.pure = apply(self.pure)
            self.tainted -= outs

    def frame(self, op: FrameOp) -> None:
        if op.row_changing:
            # rows change: pure and output must stay row-aligned
            if self.tainted:
                self.seal()
            self.df = op.fn(self.df)
            self.pure = self.df
        elif op.apply_to_pure:
            self.df = op.fn(self.df)
            self.pure = op.fn(self.pure)
            self.tainted = {op.renames.get(c, c) for c in self.tainted}
        else:
            self.df = op.fn(self.df)
        self.tainted &= set(self.df.columns)

    def groups(self, ops: list[GroupOp]) -> None:
        if any(self._needs_seal(o.inputs) for o in ops):
            self.seal()
        aggs, outputs = [], []
        for o in ops:
            names = {n: self._fresh("a") for n, _ in o.aggs}
            aggs += [(names[n], a) for n, a in o.aggs]
            for out, fn in o.outputs:
                outputs.append((out, fn(lambda n, names=names: F.col(names[n]))))
        internal = [n for n, _ in aggs]
        self.df = grp.join_group_stats(self.df, self.pure, ops[0].keys, aggs)
        self._attach(outputs, internal)

    def globals_(self, ops: list[GlobalOp]) -> None:
        if any(self._needs_seal(o.inputs) for o in ops):
            self.seal()
        aggs, outputs = [], []
        for o in ops:
            names = {n: self._fresh("g") for n, _ in o.aggs}
            aggs += [(names[n], a) for n, a in o.aggs]
            for out, fn in o.outputs:
                outputs.append((out, fn(lambda n, names=names: F.col(names[n]))))
        self.df = grp.join_global_stats(self.df, self.pure, aggs)
        self._attach(outputs, [n for n, _ in aggs])

    def _attach(self, outputs, internal) -> None:
        merged: dict = {}
        for name, col in outputs:
            merged.pop(name, None)
            merged[name] = col
        self.df = self.df.withColumns(merged).drop(*[c for c in internal if c not in merged])
        self.tainted |= set(merged)

    def code(self, op: CodeOp) -> None:
        if self._needs_seal(op.inputs):
            self.seal()
        codes = grp.dense_codes(self.pure, op.column, self.n)
        tmp = self._fresh("v")
        codes = codes.withColumnRenamed("__val", tmp)
        joined = self.df.join(codes, F.col(op.column) == F.col(tmp), "left")
        self.df = joined.withColumn(op.output, F.coalesce(F.col("__code"), F.lit(-1).cast("long"))) \
            .drop(tmp, "__code")
        self.tainted.add(op.output)

    def scans(self, ops: list[ScanOp]) -> None:
        if any(self._needs_seal(o.inputs) for o in ops):
            self.seal()
        first = ops[0]
        rid = self.rid
        key_alias = [f"__k{i}" for i in range(len(first.keys))]
        cols = [F.col(rid)] + [F.col(k).alias(a) for k, a in zip(first.keys, key_alias)]
        t_us = tf.epoch_micros(F.col(first.time_col), self.pure.schema[first.time_col].dataType)
        cols.append(t_us.alias("__t"))
        targets = list(dict.fromkeys(o.target for o in ops if o.target is not None))
        minutes = list(dict.fromkeys(o.bucket_minutes for o in ops if o.bucket_minutes is not None))
        combos = list(dict.fromkeys((targets.index(o.target), minutes.index(o.bucket_minutes))
                                    for o in ops if o.bucket_minutes is not None))
        for i, tcol in enumerate(targets):
            cols.append(F.coalesce(F.col(tcol).cast("string"), F.lit("__missing__")).alias(f"__v{i}"))
        for j, m in enumerate(minutes):
            cols.append(tf.bucket_id(t_us, m).alias(f"__b{j}"))
        narrow = self.pure.select(*cols)
        res = grp.segmented_scan(narrow, key_alias, rid, n_values=len(targets), n_buckets=len(minutes),
                                 combos=combos, num_partitions=self.n)
        for i, jb in combos:
            b = f"__b{jb}"
            totals = res.groupBy(*[F.col(k).alias("__c" + k) for k in key_alias], F.col(b).alias("__cb")) \
                .agg(F.sum(f"__bchg{i}_{jb}").alias(f"__bsum{i}_{jb}"))
            cond = F.col(b).eqNullSafe(F.col("__cb"))
            for k in key_alias:
                cond = cond & F.col(k).eqNullSafe(F.col("__c" + k))
            res = res.join(totals, cond, "left").drop("__cb", *["__c" + k for k in key_alias])
        outs = {}
        for o in ops:
            for name, kind in o.outputs:
                if kind == "order":
                    expr = F.col("__order").cast("long")
                elif kind == "prev":
                    expr = (F.col("__t") - F.col("__prev_t")).cast("double") / 1e6
                elif kind == "next":
                    expr = (F.col("__next_t") - F.col("__t")).cast("double") / 1e6
                elif kind == "changed":
                    expr = F.col(f"__chg{targets.index(o.target)}").cast("long")
                else:
                    i, jb = targets.index(o.target), minutes.index(o.bucket_minutes)
                    expr = F.col(f"__bsum{i}_{jb}").cast("long")
                outs.pop(name, None)
                outs[name] = expr
        tmp = self._fresh("r")
        res = res.select(F.col(rid).alias(tmp), *[e.alias(n) for n, e in outs.items()])
        existing = [c for c in outs if c in self.df.columns]
        self.df = self.df.drop(*existing).join(res, F.col(rid) == F.col(tmp), "left").drop(tmp)
        self.tainted |= set(outs)


def _run(df: DataFrame, steps: list, kind: str, rid: str | None, num_partitions: int | None,
         collect_lineage: bool) -> ChainResult:
    added = False
    if rid is None:
        rid = ROW_ID
    if rid not in df.columns:
        df = with_row_id(df, rid)
        added = True
    ship_package(df.sparkSession)
    chain = _Chain(df, rid, num_partitions)
    lineage: dict[str, dict[str, Any]] = {}
    compile_fn = compile_feature_step if kind == "feature" else compile_preprocess_step
    enabled = [st for st in (Step.of(r) for r in steps) if st.enabled]
    k = 0
    while k < len(enabled):
        step = enabled[k]
        before = list(chain.df.columns)
        ops = compile_fn(chain.df, step, rid)
        owners = [step] * len(ops)
        k += 1
        # cross-step fusion: following steps that compile to the same kind of group /
        # dataset / scan fragment (and read none of the pending outputs) share one pass
        kind_ = _fusable_kind(ops)
        if kind_ is not None:
            produced = _outputs(ops)
            while k < len(enabled) and enabled[k].input_selector.get("mode") in (None, "explicit"):
                try:
                    nops = compile_fn(chain.df, enabled[k], rid)
                except StepError:
                    break
                if _fusable_kind(nops) != kind_ or (set(_inputs(nops)) & produced):
                    break
                ops += nops
                owners += [enabled[k]] * len(nops)
                produced |= _outputs(nops)
                k += 1
        _execute(chain, ops)
        if collect_lineage:
            owner_of = {name: st for op, st in zip(ops, owners) for name in _outputs([op])}
            for c in chain.df.columns:
                if c not in before and c != rid:
                    lineage[c] = _lineage.lineage_entry(c, owner_of.get(c, step))
    out = chain.df
    if added:
        out = out.drop(rid)
    return ChainResult(out, lineage)


def _fusable_kind(ops: list):
    if not ops:
        return None
    if all(isinstance(o, GroupOp) for o in ops) and len({o.sig for o in ops}) == 1:
        return ("group", ops[0].sig)
    if all(isinstance(o, GlobalOp) for o in ops):
        return ("global",)
    if all(isinstance(o, ScanOp) for o in ops) and len({o.sig for o in ops}) == 1:
        return ("scan", ops[0].sig)
    return None


def _outputs(ops: list) -> set[str]:
    names: set[str] = set()
    for o in ops:
        if isinstance(o, (GroupOp, GlobalOp, ScanOp)):
            names |= {n for n, _ in o.outputs}
        elif isinstance(o, RowOp):
            names |= {n for n, _ in o.assigns}
        elif isinstance(o, CodeOp):
            names.add(o.output)
    return names


def _inputs(ops: list) -> list[str]:
    return [c for o in ops for c in o.inputs]


def _execute(chain: "_Chain", ops: list) -> None:
    i = 0
    while i < len(ops):
        op = ops[i]
        if isinstance(op, GroupOp):
            batch = [op]
            while i + 1 < len(ops) and isinstance(ops[i + 1], GroupOp) and ops[i + 1].sig == op.sig:
                i += 1
                batch.append(ops[i])
            chain.groups(batch)
        elif isinstance(op, GlobalOp):
            batch = [op]
            while i + 1 < len(ops) and isinstance(ops[i + 1], GlobalOp):
                i += 1
                batch.append(ops[i])
            chain.globals_(batch)
        elif isinstance(op, ScanOp):
            batch = [op]
            while i + 1 < len(ops) and isinstance(ops[i + 1], ScanOp) and ops[i + 1].sig == op.sig:
                i += 1
                batch.append(ops[i])
            chain.scans(batch)
        elif isinstance(op, RowOp):
            chain.row(op)
        elif isinstance(op, CodeOp):
            chain.code(op)
        elif isinstance(op, FrameOp):
            chain.frame(op)
        else:  # pragma: no cover
            raise StepError(f"unknown plan fragment {op!r}")
        i += 1


def run_preprocess(df: DataFrame, steps: list, rid: str | None = None,
                   num_partitions: int | None = None) -> DataFrame:
    """PIP-1: ordered preprocess chain; disabled steps skipped; unknown type -> StepError."""
    return _run(df, steps, "preprocess", rid, num_partitions, False).frame


def run_features(df: DataFrame, steps: list, rid: str | None = None, num_partitions: int | None = None,
                 collect_lineage: bool = False) -> DataFrame | ChainResult:
    """PIP-2: feature chain; with ``collect_lineage`` returns frame + lineage of new columns."""
    res = _run(df, steps, "feature", rid, num_partitions, collect_lineage)
    return res if collect_lineage else res.frame


def _counted_head(frame: DataFrame, rid: str, columns: list[str], head: int) -> tuple[int, DataFrame]:
    """Number of rows and the first ``head`` by row id, from one run of the plan: the count is observed as the rows pass."""
    seen = Observation()
    first = frame.observe(seen, F.count(F.lit(1)).alias("rows")).orderBy(rid).limit(head).select(*columns)
    rows = first.collect()  # at most ``head``; as a table of their own they do not run the chain again
    count = seen.get["rows"] if rows else 0  # a plan known to be empty reports nothing
    return count, frame.sparkSession.createDataFrame(rows, first.schema)


def preview_step(df: DataFrame, steps: list, index: int, kind: str = "feature", limit: int = 20,
                 rid: str | None = None) -> dict[str, Any]:
    """PIP-3: run steps before ``index`` then step ``index``; counts, column diff and first rows.

    Each side's plan runs once, when the function is called."""
    if index < 0 or index >= len(steps):
        raise StepError("step index out of range")
    runner = run_features if kind == "feature" else run_preprocess
    own_rid = rid or ROW_ID
    base = df if own_rid in df.columns else with_row_id(df, own_rid)
    before = runner(base, steps[:index], rid=own_rid)
    after = runner(before, [steps[index]], rid=own_rid)
    hidden = own_rid if own_rid not in df.columns else None
    bcols = [c for c in before.columns if c != hidden]
    acols = [c for c in after.columns if c != hidden]
    head = max(1, min(int(limit), 50))
    before_count, before_rows = _counted_head(before, own_rid, bcols, head)
    after_count, after_rows = _counted_head(after, own_rid, acols, head)
    return {
        "before_count": before_count,
        "after_count": after_count,
        "before_columns": bcols,
        "after_columns": acols,
        "added_columns": [c for c in acols if c not in bcols],
        "removed_columns": [c for c in bcols if c not in acols],
        "before_rows": before_rows,
        "after_rows": after_rows,
    }
