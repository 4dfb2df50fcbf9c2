"""State tables of aggregate views: build, merge a signed change, read the answer.

A state without MIN and MAX is a stack of layers that add up: the table that was built, and the
signed statistics of each change since. A change writes its own layer alone, whatever the size
of the state; `FANOUT` layers of one level become one of the next, and the last level is
merged into the base. Reading sums the layers by group.

MIN and MAX keep the best `topk` values of each group as a sorted array (a heap): it is the
true best min(topk, count) values, or a strict prefix of them after deletes. Deletes apply
before inserts; a partial heap takes only values no worse than its worst; an empty one with
values left is rebuilt from the source, for those groups alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import heaps
from ..plans.aggregate import COUNT, Plan
from ..plans.analyze import ViewError
from ..plans.cross import TIMES
from ..sources.changes import Delta

#: Layers of one level before they become one of the next: 0 changes, 1 sums of changes, 2 the base.
FANOUT = 8
_BASE = 2
_DIRTY = "__dirty"
_NO_KEY = "__k"


def _keys(plan: Plan) -> list[str]:
    return plan.keys or [_NO_KEY]


def _rows(plan: Plan, rows: DataFrame) -> DataFrame:
    return rows if plan.keys else rows.withColumn(_NO_KEY, F.lit(0))


def _best(plan: Plan, rows: DataFrame, column: str, kind: str, k: int) -> DataFrame:
    """Per group the best k non-null values, best first. Ranks are cut per task before they are shuffled."""
    keys = _keys(plan)
    if TIMES in rows.columns:
        rows = rows.withColumn(TIMES, F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(TIMES, F.lit(k).cast("bigint")))))
    ranked = rows.where(F.col(column).isNotNull()).select(*keys, column).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(heaps.order(kind, column)))).where(F.col("__r") <= k)
    return ranked.groupBy(*keys).agg(heaps.best_first(kind, F.collect_list(column)).alias(column))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"__b_{k}"])
    return out


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    right = b.withColumnsRenamed({k: f"__b_{k}" for k in keys})
    return a.join(right, _same(a, right, keys), how).drop(*[f"__b_{k}" for k in keys])


def build(plan: Plan, rows: DataFrame, topk: int) -> DataFrame:
    """The state of all rows; a row counts as often as it says."""
    rows, keys = _rows(plan, rows), _keys(plan)
    if TIMES in rows.columns:
        kinds = rows.agg(F.count("*").alias(COUNT), *[F.sum(c).alias(c) for c in plan.sums]).schema
        out = rows.groupBy(*keys).agg(F.sum(TIMES).alias(COUNT), *[F.sum(F.col(c) * F.col(TIMES)).cast(kinds[c].dataType).alias(c) for c in plan.sums])
    else:
        out = rows.groupBy(*keys).agg(F.count("*").alias(COUNT), *[F.sum(c).alias(c) for c in plan.sums])
    for column, (kind, _) in plan.heaps.items():
        out = _null_safe(out, _best(plan, rows, column, kind, topk), keys, "left")
    return out


def _partial(plan: Plan, rows: DataFrame | None, sign: int, topk: int) -> DataFrame | None:
    """The signed statistics of changed rows; heap arguments become arrays of what leaves or enters."""
    if rows is None:
        return None
    out = build(plan, rows, topk)
    sums = [(F.col(c) * sign).alias(c) for c in (COUNT, *plan.sums)]
    changed = []
    for c in plan.heaps:
        empty = F.lit(None).cast(out.schema[c].dataType)
        changed += [(F.col(c) if sign < 0 else empty).alias(f"{c}_gone"), (F.col(c) if sign > 0 else empty).alias(f"{c}_new")]
    return out.select(*_keys(plan), *sums, *changed)


Layers = tuple[tuple[int, DataFrame], ...]


def base(state: DataFrame) -> Layers:
    return ((_BASE, state),)


def _together(layers: Layers) -> DataFrame:
    out = layers[0][1]
    for _, part in layers[1:]:
        out = out.unionByName(part)
    return out


def _summed(plan: Plan, out: DataFrame) -> DataFrame:
    return out.groupBy(*_keys(plan)).agg(*[F.sum(c).cast(out.schema[c].dataType).alias(c) for c in (COUNT, *plan.sums)])


def stacked(plan: Plan, layers: Layers, touched: DataFrame | None = None) -> DataFrame:
    """The state that layers add up to, of all groups or of those that agree with a row of `touched` in its columns."""
    rows = _together(layers)
    if touched is not None:
        rows = _null_safe(rows, touched, touched.columns, "left_semi")
    return rows if len(layers) == 1 and layers[0][0] == _BASE else _summed(plan, rows).where(F.col(COUNT) != 0)


def append(plan: Plan, layers: Layers, delta: Delta, keep: Callable[[DataFrame], DataFrame]) -> tuple[Layers, DataFrame, int]:
    """(layers with the change, keys it touches, their number). The state is read for deletes only, and of the touched groups only."""
    schema = layers[0][1].schema
    parts = [p for p in (_partial(plan, _rows(plan, rows) if rows is not None else None, sign, 1) for sign, rows in ((-1, delta.minus), (1, delta.plus))) if p is not None]
    change = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    signs = delta.plus is not None and TIMES in delta.plus.columns
    if signs:  # groups whose rows all cancel
        change = change.where(reduce(or_, [F.coalesce(F.col(c) != 0, F.lit(False)) for c in (COUNT, *plan.sums)]))
    change = keep(change.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]))
    n = change.count()
    if not n:  # no changed row reaches the view
        return layers, change.select(*_keys(plan)), 0
    layers, touched = (*layers, (0, change)), change.select(*_keys(plan))
    if (signs or delta.minus is not None) and not stacked(plan, layers, touched).where(f"{COUNT} < 0").isEmpty():
        raise ViewError("a change deletes rows that are not there")
    if sum(level == 0 for level, _ in layers) >= FANOUT:
        layers = (*[x for x in layers if x[0] > 0], (1, keep(_summed(plan, _together(tuple(x for x in layers if x[0] == 0))))))
    if sum(level == 1 for level, _ in layers) >= FANOUT:
        layers = base(keep(stacked(plan, layers)))
    return layers, touched, n


def merge(plan: Plan, state: DataFrame, delta: Delta, topk: int, rows_now: Callable[[], DataFrame], keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(state after the change, keys it touches), both written by `keep`. delta holds changed rows of the row query, rows_now all rows after the change."""
    keys = _keys(plan)
    parts = [p for p in (_partial(plan, _rows(plan, delta.minus) if delta.minus is not None else None, -1, topk), _partial(plan, _rows(plan, delta.plus) if delta.plus is not None else None, 1, topk)) if p is not None]
    change = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    change = keep(change)
    touched = change.select(*keys).distinct()
    if change.isEmpty():  # no changed row reaches the view
        return state, touched
    old = state
    for c in plan.heaps:
        empty = F.lit(None).cast(state.schema[c].dataType)
        old = old.withColumns({f"{c}_gone": empty, f"{c}_new": empty})
        change = change.withColumn(c, empty)
    aggs = [F.sum(c).cast(state.schema[c].dataType).alias(c) for c in (COUNT, *plan.sums)]
    aggs += [F.first(x, ignorenulls=True).alias(x) for c in plan.heaps for x in (c, f"{c}_gone", f"{c}_new")]
    merged = old.unionByName(change).groupBy(*keys).agg(*aggs)
    dirty = F.lit(False)
    for c, (kind, n) in plan.heaps.items():
        kept = heaps.without(f"coalesce({c}, array())", f"{c}_gone")
        merged = merged.withColumn(f"{c}_left", kept.cast(state.schema[c].dataType))
        left, new = F.col(f"{c}_left"), F.coalesce(F.col(f"{c}_new"), F.array().cast(state.schema[c].dataType))
        # values that were there before the inserts and are not in the heap make it partial
        before = F.col(n) - F.size(new)
        whole = (F.size(left) >= F.least(before, F.lit(topk))) & (F.size(new) < topk) | (F.size(left) == F.lit(topk)) | (before <= F.size(left))
        worst = F.try_element_at(left, F.lit(-1))
        fits = F.filter(new, heaps.no_worse(kind, worst))
        both = F.concat(left, F.when(whole, new).otherwise(fits))
        both = F.slice(heaps.best_first(kind, both), 1, topk)
        merged = merged.withColumn(c, F.when(F.col(n) > 0, both).otherwise(F.array().cast(state.schema[c].dataType)))
        dirty = dirty | ((F.col(n) > 0) & ((F.size(left) == 0) & ~whole | (F.size(c) == 0)))
    merged = merged.withColumn(_DIRTY, dirty).select(*state.columns, _DIRTY)
    after = keep(merged.where(F.col(COUNT) != 0))
    if not after.where(f"{COUNT} < 0").isEmpty():
        raise ViewError("a change deletes rows that are not there")
    if plan.heaps and not after.where(_DIRTY).isEmpty():
        wrong = after.where(_DIRTY).select(*keys)
        rows = _null_safe(_rows(plan, rows_now()), wrong, keys, "left_semi")
        redone = build(plan, rows, topk).select(state.columns)
        after = keep(after.where(f"NOT {_DIRTY}").select(state.columns).unionByName(redone))
    return after.select(state.columns), touched


def read_layers(plan: Plan, layers: Layers, schema, touched: DataFrame) -> DataFrame:
    """The answer of the touched groups; groups of COUNT(DISTINCT) are looked up without the counted value."""
    columns = plan.keys[: -plan.pair] if plan.pair else _keys(plan)
    return read(plan, stacked(plan, layers, touched.select(*columns).distinct() if columns else None), schema)


def read(plan: Plan, state: DataFrame, schema, touched: DataFrame | None = None) -> DataFrame:
    """The answer of all groups, or of the touched ones."""
    rows, keys = state, _keys(plan)
    if touched is not None and plan.keys and not plan.pair:
        rows = _null_safe(rows, touched, keys, "left_semi")
    if plan.pair:
        own = plan.keys[: -plan.pair]
        groups = own or [_NO_KEY]
        rows = rows if own else rows.withColumn(_NO_KEY, F.lit(0))
        if touched is not None and own:
            rows = _null_safe(rows, touched.select(*groups).distinct(), groups, "left_semi")
        whole = F.when(reduce(and_, [F.col(k).isNotNull() for k in plan.keys[-plan.pair :]]), 1)
        rows = rows.groupBy(*groups).agg(F.count(whole).alias(f"{COUNT}_pairs"))
    if plan.scalar:
        one = state.sparkSession.range(1).select(F.lit(0).alias("__one"))
        rows = one.join(rows, F.lit(True), "left")
        rows = rows.withColumn(f"{COUNT}_pairs", F.coalesce(f"{COUNT}_pairs", F.lit(0).cast("bigint"))) if plan.pair else rows.withColumns({COUNT: F.coalesce(COUNT, F.lit(0).cast("bigint"))})
    if plan.having:
        rows = rows.where(plan.having)
    return rows.select(*[F.expr(e).cast(schema[i].dataType).alias(name) for i, (name, e) in enumerate(plan.final)])
