"""Change batches: bags of deleted and inserted rows, in the shape of the source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import SIGN, path_of

#: Operation codes of a change log: insert, delete, and the two images of an update.
OPS_IN, OPS_OUT = ("I", "U_NEW"), ("D", "U_OLD")
OP_COLUMN = "__op"


@dataclass
class Delta:
    """A signed bag: what leaves and what enters. None is empty."""

    minus: DataFrame | None = None
    plus: DataFrame | None = None

    def __bool__(self) -> bool:
        return self.minus is not None or self.plus is not None

    def then(self, other: Delta) -> Delta:
        return Delta(union(self.minus, other.minus), union(self.plus, other.plus))


def union(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    return b if a is None else a if b is None else a.unionByName(b)


def from_log(log: DataFrame) -> Delta:
    """Split an op-coded change log."""
    rows = log.drop(OP_COLUMN)
    return Delta(log.where(F.col(OP_COLUMN).isin(*OPS_OUT)).select(rows.columns), log.where(F.col(OP_COLUMN).isin(*OPS_IN)).select(rows.columns))


def net(delta: Delta) -> Delta:
    """Equal rows on both sides cancel."""
    if delta.minus is None or delta.plus is None:
        return delta
    return Delta(delta.minus.exceptAll(delta.plus), delta.plus.exceptAll(delta.minus))


def signed(minus: DataFrame, plus: DataFrame) -> DataFrame:
    """What is left of two bags when equal rows cancel, each row with its sign: one shuffle of both, where two differences take four."""
    columns = [F.col(f"`{c}`") for c in plus.columns]
    rows = minus.withColumn(SIGN, F.lit(-1)).unionByName(plus.withColumn(SIGN, F.lit(1)))
    left = rows.groupBy(*columns).agg(F.sum(SIGN).alias(SIGN)).where(f"{SIGN} <> 0")
    return left.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs(SIGN)))).select(*columns, F.signum(SIGN).cast("int").alias(SIGN))


def patched(old: DataFrame, delta: Delta, key: list[str] | None = None) -> DataFrame:
    """The bag after a change. With a unique key, deletes are an anti-join; otherwise a bag difference."""
    if delta.minus is None:
        return old if delta.plus is None else old.unionByName(delta.plus)
    if key:
        gone = delta.minus.select(*[F.col(k).alias(f"__gone_{k}") for k in key]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"__gone_{k}")) for k in key]
        kept = old.join(gone, same, "left_anti")
        return kept if delta.plus is None else kept.unionByName(delta.plus)
    grown = old if delta.plus is None else old.unionByName(delta.plus)
    return grown.exceptAll(delta.minus.select(grown.columns))


#: Changes of one level before they become one of the next: 0 changes, 1 sums of changes; sums of all make the base.
FANOUT = 8


class Bag:
    """Rows as a written base and the signed changes since, in layers: a change writes itself alone, whatever the size of the base."""

    def __init__(self, base: DataFrame, key: list[str] | None = None, layers: tuple[tuple[int, Delta], ...] = ()):
        self.base, self.key, self.layers = base, key, layers
        self._rows: DataFrame | None = None

    def rows(self) -> DataFrame:
        if self._rows is None:
            self._rows = patched(self.base, self._net(self.layers), self.key) if self.layers else self.base
        return self._rows

    @staticmethod
    def _net(layers: tuple[tuple[int, Delta], ...]) -> Delta:
        out = Delta()
        for _, delta in layers:
            out = out.then(delta)
        return net(out) if len(layers) > 1 else out

    def changed(self, delta: Delta, keep: Callable[[DataFrame], DataFrame]) -> tuple[Bag, Delta]:
        """(the bag after a change, the change as written)."""
        written = lambda d: Delta(*[x if x is None or path_of(x) else keep(x) for x in (d.minus, d.plus)])
        delta = written(delta)
        layers = (*self.layers, (0, delta))
        if sum(level == 0 for level, _ in layers) >= FANOUT:
            layers = (*[x for x in layers if x[0]], (1, written(self._net(tuple(x for x in layers if not x[0])))))
        out = Bag(self.base, self.key, layers)
        return (Bag(keep(out.rows()), self.key) if sum(level for level, _ in layers) >= FANOUT else out), delta

    def frames(self) -> list[DataFrame]:
        return [self.base, *[x for _, d in self.layers for x in (d.minus, d.plus) if x is not None]]
