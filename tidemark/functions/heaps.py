"""Heaps: arrays of the best values of a group, best first; `kind` is min or max."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def order(kind: str, column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.asc() if kind == "min" else c.desc()


def best_first(kind: str, values: Column) -> Column:
    return F.array_sort(values) if kind == "min" else F.sort_array(values, asc=False)


def no_worse(kind: str, worst: Column) -> Callable[[Column], Column]:
    return lambda x: x <= worst if kind == "min" else x >= worst


def without(heap: str, gone: str) -> Column:
    """A heap without the values of another array, each taken away once."""
    return F.expr(f"""aggregate(coalesce({gone}, array()), {heap}, (h, x) -> CASE WHEN array_position(h, x) > 0
        THEN concat(slice(h, 1, cast(array_position(h, x) AS int) - 1), slice(h, cast(array_position(h, x) AS int) + 1, greatest(size(h), 1))) ELSE h END)""")
