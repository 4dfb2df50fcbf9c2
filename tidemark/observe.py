"""What an engine knows about its views, as tables."""

from __future__ import annotations

from statistics import quantiles

from pyspark.sql import DataFrame

from .engine import Engine
from .sources.changes import Delta


def status(engine: Engine) -> DataFrame:
    rows = [
        (v.name, v.depth, not v.stale, v.mode, v.storage, ",".join(v.depends_on), v.flushes, v.last_ms, v.last_error, str(v.refreshed))
        for v in sorted(engine.views.values(), key=lambda v: (v.depth, v.name))
    ]
    return engine.spark.createDataFrame(rows, "name string, depth int, fresh boolean, mode string, storage string, depends_on string, flush_count int, last_flush_ms double, last_error string, last_refresh string")


def stats(engine: Engine, name: str) -> DataFrame:
    view = engine._view(name)
    rows = [
        ("kind", view.kind), ("state_rows", str(view.state.count()) if view.state is not None else None), ("last_rows", None if view.last_rows is None else str(view.last_rows)), ("view_rows", str(engine.read(name).count())),
        ("last_flush_ms", None if view.last_ms is None else f"{view.last_ms:.1f}"), ("flush_count", str(view.flushes)), ("last_error", view.last_error),
    ]
    return engine.spark.createDataFrame(rows, "metric string, value string")


def histogram(engine: Engine, name: str) -> DataFrame:
    times = sorted(engine._view(name).history)
    cuts = quantiles(times, n=100, method="inclusive") if len(times) > 1 else times * 99
    row = (cuts[49], cuts[94], cuts[98], times[-1], len(times)) if times else (None, None, None, None, 0)
    return engine.spark.createDataFrame([row], "p50 double, p95 double, p99 double, max double, samples int")


def explain_flush(engine: Engine, name: str) -> str:
    """The plan by which a flush derives a view's signed change from inserted rows of the first relation below it."""
    view = engine._view(name)
    below = view.depends_on[0]
    rows = engine._current(below)
    change = Delta(plus=engine.store.write("explain", rows.limit(0)))
    df = engine.delta_of(view, {below: change}, {below: rows}).plus
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
