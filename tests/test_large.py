"""What must not grow with the tables: one task's share, what the driver collects."""

from pathlib import Path

from tidemark.engine import Engine
from tidemark.plans import catalog
from tidemark.plans.cross import TIMES
from tidemark.sources.storage import path_of

DATA = "/root/testdata/sf0.001"


def test_a_change_log_is_written_by_many_tasks(spark):
    there = lambda: set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob("*/log/part-*"))
    before = there()
    catalog.stream_foreachbatch(spark, DATA)
    assert len(there() - before) > 1


def test_not_in_is_joined_by_key(spark):
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    sql = "SELECT a.k FROM a WHERE a.k NOT IN (SELECT b.k FROM b WHERE b.k > 0 OR b.k IS NULL)"
    e = Engine(spark)
    e.register("a", rows(1, 2, None, 4))
    e.register("b", rows(2, -1))
    e.create_view("v", sql)
    said = lambda: sorted((r[0] for r in e.read("v").collect()), key=str)
    assert said() == [1, 4]
    e.apply("b", inserts=rows(None))
    assert said() == []
    e.apply("b", deletes=rows(None))
    assert said() == [1, 4]
    e.apply("b", deletes=rows(2))
    assert said() == [1, 2, 4, None]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastExchange" not in e.query(sql)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _outer(spark, sql):
    e = Engine(spark)
    e.register("a", spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, g string"), ["k"])
    e.register("b", spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "k int, v int"))
    e.create_view("v", sql)
    return e


def _follows(e, spark, sql):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v int")
    same = lambda: sorted(map(repr, e.read("v").collect())) == sorted(map(repr, e.query(sql).collect()))
    e.apply("b", inserts=rows((3, 1), (3, 1), (9, 2)))
    assert same()
    e.apply("b", updates=(rows((3, 1), (2, 7)), rows((2, None), (9, 8))))
    assert same()
    e.apply("b", deletes=rows((1, 5), (1, 6), (3, 1)))
    assert same()


def test_sums_over_an_outer_join_take_signs_instead_of_differences(spark):
    sql = "SELECT a.g, COUNT(b.k) AS n, COUNT(*) AS m, SUM(b.v) AS s FROM a LEFT JOIN b ON a.k = b.k GROUP BY a.g"
    e, found = _outer(spark, sql), []
    of = e.delta_of
    e.delta_of = lambda *x: found.append(of(*x)) or found[-1]
    _follows(e, spark, sql)
    assert found and all(d.minus is None and TIMES in d.plus.columns for d in found)


def test_rows_that_differ_are_found_by_one_evaluation(spark):
    for sql in (
        "SELECT a.k, b.v FROM a LEFT JOIN b ON a.k = b.k",
        "SELECT a.k FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.v > 1)",
    ):
        e, found = _outer(spark, sql), []
        of = e.delta_of
        e.delta_of = lambda *x: found.append(of(*x)) or found[-1]  # noqa: B023
        _follows(e, spark, sql)
        assert found and all(path_of(x) for d in found for x in (d.minus, d.plus) if x is not None)
