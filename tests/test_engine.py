import random

import pytest

from tidemark import observe
from tidemark.engine import Engine
from tidemark.operators import state as states
from tidemark.plans.analyze import ViewError

SCHEMA = "id int, grp string, val int, flag boolean"
VIEWS = {
    "stats": "SELECT grp, SUM(val) AS s, COUNT(*) AS n, COUNT(val) AS c, AVG(val) AS a, BOOL_OR(flag) AS f FROM t GROUP BY grp",
    "extremes": "SELECT grp, MIN(val) AS lo, MAX(val) AS hi FROM t GROUP BY grp",
    "scalar": "SELECT SUM(val) AS s, COUNT(*) AS n, MIN(val) AS m FROM t WHERE val > 0",
    "having": "SELECT grp, SUM(val) AS s FROM t GROUP BY grp HAVING COUNT(*) > 3 AND MAX(val) > 5",
    "pairs": "SELECT grp, COUNT(DISTINCT val) AS d FROM t GROUP BY grp",
    "bag": "SELECT grp, val FROM t WHERE flag",
    "joined": "SELECT u.name, SUM(t.val) AS s, COUNT(*) AS n FROM t JOIN u ON t.grp = u.grp GROUP BY u.name",
    "outer": "SELECT u.name, COUNT(t.id) AS n, COUNT(*) AS r FROM u LEFT JOIN t ON t.grp = u.grp GROUP BY u.name",
    "self": "SELECT a.id AS i, b.id AS j FROM t a JOIN t b ON a.grp = b.grp AND a.val = b.val",
}


def make(rng, n, first):
    return [(first + i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-9, 10)]), rng.random() < 0.3) for i in range(n)]


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame(make(random.Random(1), 30, 0), SCHEMA), ["id"])
    e.register("u", spark.createDataFrame([("a", "A"), ("b", "B"), (None, "N")], "grp string, name string"))
    return e


def same(engine, name, sql):
    a, b = engine.read(name), engine.query(sql)
    assert a.schema.simpleString() == b.schema.simpleString()
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), name


@pytest.mark.parametrize("names", [("stats", "extremes", "scalar"), ("having", "pairs", "bag"), ("joined", "outer", "self")])
def test_mutations(spark, engine, names):
    rng, rows = random.Random(5), make(random.Random(1), 30, 0)
    for n in names:
        engine.create_view(n, VIEWS[n], topk=2)
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    engine.apply("t", inserts=frame(make(rng, 8, 100)))
    engine.apply("t", deletes=frame(rows[:14]))
    old = rows[14:20]
    engine.apply("t", updates=(frame(old), frame([(i, g, (v or 0) - 7, f) for i, g, v, f in old])))
    for n in names:
        same(engine, n, VIEWS[n])


def test_both_sides_of_a_join_deferred(spark, engine):
    engine.create_view("j", VIEWS["joined"], mode="DEFERRED")
    before = engine.read("j").collect()
    engine.apply("t", inserts=spark.createDataFrame([(200, "c", 4, True)], SCHEMA))
    engine.apply("u", inserts=spark.createDataFrame([("c", "C")], "grp string, name string"))
    assert engine.read("j").collect() == before
    assert engine.flush() == "FLUSHED 1 VIEWS"
    same(engine, "j", VIEWS["joined"])


def test_cascade_and_set_operation(spark, engine):
    engine.create_view("per", "SELECT grp, COUNT(*) AS n FROM t GROUP BY grp")
    engine.create_view("top", "SELECT n, COUNT(*) AS groups FROM per GROUP BY n")
    engine.create_view("both", "SELECT grp FROM t EXCEPT ALL SELECT grp FROM u")
    engine.apply("t", deletes=spark.createDataFrame(make(random.Random(1), 30, 0)[:9], SCHEMA))
    same(engine, "top", "SELECT n, COUNT(*) AS groups FROM (SELECT grp, COUNT(*) AS n FROM t GROUP BY grp) GROUP BY n")
    same(engine, "both", "SELECT grp FROM t EXCEPT ALL SELECT grp FROM u")
    with pytest.raises(ViewError, match="dependent"):
        engine.drop_view("per")
    engine.drop_view("per", cascade=True)
    assert "top" not in engine.views


def test_lifecycle_and_errors(spark, engine):
    engine.create_view("s", VIEWS["scalar"])
    with pytest.raises(ViewError, match="exists"):
        engine.create_view("s", VIEWS["scalar"])
    assert engine.create_view("s", VIEWS["scalar"], if_not_exists=True).startswith("ALREADY EXISTS")
    for bad in ({"storage": "X"}, {"mode": "X"}):
        with pytest.raises(ViewError, match="invalid"):
            engine.create_view("z", VIEWS["scalar"], **bad)
    with pytest.raises(ViewError, match="GROUP BY"):
        engine.create_view("z", "SELECT x.n FROM (SELECT grp, COUNT(*) AS n FROM t GROUP BY grp) x")
    engine.truncate("t")
    assert [tuple(r) for r in engine.read("s").collect()] == [(None, 0, None)]
    assert engine.reconcile("s") == "RECONCILED" and engine.refresh_depending_on("t") == "REFRESHED 1 VIEWS"
    assert observe.status(engine).count() == 1 and observe.histogram(engine, "s").first()["samples"] == 1
    assert engine.drop_source("t") == ["s"]


def test_layers_fold_and_fail_whole(spark, engine, monkeypatch):
    monkeypatch.setattr(states, "FANOUT", 2)
    rows, names = make(random.Random(1), 30, 0), ("stats", "pairs")
    for n in names:
        engine.create_view(n, VIEWS[n])
    engine.create_view("above", "SELECT n, COUNT(*) AS groups FROM stats GROUP BY n")
    seen = set()
    for i in range(5):
        old = rows[4 * i : 4 * i + 3]
        new = [(i_, g, (v or 0) + 1, f) for i_, g, v, f in old]
        engine.apply("t", updates=(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)))
        engine.apply("t", deletes=spark.createDataFrame(rows[4 * i + 3 : 4 * i + 4], SCHEMA))
        seen.add(tuple(level for level, _ in engine.views["stats"].layers))
    assert seen == {(2, 1), (2,)}
    for n in names:
        same(engine, n, VIEWS[n])
    same(engine, "above", "SELECT n, COUNT(*) AS groups FROM (SELECT grp, COUNT(*) AS n FROM t GROUP BY grp) GROUP BY n")
    before = sorted(map(repr, engine.read("stats").collect()))
    with pytest.raises(ViewError, match="not there"):
        engine.apply("t", deletes=spark.createDataFrame([(999, "zz", 1, True)], SCHEMA))
    assert sorted(map(repr, engine.read("stats").collect())) == before
    engine.compact("stats")
    assert len(engine.views["stats"].layers) == 1 and sorted(map(repr, engine.read("stats").collect())) == before


CROSSED = {
    "x_few": "SELECT a.grp, COUNT(*) AS n FROM (SELECT grp FROM t WHERE val > -5) AS a CROSS JOIN (SELECT name FROM u) AS b GROUP BY a.grp",
    "x_all": "SELECT a.grp, SUM(a.val) AS s, AVG(a.val) AS v, COUNT(a.val) AS n, MIN(a.val) AS lo, MAX(b.name) AS hi FROM t AS a CROSS JOIN u AS b GROUP BY a.grp",
    "x_where": "SELECT a.grp, COUNT(*) AS n, SUM(a.val) AS s FROM t a, u b WHERE a.val > 0 AND b.name <> 'A' GROUP BY a.grp",
    "x_pairs": "SELECT COUNT(DISTINCT b.name, a.grp) AS n FROM t AS a CROSS JOIN u AS b",
    "x_joined": "SELECT a.grp, COUNT(*) AS n FROM t a, u b WHERE a.grp = b.grp GROUP BY a.grp",
}


def test_cross_joins_pair_groups(spark, engine):
    rows = make(random.Random(1), 30, 0)
    for n, sql in CROSSED.items():
        engine.create_view(n, sql, topk=2)
    assert [bool(engine.views[n].counted) for n in CROSSED] == [True, True, True, True, False]
    rng, frame = random.Random(5), lambda x: spark.createDataFrame(x, SCHEMA)
    engine.apply("t", inserts=frame(make(rng, 8, 100)))
    engine.apply("u", deletes=spark.createDataFrame([("b", "B")], "grp string, name string"))
    engine.apply("t", deletes=frame(rows[:14]))
    engine.apply("u", inserts=spark.createDataFrame([("b", "B2"), ("b", "B2")], "grp string, name string"))
    for n, sql in CROSSED.items():
        same(engine, n, sql)
    engine.truncate("u")
    for n, sql in CROSSED.items():
        same(engine, n, sql)


def test_a_cross_join_of_large_sides(spark):
    """9e10 pairs: a million rows beside ninety thousand."""
    e = Engine(spark)
    e.register("p", spark.range(1_000_000).selectExpr("id", "id % 3 AS g"))
    e.register("q", spark.range(90_000).selectExpr("id"))
    e.create_view("v", "SELECT a.g, COUNT(*) AS n FROM p AS a CROSS JOIN q AS b GROUP BY a.g")
    assert sorted(map(tuple, e.read("v").collect())) == [(0, 333_334 * 90_000), (1, 333_333 * 90_000), (2, 333_333 * 90_000)]
