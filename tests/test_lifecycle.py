import threading

import pytest

from tidemark import observe
from tidemark.engine import Engine
from tidemark.plans.analyze import ViewError
from tidemark.sources.changes import Bag

SCHEMA = "id int, grp string, val int"
ROWS = [(i, "abc"[i % 3], i % 7) for i in range(30)]


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame(ROWS, SCHEMA), ["id"])
    return e


def rows(engine, name):
    return sorted(map(repr, engine.read(name).collect()))


def same(engine, name, sql):
    assert rows(engine, name) == sorted(map(repr, engine.query(sql).collect())), name


PER = "SELECT grp, SUM(val) AS s, COUNT(*) AS n FROM t GROUP BY grp"
TOP = "SELECT n, SUM(s) AS s FROM per GROUP BY n"
TOP_FLAT = "SELECT n, SUM(s) AS s FROM (SELECT grp, SUM(val) AS s, COUNT(*) AS n FROM t GROUP BY grp) GROUP BY n"


@pytest.mark.parametrize("sql, flat", [
    ("SELECT DISTINCT COUNT(*) AS n FROM t GROUP BY grp", None),
    ("SELECT DISTINCT grp FROM t GROUP BY grp, val", None),
    ("SELECT DISTINCT * FROM (SELECT grp, val FROM t) AS x", None),
    ("SELECT COUNT(DISTINCT grp, val) AS n FROM t", None),
    ("SELECT grp, concat('grp', grp) AS g, COUNT(DISTINCT val, id) FILTER (WHERE val > 2) AS n FROM t GROUP BY grp", None),
    ("SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) AS r FROM t", None),
    ("SELECT t.*, SUM(CAST(val AS float)) OVER (PARTITION BY concat('val', grp)) AS s FROM t", None),
    ("SELECT id, SUM(val) OVER (PARTITION BY EXTRACT(YEAR FROM date_add(DATE '2020-12-30', val)) ORDER BY id) AS s FROM t", None),
])
def test_shapes(spark, engine, sql, flat):
    engine.create_view("v", sql)
    engine.apply("t", deletes=spark.createDataFrame(ROWS[:11], SCHEMA), inserts=spark.createDataFrame([(100, "d", 3), (101, None, None)], SCHEMA))
    same(engine, "v", flat or sql)


@pytest.mark.parametrize("sql", [
    "SELECT t.id, u.x FROM t LEFT JOIN u ON t.grp = u.g", "SELECT t.grp, COUNT(u.x) AS n, COUNT(*) AS m FROM t LEFT JOIN u ON u.g = t.grp AND u.x > 1 GROUP BY t.grp",
    "SELECT t.id, u.x FROM u FULL OUTER JOIN t ON t.grp = u.g", "SELECT t.id, u.x, w.g AS k FROM t LEFT JOIN u ON t.grp = u.g LEFT JOIN u AS w ON w.x = t.val",
])
def test_changes_on_the_null_supplying_side(spark, engine, sql):
    u = "g string, x int"
    engine.register("u", spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("z", 4)], u))
    engine.create_view("v", sql)
    for minus, plus in ((None, [("b", 5), (None, 6)]), ([("a", 1), ("a", 2)], None), ([(None, 3)], [("a", 9), ("q", 2)])):
        engine.apply("u", inserts=spark.createDataFrame(plus, u) if plus else None, deletes=spark.createDataFrame(minus, u) if minus else None)
        same(engine, "v", sql)


def test_a_keyed_delete_takes_the_stored_row(spark, engine):
    engine.create_view("per", PER)
    engine.apply("t", deletes=spark.createDataFrame([(3, "wrong", 999)], SCHEMA))
    same(engine, "per", PER)
    assert engine.sources["t"].data.where("id = 3").isEmpty()
    with pytest.raises(ViewError, match="not there"):
        engine.apply("t", deletes=spark.createDataFrame([(3, "wrong", 999)], SCHEMA))
    same(engine, "per", PER)


def test_a_failed_flush_is_made_up_for(spark, engine, monkeypatch):
    engine.create_view("per", PER, mode="DEFERRED")
    engine.create_view("top", TOP, mode="DEFERRED")
    engine.create_view("other", "SELECT val, COUNT(*) AS n FROM t GROUP BY val", mode="DEFERRED")
    write = engine.store.write
    monkeypatch.setattr(engine.store, "write", lambda name, df: (_ for _ in ()).throw(OSError("full")) if name == "per" else write(name, df))
    engine.apply("t", inserts=spark.createDataFrame([(50, "a", 1)], SCHEMA))
    assert engine.flush() == "FLUSHED 1 VIEWS" and engine.views["per"].last_error == "full" and engine.views["top"].stale
    monkeypatch.setattr(engine.store, "write", write)
    engine.apply("t", inserts=spark.createDataFrame([(51, "a", 1)], SCHEMA))
    assert engine.flush() == "FLUSHED 5 VIEWS"
    for name, sql in (("per", PER), ("top", TOP_FLAT)):
        same(engine, name, sql)
    assert engine.flush() == "FLUSHED 0 VIEWS"


def test_reconcile_reaches_the_views_above_and_counts_nothing_twice(spark, engine):
    engine.create_view("per", PER, mode="DEFERRED")
    engine.create_view("top", TOP)
    engine.apply("t", inserts=spark.createDataFrame([(60, "a", 5)], SCHEMA))
    engine.reconcile("per")
    assert engine.flush().startswith("FLUSHED 0")
    same(engine, "top", TOP_FLAT)
    engine.sources["t"].bag = Bag(spark.createDataFrame(ROWS[:5], SCHEMA), ["id"])
    engine.reconcile("per")
    same(engine, "top", TOP_FLAT)
    assert [r["status"] for r in engine.scheduled_reconcile(0).collect()] == ["RECONCILED"] * 2 and engine.scheduled_reconcile(60).collect() == []


def test_a_view_above_an_immediate_and_a_deferred_one(spark, engine):
    engine.create_view("per", PER)
    engine.create_view("late", "SELECT grp, MAX(val) AS hi FROM t GROUP BY grp", mode="DEFERRED")
    engine.create_view("both_", "SELECT per.grp, per.s, late.hi FROM per JOIN late ON per.grp = late.grp")
    engine.create_view("over", "SELECT hi, SUM(s) AS s FROM both_ GROUP BY hi")
    engine.apply("t", updates=(spark.createDataFrame(ROWS[:9], SCHEMA), spark.createDataFrame([(i, g, v + 10) for i, g, v in ROWS[:9]], SCHEMA)))
    engine.flush()
    same(engine, "over", "SELECT hi, SUM(s) AS s FROM (SELECT SUM(val) AS s, MAX(val) AS hi FROM t GROUP BY grp) GROUP BY hi")


def test_source_schemas(spark, engine):
    engine.create_view("per", PER)
    engine.apply("t", inserts=spark.createDataFrame([(70, "a", 5, "more")], "id bigint, grp string, val bigint, x string"))
    assert engine.sources["t"].data.schema.simpleString() == "struct<id:int,grp:string,val:int>" and engine.warnings
    same(engine, "per", PER)
    with pytest.raises(ViewError, match="changed"):
        engine.apply("t", inserts=spark.createDataFrame([(71, "a")], "id int, grp string"))
    engine.alter_source_policy = "error"
    with pytest.raises(ViewError, match="changed"):
        engine.apply("t", inserts=spark.createDataFrame([(72, "a", 5)], "id bigint, grp string, val int"))


def test_logged_views_come_back(spark, engine, tmp_path):
    folder = f"file://{tmp_path}/views"
    first = Engine(spark, folder)
    first.register("t", spark.createDataFrame(ROWS, SCHEMA), ["id"])
    first.create_view("per", PER, storage="LOGGED")
    first.create_view("bag", "SELECT id, val FROM t WHERE val > 2", storage="LOGGED")
    first.create_view("plain", PER)
    first.create_view("gone", PER)
    first.drop_view("gone")
    new = spark.createDataFrame([(80, "a", 6)], SCHEMA)
    first.apply("t", inserts=new)
    second = Engine(spark, folder)
    second.register("t", spark.createDataFrame([*ROWS, (80, "a", 6)], SCHEMA), ["id"])
    filled = []
    evaluate = second._evaluate
    second._evaluate = lambda sql, relations, frames: filled.append(sql) or evaluate(sql, relations, frames)
    assert second.restore() == ["per", "bag", "plain"]
    second.apply("t", deletes=new)
    for name, sql in (("per", PER), ("bag", "SELECT id, val FROM t WHERE val > 2"), ("plain", PER)):
        same(second, name, sql)
    assert Engine(spark, f"file://{tmp_path}/none").restore() == []


def test_tables_that_nothing_stands_on_are_deleted(spark, engine, tmp_path):
    e = Engine(spark, str(tmp_path / "v"))
    e.register("t", spark.createDataFrame(ROWS, SCHEMA), ["id"])
    e.create_view("extreme", "SELECT grp, MAX(val) AS hi FROM t GROUP BY grp")
    e.create_view("bag", "SELECT id FROM t")
    for i in range(6):
        e.apply("t", inserts=spark.createDataFrame([(1000 + i, "a", i)], SCHEMA))
    assert len(list((tmp_path / "v" / "extreme").iterdir())) <= 6  # a state and a change each for now and the two before
    same(e, "extreme", "SELECT grp, MAX(val) AS hi FROM t GROUP BY grp")
    e.drop_view("extreme")
    assert not list((tmp_path / "v" / "extreme").iterdir())


def test_layers_of_rows_fold(spark, engine):
    engine.create_view("bag", "SELECT id, val FROM t WHERE val <> 4")
    for i in range(10):
        engine.apply("t", updates=(spark.createDataFrame([ROWS[i]], SCHEMA), spark.createDataFrame([(i, "n", 50 + i)], SCHEMA)))
    assert [level for level, _ in engine.views["bag"].bag.layers] == [1, 0, 0] and len(engine.sources["t"].bag.layers) == 3
    same(engine, "bag", "SELECT id, val FROM t WHERE val <> 4")
    engine.compact("bag")
    engine.compact("t")
    assert not engine.views["bag"].bag.layers and not engine.sources["t"].bag.layers
    same(engine, "bag", "SELECT id, val FROM t WHERE val <> 4")


def test_changes_that_reach_no_row_write_no_layer(spark, engine):
    engine.create_view("few", "SELECT grp, COUNT(*) AS n FROM t WHERE val = 6 GROUP BY grp")
    before = len(engine.views["few"].layers)
    engine.apply("t", inserts=spark.createDataFrame([(90, "a", 1)], SCHEMA))
    assert len(engine.views["few"].layers) == before and engine.views["few"].last_rows == 0


def test_two_threads_lose_no_change(spark, engine):
    engine.create_view("per", PER)
    threads = [threading.Thread(target=engine.apply, args=("t", spark.createDataFrame([(200 + i, "a", i)], SCHEMA))) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert engine.sources["t"].data.count() == len(ROWS) + 4
    same(engine, "per", PER)


def test_reports_and_cycles(spark, engine):
    engine.create_view("per", PER)
    engine.apply("t", inserts=spark.createDataFrame([(95, "a", 1)], SCHEMA))
    stats = {r["metric"]: r["value"] for r in observe.stats(engine, "per").collect()}
    assert stats["flush_count"] == "1" and stats["last_rows"] == "1" and stats["view_rows"] == "3"
    assert "Scan parquet" in observe.explain_flush(engine, "per")
    with pytest.raises(Exception, match="cannot be found"):  # a view can't stand on itself
        engine.create_view("self", "SELECT grp FROM self")
    assert "self" not in engine.views
    engine.create_view("zero", "SELECT grp, MIN(val) AS lo FROM t GROUP BY grp", topk=0)
    engine.apply("t", deletes=spark.createDataFrame(ROWS[:20], SCHEMA))
    same(engine, "zero", "SELECT grp, MIN(val) AS lo FROM t GROUP BY grp")


@pytest.mark.parametrize("sql, key", [
    ("SELECT t.id, u.x FROM t JOIN u ON t.grp = u.g", ["id"]), ("SELECT t.id AS k, u.x FROM t LEFT JOIN u ON t.grp = u.g WHERE t.val > 1", ["k"]), ("SELECT t.val, u.x FROM t JOIN u ON t.grp = u.g", None),
    ("SELECT t.id, u.x FROM t JOIN u ON t.val = u.x", None), ("SELECT t.id, u.x FROM u LEFT JOIN t ON t.grp = u.g", None), ("SELECT t.id, u.x FROM t CROSS JOIN u", None), ("SELECT u.g, t.val FROM t JOIN u ON t.grp = u.g", None),
])
def test_a_join_by_whole_keys_has_a_key(spark, engine, sql, key):
    engine.register("u", spark.createDataFrame([("a", 1), ("b", 2), ("z", 2)], "g string, x int"), ["g"])
    engine.create_view("v", sql)
    assert engine.views["v"].key == key
    engine.apply("u", updates=(spark.createDataFrame([("a", 1)], "g string, x int"), spark.createDataFrame([("a", 7)], "g string, x int")))
    engine.apply("t", deletes=spark.createDataFrame(ROWS[:4], SCHEMA))
    same(engine, "v", sql)
