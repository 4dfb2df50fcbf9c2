"""Registered queries: views maintained through inserts, updates and deletes, and the plain SQL of their result.

Each source starts with the rows whose key is no multiple of 5. The others are inserted, rows
whose key is a multiple of 11 are updated, and those whose key is a multiple of 7 are deleted,
so the final rows, and with them every view, are one ordinary SELECT over the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..sources.changes import Bag
from ..sources.storage import Store

#: name -> (table, key, columns, the column an update changes and its new value)
SOURCES = {
    "o": ("orders", "o_orderkey", {
        "o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "status": "o_orderstatus", "priority": "NULLIF(o_orderpriority, '3-MEDIUM')",
        "price": "CAST(o_totalprice AS DECIMAL(18,2))", "odate": "o_orderdate",
    }, ("price", "price + 1")),
    "l": ("lineitem", "l_orderkey", {
        "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "flag": "l_returnflag", "ls": "l_linestatus",
        "qty": "CAST(l_quantity AS DECIMAL(18,2))", "price": "CAST(l_extendedprice AS DECIMAL(18,2))", "disc": "CAST(l_discount AS DECIMAL(18,2))",
    }, ("qty", "qty + 1")),
    "c": ("customer", "c_custkey", {
        "c_custkey": "c_custkey", "c_nationkey": "c_nationkey", "segment": "NULLIF(c_mktsegment, 'BUILDING')", "bal": "CAST(c_acctbal AS DECIMAL(18,2))",
    }, ("bal", "bal + 1")),
    "e": ("events", "event_id", {
        "event_id": "event_id", "user_id": "user_id", "kind": "event_type", "ts": "ts", "value": "CAST(value AS DECIMAL(18,2))",
    }, ("value", "value + 1")),
    "d": ("lineitem", "l_orderkey", {
        "l_orderkey": "l_orderkey", "flag": "l_returnflag", "qty": "CAST(l_quantity AS DOUBLE)",
    }, ("qty", "qty + 1")),
}
_UNIQUE = {"o", "c", "e"}

#: name -> (view SQL, sources that change, the same query as the oracle spells it where that differs)
VIEWS: dict[str, tuple[str, tuple[str, ...], str | None]] = {
    "agg_sum_count": ("SELECT flag, ls, CAST(SUM(qty) AS DOUBLE) AS sum_qty, COUNT(*) AS n FROM l GROUP BY flag, ls", ("l",), None),
    "agg_avg": ("SELECT status, CAST(SUM(price) AS DOUBLE) AS s, ROUND(CAST(AVG(price) AS DOUBLE), 2) AS a, COUNT(priority) AS c FROM o GROUP BY status", ("o",), None),
    "agg_minmax_topk": ("SELECT o_custkey, CAST(MIN(price) AS DOUBLE) AS lo, CAST(MAX(price) AS DOUBLE) AS hi FROM o GROUP BY o_custkey", ("o",), None),
    "agg_minmax_time": ("SELECT kind, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM e GROUP BY kind", ("e",), None),
    "agg_bool_or": ("SELECT o_custkey, BOOL_OR(price > 200000) AS big FROM o GROUP BY o_custkey", ("o",), None),
    "agg_count_distinct": ("SELECT status, COUNT(DISTINCT o_custkey) AS n FROM o GROUP BY status", ("o",), None),
    "scalar_count_distinct": ("SELECT COUNT(DISTINCT priority) AS n FROM o", ("o",), None),
    "distinct_refcount": ("SELECT DISTINCT status, priority FROM o", ("o",), None),
    "filter_clause": ("SELECT kind, COUNT(*) FILTER (WHERE value > 50) AS n50, CAST(SUM(value) FILTER (WHERE user_id < 100) AS DOUBLE) AS s FROM e GROUP BY kind", ("e",), None),
    "where_filter": ("SELECT kind, COUNT(*) AS n FROM e WHERE value > 20 AND user_id < 120 GROUP BY kind", ("e",), None),
    "scalar_agg": ("SELECT COUNT(*) AS n, CAST(SUM(price) AS DOUBLE) AS s, CAST(MAX(price) AS DOUBLE) AS hi FROM o WHERE status = 'F'", ("o",), None),
    "null_group_key": ("SELECT priority, COUNT(*) AS n FROM o GROUP BY priority", ("o",), None),
    "having": ("SELECT o_custkey, COUNT(*) AS n FROM o GROUP BY o_custkey HAVING COUNT(*) > 8", ("o",), None),
    "having_hidden_agg": ("SELECT o_custkey, COUNT(*) AS n FROM o GROUP BY o_custkey HAVING MAX(price) > 300000 AND SUM(price) > 100000", ("o",), None),
    "derived_expr": ("SELECT flag, CAST(COALESCE(SUM(price * (1 - disc)), 0) AS DOUBLE) AS revenue, CASE WHEN SUM(qty) > 1000 THEN 'big' ELSE 'small' END AS size FROM l GROUP BY flag", ("l",), None),
    "cast_propagation": ("SELECT status, ROUND(SUM(price), 0)::bigint AS s FROM o GROUP BY status", ("o",), None),
    "groupby_expr": ("SELECT date_trunc('month', odate) AS m, CAST(EXTRACT(YEAR FROM odate) AS BIGINT) AS y, COUNT(*) AS n FROM o GROUP BY date_trunc('month', odate), CAST(EXTRACT(YEAR FROM odate) AS BIGINT)", ("o",), None),
    "passthrough": ("SELECT o_orderkey, UPPER(status) AS st, ABS(CAST(price AS DOUBLE)) AS p FROM o WHERE price > 1000", ("o",), None),
    "passthrough_bag": ("SELECT flag, ls FROM l WHERE qty > 45", ("l",), None),
    "join_inner_agg": ("SELECT c.segment, CAST(SUM(o.price) AS DOUBLE) AS s, COUNT(*) AS n FROM o JOIN c ON o.o_custkey = c.c_custkey GROUP BY c.segment", ("o", "c"), None),
    "join_left_agg": ("SELECT c.c_nationkey, COUNT(o.o_orderkey) AS n, COUNT(*) AS rows_, CAST(SUM(o.price) AS DOUBLE) AS s FROM c LEFT JOIN o ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey", ("o", "c"), None),
    "join_right": ("SELECT o.o_orderkey, c.segment FROM c RIGHT JOIN o ON o.o_custkey = c.c_custkey", ("c", "o"), None),
    "join_full": ("SELECT COALESCE(o.o_custkey, c.c_custkey) AS k, COUNT(*) AS n FROM o FULL OUTER JOIN c ON o.o_custkey = c.c_custkey GROUP BY COALESCE(o.o_custkey, c.c_custkey)", ("o", "c"), None),
    "join_cross": ("SELECT a.status, COUNT(*) AS n FROM (SELECT status FROM o WHERE price > 400000) AS a CROSS JOIN (SELECT c_custkey FROM c WHERE bal > 9000) AS b GROUP BY a.status", ("o", "c"), None),
    "join_theta": ("SELECT c.c_custkey, COUNT(*) AS n FROM c JOIN o ON o.o_custkey = c.c_custkey AND o.price > c.bal * 30 GROUP BY c.c_custkey", ("o", "c"), None),
    "self_join": ("SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM o AS a JOIN o AS b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.status = 'F' AND b.status = 'O'", ("o",), None),
    "join_3way_passthrough": ("SELECT o.o_orderkey, l.l_partkey, c.segment FROM o JOIN l ON l.l_orderkey = o.o_orderkey JOIN c ON c.c_custkey = o.o_custkey WHERE l.qty > 40", ("o", "l", "c"), None),
    "exists_subquery": ("SELECT c.c_custkey FROM c WHERE EXISTS (SELECT 1 FROM o WHERE o.o_custkey = c.c_custkey AND o.price > 300000)", ("o", "c"), None),
    "in_subquery": ("SELECT c.c_custkey FROM c WHERE c.c_custkey NOT IN (SELECT o.o_custkey FROM o WHERE o.status = 'F')", ("o", "c"), None),
    "scalar_subquery": ("SELECT o.o_orderkey FROM o WHERE o.price > (SELECT MAX(price) * 0.8 FROM o)", ("o",), None),
    "derived_table": ("SELECT x.status, COUNT(*) AS n FROM (SELECT status, price FROM o WHERE price > 5000) AS x GROUP BY x.status", ("o",), None),
    "union_all": ("SELECT o_custkey AS k FROM o UNION ALL SELECT c_custkey AS k FROM c", ("o", "c"), None),
    "union_distinct": ("SELECT status AS s, COUNT(*) AS n FROM o GROUP BY status UNION SELECT kind AS s, COUNT(*) AS n FROM e GROUP BY kind", ("o", "e"), None),
    "intersect": ("SELECT o_custkey AS k FROM o INTERSECT SELECT c_custkey AS k FROM c WHERE bal > 0", ("o", "c"), None),
    "except": ("SELECT c_custkey AS k FROM c EXCEPT SELECT o_custkey AS k FROM o WHERE status = 'F'", ("o", "c"), None),
    "intersect_all": ("SELECT status AS s FROM o INTERSECT ALL SELECT ls AS s FROM l", ("o", "l"), None),
    "except_all": ("SELECT ls AS s FROM l EXCEPT ALL SELECT status AS s FROM o", ("o", "l"), None),
    "cte_chain": ("WITH per AS (SELECT o_custkey, SUM(price) AS s, COUNT(*) AS n FROM o GROUP BY o_custkey), big AS (SELECT o_custkey, s, n FROM per WHERE n > 5) SELECT COUNT(*) AS customers, CAST(SUM(s) AS DOUBLE) AS s FROM big", ("o",), None),
    "window_row_number": ("SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY price DESC, o_orderkey) AS BIGINT) AS rn FROM o", ("o",), None),
    "window_rank_over_agg": ("SELECT o_custkey, CAST(SUM(price) AS DOUBLE) AS s, CAST(RANK() OVER (ORDER BY SUM(price) DESC) AS BIGINT) AS r FROM o GROUP BY o_custkey", ("o",), None),
    "window_lag_lead": ("SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, LEAD(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM e", ("e",), None),
    "window_sum_partition": ("SELECT o_orderkey, CAST(SUM(price) OVER (PARTITION BY o_custkey) AS DOUBLE) AS s, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM o", ("o",), None),
    "window_values_frames": ("SELECT event_id, FIRST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, CAST(NTILE(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS q, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, CAST(DENSE_RANK() OVER (PARTITION BY user_id ORDER BY kind) AS BIGINT) AS d FROM e", ("e",), None),
    "distinct_on": ("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, CAST(price AS DOUBLE) AS p FROM o ORDER BY o_custkey, price DESC, o_orderkey", ("o",), None),
    "distinct_group": ("SELECT DISTINCT COUNT(*) AS n FROM o GROUP BY o_custkey", ("o",), None),
    "distinct_group_column": ("SELECT DISTINCT priority, MAX(status) AS s FROM o GROUP BY priority, o_custkey", ("o",), None),
    "distinct_star": ("SELECT DISTINCT * FROM (SELECT status, priority FROM o) AS x", ("o",), None),
    "count_distinct_two": ("SELECT status, COUNT(DISTINCT o_custkey, priority) AS n FROM o GROUP BY status", ("o",), "SELECT status, COUNT(DISTINCT CASE WHEN o_custkey IS NOT NULL AND priority IS NOT NULL THEN (o_custkey, priority) END) AS n FROM o GROUP BY status"),
    "literal_group": ("SELECT concat('status ', status) AS s, COUNT(*) AS n FROM o GROUP BY status", ("o",), None),
    "window_star": ("SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY x.segment ORDER BY x.c_custkey) AS BIGINT) AS rn FROM (SELECT c_custkey, segment FROM c) AS x", ("c",), None),
    "window_expr": ("SELECT event_id, CAST(RANK() OVER (PARTITION BY EXTRACT(DAY FROM ts), kind ORDER BY CAST(value AS float) DESC, event_id) AS BIGINT) AS r FROM e", ("e",), None),
    "window_last_nth_range": ("SELECT event_id, LAST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, NTH_VALUE(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s, COUNT(*) OVER (PARTITION BY kind ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS n FROM e", ("e",), None),
    "greatest_least": ("SELECT o_orderkey, GREATEST(CAST(price AS DOUBLE), 1000.0D) AS g, LEAST(o_custkey, 50) AS m FROM o", ("o",), "SELECT o_orderkey, GREATEST(CAST(price AS DOUBLE), CAST(1000 AS DOUBLE)) AS g, LEAST(o_custkey, 50) AS m FROM o"),
    "double_columns": ("SELECT flag, SUM(qty) AS s, MIN(qty) AS lo, COUNT(*) AS n FROM d GROUP BY flag", ("d",), None),
    "join_using": ("SELECT segment, COUNT(*) AS n FROM (SELECT o_custkey AS k FROM o) AS a JOIN (SELECT c_custkey AS k, segment FROM c) AS b USING (k) GROUP BY segment", ("o", "c"), None),
    "join_comma": ("SELECT c.segment, COUNT(*) AS n FROM o, c WHERE o.o_custkey = c.c_custkey GROUP BY c.segment", ("o", "c"), None),
    "join_semi": ("SELECT c.c_custkey FROM c LEFT SEMI JOIN o ON o.o_custkey = c.c_custkey", ("o", "c"), "SELECT c.c_custkey FROM c WHERE EXISTS (SELECT 1 FROM o WHERE o.o_custkey = c.c_custkey)"),
    "join_anti": ("SELECT c.c_custkey FROM c LEFT ANTI JOIN o ON o.o_custkey = c.c_custkey AND o.status = 'F'", ("o", "c"), "SELECT c.c_custkey FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.o_custkey = c.c_custkey AND o.status = 'F')"),
    "join_left_passthrough": ("SELECT c.c_custkey, o.o_orderkey, o.status FROM c LEFT JOIN o ON o.o_custkey = c.c_custkey AND o.status <> 'P'", ("o", "c"), None),
    "table_function": ("SELECT r.id AS k, COUNT(o.o_orderkey) AS n FROM o JOIN range(5) AS r ON o.o_orderkey % 5 = r.id GROUP BY r.id", ("o",), "SELECT r.id AS k, COUNT(o.o_orderkey) AS n FROM o JOIN range(5) AS r(id) ON o.o_orderkey % 5 = r.id GROUP BY r.id"),
    "cte_set_operation": ("WITH both_ AS (SELECT o_custkey AS k FROM o WHERE status = 'F' UNION SELECT c_custkey AS k FROM c WHERE bal > 0) SELECT COUNT(*) AS n FROM both_", ("o", "c"), None),
}


def _base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, _, columns, _ = SOURCES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _updated(rows: DataFrame, name: str) -> DataFrame:
    column, value = SOURCES[name][3]
    return rows.withColumn(column, F.expr(value).cast(rows.schema[column].dataType))


def _stale(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(f"{SOURCES[name][1]} % 5 <> 0")


def engine_over(spark: SparkSession, sf_dir: str, names, changing) -> Engine:
    engine = Engine(spark)
    for name in names:
        rows = _base(spark, sf_dir, name)
        key = [SOURCES[name][1]] if name in _UNIQUE else None
        engine.register(name, _stale(rows, name) if name in changing else rows, key)
    return engine


def change(engine: Engine, spark: SparkSession, sf_dir: str, name: str) -> None:
    """The three changes; updates and deletes also meet rows that were just inserted."""
    rows, key = _base(spark, sf_dir, name), SOURCES[name][1]
    engine.apply(name, inserts=rows.where(f"{key} % 5 = 0"))
    hit = rows.where(f"{key} % 11 = 0")
    engine.apply(name, updates=(hit, _updated(hit, name)))
    gone = rows.where(f"{key} % 7 = 0")
    engine.apply(name, deletes=gone.where(f"{key} % 11 <> 0").unionByName(_updated(gone.where(f"{key} % 11 = 0"), name)))


def _mentioned(sql: str) -> list[str]:
    import re

    return [n for n in SOURCES if re.search(rf"\b(from|join)\s+(\w+,\s*)*{n}\b", sql, re.I)]


def _maintained(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql, changing, _ = VIEWS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_over(spark, sf_dir, _mentioned(sql), changing)
        engine.create_view("v", sql)
        for source in changing:
            change(engine, spark, sf_dir, source)
        return engine.read("v")

    return run


def _final(name: str, changed: bool) -> str:
    table, key, columns, (column, value) = SOURCES[name]
    picked = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    inner = f"SELECT {picked} FROM {table}"
    if not changed:
        return f"{name} AS ({inner})"
    kind = columns[column].rpartition(" AS ")[2][:-1]
    cols = ", ".join(f"CASE WHEN {key} % 11 = 0 THEN CAST({value} AS {kind}) ELSE {c} END AS {c}" if c == column else c for c in columns)
    return f"{name} AS (SELECT {cols} FROM ({inner}) AS base WHERE {key} % 7 <> 0)"


def _oracle(sql: str, changing) -> str:
    heads = ", ".join(_final(n, n in changing) for n in _mentioned(sql))
    return f"WITH {heads}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {heads} {sql}"


_PER_CUSTOMER = "SELECT o_custkey, COUNT(*) AS n, SUM(price) AS s FROM o GROUP BY o_custkey"
_PER_COUNT = "SELECT n, COUNT(*) AS customers, CAST(SUM(s) AS DOUBLE) AS s FROM per_customer GROUP BY n"
_MIXED = "SELECT s.kinds, COUNT(*) AS customers, CAST(SUM(p.s) AS DOUBLE) AS s FROM per_customer AS p JOIN statuses AS s ON p.o_custkey = s.o_custkey GROUP BY s.kinds"
_MIXED_SQL = f"WITH {_final('o', True)}, per_customer AS ({_PER_CUSTOMER}), statuses AS (SELECT o_custkey, COUNT(DISTINCT status) AS kinds FROM o GROUP BY o_custkey) {_MIXED}"
_CASCADE_SQL = f"WITH {_final('o', True)}, per_customer AS ({_PER_CUSTOMER}) {_PER_COUNT}"


def cascade_2level(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["o"], ("o",))
    engine.create_view("per_customer", _PER_CUSTOMER)
    engine.create_view("per_count", _PER_COUNT)
    change(engine, spark, sf_dir, "o")
    return engine.read("per_count")


def deferred_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued changes of both sides of a join, flushed as one net change."""
    engine = engine_over(spark, sf_dir, ["o", "c"], ("o", "c"))
    engine.create_view("v", VIEWS["join_inner_agg"][0], mode="DEFERRED")
    change(engine, spark, sf_dir, "o")
    change(engine, spark, sf_dir, "c")
    engine.flush()
    return engine.read("v")


def truncate_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emptied, then loaded again with other rows: all of them, updated."""
    engine = engine_over(spark, sf_dir, ["o"], ())
    engine.create_view("v", VIEWS["scalar_agg"][0])
    engine.truncate("o")
    engine.apply("o", inserts=_updated(_base(spark, sf_dir, "o"), "o"))
    return engine.read("v")


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, ["o"], ("o",))
    engine.create_view("v", VIEWS["null_group_key"][0])
    change(engine, spark, sf_dir, "o")
    engine.reconcile("v")
    return engine.read("v")


def reconcile_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is replaced underneath; reconciling the lower view brings the upper one up to date too."""
    engine = engine_over(spark, sf_dir, ["o"], ("o",))
    engine.create_view("per_customer", _PER_CUSTOMER)
    engine.create_view("per_count", _PER_COUNT)
    rows = _base(spark, sf_dir, "o").where("o_orderkey % 7 <> 0")
    drifted = rows.where("o_orderkey % 11 <> 0").unionByName(_updated(rows.where("o_orderkey % 11 = 0"), "o"))
    engine.sources["o"].bag = Bag(drifted, ["o_orderkey"])
    engine.reconcile("per_customer")
    return engine.read("per_count")


def flush_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deferred view whose flush fails loses nothing: the next flush makes it, and the view above it, right."""
    engine = engine_over(spark, sf_dir, ["o"], ("o",))
    engine.create_view("per_customer", _PER_CUSTOMER, mode="DEFERRED")
    engine.create_view("per_count", _PER_COUNT, mode="DEFERRED")
    change(engine, spark, sf_dir, "o")
    write = engine.store.write

    def failing(name: str, df: DataFrame) -> DataFrame:
        if name == "per_customer":
            raise OSError("no space left")
        return write(name, df)

    engine.store.write = failing
    engine.flush()
    engine.store.write = write
    engine.flush()
    return engine.read("per_count")


def mixed_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An immediate view, a deferred one, and one above both."""
    engine = engine_over(spark, sf_dir, ["o"], ("o",))
    engine.create_view("per_customer", _PER_CUSTOMER)
    engine.create_view("statuses", "SELECT o_custkey, COUNT(DISTINCT status) AS kinds FROM o GROUP BY o_custkey", mode="DEFERRED")
    engine.create_view("v", _MIXED)
    change(engine, spark, sf_dir, "o")
    engine.flush()
    return engine.read("v")


def schema_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.register("sales.o", _stale(_base(spark, sf_dir, "o"), "o"), ["o_orderkey"])
    engine.create_view("v", "SELECT o.status, COUNT(*) AS n FROM sales.o GROUP BY o.status")
    engine.apply("sales.o", inserts=_base(spark, sf_dir, "o").where("o_orderkey % 5 = 0"))
    return engine.read("v")


def logged_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A LOGGED view in a folder of its own stands on its tables again in a new engine, and is maintained on."""
    folder = Store(spark).folder
    rows = _base(spark, sf_dir, "o")
    first = Engine(spark, folder)
    first.register("o", _stale(rows, "o"), ["o_orderkey"])
    first.create_view("per_customer", _PER_CUSTOMER, storage="LOGGED")
    first.create_view("per_count", _PER_COUNT, storage="LOGGED")
    first.apply("o", inserts=rows.where("o_orderkey % 5 = 0"))
    second = Engine(spark, folder)
    second.register("o", rows, ["o_orderkey"])
    second.restore()
    hit = rows.where("o_orderkey % 11 = 0")
    second.apply("o", updates=(hit, _updated(hit, "o")))
    second.apply("o", deletes=rows.where("o_orderkey % 7 = 0"))
    return second.read("per_count")


def stream_foreachbatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An op-coded change log, read as a stream."""
    from ..streaming.changelog import maintain

    engine = engine_over(spark, sf_dir, ["e"], ("e",))
    engine.create_view("v", VIEWS["filter_clause"][0])
    rows = _base(spark, sf_dir, "e")
    tag = lambda df, op: df.withColumn("__op", F.lit(op))
    hit, gone = rows.where("event_id % 11 = 0"), rows.where("event_id % 7 = 0 AND event_id % 11 <> 0")
    log = tag(rows.where("event_id % 5 = 0"), "I").unionByName(tag(hit, "U_OLD")).unionByName(tag(_updated(hit, "e"), "U_NEW")).unionByName(tag(gone, "D")).unionByName(tag(_updated(hit.where("event_id % 7 = 0"), "e"), "D"))
    store = Store(spark)
    log.write.parquet(f"{store.folder}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{store.folder}/log")
    query = maintain(engine, "e", stream, f"{store.folder}/progress")
    query.awaitTermination()
    return engine.read("v")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _maintained(n) for n in VIEWS} | {
        "cascade_2level": cascade_2level, "deferred_coalesce": deferred_coalesce, "truncate_reload": truncate_reload,
        "reconcile": reconcile, "stream_foreachbatch": stream_foreachbatch, "reconcile_cascade": reconcile_cascade, "flush_after_failure": flush_after_failure,
        "mixed_modes": mixed_modes, "schema_qualified": schema_qualified, "logged_restore": logged_restore,
    }


def oracle_sql() -> dict[str, str]:
    out = {n: _oracle(other or sql, changing) for n, (sql, changing, other) in VIEWS.items()}
    out |= {n: _CASCADE_SQL for n in ("cascade_2level", "reconcile_cascade", "flush_after_failure", "logged_restore")}
    out["mixed_modes"] = _MIXED_SQL
    out["schema_qualified"] = f"WITH {_final('o', False)} SELECT o.status, COUNT(*) AS n FROM o GROUP BY o.status"
    out["deferred_coalesce"] = _oracle(VIEWS["join_inner_agg"][0], ("o", "c"))
    out["truncate_reload"] = f"WITH {_final('o', False)} " + VIEWS["scalar_agg"][0].replace("price", "price + 1")
    out["reconcile"] = _oracle(VIEWS["null_group_key"][0], ("o",))
    out["stream_foreachbatch"] = _oracle(VIEWS["filter_clause"][0], ("e",))
    return out
