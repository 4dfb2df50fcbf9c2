"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Per view: a recompute, and flushes of inserts, updates and deletes of a share of the rows of its
largest source, each after one change that is not timed. A flush includes writing the change to the
source. The value is the sum of all times.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.engine import Engine

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Percent of the rows -> one in so many.
SHARES = {"0.1%": 1000, "1%": 100, "10%": 10, "30%": 3}
LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag AS flag", "l_linestatus AS ls", "CAST(l_quantity AS DECIMAL(18,2)) AS qty", "CAST(l_extendedprice AS DECIMAL(18,2)) AS price"]
VIEWS = {
    "sum_count": "SELECT l_partkey, SUM(qty) AS sum_qty, COUNT(*) AS n FROM l GROUP BY l_partkey",
    "sum_count_few": "SELECT flag, ls, SUM(qty) AS sum_qty, COUNT(*) AS n FROM l GROUP BY flag, ls",
    "minmax": "SELECT l_partkey, MIN(price) AS lo, MAX(price) AS hi FROM l GROUP BY l_partkey",
    "join5": "SELECT l.l_orderkey, l.l_linenumber, l.qty, l.price, o.o_orderdate, c.c_name, p.p_brand, s.s_name FROM l JOIN orders AS o ON l.l_orderkey = o.o_orderkey "
    "JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN part AS p ON l.l_partkey = p.p_partkey JOIN supplier AS s ON l.l_suppkey = s.s_suppkey",
}


def timed(f) -> float:
    began = time.time()
    f()
    return round(time.time() - began, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    table = lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
    lines = table("lineitem").selectExpr(*LINES)
    pick = lambda n, salt: lines.where(F.pmod(F.xxhash64(*lines.columns, F.lit(salt)), F.lit(n)) == 0)
    changed = lambda df: df.withColumns({"qty": (F.col("qty") + 1).cast("decimal(18,2)"), "price": (F.col("price") + 1).cast("decimal(18,2)")})
    for name, sql in VIEWS.items():
        engine = Engine(spark)
        engine.register("l", lines)
        for other in ("orders", "customer", "part", "supplier"):
            engine.register(other, table(other))
        engine.create_view("v", sql)

        def cycle(rows):
            yield "insert", lambda: engine.apply("l", inserts=rows)
            yield "update", lambda: engine.apply("l", updates=(rows, changed(rows)))
            yield "delete", lambda: engine.apply("l", deletes=changed(rows))

        for _, f in cycle(pick(2000, "warm")):
            f()
        engine.compact("l")  # a recompute reads plain rows
        engine.reconcile("v")
        out[f"{name}_recompute"] = timed(lambda: engine.reconcile("v"))
        for label, n in SHARES.items():
            for kind, f in cycle(pick(n, label)):
                out[f"{name}_{kind}_{label}"] = timed(f)
    print(json.dumps({"metric": "maintained views: seconds per flush beside a recompute", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(SF_DIR)}))


if __name__ == "__main__":
    main()
