"""Connected components of a link table, as alternating large-star and small-star joins.

Every round is a grouped minimum and a join; no neighbourhood, component or link list is
ever held by one task or by the driver: where nodes have very many links, of which there are
few, their minima are broadcast, so that those links stay where they are. Rounds are tables in
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT_SHARE, discard, stored


#: Links of a node that one task takes in any case.
HUB = 1 << 14


def _with_least(edges: DataFrame, least: DataFrame, bound: float) -> DataFrame:
    """edges with m of their node a; least has (a, m, n), n being the number of a's edges. No more nodes have over `bound` than can be broadcast."""
    if least.where(F.col("n") > bound).isEmpty():
        return edges.join(least.select("a", "m").hint("merge"), "a")
    hubs = least.where(F.col("n") > bound).select("a", "m")
    found = edges.join(F.broadcast(hubs), "a", "left")
    return found.where("m IS NOT NULL").unionByName(found.where("m IS NULL").select("a", "b").join(least.select("a", "m").hint("merge"), "a"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return _with_least(both, least, max(HUB, 2 * total * HOT_SHARE)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, max(HUB, total * HOT_SHARE)).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node reachable.

    Self links and repeated links are allowed; a node without a link has no row. An empty
    table gives an empty table.
    """
    spark = edges.sparkSession
    now, path = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(now)
    while before[0]:
        after, after_path = stored(_small_star(_large_star(now, before[0]), before[0]), "links")
        discard(spark, path)
        now, path, state = after, after_path, _state(after)
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
