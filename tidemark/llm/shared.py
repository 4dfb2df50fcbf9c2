"""Tables, the cluster's shared folder, and sizes that operators check before they broadcast."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this part of the rows is not gathered; so there are at most as many such keys as its inverse.
HOT_SHARE = 1e-3
#: Bits of a map of keys, the same at any size; a full map only lets more rows pass to an exact join.
MAP_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """df stored with a number per row in `column`: whatever its ids are, each row can be told from the others from here on."""
    return stored(df.withColumn(column, F.monotonically_increasing_id()), name)[0]


def map_of(keys: DataFrame) -> np.ndarray:
    """A bit for the remainder of each number in column key: MAP_BITS bits whatever the table holds."""
    at = keys.select((F.pmod("key", F.lit(MAP_BITS)) + 1).alias("at"))
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for b, bits in zip(rows["b"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(bits, np.uint8)
    return out


def on_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether keys may be among those that the map was made of: never false for one that is."""
    at = np.mod(keys, MAP_BITS)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def spread_join(rows: DataFrame, named: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The join (inner or left) of rows with named, in which keys are unique.

    What named says of keys that very many rows have is broadcast, so that those rows stay where they are; the others are shuffled.
    """
    total = rows.count()
    hot = rows.groupBy(key).count().where(F.col("count") > max(1.0, total * HOT_SHARE)).select(key)
    often, _ = stored(named.join(F.broadcast(hot), key, "left_semi"), "hot")  # at most 1 / HOT_SHARE rows
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(named, key, how)
    return rows.join(F.broadcast(often), key).unionByName(rest)


def sampled(rows: DataFrame, bound: int) -> DataFrame:
    """About `bound` rows, spread by a hash of all their columns, or every row if there are no more; twice `bound` at most, also of equal rows."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.xxhash64(*rows.columns, F.lit("sample")).bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(max(1, int(bound / n * (1 << 63))))).limit(2 * bound)
