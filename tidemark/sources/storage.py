"""Where states and snapshots live: tables in the cluster's shared folder, or in a folder of the user's."""

from __future__ import annotations

import json
import tempfile
import uuid

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from .changes import Delta


#: The column that says whether a row leaves (-1) or enters (1).
SIGN = "__sign"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and all is on one machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def path_of(df: DataFrame | None) -> str | None:
    """The folder that a store wrote df to, if it did."""
    return getattr(df, "_tidemark_path", None)


class Store:
    """Versioned Parquet tables below one folder. A version is written whole before anything points at it."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.durable = spark, folder is not None
        self.folder = folder or f"{shared_dir(spark)}/tidemark-views-{uuid.uuid4().hex}"
        self.new: dict[str, set[str]] = {}  # by name, what was written since its owner looked

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Lineage ends here: the result reads files that every executor sees."""
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        self.new.setdefault(name, set()).add(path)
        df.write.parquet(path)
        return self.read(path, df.schema)

    def write_signed(self, name: str, df: DataFrame) -> Delta:
        """Rows that leave and rows that enter as two tables, by one evaluation."""
        from .changes import Delta

        path, rows = f"{self.folder}/{name}/{uuid.uuid4().hex}", df.drop(SIGN)
        df.write.partitionBy(SIGN).parquet(path)
        sides = []
        for value in (-1, 1):
            part = f"{path}/{SIGN}={value}"
            files, target = self._file(part)
            there = files.exists(target)
            if there:
                self.new.setdefault(name, set()).add(part)
            sides.append(self.read(part, rows.schema) if there else None)
        return Delta(*sides)

    def read(self, path: str, schema=None) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path) if schema is not None else self.spark.read.parquet(path)
        out._tidemark_path = path
        return out

    def _file(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def delete(self, path: str) -> None:
        files, target = self._file(path)
        files.delete(target, True)

    def save_json(self, name: str, value: object) -> None:
        """Written beside the old one and moved over it, so that there is always a whole one."""
        new = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        files, target = self._file(new)
        out = files.create(target, True)
        out.write(json.dumps(value).encode())
        out.close()
        _, old = self._file(f"{self.folder}/{name}")
        files.delete(old, True)
        if not files.rename(target, old):
            raise RuntimeError(f"can't write {name}")

    def load_json(self, name: str) -> object | None:
        files, target = self._file(f"{self.folder}/{name}")
        if not files.exists(target):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/{name}").collect()))
