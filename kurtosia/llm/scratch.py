"""Intermediate tables in the folder that the cluster shares, so that lost executors lose no finished stage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Has Spark delete a query's shuffle files when it ends: a saved table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of the session's warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (root or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


class Scratch:
    """Writes DataFrames as Parquet below the shared folder and reads them again: this cuts their lineage.

    Tables that are no longer needed are dropped at once with ``drop``; what the
    returned result still reads goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        path = self._path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        return self.measure(df)[0]

    def measure(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """The saved table, and its number of rows (``n``) and ``metrics``, observed while it was written."""
        self._n += 1
        at = f"{self.root}/{self._n}"
        seen = Observation()
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in metrics.items()]).write.parquet(at)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out, seen.get

    def drop(self, df: DataFrame) -> None:
        self._fs.delete(self._path(df._scratch_path), True)
