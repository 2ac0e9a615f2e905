"""A feature table kept up to date source by source, in generations.

Layout below the view's folder: ``data/part=<name>/`` holds the features built by one
refresh, ``generations/<number>/`` the table (source, fingerprint, part) of one generation, and
``claims/<number>`` says who may write it.  Nothing is overwritten: a generation is
readable once its table is complete, and the earlier ones stay so.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    at, fs = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def generations(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete generations, in order."""
    _, fs = _fs(spark, path)
    return [n for n in _numbers(spark, f"{path}/generations") if fs.exists(_fs(spark, f"{path}/generations/{n}/_SUCCESS")[0])]


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(source, fingerprint) of the files at ``path``: a hash of each one's bytes, taken where it is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("source"), F.sha2("content", 256).alias("fingerprint"))


def refresh(spark: SparkSession, path: str, sources: DataFrame, build: Callable[[DataFrame], DataFrame], version: str = "") -> int:
    """Brings the view to ``sources`` (source, fingerprint) and returns its generation.

    ``build(changed)`` gives the features, with a column ``source``, of a table (source): those new or of another
    fingerprint.  The rest keep the features they have; sources that vanished leave the
    generation.  ``version`` is of code and profile: another one builds all sources anew.
    Sources of null name fail, as do names given twice with different fingerprints.  With nothing to do, the
    generation stays.  A build that fails leaves no generation; of two
    refreshes that set out from the same one, the later to end fails.
    """
    bad = F.when(F.col("source").isNull(), F.raise_error(F.lit("a source has no name"))).when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two fingerprints of "), "source")))
    print_ = F.concat_ws(":", F.lit(version), "fingerprint")
    given = sources.groupBy("source").agg(F.min(print_).alias("fingerprint"), F.count_distinct(print_).alias("n")).withColumn("_bad", bad.cast("string")).where("_bad is null").select("source", "fingerprint")
    done = generations(spark, path)
    part = uuid.uuid4().hex
    if done:
        held = spark.read.parquet(f"{path}/generations/{done[-1]}")
        both = given.join(held.withColumnRenamed("fingerprint", "before"), "source", "full")
        table = both.select("source", "fingerprint", F.when(F.col("fingerprint") == F.col("before"), F.col("part")).alias("kept"))
    else:
        table = given.withColumn("kept", F.lit(None).cast("string"))
    staged = f"{path}/staged/{part}"
    table.write.parquet(staged)  # both uses below see one reading of the sources
    table = spark.read.parquet(staged)
    changed = table.where("fingerprint is not null and kept is null")
    vanished = table.where("fingerprint is null")
    if done and changed.unionByName(vanished).isEmpty():
        return done[-1]
    number = 1 + max([0, *done, *_numbers(spark, f"{path}/claims")])  # a claim without a generation is of a refresh that failed
    build(changed.select("source")).write.parquet(f"{path}/data/part={part}")
    table.where("fingerprint is not null").select("source", "fingerprint", F.coalesce("kept", F.lit(part)).alias("part")).write.parquet(f"{path}/staged/{part}_table")
    claim, fs = _fs(spark, f"{path}/claims/{number}")
    fs.create(claim, False).close()  # fails where another refresh has it
    target, _ = _fs(spark, f"{path}/generations/{number}")
    fs.mkdirs(target.getParent())
    if not fs.rename(_fs(spark, f"{path}/staged/{part}_table")[0], target):
        raise OSError(f"generation {number} could not be put in its place")
    return number


def features(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The features of a generation, else of the last complete one."""
    done = generations(spark, path)
    number = generation if generation is not None else (done[-1] if done else None)
    if number not in done:
        raise FileNotFoundError(f"{path}: no generation {'' if number is None else number}")
    table = spark.read.parquet(f"{path}/generations/{number}").select("source", "part")
    data = spark.read.option("basePath", f"{path}/data").option("mergeSchema", True).parquet(f"{path}/data")
    return data.withColumn("part", F.col("part").cast("string")).join(table, ["source", "part"], "left_semi").drop("part")
