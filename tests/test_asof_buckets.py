"""As-of joins in buckets of time equal those of one window a key, and one key spreads over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from kurtosia.operators import asof


def made(spark, seed):
    rng = random.Random(seed)
    left = [(rng.choice(["a", "b", None]), rng.randrange(0, 400), i) for i in range(300)]
    right = [(rng.choice(["a", "b", None, "c"]), rng.choice([rng.randrange(0, 400), 7, 350]), rng.choice([None, rng.randrange(9)]), rng.randrange(3)) for _ in range(40)]
    return spark.createDataFrame(left, "k string, t long, i int"), spark.createDataFrame(right, "k string, t long, v int, u int")


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("bucket", [1, 10, 64.5, 1000])
def test_buckets_change_nothing(spark, forward, bucket):
    left, right = made(spark, int(bucket))
    want = asof.as_of(left, right, ["k"], "t", ["v", "u"], forward)
    assert rows(asof.as_of(left, right, ["k"], "t", ["v", "u"], forward, bucket=bucket)) == rows(want)
    assert asof.as_of(left.limit(0), right, ["k"], "t", ["v"], forward, bucket=bucket).collect() == []


def test_interpolation_in_buckets(spark):
    left, right = made(spark, 5)
    grid, signal = left.select("k", "t").distinct(), right.where("v is not null").groupBy("k", "t").agg(F.max("v").cast("double").alias("x"))
    assert rows(asof.interpolate(grid, signal, ["k"], "t", "x", bucket=25)) == rows(asof.interpolate(grid, signal, ["k"], "t", "x"))


def test_one_key_in_many_tasks(spark):
    left = spark.range(0, 200_000).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    right = spark.range(0, 200_000, 1000).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = asof.as_of(left, right, ["k"], "t", ["v"], bucket=2_000).withColumn("task", F.spark_partition_id())
        per_task = [r["n"] for r in out.groupBy("task").agg(F.count("*").alias("n")).collect()]
        assert len(per_task) >= 6 and max(per_task) < 100_000
        assert out.where("v <> t - t % 1000").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
