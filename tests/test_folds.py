"""Folds in buckets give the rows of folds of whole keys, and one key spreads over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from kurtosia.operators import folds, sequences


def signal(spark, seed, n=900):
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([10, 10, 10, 10, 40])
        c = rng.choice([None, 20.0 + rng.random(), 20.0 + rng.random(), 60.0 + rng.random() * rng.choice([1, 30])]) if i % 200 < 150 else rng.uniform(0, 200)
        rows.append((rng.choice(["a", "a", None]), i, c, at if rng.random() > 0.02 else None, at + 5 if rng.random() > 0.02 else None))
    return spark.createDataFrame(rows, "k string, seq long, c double, s long, e long")


def rows(df, value):
    return sorted(((r[0], r[1], None if r[value] is None else float(r[value]), r["count"] if "count" in df.columns else 0) for r in df.collect()), key=repr)


@pytest.mark.parametrize("span", [1, 7, 100, 5000])
@pytest.mark.parametrize("relock", [1, 3, 5])
def test_tracks_in_buckets(spark, span, relock):
    df = signal(spark, span + relock)
    want = sequences.track_rotation(df, ["k"], ["seq"], "c", 5.0, relock)
    got = folds.track_rotation(df, ["k"], ["seq"], "c", F.floor(F.col("seq") / span), 5.0, relock)
    assert rows(got, "hz") == rows(want, "hz")


@pytest.mark.parametrize("span", [1, 7, 5000])
@pytest.mark.parametrize("alpha", [0.4, 0.97, 1.0, 0.01])
def test_means_in_buckets(spark, span, alpha):
    df = signal(spark, span)
    want = rows(sequences.smooth(df, ["k"], ["seq"], "c", "s", "e", alpha, 60), "value")
    got = rows(folds.smooth(df, ["k"], ["seq"], "c", "s", "e", F.floor(F.col("seq") / span), alpha, 60), "value")
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
    assert [r[2] is None for r in got] == [r[2] is None for r in want]
    assert [r[2] or 0.0 for r in got] == pytest.approx([r[2] or 0.0 for r in want], rel=1e-12)


def test_long_runs_and_empty_tables(spark):
    df = spark.range(6000).select(F.lit("a").alias("k"), F.col("id").alias("seq"), (F.col("id") % 97).cast("double").alias("c"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 5).alias("e"))
    want, got = (rows(x, "value") for x in (sequences.smooth(df, ["k"], ["seq"], "c", "s", "e"), folds.smooth(df, ["k"], ["seq"], "c", "s", "e", F.floor(F.col("seq") / 2500))))
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], rel=1e-12)
    none = df.limit(0)
    assert folds.smooth(none, ["k"], ["seq"], "c", "s", "e", F.col("seq")).collect() == folds.track_rotation(none, ["k"], ["seq"], "c", F.col("seq")).collect() == []


def test_values_that_are_not_finite(spark):
    df = spark.createDataFrame([(i, x, 10 * i, 10 * i + 5) for i, x in enumerate([1.0, float("nan"), 2.0, None, 3.0])], "seq long, c double, s long, e long").withColumn("k", F.lit("a"))
    for span in (1, 2, 10):
        got = [r.value for r in folds.smooth(df, ["k"], ["seq"], "c", "s", "e", F.floor(F.col("seq") / span)).orderBy("seq").collect()]
        assert got[0] == 1.0 and got[1] != got[1] and got[2] != got[2] and got[3] is None and got[4] == 3.0


def test_one_key_in_many_tasks(spark):
    df = spark.range(100_000).select(F.lit("a").alias("k"), F.col("id").alias("seq"), (20 + F.col("id") % 3).cast("double").alias("c"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = folds.track_rotation(df, ["k"], ["seq"], "c", F.floor(F.col("seq") / 1000)).withColumn("task", F.spark_partition_id())
        per_task = [r["n"] for r in out.groupBy("task").agg(F.count("*").alias("n")).collect()]
        assert len(per_task) >= 6 and max(per_task) < 50_000
        assert out.where("hz <> 20 + seq % 3").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
