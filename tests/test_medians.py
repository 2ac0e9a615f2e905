import math
import random

import pytest
from pyspark.sql import functions as F

from kurtosia.operators import baseline, medians


def as_text(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_medians_equal_those_of_gathered_values(spark):
    rng = random.Random(4)
    odd = [None, 0.0, -0.0, math.inf, -math.inf, 1e300, -1e300, 5e-324]
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice([rng.gauss(0, 1), float(rng.randrange(3)), rng.choice(odd)]), rng.choice([None, rng.lognormvariate(0, 30)])) for _ in range(3000)]
    rows += [("few", 1.0, None), ("few", 4.0, None), ("one", 2.5, 1.0), ("none", None, None), ("nan", math.nan, 1.0), ("nan", math.nan, 2.0), ("nan", 1.0, 4.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    same = lambda out: out.select("k", F.col("x_median") + 0.0, "y_median")
    assert as_text(same(medians.medians(df, ["k"], ["x", "y"]))) == as_text(same(baseline.fit_medians(df, ["k"], ["x", "y"])))
    assert as_text(medians.medians(df, [], ["y"])) == as_text(baseline.fit_medians(df, [], ["y"]))
    assert medians.medians(df.limit(0), ["k"], ["x"]).collect() == []


def test_robust_fits(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i % 7, rng.lognormvariate(1, 2), rng.random() + 1) for i in range(4000)], "k int, x double, y double")
    want = {r.k: (r.x_median, r.x_scale, r.y_median, r.y_scale) for r in baseline.fit_robust(df, ["k"], ["x", "y"]).collect()}
    got = {r.k: (r.x_median, r.x_scale, r.y_median, r.y_scale) for r in medians.fit_robust(df, ["k"], ["x", "y"]).collect()}
    assert got == want


def test_one_large_key_sorts_few_values(spark):
    n = 400_001
    df = spark.range(n).select(F.lit("a").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(n))).cast("double").alias("x"))
    (r,) = medians.medians(df, ["k"], ["x"]).collect()
    assert r.x_median == (n - 1) / 2
    tied = df.withColumn("x", F.floor(F.col("x") / 150_000).cast("double"))
    assert medians.medians(tied, ["k"], ["x"]).first().x_median == 1.0
    out = medians.medians(df, ["k"], ["x"])._jdf.queryExecution().toString()
    assert "collect_list" not in out and "percentile(" not in out
    assert pytest.approx(medians.MARGIN * 2) == 0.002


def sql_fits(rows):
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE TABLE t (k VARCHAR, x DOUBLE)")
    db.executemany("INSERT INTO t VALUES (?, ?)", rows)
    return {k: (m, s) for k, m, s in db.execute("SELECT k, median(ln(x)), greatest(1.4826 * mad(ln(x)), 0.2) FROM t GROUP BY k").fetchall()}


ZEROS = [("some", x) for x in (0.0, 1.0, 2.0, 8.0, 9.0)] + [("half", 0.0), ("half", 5.0), ("most", 0.0), ("most", 0.0), ("most", 3.0), ("below", -1.0), ("below", 2.0), ("below", 4.0)]
ZEROS += [("none", None), ("gaps", None), ("gaps", 2.0), ("gaps", 0.0), ("gaps", 3.0), (None, 0.0), (None, 2.0), (None, 7.0)]


def test_logs_of_zeros_count_as_smallest(spark):
    df = spark.createDataFrame(ZEROS, "k string, x double")
    got = {r.k: (r.x_median, r.x_scale) for r in baseline.fit_robust(df, ["k"], ["x"]).collect()}
    want = sql_fits(ZEROS)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], nan_ok=True), k


def test_counted_logs_of_zeros_count_as_smallest(spark):
    df = spark.createDataFrame(ZEROS, "k string, x double")
    got = {r.k: (r.x_median, r.x_scale) for r in medians.fit_robust(df, ["k"], ["x"]).collect()}
    want = sql_fits(ZEROS)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], nan_ok=True), k
