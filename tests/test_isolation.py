import math
import random

import pytest
from pyspark.sql import functions as F

from kurtosia.operators import isolation


def table(spark, n=3000):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 2)) for i in range(n)]
    rows += [(n + i, 9.0 + i, -20.0 - i) for i in range(5)] + [(n + 5, None, 1.0), (n + 6, math.nan, 1.0), (n + 7, 1.0, math.inf)]
    return spark.createDataFrame(rows, "id long, x double, y double")


def test_scores_by_plain_walks_in_any_partitioning(spark):
    df = table(spark)
    forest = isolation.fit(df, ["id"], ["x", "y"], trees=20, sample=64)
    nodes = {(r["tree"], r["node"]): r for r in forest.collect()}
    assert {t for t, _ in nodes} == set(range(20))
    other = isolation.fit(df.repartition(13).sortWithinPartitions("x"), ["id"], ["x", "y"], trees=20, sample=64)
    assert {(r["tree"], r["node"]): r for r in other.collect()} == nodes
    got = {r.id: (r.anomaly, r.x, r.y) for r in isolation.score(df, forest, ["x", "y"], 64).collect()}

    def length(t, x):
        r = nodes[t, 0]
        while r["feature"] >= 0:
            r = nodes[t, r["below"] if x[r["feature"]] < r["cut"] else r["above"]]
        return r["length"]

    for i, (told, *x) in got.items():
        if i >= 3005:
            assert told is None
        else:
            assert told == pytest.approx(2 ** (-sum(length(t, x) for t in range(20)) / 20 / isolation.average_length(64)), rel=1e-12)


def test_planted_outliers_rank_first(spark):
    """With as many trees and rows as the defaults say; twenty small trees vary too much for an exact ranking."""
    df = table(spark)
    for seed in (1, 2):
        scored = isolation.score(df, isolation.fit(df, ["id"], ["x", "y"], seed=seed), ["x", "y"])
        top = scored.orderBy(F.desc_nulls_last("anomaly")).limit(5).collect()
        assert {r.id for r in top} == {3000, 3001, 3002, 3003, 3004} and top[4].anomaly > 0.6


def test_trees_part_their_rows(spark):
    """Leaves that are not at the last level hold one row, or equal ones; a sample of n rows is used whole."""
    import numpy as np

    x = np.random.default_rng(1).normal(size=(50, 3))
    nodes = isolation.grown(x, 7, 0)
    inner = [v for v in nodes if v[1] >= 0]
    assert len(nodes) == 2 * len(inner) + 1
    assert all(v[5] >= 1 for v in nodes if v[1] < 0)
    assert isolation.grown(np.ones((9, 2)), 1, 0) == [(0, -1, 0.0, -1, -1, isolation.average_length(9))]


def test_small_empty_and_repeated(spark):
    df = table(spark, 3)
    forest = isolation.fit(df.unionAll(df), ["id"], ["x", "y"], trees=5, sample=64)
    assert sorted(forest.collect()) == sorted(isolation.fit(df, ["id"], ["x", "y"], trees=5, sample=64).collect())
    none = df.limit(0)
    assert isolation.score(none, isolation.fit(none, ["id"], ["x", "y"]), ["x", "y"]).collect() == []
    assert isolation.score(df.withColumn("more", F.lit("m")), forest, ["x", "y"]).columns == ["id", "x", "y", "more", "anomaly"]
