import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kurtosia.operators import boosting

FEATURES = ["a", "b"]
SCALE = boosting.SCALE


def ring(spark, n=1500):
    """Class 1 inside a ring, class 2 in a corner, else 0: no single cut tells them apart."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        a, b = rng.uniform(-1, 1), rng.uniform(-1, 1)
        rows.append((i, a, b, 1 if a * a + b * b < 0.4 else 2 if a > 0.6 and b > 0.6 else 0, 3 * a + b * b))
    return spark.createDataFrame(rows, "id long, a double, b double, c int, y double")


def plain_tree(bins, g, h, depth, penalty, least):
    """The tree of the best cuts by looking at every cut of every node: {node: (feature, cut)}."""
    cuts, nodes = {}, {0: np.arange(len(g))}
    part = lambda at: (g[at].sum() / SCALE) ** 2 / (h[at].sum() / SCALE + penalty)
    for node in range(2**depth - 1):
        at = nodes.get(node)
        if at is None:
            continue
        found = []
        for f in range(bins.shape[1]):
            for cut in sorted(set(bins[at, f]))[:-1]:
                low, high = at[bins[at, f] <= cut], at[bins[at, f] > cut]
                if min(len(low), len(high)) >= least:
                    found.append((part(low) + part(high) - part(at), -f, -cut))
        if found and max(found)[0] > 1e-9:
            _, f, cut = max(found)
            cuts[node] = (-f, -cut)
            nodes[2 * node + 1], nodes[2 * node + 2] = at[bins[at, -f] <= -cut], at[bins[at, -f] > -cut]
    return cuts


def cuts_of(tree):
    return {int(i): (int(tree.feature[i]), int(tree.cut[i])) for i in np.flatnonzero(tree.feature >= 0)}


def same(one, other):
    return len(one.rounds) == len(other.rounds) and all(
        np.array_equal(x.feature, y.feature) and np.array_equal(x.cut, y.cut) and np.array_equal(x.value, y.value) for a, b in zip(one.rounds, other.rounds, strict=True) for x, y in zip(a, b, strict=True)
    )


def test_cuts_by_looking_at_all(spark):
    df = ring(spark, 400)
    edges = boosting.even_edges(df, FEATURES, 8)
    model = boosting.boosted(df, "y", FEATURES, edges, rounds=2, depth=3, rate=0.5, least_rows=5)
    rows = df.orderBy("id").collect()
    x, y = np.array([[r.a, r.b] for r in rows]), np.array([r.y for r in rows])
    y = (y - y.min()) / (y.max() - y.min())
    bins = np.array([[1 + sum(e <= v for e in edges[f]) for f, v in enumerate(row)] for row in x])
    raw = np.full(len(y), np.floor(y * SCALE + 0.5).sum() / len(y) / SCALE)
    h = np.full(len(y), SCALE)
    for (tree,) in model.rounds:
        g = np.floor((raw - y) * SCALE + 0.5).astype(np.int64)
        assert cuts_of(tree) == plain_tree(bins, g, h, 3, 1.0, 5)
        raw = raw + tree.value[tree.places(bins, 3), 0]
    got = [r.predicted[0] for r in boosting.predicted(df, model, FEATURES).orderBy("id").collect()]
    assert got == pytest.approx(list(model.low + model.width * raw), rel=1e-12)


def test_same_in_any_partitioning_and_over_written_rounds(spark, monkeypatch):
    df = ring(spark, 600)
    edges = boosting.even_edges(df, FEATURES, 8)
    fit = lambda d: boosting.boosted(d, "c", FEATURES, edges, "classes", rounds=3, depth=2)
    one = fit(df.coalesce(1))
    assert same(one, fit(df.repartition(7, "b")))
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 1)
    assert same(one, fit(df))
    forest = lambda d: boosting.extra_trees(d, "c", FEATURES, edges, trees=3, depth=3)
    assert same(forest(df.coalesce(1)), forest(df.repartition(5, "a")))


def test_classes_of_held_out_rows(spark):
    df = ring(spark)
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    edges = boosting.ranked_edges(train, FEATURES, 16)
    boosted = boosting.boosted(train, "c", FEATURES, edges, "classes", rounds=12, depth=3, rate=0.4)
    forest = boosting.extra_trees(train, "c", FEATURES, edges, trees=20, depth=6)
    for model in (boosted, forest):
        got = boosting.predicted(test, model, FEATURES).select("c", "predicted").collect()
        assert all(sum(r.predicted) == pytest.approx(1) and min(r.predicted) >= 0 for r in got)
        assert sum(r.predicted.index(max(r.predicted)) == r.c for r in got) > 0.9 * len(got)


def test_random_cuts_lie_within_their_node(spark):
    df = ring(spark, 500)
    edges = boosting.even_edges(df, FEATURES, 16)
    model = boosting.extra_trees(df, "c", FEATURES, edges, trees=8, depth=4, share=0.5)
    rows = df.collect()
    bins = np.array([[1 + sum(e <= v for e in edges[f]) for f, v in enumerate((r.a, r.b))] for r in rows])
    c = np.array([r.c for r in rows])
    weight = np.array([round(len(c) / (3 * (c == k).sum()) * SCALE) for k in range(3)])[c]
    assert len({cuts_of(t)[0] for (t,) in model.rounds}) > 3
    for (tree,) in model.rounds:
        for level in range(5):
            at = tree.places(bins, level)
            for node in set(at.tolist()):
                here = at == node
                assert tree.value[node] == pytest.approx([weight[here & (c == k)].sum() / weight[here].sum() for k in range(3)])
                if tree.feature[node] >= 0:
                    held = bins[here, tree.feature[node]]
                    assert held.min() <= tree.cut[node] < held.max()


def test_nulls_empties_ties_and_clashing_names(spark):
    rows = [(1, None, 1.0, 0, 1.0), (2, math.nan, 1.0, 0, 1.0), (3, 5.0, None, 1, 4.0), (4, math.inf, 2.0, 1, 4.0), (5, 1.0, 1.0, None, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c int, y double")
    edges = boosting.even_edges(df, FEATURES, 4)
    assert edges == [[2.0, 3.0, 4.0], [1.25, 1.5, 1.75]]
    model = boosting.boosted(df, "y", FEATURES, edges, rounds=1, depth=1, rate=1.0, penalty=0.0, least_rows=1)
    assert cuts_of(model.rounds[0][0]) == {0: (0, 0)}  # what is missing lies below the rest
    told = {r.id: r.predicted[0] for r in boosting.predicted(df, model, FEATURES).collect()}
    assert told == pytest.approx({1: 1.0, 2: 1.0, 3: 4.0, 4: 4.0, 5: 4.0})
    more = df.select("*", F.lit("x").alias("tree"), F.lit("y").alias("bin"))
    assert same(model, boosting.boosted(more, "y", FEATURES, edges, rounds=1, depth=1, rate=1.0, penalty=0.0, least_rows=1))
    assert boosting.predicted(more, model, FEATURES).columns == ["id", "a", "b", "c", "y", "tree", "bin", "predicted"]
    for none in (df.limit(0), df.where("id = 5")):
        flat = boosting.even_edges(none.where("false"), FEATURES)
        assert flat == [[], []]
        assert [r.predicted for r in boosting.predicted(df, boosting.boosted(none, "y", FEATURES, flat), FEATURES).collect()] == [[0.0]] * 5
        assert boosting.extra_trees(none, "c", FEATURES, flat).rounds == []
        assert boosting.boosted(none, "c", FEATURES, flat, "classes").rounds == []
    alike = boosting.boosted(df.where("id < 3"), "y", FEATURES, edges)
    assert alike.rounds == [] and {r.predicted[0] for r in boosting.predicted(df, alike, FEATURES).collect()} == {1.0}


def test_passes_read_blocks_of_rows(spark, monkeypatch):
    held = []
    settled = boosting.settled
    monkeypatch.setattr(boosting, "settled", lambda df: held.append(settled(df)) or held[-1])
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 1)
    df = ring(spark, 1500).coalesce(2)
    boosting.boosted(df, "c", FEATURES, boosting.even_edges(df, FEATURES, 8), "classes", rounds=2, depth=2)
    boosting.extra_trees(df, "c", FEATURES, boosting.even_edges(df, FEATURES, 300), trees=2, depth=2)
    assert len(held) == 3 and all(0 < table.count() <= 2 for table in held)


def test_forests_keep_equal_rows_once(spark, monkeypatch):
    """Forty copies of a table are no more to grow trees on than the table itself, and give the same trees."""
    held = []
    settled = boosting.settled
    monkeypatch.setattr(boosting, "settled", lambda df: held.append(settled(df)) or held[-1])
    df = ring(spark, 300)
    edges = boosting.even_edges(df, FEATURES, 8)
    grow = lambda d: boosting.extra_trees(d, "c", FEATURES, edges, trees=3, depth=3)
    one, forty = grow(df), grow(df.crossJoin(spark.range(40).select()))
    kept = [t.selectExpr("sum(length(_y) / 8) AS n").first().n for t in held]
    assert kept[0] == kept[1] <= 300
    assert all(np.array_equal(a.cut, b.cut) and np.allclose(a.value, b.value, rtol=1e-12) for (a,), (b,) in zip(one.rounds, forty.rounds, strict=True))


def test_sums_of_whole_numbers_are_exact():
    column = np.array([(1 << 60) + 1, 3, -(1 << 40) - 1, 5])
    assert boosting._sums(np.array([0, 0, 1, 1]), column, 3).tolist() == [(1 << 60) + 4, 4 - (1 << 40), 0]
