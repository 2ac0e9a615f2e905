import numpy as np
from pyspark.sql import functions as F

from kurtosia.llm import nn_descent


def test_copies_give_the_smallest_ids(spark):
    """A third of the rows are copies of one vector, among other vectors and smaller groups of copies."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((1500, 8))
    kinds = rng.permutation(1500)
    vectors[kinds[:500]] = vectors[kinds[0]]
    for g in range(20):
        vectors[kinds[500 + 10 * g : 510 + 10 * g]] = vectors[kinds[500 + 10 * g]]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in nn_descent.nearest_neighbours(table, F.lit(True)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert sorted(got) == list(range(1500))
    for members in (kinds[:500], *[kinds[500 + 10 * g : 510 + 10 * g] for g in range(20)]):
        ids = sorted(members.tolist())
        for q in ids:
            assert got[q] == [i for i in ids[:6] if i != q][:5]


def test_vectors_of_one_byte_code_are_told_apart(spark):
    """400 different vectors that agree in every component to a 127th of the largest."""
    rng = np.random.default_rng(6)
    base = np.round(rng.uniform(-1, 1, 8) * 127) / 127
    base[0] = 1.0
    vectors = base + np.concatenate([np.zeros((400, 1)), rng.uniform(-0.4, 0.4, (400, 7)) / 127], axis=1)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    distance = ((unit[:, None] - unit[None]) ** 2).sum(2) + np.eye(400)
    want = np.argsort(distance, axis=1)[:, :5]
    hits = sum(r.id in want[r.query_id] for r in nn_descent.nearest_neighbours(table, F.lit(True)).collect())
    assert hits >= 0.95 * 2000
