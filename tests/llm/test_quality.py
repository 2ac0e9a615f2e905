"""The field against enumeration, held-out accuracy, and odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kurtosia.llm import quality

AT = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, quality string, x long"


@pytest.mark.parametrize("lengths", [[1], [3, 0, 1, 4], [2, 2, 5, 0]])
def test_marginals_equal_enumeration(lengths):
    rng = np.random.default_rng(sum(lengths))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    theta, turn = rng.normal(size=bounds[-1]) * 3, rng.normal(size=(2, 2))
    f, b, log_z = quality.Chains(bounds).messages(theta, turn)
    want, total = np.zeros(bounds[-1]), 0.0
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi > lo:
            ys = np.array(list(itertools.product((0, 1), repeat=hi - lo)))
            weight = np.exp([theta[lo:hi] @ y + sum(turn[a, c] for a, c in itertools.pairwise(y)) for y in ys])
            want[lo:hi] = weight @ ys / weight.sum()
            total += np.log(weight.sum())
    assert np.allclose(1 / (1 + np.exp(-(f + b))), want) and np.isclose(log_z, total)


def test_the_fit_is_a_minimum():
    rng = np.random.default_rng(0)
    bounds = np.concatenate(([0], np.cumsum(rng.integers(0, 6, 40))))
    x, good = rng.normal(size=(bounds[-1], 3)).astype(np.float32), rng.integers(0, 2, 40).astype(float)
    x[:, 0] += np.repeat(good, np.diff(bounds))
    weights, turn = quality.fit_field(x, bounds, good)
    y, inner = np.repeat(good, np.diff(bounds)), np.setdiff1d(np.arange(bounds[-1]), bounds[:-1])

    def loss(w, t):
        theta = w[0] + x @ w[1:]
        own = theta @ y + sum(t[int(y[i - 1]), int(y[i])] for i in inner)
        return quality.Chains(bounds).messages(theta, t)[2] - own + 0.5 * ((w[1:] ** 2).sum() + (t**2).sum() + 1e-3 * w[0] ** 2)

    best = loss(weights, turn)
    for _ in range(50):
        assert loss(weights + rng.normal(size=4) * 0.05, turn + rng.normal(size=(2, 2)) * 0.05) > best - 1e-4


def test_features_of_lines():
    text = "Good words here.\n\n  \nBAD!! BAD!! x\nGood words here."
    data = np.frombuffer(("" + text + "one line").encode(), dtype=np.uint8)
    x, size, bounds = quality.line_features(data, np.array([0, 0, len(text), len(text) + 8]))
    col = lambda k: x[:, quality.FEATURES.index(k)].tolist()
    assert bounds.tolist() == [0, 0, 3, 4] and size.tolist() == [14, 11, 14, 7]
    assert np.allclose(col("marked_words"), [0, 2 / 3, 0, 0]) and np.allclose(col("distinct"), [1, 2 / 3, 1, 1]) and np.allclose(col("stutter"), [0, 1 / 3, 0, 0])
    assert col("copy_in_text") == [1, 0, 1, 0] and col("first") == [1, 0, 0, 1] and col("last") == [0, 0, 1, 1]
    assert col("after_marked_words")[0] == col("marked_words")[1] == col("before_marked_words")[2]


def test_held_out_documents(spark):
    at = "/root/testdata/sf0.01"
    out = quality.op13(spark, at)
    labels = spark.read.parquet(f"{at}/labels.parquet")
    n = out.join(labels, "doc_id").where("held_out").agg(F.count("*").alias("n"), F.sum((F.col("predicted") == F.col("quality")).cast("int")).alias("right")).first()
    assert n.right >= 0.97 * n.n > 50
    assert out.count() == spark.read.parquet(f"{at}/documents.parquet").count()
    assert out.where("score is null or score < 0 or score > 1 or predicted <> (score >= 0.5)::int").count() == 0


def test_odd_rows(spark):
    labels = spark.read.parquet(f"{AT}/labels.parquet")
    texts = spark.read.parquet(f"{AT}/documents.parquet").select("doc_id", "text")
    odd = [(10**9, None), (10**9 + 1, ""), (10**9 + 2, " \n "), (None, "Some words of a line."), (10**9 + 3, "junk$$ " * 300_000), (10**9 + 3, "junk$$ " * 300_000), (10**9 + 4, "a b\n" * 30_000)]
    docs = spark.createDataFrame([(r.doc_id, r.text, "en", "q", 1) for r in texts.collect()] + [(i, t, "en", "q", 1) for i, t in odd], DOCS)
    out = quality.score(docs, labels)
    assert out.columns == ["doc_id", "text", "lang", "quality", "x"]
    got = {}
    for r in out.where("doc_id is null or doc_id >= 1000000000").collect():
        got.setdefault(r.doc_id, []).append(r.quality)
    assert got[10**9] == got[10**9 + 1] == got[10**9 + 2] and got[10**9][0] > 0.5
    assert len(got[10**9 + 3]) == 2 and len(set(got[10**9 + 3])) == 1 and all(0 <= x[0] <= 1 for x in got.values())
    assert quality.score(docs.limit(0), labels).count() == 0
    none = quality.score(docs, labels.where("quality = 1"), score_col="s").select("s").distinct().collect()
    assert len(none) == 1 and none[0].s > 0.5
    assert {r.s for r in quality.score(docs, labels.limit(0), score_col="s").collect()} == {0.5}


def test_labels_are_no_input(spark):
    """Held-out labels, languages and ids change no score."""
    labels = spark.read.parquet(f"{AT}/labels.parquet")
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    first = {r.doc_id: r.s for r in quality.score(docs, labels, score_col="s").select("doc_id", "s").collect()}
    second = {r.doc_id: r.s for r in quality.score(docs.withColumn("lang", F.lit("x")), other, score_col="s").select("doc_id", "s").collect()}
    assert first == second
