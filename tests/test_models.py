import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from kurtosia.operators import models


def _rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, [float(i % 3) + float(rng.normal(0, 0.1)), float(rng.normal()), 1.0], i // 3 % 2) for i in range(240)]
    return spark.createDataFrame(rows, "id int, label int, x array<double>, fold int")


def test_models_of_held_out_folds(spark):
    df = _rows(spark)
    for make in (models.logistic, models.shallow_tree, models.one_vs_rest, models.forest):
        out = models.held_out_predictions(df, "label", "x", "fold", make, 2)
        assert out.count() == 240 and out.where("label = predicted").count() > 200


def test_trees_as_case_and_importance(spark):
    df = _rows(spark).withColumn("features", array_to_vector("x")).withColumn("label", F.col("label").cast("double"))
    model = models.shallow_tree().fit(models.balanced(df, "label"))
    out = model.transform(df).withColumn("case", models.case_of(model, F.col("x")))
    assert out.where("case <> prediction").count() == 0
    lost = models.permutation_importance(model, df.drop("features"), "label", "x", 2)
    assert lost[0][0] > 0.3 > abs(lost[1][0]) and all(d < 0.2 for _, d in lost)
    assert models.balanced(df.limit(10), "label").agg(F.sum("weight")).first()[0] > 9.9


def test_weights_reach_the_fit(spark):
    """Nine tenths of class 0 and features that tell little: without weights nearly all rows are predicted 0."""
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 10 == 0), [float(rng.normal(0.8 * (i % 10 == 0), 1))], i // 10 % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, label int, x array<double>, fold int")
    out = models.held_out_predictions(df, "label", "x", "fold", models.logistic, 2)
    assert out.where("label = 1 and predicted = 1").count() > 25


def test_learning_curve_and_nested_choice(spark):
    rng = np.random.default_rng(9)
    rows = [(i, i % 2, [float(i % 2) * 1.5 + float(rng.normal()), float(rng.normal())], i // 2 % 3, 10 * (i % 2) + i // 2 % 6) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, label int, x array<double>, fold int, trial int")
    curve = models.learning_curve(df, "label", "x", "trial", "fold", models.logistic, (1, 2), 3).orderBy("trials").collect()
    assert [r.trials for r in curve] == [1, 2] and all(0.5 < r.accuracy <= 1 for r in curve)
    out = models.nested_predictions(df, "label", "x", "fold", {"tree": models.shallow_tree, "line": models.logistic}, 3)
    assert out.count() == 240 and out.select("fold", "model").distinct().count() == 3
