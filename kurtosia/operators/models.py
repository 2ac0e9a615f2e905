"""Training with pyspark.ml on whole groups held out, importances, and trees as CASE expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import memberships
from .metrics import by_class, overall
from .scoring import standardised
from .settling import settled

Names = Sequence[str]


def logistic() -> LogisticRegression:
    return LogisticRegression(maxIter=100, regParam=1e-3, weightCol="weight")


def shallow_tree() -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=4, seed=1, weightCol="weight")


def forest() -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=50, maxDepth=8, seed=1, weightCol="weight")


def one_vs_rest() -> OneVsRest:
    return OneVsRest(classifier=LinearSVC(maxIter=50, regParam=1e-3), weightCol="weight")


def scale_of(df: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each component of an array column: one row on the driver."""
    long = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    return [r.m for r in long], [r.s for r in long]


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: rows / (classes * rows of the class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = n.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(n), label).join(F.broadcast(whole), how="cross").withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def _ready(df: DataFrame, label: str, vector: str, scale: tuple) -> DataFrame:
    return df.withColumn("features", array_to_vector(standardised(F.col(vector), *scale))).withColumn("label", F.col(label).cast("double"))


def fitted(train: DataFrame, label: str, vector: str, make: Callable) -> tuple:
    """(model, scale): fitted on rows scaled by themselves, classes weighing alike."""
    scale = scale_of(train, vector)
    return make().fit(balanced(_ready(train, label, vector, scale), "label")), scale


def predicted_by(model: tuple, test: DataFrame, label: str, vector: str) -> DataFrame:
    """``test`` with ``predicted``."""
    fit, scale = model
    return fit.transform(_ready(test, label, vector, scale)).withColumn("predicted", F.col("prediction").cast("int")).select(*test.columns, "predicted")


def held_out_predictions(df: DataFrame, label: str, vector: str, fold: str, make: Callable, folds: int = 5, train_where: Callable | None = None) -> DataFrame:
    """``df`` with ``predicted``: each fold by a model of the others, scaled by them alone.

    ``train_where(k)`` narrows the rows that train for fold k further.  Models are a few per fold; Spark trains each over all its rows.
    Each fold's predictions are written before the next: the union is one of plain tables.
    """
    out = None
    for k in range(folds):
        train = df.where(F.col(fold) != k)
        train = train.where(train_where(k)) if train_where else train
        told = settled(predicted_by(fitted(train, label, vector, make), df.where(F.col(fold) == k), label, vector))
        out = told if out is None else out.unionByName(told)
    return out


def learning_curve(df: DataFrame, label: str, vector: str, trial: str, fold: str, make: Callable, counts: Sequence[int], folds: int = 5) -> DataFrame:
    """(trials, accuracy, macro_f1, ...): held-out folds by models of the first 1, 2, ... trials of each class outside them."""
    ids = [trial, fold, label]
    out = None
    for count in counts:
        dealt = memberships(df.select(*ids), label, trial, fold, list(range(folds)), count).where("role = 'train'")
        used = dealt.groupBy(*ids).agg(F.collect_set("holdout").alias("_trains"))
        rows = df.join(used, ids, "left")
        told = held_out_predictions(rows, label, vector, fold, make, folds, lambda k: F.array_contains("_trains", k)).drop("_trains")
        one = overall(by_class(told.withColumn("trials", F.lit(count)), ["trials"], label, "predicted"), ["trials"])
        out = one if out is None else out.unionByName(one)
    return out


def nested_predictions(df: DataFrame, label: str, vector: str, fold: str, makes: dict[str, Callable], folds: int = 5) -> DataFrame:
    """``df`` with ``model`` and ``predicted``: for each fold the kind of model that does best on the other folds, held out in turn.

    Best is the largest least precision or recall, then macro F1, then the name.
    """
    out = None
    for k in range(folds):
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        inner = {j: i for i, j in enumerate(x for x in range(folds) if x != k)}
        place = F.create_map(*[F.lit(x) for pair in inner.items() for x in pair])[F.col(fold)]
        numbered = train.withColumn("_inner", place)
        scores = []
        for name, make in makes.items():
            told = held_out_predictions(numbered, label, vector, "_inner", make, folds - 1)
            r = overall(by_class(told, [], label, "predicted"), []).first()
            scores.append((-min(r["min_precision"], r["min_recall"]), -r["macro_f1"], name))
        best = min(scores)[2]
        told = settled(predicted_by(fitted(train, label, vector, makes[best]), test, label, vector)).withColumn("model", F.lit(best))
        out = told if out is None else out.unionByName(told)
    return out


def case_of(model: DecisionTreeClassificationModel, values: Column) -> Column:
    """A fitted tree as one CASE expression over an array of its features."""

    def build(node) -> Column:
        if node.numDescendants() == 0:
            return F.lit(int(node.prediction()))
        split = node.split()
        return F.when(values[split.featureIndex()] <= split.threshold(), build(node.leftChild())).otherwise(build(node.rightChild()))

    return build(model._call_java("rootNode"))


def permutation_importance(model, df: DataFrame, label: str, vector: str, size: int, repeats: int = 5, seed: int = 1) -> list[tuple[float, float]]:
    """(mean, deviation) of the macro F1 lost when a feature is taken from another row, over ``repeats`` orders of the rows.

    Rows are dealt into parts by hash and shifted by one in a hashed order of each part; one pass scores all repeats of a feature.
    """
    parts = F.pmod(F.xxhash64(vector), F.lit(64))
    others = {f"_other{r}": F.lag(vector).over(Window.partitionBy(parts).orderBy(F.xxhash64(vector, F.lit(seed + r)))) for r in range(repeats)}
    moved = df.withColumns(others).persist()

    def f1(rows: DataFrame) -> dict:
        told = model.transform(rows.withColumn("features", array_to_vector("_x"))).withColumn("_p", F.col("prediction").cast(df.schema[label].dataType))
        return {r["_r"]: r["macro_f1"] for r in overall(by_class(told, ["_r"], label, "_p"), ["_r"]).collect()}

    whole = f1(df.withColumn("_x", F.col(vector)).withColumn("_r", F.lit(0)))[0]
    out = []
    for i in range(size):
        swapped = [F.struct(F.lit(r).alias("_r"), F.transform(vector, _swap(i, F.coalesce(f"_other{r}", vector))).alias("_x")) for r in range(repeats)]
        lost = [whole - x for x in f1(moved.select(label, F.inline(F.array(*swapped)))).values()]
        mean = sum(lost) / repeats
        out.append((mean, (sum((x - mean) ** 2 for x in lost) / repeats) ** 0.5))
    moved.unpersist()
    return out


def _swap(i: int, other: Column) -> Callable:
    return lambda x, j: F.when(j == i, other[i]).otherwise(x)
