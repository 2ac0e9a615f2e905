"""Scoring with given linear models and trees, and their explanation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def standardised(vector: Column, mean: Sequence[float], scale: Sequence[float]) -> Column:
    """(x - mean) / scale; a scale of zero counts as one."""
    m, s = (F.array(*[F.lit(float(v)) for v in x]) for x in (mean, [v or 1.0 for v in scale]))
    return F.zip_with(F.zip_with(vector, m, lambda x, y: x - y), s, lambda x, y: x / y)


def margins(vector: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """One linear score a class."""
    dot = lambda w: F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(v)) for v in w]), lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
    return F.array(*[dot(w) + float(b) for w, b in zip(weights, bias, strict=True)])


def folded(models: Sequence[tuple]) -> tuple[list[list[float]], list[float]]:
    """Standardised linear models (mean, scale, weights, bias) as one model on raw features with their mean margin."""
    n, classes, size = len(models), len(models[0][3]), len(models[0][0])
    weights = [[sum(m[2][c][i] / (m[1][i] or 1.0) for m in models) / n for i in range(size)] for c in range(classes)]
    bias = [sum(m[3][c] - sum(m[2][c][i] * m[0][i] / (m[1][i] or 1.0) for i in range(size)) for m in models) / n for c in range(classes)]
    return weights, bias


def best_class(scores: Column) -> Column:
    """Position (from 0) of the largest score, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def contributions(vector: Column, weights: Sequence[float]) -> Column:
    """What each feature adds to a linear score; with the bias they sum up to it."""
    return F.zip_with(vector, F.array(*[F.lit(float(w)) for w in weights]), lambda x, y: x * y)


def tree(node: dict, columns: Sequence[str]) -> Column:
    """A decision tree ({feature, threshold, left, right} or {label}) as one CASE expression; left takes values up to the threshold."""
    if "label" in node:
        return F.lit(node["label"])
    below = F.col(columns[node["feature"]]) <= node["threshold"]
    return F.when(below, tree(node["left"], columns)).otherwise(tree(node["right"], columns))
