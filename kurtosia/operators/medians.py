"""Exact medians and MADs of keys of any size, without gathering a key's values.

A sketch of each key, merged from partial ones, brackets the middle; counting below and
inside the bracket finds it exactly.  Only distinct values in the bracket, one value in five hundred of
a large key, are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kurtosia.functions.numbers import natural_log

Names = Sequence[str]

ACCURACY = 10_000
MARGIN = 10 / ACCURACY  # ten times what a sketch may err


def _same_keys(left: DataFrame, right: DataFrame, keys: Names) -> DataFrame:
    """Both sides' columns where the keys, nulls included, are the same."""
    renamed = right.withColumnsRenamed({k: f"_right{i}" for i, k in enumerate(keys)})
    on = [F.col(k).eqNullSafe(F.col(f"_right{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, on, "left").drop(*[f"_right{i}" for i in range(len(keys))])


def medians(df: DataFrame, keys: Names, features: Names) -> DataFrame:
    """(keys, <feature>_median): the median of each feature's values that are not NULL, as ``F.median`` gives it.

    A key without values has NULL; NaN counts as largest; null keys are keys.  Without ``keys``, one row.
    """
    each = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)])
    rows = df.select(*keys, F.explode(each).alias("_e")).select(*keys, F.col("_e.f").alias("_f"), F.col("_e.v").alias("_v"))
    within = [*keys, "_f"]
    level = F.when(F.isnan("_v"), F.lit(math.inf)).otherwise(F.col("_v"))  # sketches know no NaN
    around = F.percentile_approx(level, [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY)
    bracket = rows.groupBy(*within).agg(F.count("_v").alias("_n"), around.alias("_a")).select(*within, "_n", F.col("_a")[0].alias("_lo"), F.col("_a")[1].alias("_hi"))
    side = F.when(F.col("_v").isNull(), 3).when(level < F.col("_lo"), 0).when(level <= F.col("_hi"), 1).otherwise(2)
    told = _same_keys(rows, bracket, within).select(*within, "_n", side.alias("_side"), F.when(side == 1, F.col("_v")).alias("_v"))
    counts = told.groupBy(*within, "_n", "_side", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*within).orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto)
    at = lambda rank: F.max(F.when((F.col("_side") == 1) & (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_c") < rank), F.col("_v")))
    middle = ranked.groupBy(*within, "_n").agg(at(F.floor((F.col("_n") + 1) / 2)).alias("_x"), at(F.floor(F.col("_n") / 2) + 1).alias("_y"))
    missed = (F.col("_n") > 0) & (F.col("_x").isNull() | F.col("_y").isNull())
    median = F.when(missed, F.raise_error(F.lit("a sketch erred by more than its bound")).cast("double")).when(F.col("_x") == F.col("_y"), F.col("_x")).otherwise(0.5 * F.col("_x") + 0.5 * F.col("_y"))
    found = middle.select(*within, median.alias("_m"))
    out = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_f") == i, F.col("_m"))).alias(f"{f}_median") for i, f in enumerate(features)])
    return out


def fit_medians(df: DataFrame, keys: Names, features: Names, where: Column | None = None) -> DataFrame:
    """``baseline.fit_medians`` for keys of any size."""
    return medians(df if where is None else df.where(where), keys, features)


def fit_robust(df: DataFrame, keys: Names, features: Names, least_scale: float = 0.20) -> DataFrame:
    """``baseline.fit_robust`` for keys of any size: (keys, <feature>_median, <feature>_scale), of logs."""
    logs = df.select(*keys, *[natural_log(F.col(f)).alias(f) for f in features])
    centre = medians(logs, keys, features)
    apart = _same_keys(logs, centre, keys).select(*keys, *[F.abs(F.col(f) - F.col(f"{f}_median")).alias(f) for f in features])
    spread = medians(apart, keys, features).withColumnsRenamed({f"{f}_median": f"{f}_scale" for f in features})
    scale = {f"{f}_scale": F.greatest(1.4826 * F.col(f"{f}_scale"), F.lit(least_scale)) for f in features}
    return _same_keys(centre, spread, keys).withColumns(scale)
