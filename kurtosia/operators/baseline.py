"""Baselines of normal operation, and how far windows lie from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kurtosia.functions.numbers import log_feature, natural_log, rate

Names = Sequence[str]


def numbered(df: DataFrame, keys: Names, order: Names, name: str = "row") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def fit_mean_std(df: DataFrame, keys: Names, features: Names) -> DataFrame:
    """Mean and population deviation of each feature: <feature>_mean, <feature>_std, and n."""
    stats = [s for f in features for s in (F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std"))]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *stats)


def refit(first: DataFrame, later: DataFrame, keys: Names, features: Names) -> DataFrame:
    """The later fit with <feature>_original: the means of the first fit, which no refit changes."""
    originals = first.select(*keys, *[F.col(f"{f}_mean").alias(f"{f}_original") for f in features])
    return later.join(originals, list(keys), "left").withColumns({f"{f}_original": F.coalesce(f"{f}_original", f"{f}_mean") for f in features})


def fit_log(df: DataFrame, keys: Names, order: Names, features: Names, n: int = 120, relative: float = 0.02, floor: float = 1e-6) -> DataFrame:
    """Mean and floored sample deviation, in log space, of each key's first ``n`` rows; keys with fewer have no baseline."""
    first = numbered(df, keys, order).where(F.col("row") <= n)
    stats = [s for f in features for s in (F.avg(log_feature(F.col(f))).alias(f"{f}_mean"), F.stddev_samp(log_feature(F.col(f))).alias(f"{f}_sd"))]
    out = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *stats).where(F.col("n") == n)
    std = lambda f: F.greatest(F.col(f"{f}_sd"), relative * F.abs(f"{f}_mean"), F.lit(floor))
    return out.withColumns({f"{f}_std": std(f) for f in features}).drop(*[f"{f}_sd" for f in features])


def fit_robust(df: DataFrame, keys: Names, features: Names, least_scale: float = 0.20) -> DataFrame:
    """Median of the logs and scale max(1.4826 * MAD, ``least_scale``) of each feature, exactly.

    Zeros have the log -infinity and count as smallest; null keys are keys.
    """
    logs = df.select(*keys, *[natural_log(F.col(f)).alias(f) for f in features])
    medians = logs.groupBy(*keys).agg(*[F.median(f).alias(f"{f}_median") for f in features]).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    spread = [F.greatest(1.4826 * F.median(F.abs(F.col(f) - F.col(f"{f}_median"))), F.lit(least_scale)).alias(f"{f}_scale") for f in features]
    return logs.join(medians, same).groupBy(*keys, *[f"{f}_median" for f in features]).agg(*spread)


def fit_medians(df: DataFrame, keys: Names, features: Names, where: Column | None = None) -> DataFrame:
    """The median of each feature over the rows of the baseline role."""
    return (df if where is None else df.where(where)).groupBy(*keys).agg(*[F.median(f).alias(f"{f}_median") for f in features])


def z_scores(df: DataFrame, baseline: DataFrame, keys: Names, features: Names, logs: bool = True) -> DataFrame:
    """Adds <feature>_z; NULL where the key has no baseline."""
    cols = [f"{f}_{x}" for f in features for x in ("mean", "std")]
    value = lambda f: log_feature(F.col(f)) if logs else F.col(f)
    z = {f"{f}_z": rate(value(f) - F.col(f"{f}_mean"), F.col(f"{f}_std")) for f in features}
    return df.join(baseline.select(*keys, *cols), list(keys), "left").withColumns(z).drop(*cols)


def deviates(features: Names, sigma: float = 3.0, least: int = 1) -> Column:
    """Whether ``least`` of the z scores are over ``sigma`` in size; NULL where one is missing."""
    return sum([(F.abs(f"{f}_z") > sigma).cast("int") for f in features], F.lit(0)) >= least


def out_of_range(features: Names, k: float = 3.0, limits: dict[str, float] | None = None) -> Column:
    """Names of the features outside mean +- k deviations, and of those over an absolute limit."""
    outside = lambda f: (F.col(f) < F.col(f"{f}_mean") - k * F.col(f"{f}_std")) | (F.col(f) > F.col(f"{f}_mean") + k * F.col(f"{f}_std"))
    over = [F.when(F.col(f) > x, F.lit(f"{f}_limit")) for f, x in (limits or {}).items()]
    return F.array_compact(F.array(*[F.when(outside(f), F.lit(f)) for f in features], *over))


def drift_ratio(value: Column, original: Column, limit: float = 1.5) -> Column:
    """Whether a value has grown to ``limit`` times its original mean; NULL for originals near zero."""
    return F.when(F.abs(original) >= 1e-9, value / original >= limit)


def worst_feature(features: Names) -> Column:
    """The feature of the largest z in size, the first of equals."""
    sizes = F.array(*[F.abs(f"{f}_z") for f in features])
    return F.element_at(F.array(*[F.lit(f) for f in features]), F.array_position(sizes, F.array_max(sizes)).cast("int"))


def with_fallback(df: DataFrame, bins: DataFrame, default: DataFrame, bin_cols: Names, values: Names, least: int = 20) -> DataFrame:
    """Adds ``values`` of the row's bin, or of the one-row default where the bin has fewer than ``least`` rows."""
    used = bins.where(F.col("n") >= least).select(*bin_cols, *values)
    one = F.broadcast(default.select(*[F.col(v).alias(f"_{v}") for v in values]))
    out = df.join(used, list(bin_cols), "left").join(one, how="left")
    return out.withColumns({v: F.coalesce(v, f"_{v}") for v in values}).drop(*[f"_{v}" for v in values])


def speed_bin(hz: Column, cuts: Sequence[float] = (25.0, 40.0, 52.0)) -> Column:
    """The number of cuts at or below a speed."""
    return sum([(hz >= c).cast("int") for c in cuts], F.lit(0))


def relative_to_median(df: DataFrame, features: Names, normal: Column) -> DataFrame:
    """Adds <feature>_relative: the difference from the median of the normal rows (one row, broadcast)."""
    medians = df.where(normal).agg(*[F.median(f).alias(f"{f}_median") for f in features])
    return df.join(F.broadcast(medians), how="left").withColumns({f"{f}_relative": F.col(f) - F.col(f"{f}_median") for f in features})


def leading_share(df: DataFrame, keys: Names, order: Names, share: float = 0.6) -> DataFrame:
    """Adds ``leading``: the row is among the first int(n * share) of its key."""
    whole = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return numbered(df, keys, order, "_row").withColumn("leading", F.col("_row") <= F.floor(whole * share)).drop("_row")
