"""Windows of a signal: framing, and statistics of each window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kurtosia.functions.numbers import rate

Names = Sequence[str]


def frames(df: DataFrame, signal: str, size: int, hop: int) -> DataFrame:
    """A row for each window of an array: ``start`` and ``frame``.  Windows begin at 0, every ``hop``; a partial tail is dropped."""
    starts = F.when(F.size(signal) >= size, F.sequence(F.lit(0), F.size(signal) - size, F.lit(hop)))
    out = df.withColumn("start", F.explode(starts))
    return out.withColumn("frame", F.slice(signal, F.col("start") + 1, size))


def frames_of_samples(df: DataFrame, keys: Names, i: str, size: int, hop: int) -> DataFrame:
    """Samples in long form with the number of each window they are in (``frame``); full windows only.

    Windows need not be collected: a sample is repeated once for each window that covers it.
    """
    first = F.greatest(F.lit(0), F.floor((F.col(i) - size) / hop) + 1)
    out = df.withColumn("frame", F.explode(F.sequence(first, F.floor(F.col(i) / hop))))
    full = out.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).drop("_n")
    return out.join(full, [*keys, "frame"], "left_semi")


def samples(df: DataFrame, keys: Names, signal: str) -> DataFrame:
    """Long form (keys, i, x) of an array of samples, in double precision."""
    return df.select(*keys, F.posexplode(signal).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda t, v: t + v) / F.size(x)


def centred(signal: Column) -> Column:
    """The array without its mean."""
    mean = _mean(F.transform(signal, lambda v: v.cast("double")))
    return F.transform(signal, lambda v: v.cast("double") - mean)


def rms(signal: Column) -> Column:
    """Root mean square, the mean left in."""
    return F.sqrt(_mean(F.transform(signal, lambda v: v.cast("double") * v.cast("double"))))


def window_statistics(long: DataFrame, keys: Names) -> DataFrame:
    """rms, kurtosis (excess), skewness, crest and peak of the centred samples (keys, i, x), in two aggregations."""
    mean = long.groupBy(*keys).agg(F.avg("x").alias("mean"))
    c = F.col("x") - F.col("mean")
    moment = lambda k: F.avg(F.pow(c, k))
    out = long.join(mean, list(keys)).groupBy(*keys).agg(*[moment(float(k)).alias(f"m{k}") for k in (2, 3, 4)], F.max(F.abs(c)).alias("peak"))
    return out.select(
        *keys,
        F.sqrt("m2").alias("rms"),
        (rate(F.col("m4"), F.col("m2") * F.col("m2")) - 3).alias("kurtosis"),
        rate(F.col("m3"), F.pow("m2", F.lit(1.5))).alias("skewness"),
        rate(F.col("peak"), F.sqrt("m2")).alias("crest"),
        "peak",
    )


def radial_shape(long: DataFrame, keys: Names, size: int, parts: int = 8) -> DataFrame:
    """Shape of the radius over axes (keys, axis, i, x): kurtosis m4/m2**2, crest, and the variation of rms over ``parts`` parts."""
    mean = long.groupBy(*keys, "axis").agg(F.avg("x").alias("mean"))
    radial = long.join(mean, [*keys, "axis"]).groupBy(*keys, "i").agg(F.sum(F.pow(F.col("x") - F.col("mean"), 2.0)).alias("r2"))
    part = F.floor(F.col("i") * parts / size)
    sub = radial.groupBy(*keys, part.alias("part")).agg(F.sqrt(F.avg("r2")).alias("sub"), F.sum("r2").alias("s2"), F.sum(F.col("r2") * F.col("r2")).alias("s4"), F.max("r2").alias("p2"), F.count(F.lit(1)).alias("n"))
    out = sub.groupBy(*keys).agg((F.sum("s2") / F.sum("n")).alias("m2"), (F.sum("s4") / F.sum("n")).alias("m4"), F.max("p2").alias("p2"), F.avg("sub").alias("sub"), F.stddev_pop("sub").alias("spread"))
    return out.select(*keys, rate(F.col("m4"), F.col("m2") * F.col("m2")).alias("kurtosis"), F.sqrt(rate(F.col("p2"), F.col("m2"))).alias("crest"), F.greatest(rate(F.col("spread"), F.col("sub")), F.lit(1e-8)).alias("rms_variability"))
