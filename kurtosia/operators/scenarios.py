"""How a detector does in trials that turn from normal to faulty, and how its sensitivity changes with noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kurtosia.functions.numbers import rate

Names = Sequence[str]


def scenario_statistics(df: DataFrame, keys: Names, trial: Names, order: Names, faulty: str, suspect: str, confirmed: str, most: int = 30) -> DataFrame:
    """Of each key: rates of false alarms and misses, of confirmed false alarms, and the mean number of windows until a fault is confirmed.

    A trial's latency counts its faulty windows from 1 to the first confirmed one, of
    ``most`` at most; trials without one are missed and leave the mean, which is NULL if all are.
    """
    own = Window.partitionBy(*keys, *trial)
    nth = F.sum(F.col(faulty).cast("int")).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_nth", nth)
    trials = rows.groupBy(*keys, *trial).agg(
        F.count_if(~F.col(faulty)).alias("normal"), F.count_if(~F.col(faulty) & F.col(suspect)).alias("false_suspect"), F.count_if(~F.col(faulty) & F.col(confirmed)).alias("false_confirmed"),
        F.count_if(F.col(faulty)).alias("faulty"), F.count_if(F.col(faulty) & ~F.col(suspect)).alias("missed"), F.min(F.when(F.col(faulty) & F.col(confirmed) & (F.col("_nth") <= most), F.col("_nth"))).alias("latency"),
    )
    total = lambda c: F.sum(c)
    return trials.groupBy(*keys).agg(
        rate(total("false_suspect"), total("normal")).alias("false_positive_rate"),
        rate(total("missed"), total("faulty")).alias("false_negative_rate"),
        rate(total("false_confirmed"), total("normal")).alias("confirmed_false_positive_rate"),
        F.count_if(F.col("faulty") > 0).alias("trials"),
        F.count("latency").alias("detected"),
        F.count_if((F.col("faulty") > 0) & F.col("latency").isNull()).alias("missed_trials"),
        F.avg("latency").alias("mean_latency"),
    )


def sensitivity_curve(df: DataFrame, keys: Names, value: str, mean: str, std: str, noises: Sequence[float], strengths: Sequence[float], sigma: float = 3.0) -> DataFrame:
    """(keys, noise, strength, n, detected, rate): how often a value grown by ``strength`` leaves ``sigma`` deviations that noise has widened.

    The grid is a few literals; counts combine before the shuffle.
    """
    grid = F.array(*[F.struct(F.lit(float(n)).alias("noise"), F.lit(float(s)).alias("strength")) for n in noises for s in strengths])
    each = df.select(*keys, value, mean, std, F.explode(grid).alias("g")).select(*keys, value, mean, std, "g.*")
    flagged = F.abs(F.col(value) * (1 + F.col("strength")) - F.col(mean)) > sigma * F.col(std) * F.col("noise")
    out = each.groupBy(*keys, "noise", "strength").agg(F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("detected"))
    return out.withColumn("rate", rate(F.col("detected"), F.col("n")))
