"""As-of joins, interpolation and order tracking between samples and tachometer pulses.

An as-of join is a union sorted by time with the last pulse carried forward: one
shuffle on the keys, no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kurtosia.functions.numbers import rate

Names = Sequence[str]


def as_of(left: DataFrame, right: DataFrame, keys: Names, time: str, values: Names, forward: bool = False, bucket: float | None = None) -> DataFrame:
    """``left`` with ``values`` of the last right row at or before its time (``forward``: the first after it).

    Right rows of equal time count as one; the largest values in their order win.  With
    ``bucket``, a span of the time (a number), a key's rows are dealt by key and bucket: windows run inside
    buckets, and what earlier buckets leave is carried on by a scan of one row a bucket.  So
    one key of any length spreads over tasks.
    """
    cols = [c for c in left.columns if c not in (*keys, time)]
    l = left.select(*keys, time, F.struct(*cols).alias("_l") if cols else F.struct(F.lit(1).alias("_")).alias("_l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_r"), F.lit(1).alias("_side"))
    r = right.select(*keys, time, F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.struct(*values).alias("_r"), F.lit(0).alias("_side"))
    order = [F.desc(time), F.desc("_side"), F.asc("_r")] if forward else [time, "_side", "_r"]  # at one time rights come last, or first: so forward is after
    both, within = l.unionByName(r), list(keys)
    if bucket:
        both, within = both.withColumn("_bucket", F.floor(F.col(time) / bucket)), [*keys, "_bucket"]
    found = F.last("_r", ignorenulls=True).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_found", found)
    if bucket:
        best = F.struct(F.when(F.col("_r").isNotNull(), -F.col(time) if forward else F.col(time)), "_r")
        left_by = both.groupBy(*within).agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), best)).alias("_leaves"))
        before = Window.partitionBy(*keys).orderBy(F.desc("_bucket") if forward else "_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = left_by.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), F.last("_leaves", ignorenulls=True).over(before).alias("_carried"))
        same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
        out = out.join(carried, [*same, F.col("_bucket").eqNullSafe(F.col("_b"))], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    out = out.where("_side = 1")
    return out.select(*keys, time, *[F.col(f"_l.{c}").alias(c) for c in cols], *[F.col(f"_found.{v}").alias(v) for v in values])


def interpolate(grid: DataFrame, signal: DataFrame, keys: Names, time: str, x: str, bucket: float | None = None) -> DataFrame:
    """``grid`` with x between the nearest signal rows on both sides; NULL beyond the ends.  ``bucket`` as for ``as_of``."""
    points = signal.select(*keys, time, F.col(time).alias("_t0"), F.col(x).alias("_x0"))
    before = as_of(grid, points, keys, time, ["_t0", "_x0"], bucket=bucket)
    after = as_of(before, points.withColumnsRenamed({"_t0": "_t1", "_x0": "_x1"}), keys, time, ["_t1", "_x1"], forward=True, bucket=bucket)
    t = F.col(time)
    value = F.when(t == F.col("_t0"), F.col("_x0")).otherwise(F.col("_x0") + rate((F.col("_x1") - F.col("_x0")) * (t - F.col("_t0")), F.col("_t1") - F.col("_t0")))
    return after.withColumn(x, value).drop("_t0", "_x0", "_t1", "_x1")


def order_projection(samples: DataFrame, pulses: DataFrame, keys: Names, ppr: int = 1, orders: Sequence[int] = (1, 2, 3), bucket: float | None = None) -> DataFrame:
    """(keys, amp_<k>x, ratio_<k>x, phase_1x) of samples (keys, t_us, x) against pulses (keys, t_us, ordinal).

    A sample's angle comes from the pulse at or before it and its share of the way to
    the next one; past the last pulse the mean interval stands in.  Samples without a
    pulse, or more than 1.1 intervals past one, make the window's result NULL.
    """
    w = Window.partitionBy(*keys).orderBy("t_us")
    edge = pulses.withColumn("_edge", F.col("t_us")).withColumn("_step", F.lead("t_us").over(w) - F.col("t_us"))
    mean_step = edge.groupBy(*keys).agg(F.avg("_step").alias("_mean_step"))
    joined = as_of(samples, edge, keys, "t_us", ["_edge", "_step", "ordinal"], bucket=bucket).join(mean_step, list(keys), "left")
    mean = samples.groupBy(*keys).agg(F.avg("x").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    part = (F.col("t_us") - F.col("_edge")) / F.coalesce("_step", "_mean_step")
    angle = 2 * math.pi / ppr * (F.col("ordinal") % ppr + part)
    good = F.col("_edge").isNotNull() & (part >= 0) & (part <= 1.1)
    c = F.col("x") - F.col("_mean")
    sums = [s for k in orders for s in (F.sum(c * F.cos(k * angle)).alias(f"re{k}"), F.sum(-c * F.sin(k * angle)).alias(f"im{k}"))]
    out = joined.join(mean, list(keys)).groupBy(*keys, "_n").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("ok"), F.avg(c * c).alias("ms"), *sums)
    amp = lambda k: 2 * F.hypot(f"re{k}", f"im{k}") / F.col("_n")
    cols = [F.when(F.col("ok"), amp(k)).alias(f"amp_{k}x") for k in orders]
    cols += [F.when(F.col("ok"), F.when(F.col("ms") > 1e-12, 0.5 * amp(k) * amp(k) / F.col("ms")).otherwise(0.0)).alias(f"ratio_{k}x") for k in orders]
    return out.select(*keys, *cols, F.when(F.col("ok"), F.atan2(f"im{orders[0]}", f"re{orders[0]}")).alias(f"phase_{orders[0]}x"))


def pulse_quality(pulses: DataFrame, keys: Names, least_us: float = 3000, most_us: float = 100000, deviation: float = 0.15) -> DataFrame:
    """(keys, fg_hz, reason) of each window's pulses (t_us, ordinal): fg_missing under four, fg_unstable for gaps and uneven steps, else ok."""
    w = Window.partitionBy(*keys).orderBy("t_us")
    steps = pulses.withColumn("_step", F.col("t_us") - F.lag("t_us").over(w)).withColumn("_jump", F.col("ordinal") - F.lag("ordinal").over(w))
    mean = F.avg("_step").over(Window.partitionBy(*keys))
    steps = steps.withColumn("_off", F.abs(F.col("_step") - mean) / mean)
    out = steps.groupBy(*keys).agg(F.count("_step").alias("n"), F.avg("_step").alias("mean"), F.min("_step").alias("lo"), F.max("_step").alias("hi"), F.max("_off").alias("off"), F.bool_and(F.col("_jump") == 1).alias("contiguous"))
    bad = ~F.col("contiguous") | (F.col("lo") < least_us) | (F.col("hi") > most_us) | (F.col("off") > deviation)
    reason = F.when(F.col("n") < 3, "fg_missing").when(bad, "fg_unstable").otherwise("ok")
    return out.withColumn("reason", reason).select(*keys, F.when(F.col("reason") == "ok", 1e6 / F.col("mean")).alias("fg_hz"), "reason")


def continues(before_period: Column, gap: Column, ordinal_step: Column, deviation: float = 0.15) -> Column:
    """Whether the first pulse of a window follows the last of the window before: next ordinal, a step within ``deviation`` of its period."""
    return (ordinal_step == 1) & (F.abs(gap - before_period) <= deviation * before_period)


def window_continuity(pulses: DataFrame, starts: DataFrame, keys: Names, window: str, start: str, least_us: float = 3000, most_us: float = 100000, deviation: float = 0.15, tail: float = 1.1) -> DataFrame:
    """(keys, window, period, tail, continuous): whether a window's pulses (t_us, ordinal) go on from the window before.

    They do if the period before was in bounds, the first pulse ``continues`` it, and the window
    (``start`` in ``starts``) begins after its last pulse by ``tail`` periods at most.  NULL for a key's first window.
    """
    span = F.max("t_us") - F.min("t_us")
    own = pulses.groupBy(*keys, window).agg(
        F.min("t_us").alias("_first"), F.max("t_us").alias("_last"), F.min_by("ordinal", "t_us").alias("_from"), F.max_by("ordinal", "t_us").alias("_to"), rate(span, F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("period")
    ).join(starts.select(*keys, window, start), [*keys, window])
    w = Window.partitionBy(*keys).orderBy(window)
    was = own.withColumns({f"_before{c}": F.lag(c).over(w) for c in ("_last", "_to", "period")})
    out = was.withColumn("tail", F.col(start) - F.col("_before_last"))
    period = F.col("_beforeperiod")
    good = period.between(least_us, most_us) & continues(period, F.col("_first") - F.col("_before_last"), F.col("_from") - F.col("_before_to"), deviation) & F.col("tail").between(F.lit(0), tail * period)
    return out.select(*keys, window, "period", "tail", F.when(F.col("_before_last").isNotNull(), F.coalesce(good, F.lit(False))).alias("continuous"))
