"""Reasons why a window may not be judged, in order of precedence; ok if it may."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Names = Sequence[str]


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The first check that fails; a check that is NULL fails."""
    out = None
    for bad, reason in checks:
        bad = F.coalesce(bad, F.lit(True))
        out = F.when(bad, reason) if out is None else out.when(bad, reason)
    return out.otherwise("ok")


def finite_positive(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))


def sensor_state(failed: Column, clipped: Column, size: int) -> tuple[Column, Column]:
    """(fault, clipped): over 2 % of a window's reads failed, so it gives no verdict; over 1 % of its samples are clipped."""
    return failed > size // 50, clipped > size // 100


def sample_faults(samples: DataFrame, keys: Names, fs: str, most_g: float = 3.95, jitter: float = 0.05) -> DataFrame:
    """(keys, n, seconds, bad_sample, bad_step) of samples (keys, i, t_us, x, fs): the first sample out of range and the first uneven step.

    ``t_us`` may be a 32-bit clock that wraps: steps and the seconds from the first sample to the last are taken modulo 2 ** 32.
    """
    from pyspark.sql import Window

    since = lambda a, b: F.pmod(a.cast("long") - b.cast("long"), F.lit(1 << 32))
    step = since(F.col("t_us"), F.lag("t_us").over(Window.partitionBy(*keys).orderBy("i")))
    even = F.abs(step - 1e6 / F.col(fs)) <= jitter * 1e6 / F.col(fs)
    good = ~F.isnan("x") & (F.abs("x") < most_g)
    marked = samples.withColumn("_step", step).withColumn("_uneven", F.col("_step").isNotNull() & ~F.coalesce(even, F.lit(False)))
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (since(F.max_by("t_us", "i"), F.min_by("t_us", "i")) / 1e6).alias("seconds"),
        F.min(F.when(~F.coalesce(good, F.lit(False)), F.col("i"))).alias("bad_sample"),
        F.min(F.when(F.col("_uneven"), F.col("i"))).alias("bad_step"),
    )


def live_reason(acquired: Column, fs: Column, rpm: Column, spread_pct: Column, bad_sample: Column, bad_step: Column, seconds: Column, span: float = 399 / 400) -> Column:
    """Gates of live scoring: acquisition, rate and speed, spread of the rotation, samples and steps by which comes first, one second of signal."""
    none = 1 << 30
    sample, step = F.coalesce(bad_sample, F.lit(none)), F.coalesce(bad_step, F.lit(none))
    return first_reason(
        (~acquired, "invalid_acquisition"),
        (~(fs.between(380, 420) & finite_positive(rpm)), "invalid_fs_or_rpm"),
        (~(spread_pct <= 5) | F.isnan(spread_pct), "rotation_spread"),
        ((sample < none) & (sample <= step), "invalid_sensor_sample"),
        (step < none, "invalid_time_axis"),
        (seconds < span, "insufficient_one_second"),
    )


#: What a configuration of physical evidence has to meet: column, least, whether the least itself is allowed, most.
CONFIGURATION = (
    ("sensor_max_hz", 0.0, False, None), ("upper_band_min_hz", 0.0, False, None), ("energy_floor", 0.0, False, None), ("log_mad_floor", 0.0, False, None), ("z_start", 0.0, True, None),
    ("support_tolerance", 0.0, True, 0.05), ("relative_abnormality_min", 0.0, True, 100.0), ("relative_strength_sum_min", 0.0, False, None), ("ewma_alpha", 0.0, False, 1.0), ("pulses_per_turn", 0.0, False, None), ("relative_min_windows", 3.0, True, None),
)


def configuration_valid(c: str) -> Column:
    """Whether a struct column holds a configuration within its bounds."""
    ok = F.col(f"{c}.z_full") > F.col(f"{c}.z_start")
    for name, least, allowed, most in CONFIGURATION:
        x = F.col(f"{c}.{name}").cast("double")
        inside = (x >= least) if allowed else (x > least)
        ok = ok & ~F.isnan(x) & (x < float("inf")) & inside & ((x <= most) if most is not None else F.lit(True))
    return F.coalesce(ok, F.lit(False))


def support_reason(valid: Column, ready: Column, same_config: Column, axes: Column, own_axes: Column, fs: Column, fs_range: tuple[Column, Column], fr: Column, fr_range: tuple[Column, Column], features: Column, own_features: Column, tolerance: Column) -> Column:
    """Whether a window can be held against a baseline: configuration, baseline, axes, rate and speed within its support, bands."""
    outside = lambda x, r: ~x.between(r[0] * (1 - tolerance), r[1] * (1 + tolerance))
    return first_reason(
        (~valid, "invalid_argument"),
        (~ready, "baseline_not_ready"),
        (~same_config, "config_changed"),
        (axes != own_axes, "axis_support_changed"),
        (outside(fs, fs_range), "fs_unsupported"),
        (outside(fr, fr_range), "rpm_unsupported"),
        (features != own_features, "band_support_changed"),
    )


def top_axis(amplitudes: Column, baselines: Column, least: float = 0.001) -> Column:
    """(axis, ratio) of the largest amplitude over baseline, the first of equals; axes with a baseline under ``least`` do not count, NULL if none is above 0."""
    ratios = F.zip_with(amplitudes, baselines, lambda a, b: F.when(b >= least, a / b).otherwise(0.0))
    best = F.array_max(ratios)
    return F.when(best > 0, F.struct((F.array_position(ratios, best) - 1).cast("int").alias("axis"), best.alias("ratio")))
