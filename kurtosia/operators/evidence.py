"""Composition of physical evidence: deviations, abnormality and the strengths of five candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kurtosia.functions.numbers import clamp, ramp, rate

CANDIDATES = ("imbalance", "looseness", "misalignment", "bearing", "belt")


def deviations(df: DataFrame, features: list[str], z_start: float = 2.0, z_full: float = 6.0) -> DataFrame:
    """Adds <feature>_dev from ln(feature) against <feature>_median and <feature>_scale; missing features deviate by 0."""
    z = lambda f: (F.ln(f) - F.col(f"{f}_median")) / F.col(f"{f}_scale")
    return df.withColumns({f"{f}_dev": F.coalesce(ramp(z(f), z_start, z_full - z_start), F.lit(0.0)) for f in features})


def abnormality(spectral: Column, irregularity: Column, physical: Column) -> Column:
    """Percent, by a noisy or of three groups of evidence."""
    return 100 * clamp(1 - (1 - spectral) * (1 - 0.5 * irregularity) * (1 - 0.75 * physical), 0.0, 1.0)


def strengths(df: DataFrame) -> DataFrame:
    """Adds <candidate>_strength in percent, NULL where a candidate is not available, and <candidate>_reason.

    Columns: abnormality, dev_1x, dev_2x, dev_3x, dev_orders (the largest of the other
    orders), share_1x, share_orders, irregularity, and phase, direction, envelope,
    transmission: outside evidence from 0 to 1, NULL where there is none.
    """
    a = F.col("abnormality")
    parts = {
        "imbalance": (F.col("phase"), "missing_fg_phase", F.sqrt(F.col("dev_1x") * clamp(F.col("share_1x") / 70, 0.0, 1.0)) * F.col("phase")),
        "looseness": (F.col("share_orders"), "band_support_changed", F.sqrt(F.col("dev_orders") * clamp(F.col("share_orders") / 50, 0.0, 1.0) * F.col("irregularity"))),
        "misalignment": (F.col("direction"), "missing_direction_or_location", F.sqrt(F.greatest("dev_1x", "dev_2x", "dev_3x") * F.col("direction"))),
        "bearing": (F.col("envelope"), "missing_envelope_or_geometry", F.col("envelope")),
        "belt": (F.col("transmission"), "missing_transmission_evidence", F.col("transmission")),
    }
    for name, (needed, reason, strength) in parts.items():
        df = df.withColumn(f"{name}_strength", F.when(needed.isNotNull(), a * strength)).withColumn(f"{name}_reason", F.when(needed.isNull(), reason).otherwise("ok"))
    return df


def relative_shares(df: DataFrame, windows: str, least_windows: int = 3, least: float = 20.0) -> DataFrame:
    """Adds <candidate>_share: its part of all strengths, shown from ``least_windows`` windows on where abnormality and the sum reach ``least``."""
    total = sum([F.coalesce(f"{c}_strength", F.lit(0.0)) for c in CANDIDATES], F.lit(0.0))
    shown = (F.col(windows) >= least_windows) & (F.col("abnormality") >= least) & (total >= least)
    return df.withColumns({f"{c}_share": F.when(shown, 100 * rate(F.col(f"{c}_strength"), total)) for c in CANDIDATES})
