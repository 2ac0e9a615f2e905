"""Spectra in long form (keys, k, value), bands of them, and the feature vectors of the analysis paths.

``fft`` takes windows as arrays, a row each, and shuffles nothing; ``dft`` takes samples in
long form and gathers each window, whose size bounds the array, first.  Both transform
all windows of an Arrow batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kurtosia.functions.numbers import clamp, rate

from .waveform import by_length

Names = Sequence[str]
TAPERS = ("none", "hann_symmetric", "hann_periodic")


def taper(size: int, kind: str) -> np.ndarray:
    if kind == "none":
        return np.ones(size)
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1 if kind == "hann_symmetric" else size))


def fft(df: DataFrame, keys: Names, signal: str, kind: str = "none", centre: bool = True, size: int | None = None) -> DataFrame:
    """(keys, k, re, im) for k up to half the size of the windows in an array column; NULL samples count nothing.

    Windows that are NULL or hold other than finite samples give no rows, nor do those of another length than ``size``.
    """
    if kind not in TAPERS:
        raise ValueError(f"unknown taper {kind}")

    def rows(x: np.ndarray) -> list:
        if size is not None and x.shape[1] != size:
            return [None] * len(x)
        x = x - x.mean(axis=1, keepdims=True) if centre else x
        z = np.fft.rfft(x * taper(x.shape[1], kind))
        return list(np.stack([z.real, z.imag], axis=1))

    def transform(column: pd.Series) -> pd.DataFrame:
        z = by_length(column, rows)
        return pd.DataFrame({part: [None if x is None else x[i] for x in z] for i, part in enumerate(("re", "im"))}, index=column.index)

    bins = F.pandas_udf(transform, "re array<double>, im array<double>")(F.col(signal))
    out = df.select(*keys, bins.alias("_z"))
    k = F.transform(F.sequence(F.lit(0), F.size("_z.re") - 1), lambda i: i.cast("int"))
    return out.where("_z.re is not null").select(*keys, F.inline(F.arrays_zip(k.alias("k"), F.col("_z.re"), F.col("_z.im"))).alias("k", "re", "im"))


def dft(long: DataFrame, keys: Names, size: int, kind: str = "none", centre: bool = True) -> DataFrame:
    """The same of windows (keys, i, x) of ``size`` samples; a missing sample counts as the mean, or as 0 without centring.

    Of samples that repeat a number in a window the least counts.
    """
    at = F.col("i").between(0, size - 1) & F.col("x").isNotNull()
    sample = F.struct(F.col("i").cast("int").alias("i"), F.col("x").cast("double").alias("x"))
    got = long.where(at).groupBy(*keys).agg(F.array_sort(F.collect_list(sample)).alias("_s"))
    first = F.filter("_s", lambda s, j: (j == 0) | (s["i"] != F.get("_s", j - 1)["i"]))
    got = got.select(*keys, first.alias("_s"))
    gap = F.aggregate("_s", F.lit(0.0), lambda total, s: total + s["x"]) / F.size("_s") if centre else F.lit(0.0)
    got = got.select(*keys, "_s", gap.alias("_gap"))
    absent = F.array_except(F.sequence(F.lit(0), F.lit(size - 1)), F.transform("_s", lambda s: s["i"]))
    filled = F.array_sort(F.concat("_s", F.transform(absent, lambda i: F.struct(i.alias("i"), F.col("_gap").alias("x")))))
    return fft(got.select(*keys, F.transform(filled, lambda s: s["x"]).alias("_x")), keys, "_x", kind, centre, size)


def amplitude(spectrum: DataFrame, size: int) -> DataFrame:
    """Adds ``mag`` = 2|X|/n of bins below Nyquist (untapered paths)."""
    return spectrum.where(F.col("k") < size // 2).withColumn("mag", F.hypot("re", "im") * 2 / size)


def amplitude_hann(spectrum: DataFrame, size: int) -> DataFrame:
    """Adds ``mag`` corrected for the Hann gain of a half, DC halved, Nyquist dropped."""
    mag = F.hypot("re", "im") * 2 / size / 0.5
    return spectrum.where(F.col("k") < size // 2).withColumn("mag", F.when(F.col("k") == 0, mag / 2).otherwise(mag))


def power(spectrum: DataFrame, keys: Names, size: int) -> DataFrame:
    """(keys, k, power) summed over whatever else distinguishes rows (axes): periodic Hann mean-square power, DC excluded."""
    p = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (size * size * 0.375)
    one_sided = F.when(F.col("k") == size // 2, p).otherwise(2 * p)
    return spectrum.where("k > 0").groupBy(*keys, "k").agg(F.sum(one_sided).alias("power"))


def power_spectrum(spectrum: DataFrame, size: int) -> DataFrame:
    """Adds ``power`` in "spectrum" scaling of the periodic Hann taper: |X|**2 / sum(w)**2, doubled but for DC and Nyquist."""
    p = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (size / 2.0) ** 2
    return spectrum.withColumn("power", F.when(F.col("k").isin(0, size // 2), p).otherwise(2 * p))


def harmonic_capture(spectrum: DataFrame, keys: Names, bin_hz: float, hz: float, errors: Sequence[float], harmonics: Sequence[int] = (1, 2, 3), width: float = 5.0) -> DataFrame:
    """(keys, error, harmonic, captured): the magnitude in a harmonic's band when the speed is off by ``error``, over that at the right speed.

    The errors and harmonics are a few literals; each row of the spectrum is added to the bands that hold it.
    """
    f = F.col("k") * bin_hz
    grid = F.array(*[F.struct(F.lit(float(e)).alias("error"), F.lit(h).alias("harmonic")) for e in errors for h in harmonics])
    near = spectrum.select(*keys, "mag", f.alias("_f"), F.explode(grid).alias("_g")).select(*keys, "mag", "_f", "_g.*")
    got = F.sum(F.when(F.abs(F.col("_f") - (hz + F.col("error")) * F.col("harmonic")) <= width, F.col("mag")).otherwise(0.0))
    right = F.sum(F.when(F.abs(F.col("_f") - hz * F.col("harmonic")) <= width, F.col("mag")).otherwise(0.0))
    return near.groupBy(*keys, "error", "harmonic").agg(rate(got, right).alias("captured"))


def band_within(value: Column, f: Column, centre: Column, width: float | Column) -> Column:
    """Sum over |f - centre| <= width."""
    return F.coalesce(F.sum(F.when(F.abs(f - centre) <= width, value)), F.lit(0.0))


def band_bins(value: Column, k: Column, lo: Column, hi: Column, bin_hz: float, bins: int) -> Column:
    """Sum over bins floor(lo) to ceil(hi), both included, kept to 1..bins-1."""
    first = F.greatest(F.floor(lo / bin_hz), F.lit(1))
    last = F.least(F.ceil(hi / bin_hz), F.lit(bins - 1))
    return F.coalesce(F.sum(F.when((k >= first) & (k <= last), value)), F.lit(0.0))


def band_half_open(value: Column, f: Column, lo: float | Column, hi: float | Column) -> Column:
    return F.coalesce(F.sum(F.when((f >= lo) & (f < hi), value)), F.lit(0.0))


def rotation_peak(spectrum: DataFrame, keys: Names, f: Column, lo: float | Column, hi: float | Column) -> DataFrame:
    """(keys, rotation_hz): the frequency of the largest magnitude between lo and hi, the first of equals; NULL without bins."""
    inside = (f >= lo) & (f <= hi)
    best = F.max_by(F.when(inside, f), F.when(inside, F.struct(F.col("mag"), (-F.col("k")).alias("first"))))
    return spectrum.groupBy(*keys).agg(best.alias("rotation_hz"))


def rotation_measure(spectrum: DataFrame, keys: Names, rated_hz: float, bin_hz: float, bins: int, low: float = 0.6, high: float = 1.4) -> DataFrame:
    """(keys, rotation_hz, snr): the peak near the rated speed between bins by a parabola, and its height over the other bins.

    Two bins to each side of the peak do not count as others.  A search range of
    fewer than six bins gives the rated speed and 0.
    """
    first = max(math.floor(rated_hz * low / bin_hz), 1)
    last = min(math.ceil(rated_hz * high / bin_hz), bins - 2)
    if last <= first + 4:
        return spectrum.select(*keys).distinct().withColumn("rotation_hz", F.lit(float(rated_hz))).withColumn("snr", F.lit(0.0))
    near = spectrum.where(F.col("k").between(first - 1, last + 1)).select(*keys, "k", "mag")
    bag = near.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "mag"))).alias("b"))  # at most last - first + 3 bins
    searched = F.filter("b", lambda x: (x["k"] >= first) & (x["k"] <= last))
    top = F.array_max(F.transform(searched, lambda x: F.struct(x["mag"].alias("mag"), (-x["k"]).alias("k"))))
    at = lambda d: F.element_at(F.filter("b", lambda x: x["k"] == F.col("peak") + d), 1)["mag"]
    out = bag.withColumn("peak", -top["k"]).withColumns({"y0": at(-1), "y1": at(0), "y2": at(1)})
    others = F.filter(searched, lambda x: F.abs(x["k"] - F.col("peak")) > 2)
    floor = F.aggregate(others, F.lit(0.0), lambda t, x: t + x["mag"]) / F.size(others)
    bend = F.col("y0") - 2 * F.col("y1") + F.col("y2")
    delta = F.when(F.abs(bend) > 1e-12, clamp(0.5 * (F.col("y0") - F.col("y2")) / bend, -0.5, 0.5)).otherwise(0.0)
    return out.select(*keys, ((F.col("peak") + delta) * bin_hz).alias("rotation_hz"), F.when(floor > 1e-20, F.col("y1") / floor).otherwise(0.0).alias("snr"))


def features_v1(spectrum: DataFrame, stats: DataFrame, keys: Names, bin_hz: float, width: float = 5.0, search: tuple = (30.0, 70.0), high: tuple = (250.0, 400.0), default_hz: float = 50.0) -> DataFrame:
    """rms and kurtosis of ``stats`` with the largest peak and the amplitude of three harmonics and a high band."""
    f = F.col("k") * bin_hz
    rotation = rotation_peak(spectrum, keys, f, *search).withColumn("rotation_hz", F.coalesce("rotation_hz", F.lit(default_hz)))
    peak = F.when(f > 1.0, F.struct(F.col("mag"), (-F.col("k")).alias("k")))
    harmonics = [band_within(F.col("mag"), f, h * F.col("rotation_hz"), width).alias(f"harmonic{h}") for h in (1, 2, 3)]
    hf = F.coalesce(F.sum(F.when((f >= high[0]) & (f <= high[1]), F.col("mag"))), F.lit(0.0)).alias("high_freq")
    out = spectrum.join(rotation, list(keys)).groupBy(*keys, "rotation_hz").agg(F.max_by(f, peak).alias("peak_hz"), F.max(F.when(f > 1.0, F.col("mag"))).alias("peak_magnitude"), *harmonics, hf)
    return out.join(stats, list(keys))


def features_v2(spectrum: DataFrame, keys: Names, rotation: DataFrame, rated_hz: float, bin_hz: float, bins: int, width: float, high_hz: float, cutoff: float = 4.5) -> DataFrame:
    """Shares of the energy (squared magnitudes without DC) in three harmonics and a high band."""
    e = F.col("mag") * F.col("mag")
    k = F.col("k")
    hz = F.when(F.col("rotation_hz") > 0, F.col("rotation_hz")).otherwise(F.lit(float(rated_hz)))
    bands = [band_bins(e, k, h * hz - width, h * hz + width, bin_hz, bins).alias(f"h{h}") for h in (1, 2, 3)]
    hf = band_bins(e, k, F.lit(rated_hz * cutoff), F.lit(float(high_hz)), bin_hz, bins).alias("hf")
    total = F.greatest(F.coalesce(F.sum(F.when(k > 0, e)), F.lit(0.0)), F.lit(1e-20)).alias("total")
    out = spectrum.join(rotation, list(keys)).groupBy(*keys, "rotation_hz", "snr").agg(*bands, hf, total)
    return out.select(*keys, "rotation_hz", "snr", *[(F.col(f"h{h}") / F.col("total")).alias(f"harmonic{h}_ratio") for h in (1, 2, 3)], (F.col("hf") / F.col("total")).alias("high_freq_ratio"))


def features_six(spectrum: DataFrame, stats: DataFrame, keys: Names, nominal_hz: float, bin_hz: float, nyquist: float) -> DataFrame:
    """rms, kurtosis and four amplitude ratios; the speed is the peak within a fifth of the nominal one, or that."""
    f = F.col("k") * bin_hz
    width = max(5.0, 2 * bin_hz)
    rotation = rotation_peak(spectrum, keys, f, 0.8 * nominal_hz, 1.2 * nominal_hz).withColumn("rotation_hz", F.coalesce("rotation_hz", F.lit(float(nominal_hz))))
    hz = F.col("rotation_hz")
    harmonics = [band_within(F.col("mag"), f, h * hz, width).alias(f"h{h}") for h in (1, 2, 3)]
    hf = F.coalesce(F.sum(F.when((f >= 10 * hz) & (f <= 0.8 * nyquist), F.col("mag"))), F.lit(0.0)).alias("hf")
    total = (F.coalesce(F.sum(F.when(f > 1.0, F.col("mag"))), F.lit(0.0)) + 1e-12).alias("total")
    out = spectrum.join(rotation, list(keys)).groupBy(*keys, "rotation_hz").agg(*harmonics, hf, total)
    ratios = [(F.col(c) / F.col("total")).alias(n) for c, n in (("h1", "harmonic1_ratio"), ("h2", "harmonic2_ratio"), ("h3", "harmonic3_ratio"), ("hf", "high_freq_ratio"))]
    return out.select(*keys, "rotation_hz", *ratios).join(stats, list(keys))


def synchronous(long: DataFrame, keys: Names, hz: float, fs: float, size: int, start: str | None = None) -> DataFrame:
    """(keys, amplitude, phase) at one frequency; ``start`` (samples before the window) makes phases absolute."""
    mean = long.groupBy(*keys).agg(F.avg("x").alias("_mean"))
    i = F.col("i") + (F.col(start) if start else F.lit(0))
    c = F.col("x") - F.col("_mean")
    angle = 2 * math.pi * hz * i / fs
    out = long.join(mean, list(keys)).groupBy(*keys).agg((2 / size * F.sum(c * F.cos(angle))).alias("re"), (-2 / size * F.sum(c * F.sin(angle))).alias("im"))
    return out.select(*keys, F.hypot("re", "im").alias("amplitude"), F.atan2("im", "re").alias("phase"))


ORDERS = (0.5, 1.0, 1.5, 2.0, 3.0)


def owned_bands(spectrum: DataFrame, keys: Names, bin_hz: float, fr_hz: float, most_hz: float, orders: Sequence[float] = ORDERS, upper_hz: float = 80.0) -> DataFrame:
    """(keys, owner, energy, share): each bin up to ``most_hz`` belongs to the first available order band, else to upper or other.

    A band of half-width max(2 bins, 5 % of its centre) is available if it lies in the
    trusted range and overlaps no other such band.
    """
    spans = [(o, o * fr_hz - max(2 * bin_hz, 0.05 * o * fr_hz), o * fr_hz + max(2 * bin_hz, 0.05 * o * fr_hz)) for o in orders]
    fit = [s for s in spans if s[1] >= bin_hz and s[2] <= most_hz]
    free = [s for s in fit if not any(t is not s and s[1] <= t[2] and t[1] <= s[2] for t in fit)]
    f = F.col("k") * bin_hz
    owner = F.when(f >= upper_hz, "upper").otherwise("other")
    for o, lo, hi in reversed(free):
        owner = F.when((f >= lo) & (f <= hi), F.lit(f"{o:g}x")).otherwise(owner)
    trusted = spectrum.where((F.col("k") >= 1) & (f <= most_hz)).withColumn("owner", owner)
    out = trusted.groupBy(*keys, "owner").agg(F.sum("power").alias("energy"))
    total = trusted.groupBy(*keys).agg(F.sum("power").alias("total"))
    return out.join(total, list(keys)).select(*keys, "owner", "energy", (100 * rate(F.col("energy"), F.col("total"))).alias("share"))
