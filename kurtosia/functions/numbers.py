"""Column functions shared by the operators.  Missing is NULL, never NaN, and a ratio without denominator is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_feature(x: Column, eps: float = 1e-6) -> Column:
    """log(max(x, 0) + eps), the space in which features are standardised."""
    return F.ln(F.greatest(x, F.lit(0.0)) + eps)


def natural_log(x: Column) -> Column:
    """log(x) as C and SQL have it: -infinity of zero and NaN below, where ``F.ln`` has NULL as if nothing was measured."""
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.ln(x))


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def wrapping_difference(a: Column, b: Column) -> Column:
    """a - b of unsigned 32-bit clocks as a signed 32-bit difference."""
    return F.pmod(a.cast("long") - b.cast("long") + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def ramp(z: Column, start: float = 2.0, width: float = 4.0) -> Column:
    """How strongly a robust z deviates: 0 up to ``start``, 1 from ``start + width`` on."""
    return clamp((z - start) / width, 0.0, 1.0)


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes of a string as numbers."""
    digits = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.when(text.isNotNull(), F.transform(at, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")))


def fold31(text: Column) -> Column:
    """The multiply-by-31 checksum of a string's UTF-8 bytes, modulo 2**32."""
    return F.aggregate(_bytes(text), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a string's UTF-8 bytes."""
    return F.aggregate(_bytes(text), F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * 16777619, F.lit(1 << 32)))


# Labels of the source data and their canonical names.
CONDITIONS = {"정상": "normal", "베어링불량": "bearing", "회전체불평형": "imbalance", "축정렬불량": "misalignment", "벨트느슨함": "belt"}


def condition(label: Column) -> Column:
    """The canonical name of a condition label; NULL if unknown."""
    out = F.when(label.isin(*CONDITIONS.values()), label)
    for source, name in CONDITIONS.items():
        out = out.when(label == source, F.lit(name))
    return out
