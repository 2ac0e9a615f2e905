"""Long recordings that lie in blocks over tasks: resampling and framing across the borders of blocks.

A recording is a key's blocks (first, signal): ``first`` is the number of the block's first
sample, counted from 0.  Blocks may have any sizes.  They are cut anew into cells of ``cell`` samples,
and each cell fetches what it needs of its neighbours, so a task holds cells, never
recordings.  A sample that is missing or given twice fails the query; blocks without samples or place are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .waveform import kaiser_lowpass

Names = Sequence[str]


def cells(df: DataFrame, keys: Names, first: str, signal: str, cell: int, before: int, after: int) -> DataFrame:
    """(keys, _cell, _from, _own, _x): each cell's samples with ``before`` and ``after`` more, as far as there are any.

    ``_from`` is the number of the first of them, ``_own`` how many are the cell's own.  Where there
    is a whole cell less than a recording of no end needs, its end is the recording's.
    """
    rows = df.select(*keys, F.col(first).cast("long").alias("_at"), F.col(signal).cast("array<double>").alias("_s")).where("size(_s) > 0 and _at is not null")
    end = F.col("_at") + F.size("_s")
    within = F.sequence(F.greatest(F.lit(0), F.floor((F.col("_at") - after) / cell)), F.floor((end - 1 + before) / cell))
    parts = rows.withColumn("_end", end).withColumn("_cell", F.explode(within))
    lo = F.greatest(F.col("_at"), F.col("_cell") * cell - before)
    hi = F.least(F.col("_end"), (F.col("_cell") + 1) * cell + after)
    piece = F.struct(lo.alias("at"), F.slice("_s", (lo - F.col("_at") + 1).cast("int"), (hi - lo).cast("int")).alias("s"))
    held = parts.where(lo < hi).groupBy(*keys, "_cell").agg(F.sort_array(F.collect_list(piece)).alias("_p"))
    begin = F.col("_p")[0]["at"]
    whole = held.select(*keys, "_cell", begin.alias("_from"), F.flatten("_p.s").alias("_x"), F.forall("_p", lambda p: p["at"] >= 0).alias("_sound"), F.aggregate("_p", begin, lambda to, p: F.when(p["at"] == to, to + F.size(p["s"]))).alias("_to"))
    own = F.least(F.col("_to"), (F.col("_cell") + 1) * cell) - F.col("_cell") * cell
    bad = F.col("_to").isNull() | ~F.col("_sound") | (F.col("_from") > F.greatest(F.lit(0), F.col("_cell") * cell - before))
    told = F.when(F.col("_to").isNotNull() & (F.col("_to") <= F.col("_cell") * cell), F.lit(0)).when(bad, F.raise_error(F.lit("samples are missing or given twice")).cast("long")).otherwise(own)
    return whole.select(*keys, "_cell", "_from", told.cast("long").alias("_own"), "_x").where("_own > 0")


def frames(df: DataFrame, keys: Names, first: str, signal: str, size: int, hop: int, cell: int = 1 << 16) -> DataFrame:
    """(keys, start, frame): every full window of ``size`` samples, one each ``hop``, over blocks' borders."""
    found = cells(df, keys, first, signal, cell, 0, size - 1)
    at = F.ceil(F.col("_cell") * cell / hop) * hop  # the first window of the cell
    last = F.least(F.col("_from") + F.col("_own") - 1, F.col("_from") + F.size("_x") - size)
    starts = F.when(at <= last, F.sequence(at, last, F.lit(hop).cast("long")))
    out = found.withColumn("start", F.explode(starts))
    return out.select(*keys, "start", F.slice("_x", (F.col("start") - F.col("_from") + 1).cast("int"), size).alias("frame"))


def resampled_span(x: np.ndarray, begin: int, lo: int, hi: int, up: int, down: int) -> tuple[int, np.ndarray]:
    """The samples at up/down of the rate that fall to the input's places ``lo`` to ``hi``; ``x`` begins at ``begin``, zeros lie beyond it.

    Products are added tap by tap, so a sample does not depend on what is asked for beside it.
    """
    taps = kaiser_lowpass(up, down)
    half = len(taps) // 2
    m = np.arange(-(-lo * up // down), -(-hi * up // down), dtype=np.int64)
    j = -(-(m * down - half) // up)
    y = np.zeros(len(m))
    for _ in range(2 * half // up + 1):
        t = half + m * down - j * up
        at = j - begin
        used = (t >= 0) & (at >= 0) & (at < len(x))
        y[used] += taps[t[used]] * x[at[used]]
        j = j + 1
    return int(m[0]) if len(m) else 0, y


def resampled(df: DataFrame, keys: Names, first: str, signal: str, up: int, down: int, cell: int = 1 << 16) -> DataFrame:
    """(keys, first, signal): blocks at up/down of the rate, as ``waveform.resample`` of the whole recording but for rounding.

    Sizes of blocks and cells change no bit of a sample.  NULL samples count as NaN.
    """
    if up < 1 or down < 1:
        raise ValueError("up and down must be positive")
    g = math.gcd(up, down)
    up, down = up // g, down // g
    reach = 10 * max(up, down) // up + 1
    found = cells(df, keys, first, signal, cell, reach, reach)
    kept = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, blocks = [], []
            for c, begin, own, x in zip(b["_cell"].to_pylist(), b["_from"].to_pylist(), b["_own"].to_pylist(), b["_x"], strict=True):
                x = x.values.to_numpy(zero_copy_only=False).astype(float)
                if up == down:
                    at, y = c * cell, x[c * cell - begin : c * cell - begin + own]
                else:
                    at, y = resampled_span(x, begin, c * cell, c * cell + own, up, down)
                places.append(at)
                blocks.append(y)
            columns = [b[k] for k in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.int64()), pa.array(blocks, pa.list_(pa.float64()))], names=[*kept, "first", "signal"])

    schema = StructType([*[df.schema[k] for k in kept], StructField("first", LongType()), StructField("signal", ArrayType(DoubleType()))])
    return found.mapInArrow(run, schema).where(F.size("signal") > 0)


def samples(df: DataFrame, keys: Names, first: str = "first", signal: str = "signal") -> DataFrame:
    """(keys, i, x): a row for each sample of the blocks."""
    return df.select(*keys, first, F.posexplode(signal).alias("_p", "x")).select(*keys, (F.col(first) + F.col("_p")).alias("i"), "x")


def blocks(df: DataFrame, keys: Names, i: str | Column, x: str, size: int) -> DataFrame:
    """(keys, first, signal): samples in long form, numbered from 0 by ``i``, in blocks of ``size``."""
    rows = df.select(*keys, F.struct((F.col(i) if isinstance(i, str) else i).cast("long").alias("i"), F.col(x).cast("double").alias("x")).alias("_s"))
    held = rows.groupBy(*keys, F.floor(F.col("_s.i") / size).alias("_b")).agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    return held.select(*keys, F.col("_s")[0]["i"].alias("first"), F.col("_s.x").alias("signal"))
