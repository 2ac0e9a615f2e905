"""Resampling and framing over blocks equal those of whole recordings, whatever the blocks."""

import random

import numpy as np
import pytest

from kurtosia.operators import recordings, waveform


def cut(spark, signals, seed, most):
    rng, rows = random.Random(seed), []
    for k, x in signals.items():
        at = 0
        while at < len(x):
            n = rng.randrange(1, most + 1)
            rows.append((k, at, [float(v) for v in x[at : at + n]]))
            at += n
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, first long, signal array<double>")


def joined(df):
    out = {}
    for r in df.orderBy("k", "first").collect():
        have = out.setdefault(r.k, [])
        assert r.first == len(have)
        have.extend(r.signal)
    return out


SIGNALS = {"a": np.random.default_rng(1).normal(size=1000), None: np.random.default_rng(2).normal(size=257), "one": np.array([3.0])}


@pytest.mark.parametrize("up, down", [(2, 5), (5, 2), (1, 3), (3, 3), (147, 160)])
def test_resampling_over_borders(spark, up, down):
    want = joined(recordings.resampled(cut(spark, SIGNALS, 1, 2000), ["k"], "first", "signal", up, down, 5000))
    for k, x in SIGNALS.items():
        assert want[k] == pytest.approx(waveform.resample(x, up, down), abs=1e-9)
    for most, cell in ((7, 64), (300, 10), (40, 1000)):
        assert joined(recordings.resampled(cut(spark, SIGNALS, most, most), ["k"], "first", "signal", up, down, cell)) == want


@pytest.mark.parametrize("size, hop", [(16, 16), (16, 5), (3, 10), (400, 100)])
def test_framing_over_borders(spark, size, hop):
    want = sorted((str(k), s, x[s : s + size].tolist()) for k, x in SIGNALS.items() for s in range(0, len(x) - size + 1, hop))
    for most, cell in ((7, 64), (300, 10), (2000, 5000)):
        got = recordings.frames(cut(spark, SIGNALS, most, most), ["k"], "first", "signal", size, hop, cell)
        assert sorted((str(r.k), r.start, list(r.frame)) for r in got.collect()) == want


def test_faulty_and_empty_recordings(spark):
    df = cut(spark, {"a": np.arange(100.0)}, 3, 10)
    run = lambda d, cell=32: recordings.resampled(d, ["k"], "first", "signal", 2, 5, cell).collect()
    for bad in (df.where("first > 5"), df.unionAll(df.limit(1)), df.where("first < 20 or first > 80"), df.where("not (first between 30 and 60)")):
        for cell in (8, 32, 500):
            with pytest.raises(Exception, match="missing or given twice"):
                run(bad, cell)
    assert run(df.limit(0)) == []
    odd = spark.createDataFrame([("a", None, [1.0]), ("b", 0, []), ("c", 0, None)], df.schema)
    assert run(odd) == [] and len(run(df.unionAll(odd))) == len(run(df))
