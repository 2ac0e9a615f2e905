"""A stream in several micro-batches gives what the batch operators give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kurtosia.operators import sequences, voting
from kurtosia.streaming import verdicts

SCHEMA = "k string, seq long, flag boolean, hz0 double, snr double, session string, n long, bad boolean, at timestamp"
WINDOWS = "k string, seq long, session string, sequence long, start long, rpm double, now long, usable boolean, flag boolean, x double, from_ms long, to_ms long, reset boolean"


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    data = []
    for i in range(120):
        flag = [True, False, None][rng.integers(0, 3)]
        data.append((f"k{i % 3}", i, flag, float(50 + rng.integers(0, 12)) if rng.random() < 0.9 else None, float(rng.integers(0, 10)), f"s{i // 60}", int(i // 3 + rng.integers(0, 3)), bool(rng.random() < 0.1), None))
    folder = tmp_path_factory.mktemp("stream")
    for part in range(4):
        spark.createDataFrame(data[part * 30 : part * 30 + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.read.schema(SCHEMA).parquet(str(folder)), spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _run(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name)


def _same(got, want, columns):
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, want.select(*columns).collect()))


def test_confirm(spark, rows):
    batch, stream = rows
    _same(_run(spark, verdicts.confirm(stream, ["k"], "seq", "flag"), "confirmed"), voting.confirm(batch, ["k"], ["seq"], "flag"), ["k", "seq", "votes_positive", "votes_valid", "status"])


def test_track_rotation(spark, rows):
    batch, stream = rows
    _same(_run(spark, verdicts.track_rotation(stream, ["k"], "seq", "hz0", 3.0, 2), "tracked"), sequences.track_rotation(batch, ["k"], ["seq"], "hz0", 3.0, 2), ["k", "seq", "hz"])


def test_run_state(spark, rows):
    batch, stream = rows
    _same(_run(spark, verdicts.run_state(stream, ["k"], "seq", "snr", 5.0, 2), "running"), sequences.run_state(batch, ["k"], ["seq"], "snr", 5.0, 2), ["k", "seq", "running", "just_started"])


def test_sequence_status(spark, rows):
    batch, stream = rows
    _same(_run(spark, verdicts.sequence_status(stream, ["k"], "seq", "session", "n", "bad"), "sequence"), sequences.sequence_status(batch, ["k"], ["seq"], "session", "n", "bad"), ["k", "seq", "status", "missing"])


def test_late_rows_are_marked(spark, tmp_path):
    one = lambda seq: spark.createDataFrame([("k", seq, True, 1.0, 1.0, "s", 1, False, None)], SCHEMA)
    for seq in (5, 3):
        one(seq).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {r.seq: r.status for r in _run(spark, verdicts.confirm(stream, ["k"], "seq", "flag"), "late").collect()}
    assert sorted(out) == [3, 5] and list(out.values()).count("late") <= 1


def test_alarm_counts_by_event_time(spark, tmp_path):
    spark.sql("select 'k' as k, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int)) as at, id % 2 = 0 as flag from range(40)").write.parquet(str(tmp_path / "in"))
    schema = "k string, at timestamp, flag boolean"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    counts = verdicts.alarm_counts(stream, ["k"], "at", "flag")
    query = counts.writeStream.format("memory").queryName("alarms").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("alarms").agg(F.sum("rows"), F.sum("alarms")).first()[:] == (40, 20)


@pytest.fixture(scope="module")
def windows(spark, tmp_path_factory):
    """Windows of detectors with gaps, repeats, changes of session and speed, ticks of the clock and stale ones."""
    rng = np.random.default_rng(7)
    data = []
    for i in range(160):
        n, odd = i // 2, int(rng.integers(0, 14))
        sequence = None if odd == 0 else n - (odd == 1) + (odd == 2)
        data.append((f"k{i % 2}", n, f"s{n // 30}", sequence, n * 2048 + 7 * (odd == 3), 1797.0 + (odd == 4), n * 1000 + 2500 * (odd == 5), odd != 6, bool(rng.random() < 0.8), None if odd == 7 else float(n), n * 100, n * 100 + 60 + 90 * (odd == 8), odd == 9))
    folder = tmp_path_factory.mktemp("windows")
    for part in range(4):
        spark.createDataFrame(data[part * 40 : part * 40 + 40], WINDOWS).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.read.schema(WINDOWS).parquet(str(folder)), spark.readStream.schema(WINDOWS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_bearing_continuity(spark, windows):
    batch, stream = windows
    columns = {c: c for c in ("session", "sequence", "start", "rpm", "now", "usable", "flag")}
    want = sequences.bearing_continuity(batch, ["k"], ["seq"], *columns.values())
    assert {r.outcome for r in want.select("outcome").distinct().collect()} >= {"first", "continued", "restarted", "rejected_repeated", "rejected_unusable", "time"}
    _same(_run(spark, verdicts.bearing(stream, ["k"], "seq", columns), "bearing"), want, ["k", "seq", "outcome", "votes_positive", "votes_valid", "status"])


def test_bearing_steps():
    step = lambda s, *row: sequences.bearing_step(s, *row)
    state = (None, None, None, None, None, "")
    for i in range(5):
        state, out = step(state, "a", i, i * 2048, 1797.0, i * 100, True, True)
    assert out == ("continued", 5, 5, "confirmed")
    assert step(state, "a", 4, 5 * 2048, 1797.0, 500, True, True)[1] == ("rejected_repeated", 0, 0, "unavailable")
    assert step(state, "a", 6, 6 * 2048, 1797.0, 500, True, True)[1] == ("restarted", 1, 1, "unavailable")
    assert step(state, "b", 0, 0, 1797.0, 500, True, False)[1] == ("restarted", 0, 1, "unavailable")
    assert step(state, "a", 5, 5 * 2048, 1797.0, 2401, True, True)[1][0] == "restarted" and step(state, "a", 5, 5 * 2048, 1797.0, 2400, True, True)[1][0] == "continued"
    assert step(state, None, None, None, None, 2401, None, None)[1] == ("expired", 0, 0, "unavailable") and step(state, None, None, None, None, 2400, None, None)[1][3] == "confirmed"
    assert step(state, "a", 5, 5 * 2048, 1797.0, 500, False, True)[1][0] == "rejected_unusable"


def test_smooth(spark, windows):
    batch, stream = windows
    _same(_run(spark, verdicts.smooth(stream, ["k"], "seq", "x", "from_ms", "to_ms", 0.4, 45), "smooth"), sequences.smooth(batch, ["k"], ["seq"], "x", "from_ms", "to_ms", 0.4, 45), ["k", "seq", "value", "count"])


def test_confirm_after_resets(spark, windows):
    batch, stream = windows
    parts = sequences.segments(batch, ["k"], ["seq"], F.col("reset"))
    _same(_run(spark, verdicts.confirm(stream, ["k"], "seq", "flag", reset="reset"), "resets"), voting.confirm(parts, ["k", "segment"], ["seq"], "flag"), ["k", "seq", "votes_positive", "votes_valid", "status"])
