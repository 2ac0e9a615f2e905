"""Votes with commands and expiry: the stream gives the table's rows, in any order of arrival and over restarts."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from kurtosia.streaming import keyed

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "k string, t timestamp, n long, flag boolean, command string"


def at(s):
    return T0 + timedelta(seconds=s)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, keyed.PROVIDER)
    yield spark
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def made(seed=1):
    """Rows of two keys, with pauses, abstentions, resets and repeated times; a third key moves the watermark at the end."""
    rng, rows = random.Random(seed), []
    for k in ("a", "b"):
        s = 0
        for n in range(60):
            s += rng.choice([0, 1, 1, 2, 3, 70 if n % 20 == 19 else 1])
            kind = rng.random()
            rows.append((k, at(s), n, None, "reset") if kind < 0.08 else (k, at(s), n, None if kind < 0.2 else rng.random() < 0.8, None))
    return rows


def split(df):
    return df.where("command is null"), df.where("command is not null")


def table(spark, rows, **more):
    out = keyed.confirmed(*split(spark.createDataFrame(rows, SCHEMA)), ["k"], "t", "n", "flag", **more)
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_table_by_hand(spark):
    rows = [("a", at(i), i, True, None) for i in range(5)] + [("a", at(5), 5, None, "reset"), ("a", at(5), 5, True, None), ("a", at(66), 6, True, None), (None, at(1), 1, True, None), ("a", None, 9, True, None)]
    got = table(spark, rows)
    base = int(T0.timestamp() * 1000)
    votes = [(i, i + 1, i + 1, "confirmed" if i == 4 else "unavailable") for i in range(5)]
    want = [("a", base + 1000 * s, s, p, v, status) for s, p, v, status in votes] + [("a", base + 5000, 5, 1, 1, "unavailable"), ("a", base + 65000, None, 0, 0, "expired"), ("a", base + 66000, 6, 1, 1, "unavailable"), ("a", base + 126000, None, 0, 0, "expired")]
    assert got == sorted(want, key=str)
    assert table(spark, []) == []


def test_stream_equals_table_over_a_restart(rocks, tmp_path):
    spark, rows = rocks, made()
    rows.sort(key=lambda r: r[1])
    shuffled = [r for lo in range(0, len(rows), 6) for r in random.Random(lo).sample(rows[lo : lo + 6], len(rows[lo : lo + 6]))]
    parts = [shuffled[lo : lo + 30] for lo in range(0, len(shuffled), 30)]
    late = ("a", at(0), 999, True, None)
    parts += [[("z", at(5000), 0, True, None)], [late, ("z", at(5001), 1, True, None)]]
    source = tmp_path / "in"

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        out = keyed.confirmed(*split(stream), ["k"], "t", "n", "flag", late="300 seconds")
        query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()

    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        if i in (1, len(parts) - 1):
            run()  # the second run goes on from the checkpoint
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("k <> 'z'").collect()), key=str)
    want = table(spark, rows)
    assert [r for r in got if r[-1] == "late"] == [("a", int(T0.timestamp() * 1000), 999, None, None, "late")]
    got = [r for r in got if r[-1] != "late"]
    assert got == want and sum(r[-1] == "expired" for r in got) > 2 and any(r[-1] == "confirmed" for r in got)
