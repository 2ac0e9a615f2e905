"""Structured Streaming twins of the order-dependent operators: the same rows, verdict by verdict, as they arrive.

State is kept for each key and small: the last votes, a tracked speed, an anchor.
Rows of one micro-batch are put in order by key; a row older than the key's last one is late
and comes out with status ``late``, as batch operators would have sorted it in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from kurtosia.operators import sequences

Names = Sequence[str]


def _stateful(stream: DataFrame, keys: Names, order: str, out: str, state: str, start: tuple, step: Callable, forget_ms: int | None = None, expired: tuple | None = None) -> DataFrame:
    """Runs step(state, row) -> (state, outputs) over the rows of each key in order.

    With ``forget_ms`` a key that has been silent for that long starts anew; ``expired``
    are the outputs that say so, in a row with the key's last place in the order.
    """
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in stream.schema if f.name in (*keys, order)]
    names = [c.split()[0] for c in out.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            last = held.get[0]
            held.remove()
            if expired:
                yield pd.DataFrame([(*key, last, *expired)], columns=[*keys, order, *names])
            return
        now = held.get if held.exists else start
        last, now = now[0], now[1:]
        rows = pd.concat(list(batches)).sort_values(order)
        told = []
        for row in rows.to_dict("records"):
            if last is not None and row[order] <= last:
                told.append((*key, row[order], *["late" if n == "status" else None for n in names]))
                continue
            last = int(row[order])
            now, got = step(now, row)
            told.append((*key, row[order], *got))
        held.update((last, *now))
        if forget_ms:
            held.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(told, columns=[*keys, order, *names])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout
    schema = ", ".join([*fields, out])
    return stream.groupBy(*keys).applyInPandasWithState(run, schema, f"_last long, {state}", "append", timeout)


def _flag(x) -> bool | None:
    return None if x is None or x is pd.NA or x != x else bool(x)


def confirm(stream: DataFrame, keys: Names, order: str, flag: str, size: int = 5, needed: int = 4, forget_ms: int | None = None, reset: str | None = None) -> DataFrame:
    """Votes and status of ``operators.voting.confirm``; the state is the last ``size`` votes.

    A row whose boolean ``reset`` holds begins without votes.  After ``forget_ms`` of silence a
    row of status unavailable tells that the votes are gone.
    """

    def step(state, row):
        history = "" if reset and _flag(row[reset]) else state[0]
        f = _flag(row[flag])
        if f is not None:
            history = (history + ("1" if f else "0"))[-size:]
        hits = history.count("1")
        status = "unavailable" if f is None or len(history) < size else "confirmed" if hits >= needed else "normal"
        return (history,), (hits, len(history), status)

    return _stateful(stream, keys, order, "votes_positive long, votes_valid long, status string", "history string", (None, ""), step, forget_ms, (0, 0, "unavailable"))


def track_rotation(stream: DataFrame, keys: Names, order: str, candidate: str, jump: float = 5.0, relock: int = 5) -> DataFrame:
    """The tracked speed of ``operators.sequences.track_rotation``."""

    def step(state, row):
        hz, pending, rejected = state
        c = row[candidate]
        if c is None or c != c:
            return state, (hz,)
        n = rejected + 1 if rejected and abs(c - pending) <= jump else 1
        if hz is None or abs(c - hz) <= jump or n >= relock:
            return (c, None, 0), (c,)
        return (hz, c, n), (hz,)

    return _stateful(stream, keys, order, "hz double", "hz double, pending double, rejected int", (None, None, None, 0), step)


def run_state(stream: DataFrame, keys: Names, order: str, snr: str, threshold: float = 5.0, rows: int = 3) -> DataFrame:
    """Running and just_started of ``operators.sequences.run_state``."""

    def step(state, row):
        running, up, down = state
        up, down = (up + 1, 0) if row[snr] >= threshold else (0, down + 1)
        now = up >= rows or (running and down < rows)
        return (now, up, down), (now, now and not running)

    return _stateful(stream, keys, order, "running boolean, just_started boolean", "running boolean, up int, down int", (None, False, 0, 0), step)


def sequence_status(stream: DataFrame, keys: Names, order: str, session: str, seq: str, bad: str) -> DataFrame:
    """Status and missing of ``operators.sequences.sequence_status``."""

    def step(state, row):
        name, anchor = state
        n = row[seq]
        if row[bad] or n is None or n != n:
            return (None, None), ("unknown", None)
        s, n = str(row[session]).lower(), int(n)
        if name is None or s != name:
            return (s, n), ("first" if name is None else "session_changed", None)
        if n <= anchor:
            return state, ("duplicate", 0) if n == anchor else ("out_of_order", None)
        return (s, n), ("gap" if n > anchor + 1 else "contiguous", n - anchor - 1)

    return _stateful(stream, keys, order, "status string, missing long", "session string, anchor long", (None, None, None), step)


def smooth(stream: DataFrame, keys: Names, order: str, value: str, start: str, end: str, alpha: float = 0.4, most_gap: int = 500) -> DataFrame:
    """The mean of ``operators.sequences.smooth``, which starts anew after a gap, an overlap or a NULL."""

    def step(state, row):
        mean, n, last = state
        x = row[value]
        at, to = (None if v is None or v != v else int(v) for v in (row[start], row[end]))
        if x is None or x != x:
            return (None, 0, to), (None, 0)
        if not n or last is None or (at is not None and (at < last or at - last > most_gap)):
            return (x, 1, to), (x, 1)
        mean += alpha * (x - mean)
        return (mean, n + 1, to), (mean, n + 1)

    return _stateful(stream, keys, order, "value double, count int", "mean double, n int, end long", (None, None, 0, None), step)


def bearing(stream: DataFrame, keys: Names, order: str, columns: dict[str, str], stride: int = sequences.STRIDE, fresh_ms: int = sequences.FRESH_MS, forget_ms: int | None = None) -> DataFrame:
    """Outcomes of ``operators.sequences.bearing_continuity``; ``columns`` names session, sequence, start, rpm, now, usable and flag.

    With ``forget_ms`` a silent key comes out once more, expired and unavailable.
    """
    kinds = {"session": str, "sequence": int, "start": int, "rpm": float, "now": int, "usable": bool, "flag": bool}

    def step(state, row):
        values = [None if row[columns[c]] is None or row[columns[c]] is pd.NA or row[columns[c]] != row[columns[c]] else kind(row[columns[c]]) for c, kind in kinds.items()]
        return sequences.bearing_step(state, *values, stride=stride, fresh_ms=fresh_ms)

    state = "session string, sequence long, start long, rpm double, now long, history string"
    return _stateful(stream, keys, order, sequences.BEARING, state, (None, None, None, None, None, None, ""), step, forget_ms, ("expired", 0, 0, "unavailable"))


def alarm_counts(stream: DataFrame, keys: Names, time: str, flag: str, window: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Windows of event time with their rows and alarms; rows later than the watermark are dropped by it."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", window), *keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(flag).alias("alarms"))
