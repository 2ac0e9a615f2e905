"""Order-dependent state: transport sequences by window functions, non-associative folds by steps through sorted rows.

A fold deals rows by key, sorts them within partitions and steps through them batch by
batch with one state, so memory does not grow with a key's rows; Spark sorts and spills.
The rows of one key are stepped through by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

Names = Sequence[str]


def fold(df: DataFrame, keys: Names, order: Names, values: Sequence[Column], state: tuple, step: Callable[..., tuple], out: str) -> DataFrame:
    """(keys, order, <fields of the state>): the state after each row, ``step(state, *values)``.  ``out`` names the state's fields and types."""
    named = [*keys, *order]
    rows = df.select(*named, *[v.alias(f"_v{i}") for i, v in enumerate(values)])
    rows = rows.repartition(*keys) if keys else rows.coalesce(1)
    rows = rows.sortWithinPartitions(*named, *[f"_v{i}" for i in range(len(values))])
    fields = StructType.fromDDL(out).fields
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*named, *[f.name for f in fields]]
    same = lambda a, b: all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, state
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            held = zip(*columns[: len(keys)], strict=True) if keys else ((),) * b.num_rows
            states = []
            for k, *row in zip(held, *columns[len(named) :], strict=True):
                if key is None or not same(k, key):
                    key, now = k, state
                now = step(now, *row)
                states.append(now)
            done = [pa.array([x[i] for x in states], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(named)], *done], names=names)

    kept = [StructField(c, df.schema[c].dataType) for c in named]
    return rows.mapInArrow(run, StructType([*kept, *fields]))


def rotation_step(jump: float, relock: int) -> Callable[..., tuple]:
    """The step of the tracker's state (hz, last rejected candidate, how many in a row), see ``track_rotation``."""
    def step(s, c):
        hz, pending, rejected = s
        if c is None:
            return s
        n = rejected + 1 if rejected > 0 and abs(c - pending) <= jump else 1
        return (c, None, 0) if hz is None or abs(c - hz) <= jump or n >= relock else (hz, c, n)

    return step


def track_rotation(df: DataFrame, keys: Names, order: Names, candidate: str, jump: float = 5.0, relock: int = 5) -> DataFrame:
    """(keys, order, hz): follows candidates within ``jump``; a farther one is taken after ``relock`` that stay near their predecessors.

    NULL candidates change nothing.
    """
    return fold(df, keys, order, [F.col(candidate).cast("double")], (None, None, 0), rotation_step(jump, relock), "hz double, pending double, rejected int").select(*keys, *order, "hz")


def run_state(df: DataFrame, keys: Names, order: Names, snr: str, threshold: float = 5.0, rows: int = 3) -> DataFrame:
    """Adds ``running`` and ``just_started``: a state changes after ``rows`` windows in a row on its other side.

    By islands: the last window at which a side had been held for ``rows`` windows decides.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    last = w.rowsBetween(1 - rows, 0)
    above = (F.col(snr) >= threshold).cast("int")
    held = F.when(F.count(F.lit(1)).over(last) == rows, F.when(F.sum(above).over(last) == rows, True).when(F.sum(above).over(last) == 0, False))
    out = df.withColumn("_held", held).withColumn("running", F.coalesce(F.last("_held", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    return out.withColumn("just_started", F.col("running") & ~F.coalesce(F.lag("running").over(w), F.lit(False))).drop("_held")


def learning_mode(df: DataFrame, keys: Names, order: Names, running: str, warm_up: int = 5, learn: int = 120) -> DataFrame:
    """Adds ``mode``: running windows warm up, then learn, then monitor; others keep the mode."""
    count = F.sum(F.col(running).cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("mode", F.when(count <= warm_up, "warm_up").when(count <= warm_up + learn, "learning").otherwise("monitoring"))


def smooth(df: DataFrame, keys: Names, order: Names, value: str, start: str, end: str, alpha: float = 0.4, most_gap: int = 500) -> DataFrame:
    """(keys, order, value, count): exponential mean that starts anew after a gap over ``most_gap``, an overlap, or a NULL (count 0)."""
    def step(s, x, at, to):
        mean, n, last = s
        if x is None:
            return None, 0, to
        if n == 0 or last is None or (at is not None and (at < last or at - last > most_gap)):
            return x, 1, to
        return mean + alpha * (x - mean), n + 1, to

    values = [F.col(value).cast("double"), F.col(start).cast("long"), F.col(end).cast("long")]
    return fold(df, keys, order, values, (None, 0, None), step, "value double, count int, end long").select(*keys, *order, "value", "count")


def sequence_status(df: DataFrame, keys: Names, order: Names, session: str, seq: str, bad: str) -> DataFrame:
    """Adds ``status`` and ``missing`` of transport records in order of arrival.

    The anchor is the largest number seen since the session began; a duplicate or an
    older record does not move it.  Bad lines forget the session, and rows without a
    number are unknown and forget it as well.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    lost = F.col(bad) | F.col(seq).isNull()
    name = F.lower(session)
    out = df.withColumn("_lost", lost).withColumn("_name", name)
    out = out.withColumn("_epoch", F.sum(F.col("_lost").cast("int")).over(so_far))
    epoch = Window.partitionBy(*keys, "_epoch").orderBy(*order)
    known = F.when(~F.col("_lost"), F.col("_name"))
    out = out.withColumn("_before", F.last(known, ignorenulls=True).over(epoch.rowsBetween(Window.unboundedPreceding, -1)))
    changed = ~F.col("_lost") & ~F.col("_before").eqNullSafe(F.col("_name"))
    out = out.withColumn("_run", F.sum(changed.cast("int")).over(epoch.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "_epoch", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.max(F.when(~F.col("_lost"), F.col(seq))).over(run)
    out = out.withColumn("_anchor", anchor)
    n, a = F.col(seq), F.col("_anchor")
    status = F.when(F.col("_lost"), "unknown").when(F.col("_before").isNull(), "first").when(F.col("_before") != F.col("_name"), "session_changed")
    status = status.when(n == a, "duplicate").when(n < a, "out_of_order").when(n > a + 1, "gap").otherwise("contiguous")
    out = out.withColumn("status", status)
    missing = F.when(F.col("status") == "duplicate", 0).when(F.col("status").isin("gap", "contiguous"), n - a - 1)
    return out.withColumn("missing", missing.cast("long")).drop("_lost", "_name", "_epoch", "_before", "_run", "_anchor")


def gap_since(df: DataFrame, keys: Names, order: Names, start: str, end: str) -> DataFrame:
    """Adds ``gap``: start minus the last known end before it; windows without an end pass it on."""
    before = F.last(end, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_end", before).withColumn("gap", F.when(F.col(start) >= F.col("_end"), F.col(start) - F.col("_end"))).drop("_end")


def segments(df: DataFrame, keys: Names, order: Names, resets: Column) -> DataFrame:
    """Adds ``segment``: how often ``resets`` has held up to the row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("segment", F.sum(F.coalesce(resets, F.lit(False)).cast("int")).over(w))


BEARING = "outcome string, votes_positive int, votes_valid int, status string"
FRESH_MS, STRIDE, VOTES, NEEDED = 2000, 2048, 5, 4


def bearing_step(state: tuple, session, sequence, start, rpm, now, usable, flag, stride: int = STRIDE, fresh_ms: int = FRESH_MS) -> tuple[tuple, tuple]:
    """One window of a bearing detector: (state, outputs).

    state is (session, sequence, start, rpm, now, history of votes); outputs are those of BEARING.
    A window that cannot be used, or that repeats or precedes the last one, is rejected and
    clears the votes.  A new session, a gap, another speed or an age over ``fresh_ms``
    restarts them with the window.  A row without a sequence only tells the time: once
    the last window is too old the verdict is unavailable again.
    """
    empty = (None, None, None, None, None, "")
    last_session, last_sequence, last_start, last_rpm, last_now, history = state
    known = last_sequence is not None
    stale = known and now is not None and now - last_now > fresh_ms
    if sequence is None:
        if stale:
            return empty, ("expired", 0, 0, "unavailable")
        return state, ("time", history.count("1"), len(history), _bearing_status(history))
    if not usable or flag is None:
        return empty, ("rejected_unusable", 0, 0, "unavailable")
    outcome = "continued" if known else "first"
    if known and session == last_session and (sequence <= last_sequence or start <= last_start):
        return empty, ("rejected_repeated", 0, 0, "unavailable")
    if known and (session != last_session or rpm != last_rpm or sequence != last_sequence + 1 or start != last_start + stride or stale):
        outcome, history = "restarted", ""
    history = (history + ("1" if flag else "0"))[-VOTES:]
    return (session, sequence, start, rpm, now, history), (outcome, history.count("1"), len(history), _bearing_status(history))


def _bearing_status(history: str) -> str:
    return "unavailable" if len(history) < VOTES else "confirmed" if history.count("1") >= NEEDED else "normal"


def bearing_continuity(df: DataFrame, keys: Names, order: Names, session: str, sequence: str, start: str, rpm: str, now: str, usable: str, flag: str, stride: int = STRIDE, fresh_ms: int = FRESH_MS) -> DataFrame:
    """(keys, order, outcome, votes_positive, votes_valid, status) of each window, see ``bearing_step``."""

    def step(held, *row):
        state, out = bearing_step(held[:6], *row, stride=stride, fresh_ms=fresh_ms)
        return (*state, *out)

    kinds = (("string", session), ("long", sequence), ("long", start), ("double", rpm), ("long", now), ("boolean", usable), ("boolean", flag))
    fields = f"_session string, _sequence long, _start long, _rpm double, _now long, _history string, {BEARING}"
    out = fold(df, keys, order, [F.col(c).cast(kind) for kind, c in kinds], (None, None, None, None, None, "", None, 0, 0, None), step, fields)
    return out.select(*keys, *order, *[x.split()[0] for x in BEARING.split(", ")])


PROFILE_STATE = "ok boolean, reason string, context string, ppr int, current long, current_context string, current_ppr int, candidate long, candidate_context string, candidate_ppr int, previous long, previous_context string, previous_ppr int, next_id long, generation long, learning boolean, paused boolean, hold boolean"
_START = (None, None, None, 0, None, None, None, None, None, None, None, None, None, 1, 0, False, True, False)
_AT = {f.split()[0]: i for i, f in enumerate(PROFILE_STATE.split(", "))}


def _names_context(x: str) -> bool:
    return 0 < len(x) <= 12 and all(c.isascii() and (c.isalnum() or c in "_-") for c in x)


def profile_step(state: tuple, line: str | None) -> tuple:
    """One command line of a baseline store, or one of the events ``learned`` and ``storage_error``.

    learn needs a context and pulses a turn and no candidate; what is learned becomes
    the candidate under a new id that is never used again.  approve <id> and rollback
    ask that the profile's condition is the selected one; clear forgets the selection
    and all profiles.  A storage error holds the store: only status, stop and recover go on.
    Every command ends learning unless it begins it.  A command that fails changes no profile and no selection.

    Fixed values: commands and reasons are the words of the store's protocol.
    """
    s = dict(zip(_AT, state, strict=True))
    word, _, rest = (line or "").strip().partition(" ")
    roles = ("current", "candidate", "previous")
    profile = lambda role: (s[role], s[f"{role}_context"], s[f"{role}_ppr"])

    def put(role, value):
        s[role], s[f"{role}_context"], s[f"{role}_ppr"] = value

    def matches(role):
        return s[role] is not None and (s[f"{role}_context"], s[f"{role}_ppr"]) == (s["context"], s["ppr"])

    def told(ok, reason, saves=True):
        s["ok"], s["reason"] = ok, reason
        s["generation"] += 1 if ok and saves else 0
        if word not in ("learn", "learned") or not ok:
            s["learning"] = False
        return tuple(s.values())

    number = int(rest) if rest.isascii() and rest.isdigit() else 0
    if word == "storage_error":
        s["hold"] = True
        return told(False, "storage_hold")
    if word == "profile":
        return told(True, "status", saves=False)
    if word == "stop":
        s["paused"] = True
        return told(True, "paused", saves=False)
    if word == "recover":
        was, s["hold"], s["paused"] = s["hold"], False, True
        return told(was, "recovered" if was else "recovery_not_required")
    if word not in ("start", "learn", "learned", "context", "ppr", "approve", "discard", "rollback", "import", "clear"):
        return told(False, "unknown_command")
    if s["hold"]:
        return told(False, "storage_hold")
    if word == "import" and not _names_context(rest):  # import <context>
        return told(False, "context_invalid")
    if word == "start":
        s["paused"] = False
        return told(True, "sampling", saves=False)
    if word == "context":
        if not _names_context(rest):
            return told(False, "context_invalid")
        s["context"] = rest
    elif word == "ppr":
        if not 1 <= number <= 16:
            return told(False, "ppr_invalid")
        s["ppr"] = number
    elif word in ("learn", "learned", "import"):
        if word == "learned" and not s["learning"]:
            return told(False, "not_learning")
        if s["candidate"] is not None:
            return told(False, "candidate_exists")
        if word == "learn" and s["learning"]:
            return told(False, "learning_in_progress")
        context = rest if word == "import" else s["context"]
        if context is None or not s["ppr"]:
            return told(False, "selection_required")
        s["context"] = context
        if word == "learn":
            s["learning"], s["paused"] = True, False
            return told(True, "started", saves=False)
        put("candidate", (s["next_id"], s["context"], s["ppr"]))
        s["next_id"] += 1
        s["learning"] = False
    elif word == "approve":
        if not number or number != s["candidate"]:
            return told(False, "candidate_id_mismatch" if number else "candidate_id_invalid")
        if not matches("candidate"):
            return told(False, "condition_mismatch")
        put("previous", profile("current"))
        put("current", profile("candidate"))
        put("candidate", (None,) * 3)
    elif word == "discard":
        if s["candidate"] is None:
            return told(False, "candidate_missing")
        put("candidate", (None,) * 3)
    elif word == "rollback":
        if s["previous"] is None or not matches("previous"):
            return told(False, "previous_missing" if s["previous"] is None else "condition_mismatch")
        current = profile("current")
        put("current", profile("previous"))
        put("previous", current)
    elif word == "clear":
        s["context"], s["ppr"] = None, 0
        for role in roles:
            put(role, (None,) * 3)
    return told(True, "saved")


def profile_store(df: DataFrame, keys: Names, order: Names, line: str) -> DataFrame:
    """(keys, order, PROFILE_STATE): answer and state after each command line, see ``profile_step``."""
    return fold(df, keys, order, [F.col(line).cast("string")], _START, profile_step, PROFILE_STATE)
