"""Keyed votes with commands and expiry on event time: one definition for tables and for streams.

Streams keep a key's rows until the watermark has passed them, so they are voted on in
order of time however they arrive, and timers end a key's silence.  Batches say the same
by windows over the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from kurtosia.operators.voting import confirm

Names = Sequence[str]
#: What a row comes out with; an expiry has no place.
VOTES = "at long, place long, votes_positive long, votes_valid long, status string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def confirmed(rows: DataFrame, commands: DataFrame, keys: Names, time: str, place: str, flag: str, command: str = "command", size: int = 5, needed: int = 4, forget_ms: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """(keys, at, place, votes_positive, votes_valid, status): the votes of each row of ``rows``, and a row for each key that fell silent.

    Rows vote as in ``operators.voting.confirm``, in order of ``time``, then ``place``.  A row of
    ``commands`` (keys, time, place, command) begins the votes of its key anew; it comes before a
    row of the same time and place.  A key without rows and commands for more than
    ``forget_ms`` comes out once with status ``expired`` at its last time plus that, and forgets its votes.
    Of streams, rows older than the watermark (``late`` behind the newest time) do not vote: those that
    Spark still passes on come out with status ``late``, older ones are dropped.

    Rows without a time or key take no part; a NULL flag abstains.  ``at`` is in milliseconds.
    Streams need the session's state store to be RocksDB (PROVIDER), and recover from their checkpoint.
    """
    timed = lambda df, *more: df.select(*keys, F.col(time).cast("timestamp").alias("_time"), F.col(place).cast("long").alias("place"), *more)
    both = timed(rows, F.col(flag).cast("int").alias("flag"), F.lit(None).cast("string").alias("command"))
    both = both.unionByName(timed(commands, F.lit(None).cast("int").alias("flag"), F.coalesce(F.col(command).cast("string"), F.lit("")).alias("command")))
    both = both.dropna(subset=[*keys, "_time"])
    if not both.isStreaming:
        return _by_windows(both.withColumn("at", F.unix_millis("_time")), keys, size, needed, forget_ms)
    kinds = [both.schema[k] for k in keys]
    out = StructType([*kinds, *StructType.fromDDL(VOTES).fields])
    stream = both.withWatermark("_time", late).withColumn("at", F.unix_millis("_time"))
    return stream.groupBy(*keys).transformWithState(Votes(list(keys), size, needed, forget_ms), out, "Append", "EventTime")


def _by_windows(both: DataFrame, keys: Names, size: int, needed: int, forget_ms: int) -> DataFrame:
    order = ["at", "place", "_row"]
    both = both.withColumn("_row", F.col("command").isNull().cast("int"))
    w = Window.partitionBy(*keys).orderBy(*order)
    begins = F.col("command").isNotNull() | F.coalesce(F.col("at") - F.lag("at").over(w) > forget_ms, F.lit(False))
    parted = both.withColumns({"_begins": begins.cast("int"), "_next": F.lead("at").over(w)}).withColumn("_part", F.sum("_begins").over(w))
    voted = confirm(parted.where("command is null").withColumn("_flag", F.col("flag") == 1), [*keys, "_part"], order, "_flag", size, needed)
    silent = parted.where(F.coalesce(F.col("_next") - F.col("at") > forget_ms, F.lit(True)))
    expired = silent.select(*keys, (F.col("at") + forget_ms).alias("at"), F.lit(None).cast("long").alias("place"), F.lit(0).cast("long").alias("votes_positive"), F.lit(0).cast("long").alias("votes_valid"), F.lit("expired").alias("status"))
    return voted.select(*keys, "at", "place", F.col("votes_positive").cast("long"), F.col("votes_valid").cast("long"), "status").unionByName(expired)


class Votes(StatefulProcessor):
    """The state of a key: its last votes and time, and the rows that wait for the watermark."""

    def __init__(self, keys: list[str], size: int, needed: int, forget_ms: int):
        self.names = [*keys, *[f.split()[0] for f in VOTES.split(", ")]]
        self.size, self.needed, self.forget_ms = size, needed, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, place long, flag int, command string")
        self.votes = handle.getValueState("votes", "history string, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        new = [(r["at"], r["place"], r["flag"], r["command"]) for r in rows]
        late = [self._row(key, r[0], r[1], None, None, "late") for r in new if r[0] < passed and r[3] is None]
        new = [r for r in new if r[0] >= passed]
        if new:
            self.waiting.appendList(new)
        for at in sorted({r[0] for r in new}):
            self.handle.registerTimer(at)
        return iter(late)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        rest = [tuple(r) for r in held if r[0] > now]
        due = sorted((tuple(r) for r in held if r[0] <= now), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[3] is None))
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        history, last = self.votes.get() if self.votes.exists() else ("", None)
        out = []
        for at, place, flag, command in due:
            last = at
            if command is not None:
                history = ""
                continue
            history = (history + str(flag))[-self.size :] if flag is not None else history
            hits = history.count("1")
            status = "unavailable" if flag is None or len(history) < self.size else "confirmed" if hits >= self.needed else "normal"
            out.append(self._row(key, at, place, hits, len(history), status))
        if last is None:
            return iter(out)
        end = last + self.forget_ms
        silent = now >= end or (end < timerValues.getCurrentWatermarkInMs() and not any(r[0] <= end for r in rest))
        if due and not silent:
            self.votes.update((history, last))
            self.handle.registerTimer(end)
        elif silent:
            out.append(self._row(key, end, None, 0, 0, "expired"))
            self.votes.clear()
        return iter(out)

    def _row(self, key: tuple, *values) -> Row:
        return Row(*self.names)(*key, *values)

    def close(self) -> None:
        pass
