"""Folds whose keys spread over tasks: buckets of a key are summarised, summaries are composed, and buckets stepped through.

``bucket`` is a column of the order columns that never falls within a key's order, such as
``floor(time / span)``.  What a bucket does to the state that enters it is its summary: an
affine map for a mean, a small table for a tracker.  Only summaries, one row a bucket, meet
in a task of their key.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from .sequences import fold, rotation_step

Names = Sequence[str]


def _same(a: tuple, b: tuple | None) -> bool:
    return b is not None and all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[bool, tuple, tuple]]:
    """Of rows sorted by their first ``n_keys`` columns: (whether a key begins, the key, the rest of the row)."""
    key = None
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            begins = not _same(row[:n_keys], key)
            key = row[:n_keys] if begins else key
            yield begins, key, row[n_keys:]


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)


def _mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], fields: list[StructField]) -> DataFrame:
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])
    return df.mapInArrow(lambda batches: _batched(run(batches), schema), StructType(fields))


def fold_in_buckets(df: DataFrame, keys: Names, order: Names, bucket: Column, values: Sequence[Column], state: tuple, step: Callable[..., tuple], out: str, summary: Callable[[], object], through: Callable[[object, tuple], tuple]) -> DataFrame:
    """As ``fold``: (keys, order, <fields of the state>), with a key's rows dealt by bucket.

    ``summary()`` makes an object with ``add(*values)`` and ``told()``, which gives something
    that JSON holds; ``through(told, state)`` is the state after all rows of the bucket.
    Three passes: summaries by bucket, states that enter buckets by key, steps by bucket.
    """
    named, vals = [*keys, *order], [f"_v{i}" for i in range(len(values))]
    rows = df.select(*keys, bucket.alias("_bucket"), *order, *[v.alias(c) for v, c in zip(values, vals, strict=True)])
    within = [*keys, "_bucket"]
    fields = {f.name: f for f in rows.schema.fields}
    of = lambda names: [StructField(c, fields[c].dataType) for c in names]
    n, n_order = len(within), len(order)
    text = StructType.fromDDL("_told string, _enters string").fields

    def summarise(batches):
        held, now = None, None
        for begins, key, row in _runs(batches, n):
            if begins:
                if held is not None:
                    yield (*held, json.dumps(now.told()))
                held, now = key, summary()
            now.add(*row[n_order:])
        if held is not None:
            yield (*held, json.dumps(now.told()))

    def enter(batches):
        now = state
        for begins, key, (b, told) in _runs(batches, n - 1):
            now = state if begins else now
            yield (*key, b, json.dumps(now))
            now = through(json.loads(told), now)

    def steps(batches):
        now = state
        for begins, key, (enters, leads, *row) in _runs(batches, n):
            now = state if begins else now
            if leads == 0:
                now = tuple(json.loads(enters))
            else:
                now = step(now, *row[n_order:])
                yield (*key[:-1], *row[:n_order], *now)

    dealt = rows.repartition(*within).sortWithinPartitions(*within, *order, *vals)
    told = _mapped(dealt, summarise, [*of(within), text[0]])
    told = (told.repartition(*keys) if keys else told.coalesce(1)).sortWithinPartitions(*within)
    entering = _mapped(told, enter, [*of(within), text[1]])
    lead = entering.select(*within, "_enters", F.lit(0).alias("_leads"), *[F.lit(None).cast(fields[c].dataType).alias(c) for c in (*order, *vals)])
    both = lead.unionByName(rows.select(*within, F.lit(None).cast("string").alias("_enters"), F.lit(1).alias("_leads"), *order, *vals))
    both = both.repartition(*within).sortWithinPartitions(*within, "_leads", *order, *vals)
    return _mapped(both, steps, [*of(named), *StructType.fromDDL(out).fields])


class _Tracks:
    """What a bucket of candidates does to any state of the rotation tracker.

    A state matters only until it first takes a candidate; then the place of that candidate
    decides.  ``early`` holds the candidates until some run of them makes every tracker
    take one; ``tracks`` maps the state after the rows so far to the places of first candidates that
    lead to it.  Tracks that take the same candidate are one from there on.
    """

    def __init__(self, jump: float, relock: int) -> None:
        self.jump, self.relock, self.step = jump, relock, rotation_step(jump, relock)
        self.early, self.tracks, self.undecided, self.run, self.last = [], {}, True, 0, None

    def add(self, c: float | None) -> None:
        if c is None:
            return
        moved = {}
        for s, places in self.tracks.items():
            moved.setdefault(self.step(s, c), []).extend(places)
        if self.undecided:
            moved.setdefault((c, None, 0), []).append(len(self.early))
            self.early.append(c)
            self.run = self.run + 1 if self.run and abs(c - self.last) <= self.jump else 1
            self.last = c
            self.undecided = self.run < self.relock
        self.tracks = moved

    def told(self) -> list:
        return [self.early, list(self.tracks.items())]


def track_rotation(df: DataFrame, keys: Names, order: Names, candidate: str, bucket: Column, jump: float = 5.0, relock: int = 5) -> DataFrame:
    """``sequences.track_rotation`` with each key's rows dealt by bucket; the same rows to the last bit."""
    step = rotation_step(jump, relock)

    def through(told, s):
        early, tracks = told
        for i, c in enumerate(early):
            s = step(s, c)
            if s[2] == 0:
                return next(tuple(end) for end, places in tracks if i in places)
        return s

    out = "hz double, pending double, rejected int"
    tracked = fold_in_buckets(df, keys, order, bucket, [F.col(candidate).cast("double")], (None, None, 0), step, out, lambda: _Tracks(jump, relock), through)
    return tracked.select(*keys, *order, "hz")


def smooth(df: DataFrame, keys: Names, order: Names, value: str, start: str, end: str, bucket: Column, alpha: float = 0.4, most_gap: int = 500) -> DataFrame:
    """``sequences.smooth`` with each key's rows dealt by bucket, by window sums: no row passes Python, but for one a bucket.

    Where the mean starts anew depends on a row and its predecessor alone; between such places it is an
    affine map of the mean before.  Weighted sums run over blocks short enough that no
    weight leaves the range of a double; what two blocks before left is below its precision.
    Values agree with ``sequences.smooth`` but for rounding; one that is not finite makes itself
    and those after it, until the mean starts anew, NaN.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must lie in (0, 1]")
    q = 1 - alpha
    block = 1 if q == 0 else max(1, math.floor(60 / -math.log10(q)))
    power = lambda n: F.pow(F.lit(q), n)
    rows = df.select(*keys, bucket.alias("_bucket"), *order, F.col(value).cast("double").alias("_x"), F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    within, sort = [*keys, "_bucket"], [*order, "_x", "_s", "_e"]
    w = Window.partitionBy(*within).orderBy(*sort)
    pair = F.struct(F.col("_x").alias("x"), F.col("_e").alias("e"))

    def carried(side: DataFrame, *cols: str) -> Callable[[DataFrame], DataFrame]:
        """Joins ``cols`` of the bucket before to each row."""
        before = Window.partitionBy(*keys).orderBy("_bucket")
        names = [F.col(k).alias(f"_key{i}") for i, k in enumerate(within)]
        ahead = side.select(*names, *[F.lag(c).over(before).alias(c) for c in cols])
        on = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(within)]
        return lambda rows: rows.join(ahead, on, "left").drop(*[f"_key{i}" for i in range(len(within))])

    lasts = rows.groupBy(*within).agg(F.max_by(pair, F.struct(*sort)).alias("_left"))
    rows = carried(lasts, "_left")(rows.withColumn("_lag", F.lag(pair).over(w)))
    p = F.coalesce("_lag", "_left")
    apart = F.coalesce((F.col("_s") < p["e"]) | (F.col("_s") - p["e"] > most_gap), F.lit(False))
    anew = p.isNull() | p["x"].isNull() | p["e"].isNull() | F.col("_x").isNull() | apart
    rows = rows.withColumn("_anew", anew).withColumn("_seg", F.sum(F.col("_anew").cast("int")).over(w))
    segment = Window.partitionBy(*within, "_seg").orderBy(*sort)
    rows = rows.withColumn("_j", F.row_number().over(segment))
    rows = rows.withColumn("_block", F.floor((F.col("_j") - 1) / block)).withColumn("_i", (F.col("_j") - 1) % block)
    part = F.when(F.col("_anew"), F.col("_x")).otherwise(alpha * F.col("_x"))
    odd = F.max(F.isnan("_x") | (F.abs("_x") == F.lit(math.inf))).over(segment)
    sums = F.sum(part * power(-F.col("_i"))).over(Window.partitionBy(*within, "_seg", "_block").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_inner", F.when(odd, F.lit(math.nan)).otherwise(power(F.col("_i")) * sums))
    prior = F.max_by("_inner", "_i").over(Window.partitionBy(*within, "_seg").orderBy("_block").rangeBetween(-1, -1))
    rows = rows.withColumn("_own", F.col("_inner") + F.coalesce(power(F.col("_i") + 1) * prior, F.lit(0.0)))

    tails = rows.groupBy(*within).agg(F.max_by(F.struct("_seg", "_j", "_own"), F.struct(*sort, "_seg", "_j")).alias("_t"))

    def compose(s, seg, n, own):
        mean, count = s
        if seg > 0 or count == 0:
            return (own, 0 if own is None else n)
        return (q**n * mean + own, count + n)

    after = fold(tails.select(*within, "_t.*"), keys, ["_bucket"], [F.col("_seg"), F.col("_j"), F.col("_own")], (None, 0), compose, "_mean double, _count long")
    rows = carried(after, "_mean", "_count")(rows)
    goes_on = F.col("_seg") == 0
    mean = F.when(goes_on, F.col("_own") + power(F.col("_j")) * F.col("_mean")).otherwise(F.col("_own"))
    count = F.when(F.col("_x").isNull(), 0).when(goes_on, F.col("_j") + F.col("_count")).otherwise(F.col("_j")).cast("int")
    return rows.select(*keys, *order, mean.alias("value"), count.alias("count"))
