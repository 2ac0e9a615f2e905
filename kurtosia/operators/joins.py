"""Checked joins and sets: every row says why it cannot be used, and nothing is dropped silently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def channel_matrix(df: DataFrame, keys: Names, channel: str, channels: Sequence, values: Names) -> DataFrame:
    """(keys, <value>_<channel>, reason): a row a key, a column a channel and value; missing_channel, repeated_channel or ok.

    One aggregation combines before its shuffle, so no channel is joined to another.
    """
    at = {c: F.col(channel) == F.lit(c) for c in channels}
    cells = [F.max(F.when(is_, F.col(v))).alias(f"{v}_{c}") for c, is_ in at.items() for v in values]
    n = F.array(*[F.count_if(is_) for is_ in at.values()])
    gaps = F.array(*[F.count_if(is_ & F.col(v).isNull()) for is_ in at.values() for v in values])
    out = df.groupBy(*keys).agg(*cells, n.alias("_n"), gaps.alias("_gaps"))
    reason = F.when(F.array_max("_n") > 1, "repeated_channel").when((F.array_min("_n") < 1) | (F.array_max("_gaps") > 0), "missing_channel").otherwise("ok")
    return out.withColumn("reason", reason).drop("_n", "_gaps")


def merged_caches(first: DataFrame, second: DataFrame, keys: Names, same: Names, close: Names, rtol: float = 1e-12, atol: float = 1e-14) -> DataFrame:
    """(keys, same, close, source, reason): the union by key, each key once.

    reason: repeated_key where one side has a key twice; provenance where sides differ
    in a ``same`` column, values where they differ in a ``close`` one by more than atol +
    rtol * size; else ok.  Values are the first side's where it has any.
    """
    cols = [*same, *close]
    both = first.select(*keys, F.struct(*cols).alias("_v"), F.lit(1).alias("_side")).unionByName(second.select(*keys, F.struct(*cols).alias("_v"), F.lit(2).alias("_side")))
    one, two = F.col("_side") == 1, F.col("_side") == 2
    out = both.groupBy(*keys).agg(F.count_if(one).alias("_n1"), F.count_if(two).alias("_n2"), F.min(F.when(one, F.col("_v"))).alias("_a"), F.min(F.when(two, F.col("_v"))).alias("_b"))
    shared = (F.col("_n1") > 0) & (F.col("_n2") > 0)
    a, b = (lambda c: F.col(f"_a.{c}")), (lambda c: F.col(f"_b.{c}"))
    other = _any([~a(c).eqNullSafe(b(c)) for c in same])
    apart = _any([~F.coalesce(F.abs(a(c) - b(c)) <= atol + rtol * F.abs(b(c)), a(c).isNull() & b(c).isNull()) for c in close])
    reason = F.when((F.col("_n1") > 1) | (F.col("_n2") > 1), "repeated_key").when(shared & other, "provenance").when(shared & apart, "values").otherwise("ok")
    source = F.when(shared, "both").when(F.col("_n1") > 0, "first").otherwise("second")
    return out.select(*keys, *[F.when(F.col("_n1") > 0, a(c)).otherwise(b(c)).alias(c) for c in cols], source.alias("source"), reason.alias("reason"))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def relative_to_calibration(df: DataFrame, keys: Names, features: Names, calibration: Column) -> DataFrame:
    """Adds <feature>_relative, the difference from the key's one calibration row, and ``reason``: no_calibration, repeated_calibration or ok."""
    base = df.where(calibration).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.max(f).alias(f"_{f}") for f in features])
    out = df.join(base, list(keys), "left")
    reason = F.when(F.col("_n").isNull(), "no_calibration").when(F.col("_n") > 1, "repeated_calibration").otherwise("ok")
    relative = {f"{f}_relative": F.when(F.col("_n") == 1, F.col(f) - F.col(f"_{f}")) for f in features}
    return out.withColumns(relative).withColumn("reason", reason).drop("_n", *[f"_{f}" for f in features])


def memberships(df: DataFrame, label: str, trial: str, fold: str, holdouts: Sequence[int], per_class: int = 4) -> DataFrame:
    """Each row once for each held-out fold, with ``holdout`` and ``role``: test, train (the first ``per_class`` trials of its class) or unused."""
    trials = df.select(label, trial, fold).distinct().withColumn("holdout", F.explode(F.array(*[F.lit(h) for h in holdouts])))
    other = F.col(fold) != F.col("holdout")
    rank = F.row_number().over(Window.partitionBy("holdout", label, other).orderBy(trial))
    role = F.when(~other, "test").when(rank <= per_class, "train").otherwise("unused")
    return df.join(trials.withColumn("role", role), [label, trial, fold])


def pinned(manifest: DataFrame, artifacts: DataFrame, path: str, pin: str, found: str) -> DataFrame:
    """(path, pin, found, status) of a manifest's pins against artifacts' hashes: ok, hash_differs, missing or unlisted."""
    out = manifest.select(path, pin, F.lit(True).alias("_m")).join(artifacts.select(path, found, F.lit(True).alias("_a")), path, "full")
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_m").isNull(), "unlisted").when(F.col(pin).eqNullSafe(F.col(found)), "ok").otherwise("hash_differs")
    return out.select(path, pin, found, status.alias("status"))


def member_sets(first: DataFrame, second: DataFrame, keys: Names) -> DataFrame:
    """(keys, side): each key once; both, first or second."""
    sides = first.select(*keys, F.lit(1).alias("_s")).unionByName(second.select(*keys, F.lit(2).alias("_s")))
    out = sides.groupBy(*keys).agg(F.min("_s").alias("lo"), F.max("_s").alias("hi"))
    return out.select(*keys, F.when(F.col("lo") < F.col("hi"), "both").when(F.col("lo") == 1, "first").otherwise("second").alias("side"))


def drawn_share(*parts: Column) -> Column:
    """A number from 0 to 1 that follows from the parts: the first 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / (1 << 32)


def group_split(df: DataFrame, label: str, group: str, test_share: float = 0.3, tries: int = 50) -> DataFrame:
    """Adds ``test`` and ``draw``: whole groups are dealt by hash, by the first draw that has all classes on both sides; fails if none has."""
    groups = df.select(label, group).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    dealt = groups.withColumn("test", drawn_share(F.col("draw"), F.col(group)) < test_share)
    sides = dealt.groupBy("draw", label).agg((F.bool_or("test") & F.bool_or(~F.col("test"))).alias("both"))
    good = sides.groupBy("draw").agg(F.bool_and("both").alias("good")).where("good").agg(F.min("draw").alias("draw"))
    checked = good.select(F.when(F.col("draw").isNull(), F.raise_error(F.lit("no draw has all classes on both sides")).cast("int")).otherwise(F.col("draw")).alias("draw"))
    return df.join(F.broadcast(checked), how="cross").withColumn("test", drawn_share(F.col("draw"), F.col(group)) < test_share)


def last_rows(df: DataFrame, keys: Names, order: Names, n: int = 180, most: int = 2000) -> DataFrame:
    """The last ``n`` rows of each key (a report of 1 to ``most`` rows), numbered from the oldest in ``position``."""
    n = max(1, min(most, n))
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))
    out = df.withColumn("_back", back).where(F.col("_back") <= n)
    return out.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).drop("_back")
