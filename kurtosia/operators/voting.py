"""Verdicts over ordered windows.  A flag is TRUE, FALSE or NULL; NULL abstains: it neither votes nor erases votes.

Every function partitions by ``keys`` and sorts by ``order`` once; a key's windows
must be totally ordered by it.  One key is one task's work, so long streams should
carry a session in their keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def _over(keys: Sequence, order: Names, back: int | None = None):
    w = Window.partitionBy(*keys).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding if back is None else -back, 0)


def votes(df: DataFrame, keys: Names, order: Names, flag: str, size: int = 5, prefix: str = "votes", dealt: bool = False) -> DataFrame:
    """Adds <prefix>_positive and <prefix>_valid: hits and rows among the last ``size`` rows with a verdict.

    Rows that abstain carry the counts of the row before them.  Both windows run on
    one deal of the rows by ``keys``; ``dealt`` says that it has been made.
    """
    df = df if dealt else df.repartition(*keys)
    valid = F.col(flag).isNotNull()
    recent = _over([*keys, valid], order, size - 1)
    so_far = _over(keys, order)
    positive = F.when(valid, F.sum(F.col(flag).cast("int")).over(recent))
    count = F.when(valid, F.count(flag).over(recent))
    df = df.withColumn(f"{prefix}_positive", positive).withColumn(f"{prefix}_valid", count)
    carried = {f"{prefix}_{x}": F.coalesce(F.last(f"{prefix}_{x}", ignorenulls=True).over(so_far), F.lit(0)).cast("long") for x in ("positive", "valid")}
    return df.withColumns(carried)


def confirm(df: DataFrame, keys: Names, order: Names, flag: str, size: int = 5, needed: int = 4) -> DataFrame:
    """Adds votes and ``status``: confirmed or normal; unavailable, with a ``reason``, while abstaining or short of votes."""
    out = votes(df, keys, order, flag, size)
    mature = F.col("votes_valid") == size
    status = F.when(F.col(flag).isNull() | ~mature, "unavailable").when(F.col("votes_positive") >= needed, "confirmed").otherwise("normal")
    reason = F.when(F.col(flag).isNull(), "current_window_invalid").when(~mature, "confirmation_buffer_incomplete")
    return out.withColumn("status", status).withColumn("reason", reason)


def confirm_by_rate(df: DataFrame, keys: Names, order: Names, flag: str, size: int = 5, least: float = 0.6) -> DataFrame:
    """Adds ``confirmed``: the last ``size`` rows are there and the share of hits among them is ``least``."""
    recent = _over(keys, order, size - 1)
    full = F.count(F.lit(1)).over(recent) == size
    share = F.sum(F.col(flag).cast("int")).over(recent) / size
    return df.withColumn("confirmed", full & (share >= least))


def confirm_in_file(df: DataFrame, keys: Names, order: Names, flag: str, size: int = 5, needed: int = 4) -> DataFrame:
    """The rows from a file's ``size``-th on, with ``confirmed``; warm-up rows are dropped."""
    recent = _over(keys, order, size - 1)
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    hits = F.sum(F.col(flag).cast("int")).over(recent)
    return df.withColumn("confirmed", hits >= needed).withColumn("_row", row).where(F.col("_row") >= size).drop("_row")


def confirm_with_phase(df: DataFrame, keys: Names, order: Names, ratio: str, phase: str, limit: float, size: int = 5, needed: int = 4, least_concentration: float = 0.95) -> DataFrame:
    """Adds ``concentration`` (length of the mean unit vector of the phases) and ``confirmed``: enough ratios over ``limit`` in the same rows."""
    recent = _over(keys, order, size - 1)
    full = F.count(F.lit(1)).over(recent) == size
    concentration = F.hypot(F.avg(F.cos(phase)).over(recent), F.avg(F.sin(phase)).over(recent))
    hits = F.sum((F.col(ratio) > limit).cast("int")).over(recent)
    out = df.withColumn("concentration", F.when(full, concentration)).withColumn("_hits", hits)
    return out.withColumn("confirmed", F.when(full, (F.col("_hits") >= needed) & (F.col("concentration") >= least_concentration))).drop("_hits")


def four_faults(df: DataFrame, keys: Names, order: Names, ratio_limit: float = 1.1, phase_limit: float = 0.0, size: int = 5, needed: int = 4) -> DataFrame:
    """Status of bearing, misalignment, belt (flags) and imbalance (columns ratio and phase; NULL abstains).

    Imbalance is never confirmed: it is suspected, or to be inspected while misalignment is confirmed.
    """
    df = df.withColumn("imbalance", (F.col("ratio") >= ratio_limit) & (F.col("phase") >= phase_limit)).repartition(*keys)
    for fault in ("bearing", "misalignment", "belt", "imbalance"):
        df = votes(df, keys, order, fault, size, fault, dealt=True)
    unavailable = lambda x: F.col(x).isNull() | (F.col(f"{x}_valid") < size)
    enough = lambda x: F.col(f"{x}_positive") >= needed
    for fault in ("bearing", "misalignment", "belt"):
        df = df.withColumn(f"{fault}_status", F.when(unavailable(fault), "unavailable").when(enough(fault), "confirmed").otherwise("normal"))
    advisory = F.when(F.col("misalignment_status") == "confirmed", "inspection_required").otherwise("suspected")
    return df.withColumn("imbalance_status", F.when(unavailable("imbalance"), "unavailable").when(~enough("imbalance"), "normal").otherwise(advisory))


def advisory_status(ratio: Column, phase: Column, recent_votes: Column, misalignment_status: Column, ratio_limit: float = 1.1, phase_limit: float = 0.0, needed: int = 4) -> Column:
    """Imbalance status where the caller counts votes: the current window has to be positive too."""
    current = (ratio >= ratio_limit) & (phase >= phase_limit)
    advisory = F.when(misalignment_status == "confirmed", "inspection_required").otherwise("suspected")
    return F.when(ratio.isNull() | phase.isNull(), "unavailable").when(~current | (recent_votes < needed), "normal").otherwise(advisory)


def recurrence(df: DataFrame, keys: Names, flag: str, label: str, labels: Names, size: int = 20, block: int = 5, least_blocks: int = 3, least_hits: int = 5) -> DataFrame:
    """Rows of ``labels`` with a verdict, with ``recurs``: hits in ``least_blocks`` of the blocks of the last ``size`` windows.

    ``df`` has columns block and window.  Histories start anew after a gap (windows
    follow by one, or from a block to window 0 of the next), an abstention or a change
    of label; short histories give NULL.
    """
    order = ["block", "window"]
    w = Window.partitionBy(*keys).orderBy(*order)
    known = F.col(label).isin(*labels) & F.col(flag).isNotNull()
    was = lambda c: F.lag(c).over(w)
    follows = ((F.col("block") == was("block")) & (F.col("window") == was("window") + 1)) | ((F.col("block") == was("block") + 1) & (F.col("window") == 0))
    fresh = ~F.coalesce(known & was("_known") & follows & (F.col(label) == was(label)), F.lit(False))
    out = df.withColumn("_known", known).withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "_run").orderBy(*order)
    hit = F.col(flag).cast("int")
    blocks = [F.max(hit).over(run.rowsBetween(-i - block + 1, -i)) for i in range(0, size, block)]
    full = F.count(F.lit(1)).over(run.rowsBetween(1 - size, 0)) == size
    hits = F.sum(hit).over(run.rowsBetween(1 - size, 0))
    enough = (sum(blocks[1:], blocks[0]) >= least_blocks) & (hits >= least_hits)
    return out.withColumn("recurs", F.when(full, enough)).where("_known").drop("_known", "_fresh", "_run")


def drifted(df: DataFrame, keys: Names, order: Names, z: str, rows: int = 60, limit: float = 2.0) -> DataFrame:
    """Adds ``drift``: the mean of the last ``rows`` z values is over ``limit`` in size; NULL before there are so many."""
    recent = _over(keys, order, rows - 1)
    return df.withColumn("drift", F.when(F.count(z).over(recent) == rows, F.abs(F.avg(z).over(recent)) > limit))


def last_verdict(df: DataFrame, keys: Names, order: str, flag: str, label: str) -> DataFrame:
    """A row a key: its label and the verdict of its last window that has one (NULL if none has)."""
    return df.groupBy(*keys).agg(F.max(label).alias(label), F.expr(f"max_by({flag}, {order}) FILTER (WHERE {flag} IS NOT NULL)").alias("verdict"))


def first_confirmed(df: DataFrame, keys: Names, order: Names, confirmed: str) -> DataFrame:
    """A row a key: ``latency``, the number (from 1) of its first confirmed window; NULL if none is."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_row", row).groupBy(*keys).agg(F.min(F.when(F.col(confirmed), F.col("_row"))).cast("long").alias("latency"))


def transitions(df: DataFrame, keys: Names, order: Names, state: str) -> DataFrame:
    """Rows whose state differs from the one before, with ``previous``; a key's first row is one."""
    before = F.lag(state).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("previous", before).where(~F.col("previous").eqNullSafe(F.col(state)))
