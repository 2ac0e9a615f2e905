"""Connected components by rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); the component is its smallest id.

    Large-star and small-star rounds: each id hooks its neighbours to the smallest
    id near it until nothing changes, in a number of rounds that grows with the
    logarithm of a component's length.  Minima are combined before the shuffle and
    hubs sit on the side of a join that Spark can split.  Nulls and loops link nothing.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    before, state = None, None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        down = large.where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        e, now = scratch.measure(small.unionByName(low.withColumnRenamed("low", "b")).where("a <> b").distinct(), h=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        if before:
            scratch.drop(before)
        before = e
        if state == now:
            break
        state = now
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def merged_components(parts: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``parts`` (id, component), joined further by ``links`` (a, b) between ids in or out of it."""
    of = lambda x: parts.select(F.col("id").alias(x), F.col("component").alias(f"{x}c"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b"))
    named, seen = scratch.measure(named.where("a <> b").distinct())
    if not seen["n"]:
        return parts
    more = connected_components(named, scratch)
    moved = parts.join(more.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return scratch.save(moved.unionByName(more.join(parts.select("id"), "id", "left_anti")))
