"""Isolation forests: how soon random cuts part a row from a sample of the others."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

Names = Sequence[str]
NODES = "tree int, node int, feature int, cut double, below int, above int, length double"


def average_length(n: int) -> float:
    """The mean path length of an unsuccessful search in a binary search tree of ``n`` rows."""
    if n < 2:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grown(x: np.ndarray, seed: int, tree: int) -> list[tuple]:
    """Nodes (node, feature, cut, below, above, length) of one tree; a leaf has feature -1.

    Each node cuts a feature that varies in it, drawn evenly, at a point drawn evenly between
    its extremes: rows below the cut go one way.  Trees end at the depth that balanced ones of
    as many rows have; a leaf of several rows adds the mean length of a tree of them.
    """
    rng = np.random.default_rng([seed, tree])
    most = math.ceil(math.log2(max(len(x), 2)))
    nodes, queue = [None], [(0, np.arange(len(x)), 0)]
    while queue:
        at, rows, depth = queue.pop(0)
        part = x[rows]
        varying = np.flatnonzero(part.min(axis=0) < part.max(axis=0)) if len(rows) > 1 else []
        if depth >= most or not len(varying):
            nodes[at] = (at, -1, 0.0, -1, -1, depth + average_length(len(rows)))
            continue
        f = int(varying[rng.integers(len(varying))])
        lo, hi = part[:, f].min(), part[:, f].max()
        cut = lo + rng.random() * (hi - lo)
        cut = cut if lo < cut <= hi else hi  # both sides hold a row
        below = part[:, f] < cut
        nodes[at] = (at, f, float(cut), len(nodes), len(nodes) + 1, 0.0)
        queue += [(len(nodes), rows[below], depth + 1), (len(nodes) + 1, rows[~below], depth + 1)]
        nodes += [None, None]
    return nodes


def _mixed(key: np.ndarray, tree: int) -> np.ndarray:
    """A place of 52 bits for each key, another for each tree."""
    h = key ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(12)


def fit(df: DataFrame, ids: Names, features: Names, trees: int = 100, sample: int = 256, seed: int = 1) -> DataFrame:
    """NODES of ``trees`` trees, each grown on the ``sample`` rows of least hash of tree and ``ids``.

    Who is in a sample depends on ids alone, not on partitions; a row passes to a tree's task only if
    its hash lies under a bound that about ``sample`` rows pass, and all rows where there
    are few.  Rows that share ids or lack a finite feature take no part beyond the first.
    """
    finite = [F.col(f).cast("double").isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) < math.inf) for f in features]
    rows = df.select(F.struct(*ids).alias("_id"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"), *[ok.alias(f"_ok{i}") for i, ok in enumerate(finite)])
    rows = rows.where(" and ".join(f"_ok{i}" for i in range(len(features)))).select("_id", "_x")
    n = rows.agg(F.approx_count_distinct("_id", 0.02)).first()[0]
    # ten standard deviations and 100 over the expected number: far more than the count of ids and chance may err
    share = min(1.0, (sample + 10 * math.sqrt(sample) + 100) / max(n, 1))
    bound = np.uint64(int(share * 0xFFFFFFFFFFFFF))  # of places of 52 bits

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b["_k"].to_numpy(zero_copy_only=False).view(np.uint64)
            for t in range(trees):
                place = _mixed(key, t)
                at = np.flatnonzero(place <= bound)
                if len(at):
                    chosen = [b[c].take(pa.array(at)) for c in ("_id", "_x")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, dtype=np.int32)), pa.array(place[at].astype(np.int64)), *chosen], names=["tree", "_h", "_id", "_x"])

    schema = StructType([StructField("tree", IntegerType()), StructField("_h", LongType()), rows.schema["_id"], rows.schema["_x"]])
    dealt = rows.withColumn("_k", F.xxhash64("_id", F.lit(seed))).mapInArrow(draw, schema)
    dealt = dealt.groupBy("tree", "_h", "_id").agg(F.min("_x").alias("_x"))
    w = Window.partitionBy("tree").orderBy("_h", "_id")
    chosen = dealt.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= sample).select("tree", "_n", "_x")

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        tree = table["tree"][0].as_py()
        nodes = grown(np.array(table["_x"].to_pylist()), seed, tree)
        columns = [pa.array([v[i] for v in nodes], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64()))]
        names = ["tree", "node", "feature", "cut", "below", "above", "length"]
        return pa.Table.from_arrays([pa.array([tree] * len(nodes), pa.int32()), *columns], names=names)

    return chosen.groupBy("tree").applyInArrow(grow, NODES)


def _walkable(nodes: list[tuple]) -> tuple:
    """(feature, cut, children by twos, length, depth) of a tree whose leaves lead to themselves."""
    feature, cut, below, above, length = (np.array(c) for c in zip(*nodes, strict=True))
    leaf, own = feature < 0, np.arange(len(feature))
    children = np.stack([np.where(leaf, own, below), np.where(leaf, own, above)], axis=1)
    depth, level = 0, np.array([0])
    while not leaf[level].all():
        level, depth = np.unique(children[level]), depth + 1
    return np.where(leaf, 0, feature), cut, children.ravel(), length, depth


def score(df: DataFrame, forest: DataFrame, features: Names, sample: int = 256, out: str = "anomaly") -> DataFrame:
    """Adds ``out``: 2 ** -(mean path length / mean length for ``sample`` rows), near 1 for outliers; NULL where a feature is missing or not finite.

    The forest has trees times 2 * ``sample`` nodes at most, whatever the input, and goes to the tasks as it is.
    """
    trees: dict[int, list] = {}
    for r in forest.orderBy("tree", "node").collect():
        trees.setdefault(r["tree"], []).append((r["feature"], r["cut"], r["below"], r["above"], r["length"]))
    built = [_walkable(nodes) for _, nodes in sorted(trees.items())]
    norm = average_length(sample) or 1.0
    names = [f"_feature{i}" for i in range(len(features))]
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b[c].to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)
            known = np.isfinite(x).all(axis=1)
            x = x[known]
            total, flat = np.zeros(len(x)), x.ravel()
            row = np.arange(len(x)) * len(names)
            for feature, cut, children, length, depth in built:
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(depth):
                    at = children[2 * at + (flat[row + feature[at]] >= cut[at])]
                total += length[at]
            value = np.full(b.num_rows, np.nan)
            value[known] = 2.0 ** (-total / max(len(built), 1) / norm)
            kept = [b[c] for c in df_columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(value, mask=~known)], names=[*df_columns, out])

    df_columns = df.columns
    return df.select("*", *[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)]).mapInArrow(run, schema)
