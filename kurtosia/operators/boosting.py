"""Trees grown level by level from histograms: gradient boosting, and forests of extremely random trees.

Features are cut into bins once, and rows are kept in blocks: a block is one row of packed numbers,
so that a pass hands no single rows to the tasks.  Each level of all trees of a round is one pass: tasks add up
gradients by (tree, node, feature, bin), the sums are merged by one aggregation, and the best cut
of each node is chosen by windows over bins.  Only these cuts reach the driver, at most two to the
depth for each tree.  Gradients are whole numbers of 1 / SCALE, so sums do not depend on
the order of rows, and a fit is the same in any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .settling import settled

Names = Sequence[str]
SCALE = 1 << 24  # sums of 2 ** 38 rows' gradients fit in a long
KEPT_ROUNDS = 10  # rounds after which scores are written, so that tasks walk no more trees than these


@dataclass
class Tree:
    """A tree as a heap: node i leads to 2i + 1 where the bin of ``feature`` is at most ``cut``, else to 2i + 2; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int, outputs: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros((n, outputs)))

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after as many levels, or the leaf that it reached before."""
        at, row = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[row, f] > self.cut[at]), at)
        return at


@dataclass
class Ensemble:
    """``start`` plus what trees add (boosting: a list of one tree an output for each round), or the mean of trees."""

    loss: str
    edges: list[list[float]]
    depth: int
    start: np.ndarray
    low: float = 0.0
    width: float = 1.0
    rounds: list[list[Tree]] = field(default_factory=list)

    def raw(self, bins: np.ndarray, rounds: list[list[Tree]], start: np.ndarray) -> np.ndarray:
        out = np.array(np.broadcast_to(start, (len(bins), len(self.start))))
        for trees in rounds:
            for k, tree in enumerate(trees):
                value = tree.value[tree.places(bins, self.depth)]
                if self.loss == "forest":
                    out += value
                else:
                    out[:, k] += value[:, 0]
        return out

    def told(self, bins: np.ndarray) -> np.ndarray:
        """What the model says of rows: a share for each class, or one number."""
        raw = self.raw(bins, self.rounds, self.start)
        if self.loss == "classes":
            return _shares(raw)
        return raw / max(len(self.rounds), 1) if self.loss == "forest" else self.low + self.width * raw


def _shares(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def even_edges(df: DataFrame, features: Names, bins: int = 32) -> list[list[float]]:
    """Inner borders of ``bins`` bins of one width between the extremes of each feature; none where it has no finite value."""
    x = {f: F.col(f).cast("double") for f in features}
    finite = {f: F.when(F.abs(c) < math.inf, c) for f, c in x.items()}
    row = df.agg(*[g(c).alias(f"{n}{i}") for i, c in enumerate(finite.values()) for n, g in (("lo", F.min), ("hi", F.max))]).first()
    spans = [(row[f"lo{i}"], row[f"hi{i}"]) for i in range(len(features))]
    return [[lo + (hi - lo) * j / bins for j in range(1, bins)] if lo is not None and lo < hi else [] for lo, hi in spans]


def ranked_edges(df: DataFrame, features: Names, bins: int = 32, accuracy: int = 10000) -> list[list[float]]:
    """Inner borders at even ranks of each feature, by one mergeable sketch; its borders may vary a little with the partitioning."""
    ranks = [i / bins for i in range(1, bins)]
    finite = [F.when(F.abs(F.col(f).cast("double")) < math.inf, F.col(f).cast("double")) for f in features]
    row = df.agg(*[F.percentile_approx(c, ranks, accuracy).alias(f"e{i}") for i, c in enumerate(finite)]).first()
    return [sorted(set(row[f"e{i}"] or [])) for i in range(len(features))]


def _bins(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin 0 holds what is missing; a value lies in bin 1 + the number of edges up to it."""
    out = np.empty(x.shape, dtype=np.int64)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(np.asarray(e), x[:, f], side="right"))
    return out


def _values(b: pa.RecordBatch, n: int) -> np.ndarray:
    """The rows' features (``_feature<i>``) as a matrix; nulls are NaN."""
    return np.stack([b[f"_feature{i}"].to_numpy(zero_copy_only=False).astype(float) for i in range(n)], axis=1)


def _with_features(df: DataFrame, features: Names) -> list[Column]:
    return [F.col(f).cast("double").alias(f"_feature{i}") for i, f in enumerate(features)]


BLOCKS = "_y binary, _w binary, _b binary, _f binary, _n binary"
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]
_LOW = 26  # bits of the lower part of a whole number that is added up in two


def _packed(blocks: Sequence[Block], kind: type) -> pa.RecordBatch:
    held = [[y.astype(np.float64).tobytes(), w.astype(np.int64).tobytes(), bins.astype(kind).tobytes(), None if f is None else f.astype(np.float64).tobytes(), None if n is None else n.astype(np.int64).tobytes()] for y, w, bins, f, n in blocks]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*held, strict=True)], names=["_y", "_w", "_b", "_f", "_n"])


def _blocks(batches: Iterator[pa.RecordBatch], edges: list[list[float]]) -> Iterator[Block]:
    """(_y, _w, bins, scores or None, how many rows each stands for or None) of each block."""
    for batch in batches:
        for y, w, bins, f, times in zip(*[batch[c] for c in ("_y", "_w", "_b", "_f", "_n")], strict=True):
            n = len(y.as_buffer()) // 8
            scores = np.frombuffer(f.as_buffer(), np.float64).reshape(n, -1) if f.is_valid else None
            yield np.frombuffer(y.as_buffer(), np.float64), np.frombuffer(w.as_buffer(), np.int64), np.frombuffer(bins.as_buffer(), _kind(edges)).astype(np.int64).reshape(n, -1), scores, np.frombuffer(times.as_buffer(), np.int64) if times.is_valid else None


def _kind(edges: list[list[float]]) -> type:
    """The smallest type that holds every bin."""
    return np.uint8 if _sizes(edges)[1] <= 256 else np.int32


def _binned(rows: DataFrame, edges: list[list[float]]) -> DataFrame:
    """BLOCKS of rows (_y, _w, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y, w = (b[c].to_numpy(zero_copy_only=False) for c in ("_y", "_w"))
                yield _packed([(y, w, _bins(_values(b, len(edges)), edges), None, None)], _kind(edges))

    return rows.mapInArrow(run, BLOCKS)


def _merged(rows: DataFrame, edges: list[list[float]]) -> DataFrame:
    """BLOCKS of rows (_y, _w, features) in which rows of equal label, weight and bins are one that counts as many: their number is bounded by that of cells, however long the table."""
    kind, n_features = _kind(edges), len(edges)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = np.ascontiguousarray(_bins(_values(b, n_features), edges).astype(kind))
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * held.itemsize * n_features
            code = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(held)])
            yield pa.RecordBatch.from_arrays([b["_y"], b["_w"], code], names=["_y", "_w", "_b"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y, w, n = (b[c].to_numpy(zero_copy_only=False) for c in ("_y", "_w", "_n"))
                bins = np.frombuffer(b"".join(b["_b"].to_pylist()), kind).reshape(len(y), n_features)
                yield _packed([(y, w, bins, None, n)], kind)

    cells = rows.mapInArrow(coded, "_y double, _w long, _b binary").groupBy("_y", "_w", "_b").agg(F.count(F.lit(1)).alias("_n"))
    return cells.mapInArrow(packed, BLOCKS)


def _spread(df: DataFrame) -> DataFrame:
    """The table that every level reads again: dealt once to all cores where the input has fewer splits than these."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return settled(df.repartition(cores) if df.rdd.getNumPartitions() < cores else df)


def _sums(cell: np.ndarray, column: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by cell, exact beyond what a double holds."""
    low, high = (np.bincount(cell, weights=x, minlength=size).astype(np.int64) for x in (column & ((1 << _LOW) - 1), column >> _LOW))
    return (high << _LOW) + low


def _level(rows: DataFrame, trees: list[Tree], level: int, edges: list[list[float]], outputs: int, targets: Callable) -> DataFrame:
    """Sums g0.., h and n by (tree, node, feature, bin) over the rows in nodes of one level."""
    n_features, n_bins = _sizes(edges)
    first, nodes = 2**level - 1, 2**level
    names = [*[f"g{k}" for k in range(outputs)], "h", "n"]
    shape = (len(trees), len(names), n_features, nodes * n_bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape, dtype=np.int64)
        for y, w, bins, scores, times in _blocks(batches, edges):
            g, h = targets(y, w, bins, scores)  # (trees or 1, outputs, rows) and (trees or 1, rows) of whole numbers
            weights = np.concatenate([g, h[:, None]], axis=1)
            weights = weights.astype(float) if times is None else weights * times
            for t, tree in enumerate(trees):
                at = tree.places(bins, level) - first
                here = slice(None) if level == 0 else np.flatnonzero(at >= 0)  # rows of leaves above stay behind
                own = weights[t if len(weights) > 1 else 0][:, here]
                for f in range(n_features):
                    cell = at[here] * n_bins + bins[here, f]
                    for i, column in enumerate(own):
                        sums[t, i, f] += np.bincount(cell, weights=column, minlength=shape[3]).astype(np.int64) if times is None else _sums(cell, column, shape[3])
                    sums[t, -1, f] += np.bincount(cell, minlength=shape[3]) if times is None else _sums(cell, times[here], shape[3])
        tree_of, feature, cell = np.nonzero(sums[:, -1])
        if len(cell):
            keys = [tree_of, cell // n_bins + first, feature, cell % n_bins]
            yield pa.RecordBatch.from_arrays([*[pa.array(k.astype(np.int32)) for k in keys], *[pa.array(sums[tree_of, i, feature, cell]) for i in range(len(names))]], names=["tree", "node", "feature", "bin", *names])

    parts = rows.mapInArrow(run, "tree int, node int, feature int, bin int, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(n).alias(n) for n in names])


def _drawn(tree: Column, node: Column, feature: Column, *more: object) -> Column:
    """A number below 2 ** 32 that only tree, node, feature and ``more`` decide."""
    text = F.concat_ws(":", *[F.lit(str(m)) for m in more], tree.cast("string"), node.cast("string"), feature.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _splits(sums: DataFrame, outputs: int, penalty: float, least_rows: int, least_gain: float, random: tuple | None = None) -> list:
    """The best cut of each node (tree, node), with the sums of the node and of its lower side; ``best`` is NULL for leaves.

    The gain of a cut is the sum over outputs of g^2 / (h + penalty) of both sides, less that of the
    node.  Ties go to the first feature, then to the lowest bin.  ``random`` (seed, number of
    features): each feature has one cut, drawn evenly between the lowest and the highest bin that
    the node holds, and only so many of the features that vary in it are looked at.
    """
    names = [*[f"g{k}" for k in range(outputs)], "h", "n"]
    within = Window.partitionBy("tree", "node", "feature")
    upto = within.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sums.select("tree", "node", "feature", "bin", *[F.sum(n).over(upto).alias(f"l_{n}") for n in names], *[F.sum(n).over(within).alias(n) for n in names], F.lead("bin").over(within.orderBy("bin")).alias("next"), F.min("bin").over(within).alias("lo"), F.max("bin").over(within).alias("hi"))
    part = lambda g, h: (g.cast("double") / SCALE) * (g.cast("double") / SCALE) / (h.cast("double") / SCALE + penalty)
    each = lambda of: sum((of(f"g{k}") for k in range(1, outputs)), of("g0"))
    left = each(lambda g: part(F.col(f"l_{g}"), F.col("l_h")))
    right = each(lambda g: part(F.col(g) - F.col(f"l_{g}"), F.col("h") - F.col("l_h")))
    gain = left + right - each(lambda g: part(F.col(g), F.col("h")))
    may = F.col("next").isNotNull() & (F.col("l_n") >= least_rows) & (F.col("n") - F.col("l_n") >= least_rows) & (F.col("l_h") > 0) & (F.col("h") > F.col("l_h"))
    if random:
        seed, looked_at = random
        key = [F.col(c) for c in ("tree", "node", "feature")]
        cut = F.col("lo") + _drawn(*key, seed, "cut") % (F.col("hi") - F.col("lo"))
        rows = rows.withColumn("cut", F.when(F.col("hi") > F.col("lo"), cut))
        order = Window.partitionBy("tree", "node").orderBy(F.col("cut").isNull(), _drawn(*key, seed, "feature"), "feature")
        rows = rows.withColumn("place", F.dense_rank().over(order))
        may &= (F.col("cut") >= F.col("bin")) & (F.col("cut") < F.col("next")) & (F.col("place") <= looked_at)
    else:
        rows = rows.withColumn("cut", F.col("bin"))
    rows = rows.withColumn("gain", F.when(may, gain))
    told = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("cut")).alias("c"), *[f"l_{n}" for n in names])
    return rows.groupBy("tree", "node").agg(F.max(F.when(F.col("gain") > least_gain, told)).alias("best"), *[F.max(n).alias(n) for n in names]).collect()


def _grown(rows: DataFrame, trees: list[Tree], depth: int, edges: list[list[float]], outputs: int, targets: Callable, value: Callable, **choice) -> None:
    """Grows all trees to ``depth``, a pass for each level."""
    names = [f"g{k}" for k in range(outputs)]
    for level in range(depth):
        alive = False
        for r in _splits(_level(rows, trees, level, edges, outputs, targets), outputs, **choice):
            tree, node, best = trees[r["tree"]], r["node"], r["best"]
            total = np.array([r[n] for n in names], dtype=float)
            if level == 0:
                tree.value[node] = value(total, r["h"])
            if best is not None:
                alive = True
                lower = np.array([best[f"l_{n}"] for n in names], dtype=float)
                tree.feature[node], tree.cut[node] = -best["f"], -best["c"]
                tree.value[2 * node + 1] = value(lower, best["l_h"])
                tree.value[2 * node + 2] = value(total - lower, r["h"] - best["l_h"])
        if not alive:
            return


def _sizes(edges: list[list[float]]) -> tuple[int, int]:
    return len(edges), max((len(e) for e in edges), default=0) + 2


def boosted(df: DataFrame, label: str, features: Names, edges: list[list[float]], loss: str = "squares", rounds: int = 20, depth: int = 3, rate: float = 0.1, penalty: float = 1.0, least_rows: int = 20, least_gain: float = 1e-9) -> Ensemble:
    """Gradient boosting of ``label``: ``squares`` of a number, or ``classes`` 0, 1, ... by the softmax of one tree a class and round.

    Rows without a finite label take no part.  A missing feature lies below all others.  A table
    without rows, or of one value, gives a model without trees that tells that value (0 if none).
    """
    if loss not in ("squares", "classes"):
        raise ValueError("loss is squares or classes")
    y = F.col(label).cast("double")
    known = df.where(F.abs(y) < math.inf)
    stats = known.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    low, width = (stats["lo"] or 0.0, (stats["hi"] - stats["lo"]) or 1.0) if stats["n"] else (0.0, 1.0)
    if loss == "classes":
        counts = {int(r["y"]): r["n"] for r in known.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
        outputs = max(counts, default=0) + 1
        start = np.log([max(counts.get(k, 0), 1) / max(stats["n"], 1) for k in range(outputs)])
        target = y
    else:
        target = (y - low) / width
        total = known.agg(F.sum(F.floor(target * SCALE + 0.5)).alias("s")).first()["s"]
        outputs, start = 1, np.array([(total or 0) / max(stats["n"], 1) / SCALE])
    model = Ensemble(loss, edges, depth, start, low if loss == "squares" else 0.0, width if loss == "squares" else 1.0)
    if not stats["n"] or stats["lo"] == stats["hi"]:
        return model
    rows = _spread(_binned(known.select(target.alias("_y"), F.lit(SCALE).cast("long").alias("_w"), *_with_features(df, features)), edges))
    value = lambda g, h: -rate * (g / SCALE) / (h / SCALE + penalty)
    written = 0
    for r in range(rounds):
        fresh = model.rounds[written:]

        def targets(y: np.ndarray, w: np.ndarray, bins: np.ndarray, scores: np.ndarray | None, fresh=fresh) -> tuple[np.ndarray, np.ndarray]:
            f = model.raw(bins, fresh, start if scores is None else scores)
            if loss == "squares":
                g, h = f[:, 0] - y, np.ones(len(y))
                return np.floor(g * SCALE + 0.5)[None, None].astype(np.int64), (h * SCALE)[None].astype(np.int64)
            p = _shares(f)
            g, h = p - (y[:, None] == np.arange(outputs)), p * (1 - p)
            return np.floor(g.T * SCALE + 0.5)[:, None].astype(np.int64), np.floor(h.T * SCALE + 0.5).astype(np.int64)

        trees = [Tree.empty(depth, 1) for _ in range(outputs)]
        _grown(rows, trees, depth, edges, 1, targets, value, penalty=penalty, least_rows=least_rows, least_gain=least_gain)
        model.rounds.append(trees)
        if all(tree.feature[0] < 0 for tree in trees):
            break
        if len(model.rounds) - written == KEPT_ROUNDS and r + 1 < rounds:
            fresh = model.rounds[written:]

            def scored(batches: Iterator[pa.RecordBatch], fresh=fresh) -> Iterator[pa.RecordBatch]:
                for y, w, bins, scores, times in _blocks(batches, edges):
                    yield _packed([(y, w, bins, model.raw(bins, fresh, start if scores is None else scores), times)], _kind(edges))

            rows, written = settled(rows.mapInArrow(scored, rows.schema)), len(model.rounds)
    return model


def extra_trees(df: DataFrame, label: str, features: Names, edges: list[list[float]], trees: int = 20, depth: int = 6, share: float = 0.7, least_rows: int = 1, balanced: bool = True, seed: int = 1) -> Ensemble:
    """A forest on all rows for classes 0, 1, ...: each node cuts, of a ``share`` of its varying features, the one whose random cut is purest.

    Cuts fall between bins.  ``balanced`` rows weigh as much as their class is rare.  Rows without a
    finite label take no part; a missing feature lies below all others.
    """
    y = F.col(label).cast("double")
    known = df.where(F.abs(y) < math.inf)
    counts = {int(r["y"]): r["n"] for r in known.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    outputs, n = max(counts, default=0) + 1, sum(counts.values())
    model = Ensemble("forest", edges, depth, np.zeros(outputs))
    if not n:
        return model
    weight = {k: (n / (len(counts) * c) if balanced else 1.0) for k, c in counts.items()}
    w = F.coalesce(*[F.when(y == k, F.lit(round(v * SCALE))) for k, v in weight.items()]).cast("long")
    rows = settled(_merged(known.select(y.alias("_y"), w.alias("_w"), *_with_features(df, features)), edges))

    def targets(y: np.ndarray, w: np.ndarray, bins: np.ndarray, scores: None) -> tuple[np.ndarray, np.ndarray]:
        return np.where(y == np.arange(outputs)[:, None], w, 0)[None], w[None]

    grown = [Tree.empty(depth, outputs) for _ in range(trees)]
    _grown(rows, grown, depth, edges, outputs, targets, lambda g, h: g / h, penalty=0.0, least_rows=least_rows, least_gain=1e-9, random=(seed, max(1, math.ceil(share * len(features)))))
    model.rounds = [[tree] for tree in grown]
    return model


def predicted(df: DataFrame, model: Ensemble, features: Names, out: str = "predicted") -> DataFrame:
    """Adds ``out``: an array of the classes' shares, or for squares of one number."""
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))])
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = model.told(_bins(_values(b, len(features)), model.edges))
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * told.shape[1])
            yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], pa.ListArray.from_arrays(offsets, pa.array(told.ravel()))], names=[*kept, out])

    return df.select("*", *_with_features(df, features)).mapInArrow(run, schema)
