"""Approximate nearest neighbours: an NN-descent graph, built by Spark joins, and greedy search in it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

NEIGHBOURS = 32
REVERSE = 32
FIRST_CANDIDATES, CANDIDATES = 5, 10
SETTLED = 0.01
CELL = 256
POOL, POOL_A_DOUBLING = 128, 8
BEAM = 32
NODES = "id long, code binary"
FOUND = "x long, y long, score float"
EDGE = "struct<score:float,id:long,new:boolean>"


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): rows with an id and a vector of finite numbers, not all zero; of a repeated id the least vector.

    Vectors of another length than most have no cosine with them and take no part.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where("id is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    usual = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    return rows.join(F.broadcast(usual.select("d")), F.size("vec") == F.col("d"), "left_semi").groupBy("id").agg(F.min("vec").alias("vec"))


def distinct_vectors(vectors: DataFrame, most: int) -> DataFrame:
    """(id, vec, ids): each distinct vector once, with its smallest id and its ``most`` smallest ids in order.

    Spark applies the limit before it shuffles, so copies of a common vector load no task.
    """
    rank = F.row_number().over(Window.partitionBy("hash", "vec").orderBy("id"))
    least = vectors.withColumn("hash", F.xxhash64("vec")).withColumn("rank", rank).where(F.col("rank") <= most)
    return least.groupBy("hash", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("id"), "vec", "ids")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows from codes."""
    codes = [np.frombuffer(x.as_py(), dtype=np.int16) for x in column]
    m = np.stack(codes).astype(np.float32) if codes else np.zeros((0, 1), dtype=np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def encoded(vectors: DataFrame) -> DataFrame:
    """NODES: directions in two bytes a component, which is all that the graph is built from."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = []
            for v in b["vec"]:
                v = np.array(v.as_py())
                codes.append(np.rint(v / np.abs(v).max() * 32767).astype(np.int16).tobytes())
            yield pa.RecordBatch.from_pydict({"id": b["id"], "code": pa.array(codes, pa.binary())})

    return vectors.mapInArrow(encode, NODES)


def _best(score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``most`` largest entries of each row above -2."""
    most = min(most, score.shape[1])
    top = np.argpartition(-score, most - 1, axis=1)[:, :most]
    i, j = np.nonzero(np.take_along_axis(score, top, 1) > -2)
    return i, top[i, j]


def _batch(x: list, y: list, s: list) -> pa.RecordBatch:
    flat = lambda a, t: np.concatenate(a).astype(t) if a else np.zeros(0, dtype=t)
    return pa.RecordBatch.from_pydict({"x": flat(x, np.int64), "y": flat(y, np.int64), "score": flat(s, np.float32)})


def _first_neighbours(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """FOUND: the nearest in cells of random hyperplanes; cells over CELL nodes are dealt out by a hash."""
    bits = max(0, int(np.log2(max(n, 1) / (CELL / 2))))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b["code"])
            planes = np.random.default_rng(seed).standard_normal((m.shape[1], bits))
            cell = ((m @ planes > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(m), dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"id": b["id"], "code": b["code"], "cell": pa.array(cell)})

    celled = nodes.mapInArrow(cells, f"{NODES}, cell long")
    parts = celled.groupBy("cell").count().select("cell", F.ceil(F.col("count") / CELL).alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts"))
    groups = celled.join(parts, "cell").groupBy("cell", part.alias("part")).agg(F.collect_list(F.struct("id", "code")).alias("members"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, s = [], [], []
            for members in b["members"]:
                flat = members.values
                if len(flat) > 1:
                    ids, m = np.array(flat.field("id")), _matrix(flat.field("code"))
                    score = m @ m.T
                    np.fill_diagonal(score, -3)
                    i, j = _best(score, NEIGHBOURS)
                    x.append(ids[i]), y.append(ids[j]), s.append(score[i, j])
            yield _batch(x, y, s)

    return groups.mapInArrow(nearest, FOUND)


def _lists(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """A graph (id, code, near): the NEIGHBOURS best distinct entries of (x, y, score, new), best first."""
    once = found.groupBy("x", "y").agg(F.max("score").alias("score"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("score"), "y"))
    best = once.withColumn("rank", rank).where(F.col("rank") <= NEIGHBOURS)
    lists = best.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("score", F.col("y").alias("id"), "new")), asc=False).alias("near"))
    return nodes.join(lists, F.col("id") == F.col("x"), "left").select("id", "code", F.coalesce("near", F.expr(f"cast(array() as array<{EDGE}>)")).alias("near"))


def _joined_neighbours(graph: DataFrame, most: int, seed: int) -> DataFrame:
    """FOUND: for each node the pairs among its neighbours, forward and reverse, at least one of them new.

    A pair counts for the end whose list it would enter, ``most`` for an end and node.
    Reverse neighbours of hubs are drawn at random, REVERSE a round; Spark applies
    that limit before it shuffles.
    """
    edges = graph.select("id", F.explode("near").alias("e")).select("id", F.col("e.id").alias("to"), F.col("e.new").alias("new"))
    draw = F.row_number().over(Window.partitionBy("to").orderBy(F.xxhash64("id", "to", F.lit(seed))))
    back = edges.withColumn("rank", draw).where(F.col("rank") <= REVERSE).select(F.col("to").alias("pivot"), F.col("id").alias("member"), "new")
    around = edges.select(F.col("id").alias("pivot"), F.col("to").alias("member"), "new").unionByName(back).groupBy("pivot", "member").agg(F.max("new").alias("new"))
    worst = F.when(F.size("near") >= NEIGHBOURS, F.element_at("near", -1)["score"]).otherwise(F.lit(-2.0).cast("float"))
    known = graph.select(F.col("id").alias("member"), "code", worst.alias("worst"))
    groups = around.join(known, "member").groupBy("pivot").agg(F.collect_list(F.struct("member", "new", "code", "worst")).alias("members"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, s = [], [], []
            for members in b["members"]:
                flat = members.values
                new = np.array(flat.field("new"))
                if len(new) < 2 or not new.any():
                    continue
                ids, m, least = np.array(flat.field("member")), _matrix(flat.field("code")), np.array(flat.field("worst"))
                score = m @ m.T
                score[~(new[:, None] | new[None, :]) | (score <= least[:, None])] = -3
                np.fill_diagonal(score, -3)
                i, j = _best(score, most)
                x.append(ids[i]), y.append(ids[j]), s.append(score[i, j])
            yield _batch(x, y, s)

    return groups.select("members").mapInArrow(pairs, FOUND)


def build_graph(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, code, near) of every node, by NN-descent.

    Lists start from two random partitions of space.  Each round brings the
    neighbours of a node together, compares those that are not yet known to each
    other, and keeps the best; it ends when under SETTLED of the entries are new.
    """
    n = nodes.count()
    start = _first_neighbours(nodes, n, 1).unionByName(_first_neighbours(nodes, n, 2)).withColumn("new", F.lit(True))
    graph = scratch.save(_lists(start, nodes))
    for k in count() if n > NEIGHBOURS + 1 else ():
        found = _joined_neighbours(graph, CANDIDATES if k else FIRST_CANDIDATES, k).withColumn("new", F.lit(True))
        old = graph.select(F.col("id").alias("x"), F.explode("near").alias("e")).select("x", F.col("e.id").alias("y"), F.col("e.score").alias("score"), F.lit(False).alias("new"))
        fresh = F.sum(F.size(F.filter("near", lambda e: e["new"])))
        after, seen = scratch.measure(_lists(old.unionByName(found), nodes), fresh=fresh, edges=F.sum(F.size("near")))
        scratch.drop(graph)
        graph = after
        if (seen["fresh"] or 0) <= SETTLED * (seen["edges"] or 0):
            break
    return graph


def search_graph(graph: DataFrame, queries: DataFrame, scratch: Scratch, most: int = POOL) -> DataFrame:
    """(query_id, id): the ``most`` best nodes that greedy search finds for queries (query_id, code, start).

    A step expands, for each query, the BEAM best nodes of its pool that have not been
    expanded, scores their neighbours and keeps the best; it ends when no pool
    has any left.  Queries do not meet themselves.
    """
    entry = "struct<score:float,id:long,done:boolean>"
    empty = F.expr(f"cast(array() as array<{entry}>)")
    pools = queries.select("query_id", F.col("code").alias("query"), empty.alias("pool"), "start")
    links = graph.select("id", F.transform("near", lambda e: e["id"]).alias("to"))
    codes = graph.select("id", "code")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q, query, pool, found in zip(b["query_id"].to_pylist(), b["query"].to_pylist(), b["pool"].to_pylist(), b["found"], strict=True):
                pool = {e["id"]: (e["score"], e["done"]) for e in pool}
                flat = found.values
                if flat is not None and len(flat):
                    unit = np.frombuffer(query, dtype=np.int16).astype(np.float32)
                    scores = _matrix(flat.field("code")) @ (unit / np.linalg.norm(unit))
                    for i, s in zip(flat.field("id").to_pylist(), scores.tolist(), strict=True):
                        pool.setdefault(i, (s, False))
                best = sorted(pool.items(), key=lambda e: (-e[1][0], e[0]))[:most]
                ahead = [i for i, (_, done) in best if not done][:BEAM]
                now = set(ahead)
                out.append((q, query, [{"score": s, "id": i, "done": done or i in now} for i, (s, done) in best], ahead))
            kind = pa.list_(pa.struct({"score": pa.float32(), "id": pa.int64(), "done": pa.bool_()}))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), kind, pa.list_(pa.int64())), strict=True)], ["query_id", "query", "pool", "ahead"])

    found, before = pools.select("query_id", F.explode("start").alias("id")), None
    while True:
        near = found.where("id <> query_id").distinct().join(codes, "id").groupBy("query_id").agg(F.collect_list(F.struct("id", "code")).alias("found"))
        none = F.expr("cast(array() as array<struct<id:long,code:binary>>)")
        stepped = pools.select("query_id", "query", "pool").join(near, "query_id", "left").withColumn("found", F.coalesce("found", none))
        pools, seen = scratch.measure(stepped.mapInArrow(step, f"query_id long, query binary, pool array<{entry}>, ahead array<long>"), left=F.sum(F.size("ahead")))
        if before:
            scratch.drop(before)
        before = pools
        if not seen["left"]:
            break
        found = pools.select("query_id", F.explode("ahead").alias("id")).join(links, "id").select("query_id", F.explode("to").alias("id"))
    return pools.select("query_id", F.explode("pool").alias("e")).select("query_id", F.col("e.id").alias("id"))


def nearest(classes: DataFrame, graph: DataFrame, of: DataFrame, k: int, scratch: Scratch, most: int = POOL) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each id of ``of`` (query_id, class), by exact cosine.

    Distinct vectors are searched once, and of those found the ids follow; the k + 1
    best classes hold the k + 1 best ids, of which at most one is the query itself.
    """
    start = F.transform("near", lambda e: e["id"]).alias("start")
    asked = of.select(F.col("class").alias("query_id")).distinct()
    queries = graph.join(asked, F.col("id") == F.col("query_id"), "left_semi").select(F.col("id").alias("query_id"), "code", start)
    pairs = search_graph(graph, queries, scratch, most).unionByName(asked.select("query_id", F.col("query_id").alias("id")))
    left = classes.select(F.col("id").alias("query_id"), F.col("vec").alias("ua"))
    right = classes.select("id", F.col("vec").alias("ub"), "ids")
    scored = pairs.join(left, "query_id").join(right, "id").select("query_id", "id", "ids", F.pandas_udf(exact_cosine, "double")(F.col("ua"), F.col("ub")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    each = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("id")))
    found = best.groupBy(F.col("query_id").alias("class")).agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k + 1).alias("found"))
    others = F.slice(F.filter("found", lambda e: e["id"] != F.col("query_id")), 1, k)
    rows = of.join(found, "class").select("query_id", F.posexplode(others).alias("at", "e"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("id"), (-F.col("e.less")).alias("score"))


def exact_cosine(a, b):
    """Row by row in double precision; components are scaled first, so that no square overflows or vanishes."""
    if not len(a):
        return a.__class__([], index=a.index, dtype="float64")
    x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (np.stack(a.to_numpy()), np.stack(b.to_numpy())))
    dot = lambda p, q: np.einsum("ij,ij->i", p, q)
    return a.__class__(dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)), index=a.index)


def nearest_neighbours(table: DataFrame, of: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of the rows for which ``of`` (over ``id``) holds.

    The graph indexes every distinct vector once (see ``build_graph``); queries start at their own
    neighbours in it and search greedily.  Scores are exact cosines in double
    precision; ties go to the smaller id, however many rows share a vector.  Null, zero and non-finite vectors, and null ids,
    take no part (see ``valid_vectors``).  With fewer candidates than k all are
    returned; an empty table gives no rows.  Other columns are not looked at.
    """
    scratch = Scratch(table.sparkSession, "nn-descent")
    vectors = scratch.save(valid_vectors(table, id_col, vec_col))
    classes, seen = scratch.measure(distinct_vectors(vectors, k + 1))
    of_class = vectors.where(of).select(F.col("id").alias("query_id"), "vec").join(classes.select(F.col("id").alias("class"), "vec"), "vec")
    asked = scratch.save(of_class.select("query_id", "class"))
    nodes = scratch.save(encoded(classes.select("id", "vec")))
    graph = build_graph(nodes, scratch)
    return nearest(classes, graph, asked, k, scratch, max(POOL, POOL_A_DOUBLING * seen["n"].bit_length()))


def op1(spark, sf_dir: str) -> DataFrame:
    found = nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
