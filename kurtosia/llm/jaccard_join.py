"""Exact Jaccard join of shingle sets by PartEnum signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCKS, MOST_COUNT, count_in_chunks, in_chunks, pack, unpack
from .components import connected_components, merged_components
from .hashing import WORD_BASE, U, mix, rolling, utf8_slices, window_hashes, word_hashes, words
from .scratch import Scratch

SETS = "doc_id {id}, n_shingles long, set_key binary, weight long, sketch array<long>, widest array<long>, needs array<int>, kept binary, shingles array<long>"
ENTRIES = "s long, x long, weight long, part long, needs array<int>, piece long"
WIDEST = 8
PIVOTS = 4
SKETCH_LONGS = 16
_INSTANCE = 40  # bits of a piece (first-level part) below the number of its instance


def shingle_sets(text: pa.ChunkedArray, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each document's shingles; with fewer words, of the whole sequence."""
    out = []
    for _, data, offs in utf8_slices(text):
        s, e, bounds = words(data, offs)
        h = word_hashes(data, s, e, lower=True)
        _, shingles = window_hashes(h, bounds, width)
        n = np.diff(bounds)
        cut = np.concatenate(([0], np.cumsum(np.maximum(n - width + 1, 0))))
        short = np.flatnonzero((n > 0) & (n < width))
        whole = mix(rolling(h, bounds[short], bounds[short + 1], WORD_BASE) + n[short].astype(U))
        few = dict(zip(short.tolist(), whole, strict=True))
        out += [np.array([few[i]], dtype=U) if i in few else np.unique(shingles[cut[i] : cut[i + 1]]) for i in range(len(n))]
    return out


def _budget(total, percent: int):
    """The most items in which two similar sets of ``total`` items together can differ."""
    return (100 - percent) * total // (100 + percent)


def _band_ends(percent: int, most: int) -> np.ndarray:
    """Last sizes of the bands, from 0: a band reaches as far as sets similar to its smallest size do."""
    ends = [0]
    while ends[-1] < most:
        ends.append((ends[-1] + 1) * 100 // percent)
    return np.array([*ends, (ends[-1] + 1) * 100 // percent], dtype=np.int64)


def signatures(sets: list[np.ndarray], percent: int) -> list[tuple[np.ndarray, ...]]:
    """PartEnum signatures of sets, in tables with a row per first-level part and a column per enumerated subset.

    Similar sets lie in one size band or in neighbouring ones, so a set enters the
    instance of its own band and that of the next.  An instance whose sets differ in
    at most k items cuts the feature domain into n1 parts and each part into n2
    pieces, so that two similar sets differ in at most k2 items of some part.  All
    subsets of n2 - k2 pieces of each part are enumerated; a signature is the hash of
    a set's items in one subset.  Some subset holds none of the k2 differences: similar
    sets share a signature.

    k up to 2: n1 = 1, k2 = k, n2 = 2k + 2.  Else k2 = 1, n2 = 3 and n1 = k/2 + 1 and k/5 + 1
    spare ones more.  A set whose partners are so small that they differ from it in
    at most k' < k items gives only the first parts, k - k' over two fewer: in what
    two similar sets both give, as many parts as ``sure`` differ in k2 items or fewer.
    Each table is (set of each row, signatures, whether a subset is empty, sure by row,
    and the row's instance and part as one number).
    """
    size = np.array([len(x) for x in sets], dtype=np.int64)
    ends = _band_ends(percent, int(size.max(initial=0)))
    band = np.searchsorted(ends, size)
    tables = []
    for up in (0, 1):
        last = ends[np.minimum(band + up, len(ends) - 1)]
        partner = np.minimum(size * 100 // percent, last)
        k = _budget(2 * last, percent)
        spoiled = np.where(k <= 2, k, 1)
        spare = np.where(k <= 2, 0, k // 5 + 1)
        parts = np.where(k <= 2, 1, k // 2 + 1 + spare)
        given = np.where(k <= 2, 1, _budget(size + partner, percent) // 2 + 1 + spare)
        takes_part = (size > 0) & ((partner > ends[band]) | (up == 0))
        for k2 in (0, 1, 2):
            for n2 in {2 * k2 + 2, 3 if k2 == 1 else 2 * k2 + 2}:
                at = np.flatnonzero(takes_part & (spoiled == k2) & (np.where(k <= 2, 2 * k + 2, 3) == n2))
                if not len(at):
                    continue
                n, n1 = size[at], parts[at]
                h = np.concatenate([sets[i] for i in at])
                own = np.repeat(np.arange(len(at)), n)
                cells = n1 * n2
                first = np.cumsum(cells) - cells
                flat = first[own] + (((h >> U(32)) * cells[own].astype(U)) >> U(32)).astype(np.int64)
                count = np.bincount(flat, minlength=int(cells.sum()))
                upto = np.concatenate((np.zeros(1, dtype=U), np.cumsum(mix(h), dtype=U)))
                end = np.cumsum(count)
                sums = (upto[end] - upto[end - count]).reshape(-1, n2)
                count = count.reshape(-1, n2)
                row_set = np.repeat(np.arange(len(at)), n1)
                part = np.arange(len(row_set)) - np.repeat(np.cumsum(n1) - n1, n1)
                first_parts = part < given[at][row_set]
                row_set, part, sums, count = row_set[first_parts], part[first_parts], sums[first_parts], count[first_parts]
                tag = mix(part.astype(U) * U(0x9E3779B97F4A7C15) + (band[at] + up).astype(U)[row_set] * U(0xC2B2AE3D27D4EB4F))
                subsets = list(combinations(range(n2), n2 - k2))
                sig = np.stack([mix(sums[:, kept].sum(axis=1, dtype=U) ^ (tag + U(q))) for q, kept in enumerate(subsets)], axis=1)
                empty = np.stack([count[:, kept].sum(axis=1) == 0 for kept in subsets], axis=1)
                tables.append((at[row_set], sig, empty, 1 + spare[at][row_set], (up << _INSTANCE) + part))
    return tables


def _all(tables) -> np.ndarray:
    return np.concatenate([table[1].ravel() for table in tables]) if tables else np.zeros(0, dtype=U)


def _by_set(tables, *columns: list[np.ndarray]) -> list[np.ndarray]:
    """The owners of all signatures, in order of sets, and the columns (a matrix for each table) in that order."""
    if not tables:
        return [np.zeros(0, dtype=np.int64), *[np.zeros(0, dtype=U) for _ in columns]]
    owner = np.concatenate([np.repeat(table[0], table[1].shape[1]) for table in tables])
    order = np.argsort(owner, kind="stable")
    return [owner[order], *[np.concatenate([m.ravel() for m in c])[order] for c in columns]]


def _wanted(tables, n_sets: int, short: Callable, distinct: np.ndarray, heard: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each table how often its signatures are heard, and which of them others may share.

    ``heard`` is how often each of the ``distinct`` signatures, made ``short``, occurs (1: nowhere else).
    A set shares a signature of ``sure`` parts at least with a similar one; where fewer
    parts have any that is heard twice, none is kept.  Bland signatures, of empty
    subsets or with a full count, go where a set can spare them: where fewer parts than
    ``sure`` have any, one at least of those shared with a similar set has none, and
    whichever signature of it is shared is kept by both.

    Also, by instance and set, in how many parts at least the set and a similar one keep
    a signature in common: ``sure``, less the parts of which the set gives up bland ones, or
    1 where it keeps them and the other may not.
    """
    counts, keep, needs = [], [], np.ones((2, n_sets), dtype=np.int32)
    for row_set, sig, empty, sure, piece in tables:
        c = heard[np.searchsorted(distinct, short(sig))]
        parts_with = lambda x: np.bincount(row_set, weights=x.any(axis=1), minlength=n_sets)[row_set]  # noqa: B023, E731
        bland = empty | (c >= MOST_COUNT)
        bad = parts_with(bland)
        enough, spared = parts_with(c > 1) >= sure, bad < sure
        needs[piece >> _INSTANCE, row_set] = np.where(spared, sure - bad, 1)
        counts.append(c)
        keep.append((c > 1) & enough[:, None] & ~(bland & spared[:, None]))
    return counts, keep, needs


def _sketch(items: np.ndarray) -> np.ndarray:
    """Parities of the items over 64 * SKETCH_LONGS cells: two sketches differ in no more cells than the sets in items."""
    odd = np.bincount((items % U(64 * SKETCH_LONGS)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _candidates(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """SETS: a row per document; all but the number of shingles only where another document may be similar."""
    chunked, plan = in_chunks(docs, id_col, text_col, scratch)

    def blocks(key, table):
        return pack(key[0].as_py(), np.unique(plan.short(_all(signatures(shingle_sets(table["text"], width), percent)))), plan)

    def select(table, replies):
        sets = shingle_sets(table["text"], width)
        tables = signatures(sets, percent)
        distinct, n = np.unique(plan.short(_all(tables)), return_counts=True)
        chunks = unpack(replies, distinct, plan).astype(np.int64)
        counts, keep, needs = _wanted(tables, len(sets), plan.short, distinct, np.where(chunks > 1, chunks, np.minimum(n, 2)))
        owner, sig, c, k = _by_set(tables, [x[1] for x in tables], counts, keep)
        bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
        rows = [[] for _ in range(7)]
        for i, known in enumerate(table["doc_id"].is_valid().to_pylist()):
            at = slice(bounds[i], bounds[i + 1])
            if known and k[at].any():
                own = np.flatnonzero(k[at])
                widest = own[np.argsort(-c[at][own], kind="stable")[:WIDEST]]
                row = (hashlib.md5(sets[i].tobytes()).digest(), int(1000 * c[at].mean()), _sketch(sets[i]), sig[at][widest].view(np.int64), needs[:, i], np.packbits(k[at]).tobytes(), sets[i].view(np.int64))
            else:
                row = (None,) * 7
            for column, value in zip(rows, row, strict=True):
                column.append(value)
        longs = pa.list_(pa.int64())
        columns = [pa.array(x, kind) for x, kind in zip(rows, (pa.binary(), pa.int64(), longs, longs, pa.list_(pa.int32()), pa.binary(), longs), strict=True)]
        names = ["doc_id", "n_shingles", "set_key", "weight", "sketch", "widest", "needs", "kept", "shingles"]
        return pa.Table.from_arrays([table["doc_id"], pa.array([len(x) for x in sets], pa.int64()), *columns], names=names)

    replies = count_in_chunks(chunked.groupBy("chunk").applyInArrow(blocks, BLOCKS), plan)
    schema = SETS.format(id=chunked.schema["doc_id"].dataType.simpleString())
    return chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(select, schema)


def _entries(sets: DataFrame, percent: int) -> DataFrame:
    """ENTRIES: a row for each kept signature of the sets (x, weight, part, needs, kept, shingles)."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                sets = [np.asarray(x.values).view(U) for x in b["shingles"]]
                tables = signatures(sets, percent)
                owner, sig, piece = _by_set(tables, [x[1] for x in tables], [np.broadcast_to(x[4][:, None], x[1].shape) for x in tables])
                n = np.bincount(owner, minlength=len(sets))
                keep = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), dtype=np.uint8), count=c) for m, c in zip(b["kept"], n, strict=True)]).astype(bool)
                of = owner[keep]
                columns = [b[c].take(pa.array(of)) for c in ("x", "weight", "part", "needs")]
                yield pa.RecordBatch.from_arrays([pa.array(sig[keep].view(np.int64)), *columns, pa.array(piece[keep].astype(np.int64))], ["s", "x", "weight", "part", "needs", "piece"])

    found = sets.select("x", "weight", "part", "needs", "kept", "shingles").mapInArrow(entries, ENTRIES)
    return found.withColumn("need", F.col("needs")[F.shiftright("piece", _INSTANCE).cast("int")]).drop("needs")


def _open(entries: DataFrame, part: str) -> DataFrame:
    """The entries (s, x, piece, need) that may be shared by similar sets of different components.

    Their signatures occur in two components, and the set has such ones in as many parts of an instance as it needs.
    """
    mixed = entries.groupBy("s").agg(F.min(part).alias("lo"), F.max(part).alias("hi")).where("lo < hi").select("s")
    left = entries.join(mixed, "s")
    instance = F.shiftright("piece", _INSTANCE)
    pieces = left.select("x", "piece", "need").distinct().groupBy("x", instance.alias("instance")).agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    enough = pieces.where("n >= need").select(F.col("x").alias("ex"), "instance")
    return left.join(enough, (F.col("x") == F.col("ex")) & (instance == F.col("instance")), "left_semi")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar.  Sketches rule out most others before sets are fetched."""
    small = lambda x: sets.select(F.col("x").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    apart = reduce(add, [F.bit_count(F.col("ka")[i].bitwiseXOR(F.col("kb")[i])) for i in range(SKETCH_LONGS)])
    near = pairs.join(small("a"), "a").join(small("b"), "b").where(apart * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b")
    side = lambda x: sets.select(F.col("x").alias(x), F.col("shingles").alias(f"s{x}"))
    common = F.size(F.array_intersect("sa", "sb"))
    return near.join(side("a"), "a").join(side("b"), "b").where((100 + percent) * common >= percent * (F.size("sa") + F.size("sb"))).select("a", "b")


def _with_pivots(entries: DataFrame) -> DataFrame:
    """The entries (s, x, weight, part, ...) that others share, with their pivots (weight, x, part): of each of PIVOTS classes by hash the one of most weight, the best first."""
    of = lambda c: F.max(F.when(F.pmod(F.xxhash64("x"), F.lit(PIVOTS)) == c, F.struct("weight", "x", "part")))
    top = entries.groupBy("s").agg(F.sort_array(F.array_compact(F.array(*[of(c) for c in range(PIVOTS)])), asc=False).alias("pivots"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return entries.drop("weight").join(top.select("s", "pivots"), "s")


def _compared(entries: DataFrame, most: int = PIVOTS) -> DataFrame:
    """(p, pw, x) once for each class and pivot of its entries that is in another component, ``most`` pivots of a signature."""
    pairs = entries.select("x", "part", F.explode(F.slice("pivots", 1, most)).alias("p")).where("p.part <> part")
    return pairs.select(F.col("p.x").alias("p"), F.col("p.weight").alias("pw"), "x").distinct()


def _shared_items(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, shared): the items of x that a member of another component holds too, where they are enough for a partner.

    All that similar sets have in common, ``percent`` hundredths of each at least, is among
    these.  A set is opened once here, however many pivots it has.
    """
    items = members.select("x", "xc").distinct().join(sets.select("x", "n", "shingles"), "x").select("x", "xc", "n", F.explode("shingles").alias("item"))
    shared = items.groupBy("item").agg(F.min("xc").alias("lo"), F.max("xc").alias("hi")).where("lo < hi").select("item")
    return items.join(shared, "item", "left_semi").groupBy("x", "n").agg(F.collect_list("item").alias("shared")).where(100 * F.size("shared") >= percent * F.col("n")).select("x", "shared")


def _close_within(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) that may be similar among the ``members`` (p, x, pc, xc, new) of each pivot p.

    Sets are held as their differences D from the pivot's set: x and y differ in
    |Dx| + |Dy| - 2 |Dx and Dy| items.  Where that needs no common difference, both are
    similar to p and joined already.  Otherwise they share one, and the first one in
    any order of the differences that all members use stands at places i and j with

        |Dy| <= |Dx| - 2i + budget(x, y)  and  |Dx| <= |Dy| - 2j + budget(x, y).

    The order puts items that p lacks first: those that no member of another component
    has, then rare ones.  Items of p come last, by their value: in sets far from p after so
    many others that they are not asked for.  One of the pair, say x, is not similar to
    p (|Dx| > budget(x, p)): so 2j < |Dy| + budget(y, .) - budget(p, .), about the rarer
    half of Dy, and i <= budget(x, y).

    Members that ``_shared_items`` shows to have no partner are left out.  Of the others only
    shared items are laid out by pivot: all others come first in the order, and a count places them.
    """
    members = scratch.save(members)
    members = members.join(scratch.save(_shared_items(members, sets, percent)), "x")
    px = members.join(sets.select(F.col("x").alias("p"), F.col("shingles").alias("sp")), "p").join(sets.select("x", F.col("shingles").alias("sx")), "x")
    size = lambda c: F.size(c).cast("long")
    own = px.select("p", "x", "xc", "new", (F.col("xc") != F.col("pc")).alias("apart"), size("sx").alias("n"), size("sp").alias("np"), F.size(F.array_except("sx", "sp")).alias("n_own"), F.array_except("shared", "sp").alias("own"), "sx", "sp")
    most = F.expr(f"{100 - percent} * (n + n * 100 div {percent}) div {100 + percent}")  # the budget of x and its largest partner
    asked = F.greatest(F.lit(0), most - F.col("n_own") + 1).cast("int")
    of_p = F.slice(F.array_sort(F.array_except("sp", "sx")), F.lit(1), asked)
    nd = 2 * F.col("n_own") + F.col("np") - F.col("n")  # what x has more, and what p has more
    deltas = scratch.save(own.select("p", "x", "xc", "new", "apart", "n", "np", nd.alias("nd"), "n_own", "own", of_p.alias("of_p"), most.alias("most")))
    slim = ["p", "x", "xc", "new", "apart", "n", "np", "nd"]
    each = deltas.select(*slim, "most", "n_own", F.explode("own").alias("item"))
    open_ = each.groupBy("p", "item").agg(F.count(F.lit(1)).alias("holders"), F.min("xc").alias("lo"), F.max("xc").alias("hi")).where("lo < hi").select("p", "item", "holders")
    mine = Window.partitionBy("p", "x")
    place = F.row_number().over(mine.orderBy("holders", "item")) - 1 + F.col("n_own") - F.count(F.lit(1)).over(mine)
    owned = each.join(open_, ["p", "item"]).withColumn("at", place).where("at <= most").select(*slim, "item", "at")
    lent = deltas.select(*slim, "n_own", F.posexplode("of_p").alias("i", "item")).withColumn("at", F.col("n_own") + F.col("i")).select(*slim, "item", "at")
    placed = scratch.save(owned.unionByName(lent))

    x, y = placed.where("apart").alias("x"), placed.where(f"2 * at * {100 + percent} < {100 + percent} * nd + {100 - percent} * (n - np)").alias("y")
    budget = F.floor((100 - percent) * (F.col("x.n") + F.col("y.n")) / (100 + percent))
    fits = (F.col("x.p") == F.col("y.p")) & (F.col("x.item") == F.col("y.item")) & (F.col("x.xc") != F.col("y.xc")) & (F.col("x.new") | F.col("y.new"))
    fits &= (F.col("y.nd") <= F.col("x.nd") - 2 * F.col("x.at") + budget) & (F.col("x.nd") <= F.col("y.nd") - 2 * F.col("y.at") + budget)
    return x.join(y, fits).select(F.least("x.x", "y.x").alias("a"), F.greatest("x.x", "y.x").alias("b")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` hundredths or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z in lower case; a set
    holds the distinct shingles of ``width`` words, or with fewer words the whole
    sequence.  The join is exact (``percent`` * union <= 100 * intersection):

    1. PartEnum signatures of all sets are counted over the corpus (see ``signatures``);
       a document that shares none has no partner and is done.
    2. Equal sets become one class.
    3. Pivots of a signature are PIVOTS of the classes that have it, those that share most
       with others.  Each class is compared with the best pivots of its WIDEST most
       common signatures.
    4. All signatures that classes of different components share are open.  Classes
       are compared with their pivots there: a number of pairs in proportion to signatures.
    5. Two similar classes share a signature and so its best pivot.  Those that are no
       pivots of it and not yet joined are found by ``_close_within``: differences from the
       pivot are matched by their rarest items, so that a group of near copies is never
       compared pair by pair.  Pairs that two pivots serve are left to the more popular
       one where its members are most of the other's.

    Result, a row for each input row: doc_id, n_shingles, component_id (the
    smallest id that links reach, itself included).  Null, empty and separator-only
    texts: no shingles, linked with nothing.  Rows with a null id keep a null
    component and link nothing; rows that repeat an id are one node.  Ids may be of
    any type that sorts.  Other columns are not looked at.
    """
    if not 1 <= percent <= 100 or width < 1:
        raise ValueError("percent must lie in 1..100 and width be positive")
    scratch = Scratch(docs.sparkSession, "jaccard")
    found = scratch.save(_candidates(docs, id_col, text_col, width, percent, scratch))
    shared = found.where("set_key is not null")
    classes = scratch.save(shared.groupBy("set_key").agg(F.min("doc_id").alias("class_id")).withColumn("x", F.monotonically_increasing_id()))
    first = classes.select("set_key", F.col("class_id").alias("doc_id"), "x")
    sets = scratch.save(shared.join(first, ["doc_id", "set_key"]).dropDuplicates(["doc_id", "set_key"]).select("x", "weight", F.col("n_shingles").alias("n"), "sketch", "widest", "needs", "kept", "shingles"))
    alone = found.where("set_key is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("x"))
    rows = scratch.save(alone.unionByName(shared.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "x"), "set_key").drop("set_key")))
    scratch.drop(found)

    # rows that repeat an id tie the classes of their texts
    tied = rows.where("x is not null").groupBy("doc_id").agg(F.min("x").alias("a"), F.max("x").alias("z")).where("a <> z")
    tied = rows.join(tied, "doc_id").where("x is not null and a <> x").select("a", F.col("x").alias("b"))

    def named(rows: DataFrame, x: str) -> DataFrame:
        """``rows`` with the component of x as <x>c."""
        labels = parts.select(F.col("id").alias(x), F.col("component").alias(f"{x}c"))
        return rows.join(labels, x, "left").withColumn(f"{x}c", F.coalesce(f"{x}c", x))

    pairs = lambda rows: rows.select(F.col("p").alias("a"), F.col("x").alias("b"))
    wide = scratch.save(_compared(_with_pivots(sets.select(F.explode("widest").alias("s"), "x", "weight", F.col("x").alias("part"))), 1))
    best = wide.groupBy("x").agg(F.max(F.struct("pw", "p")).alias("best")).select("best.p", "x")
    parts = connected_components(scratch.save(_linked(pairs(best), sets, percent).unionByName(tied)), scratch)
    parts = merged_components(parts, _linked(pairs(named(named(wide, "x"), "p").where("pc <> xc")), sets, percent), scratch)

    signed = _entries(named(sets, "x").withColumnRenamed("xc", "part"), percent)
    entries = scratch.save(_with_pivots(scratch.save(_open(signed, "part"))))
    parts = merged_components(parts, _linked(pairs(scratch.save(_compared(entries))), sets, percent), scratch)

    best = entries.select("s", "x", "piece", "need", F.col("pivots")[0]["x"].alias("p"), F.col("pivots")[0]["weight"].alias("pw"), F.exists("pivots", lambda v: v["x"] == F.col("x")).alias("is_pivot"))
    members = scratch.save(best.select("p", "pw", "x").distinct())
    rest = best.where("not is_pivot").drop("is_pivot")  # pivots are compared with all that share their signatures
    live = scratch.save(_open(named(rest, "x"), "xc"))
    live = scratch.save(_open(live, "xc"))
    held = scratch.save(named(live.select("p", "pw", "x", "xc").distinct(), "p"))
    first = members.groupBy("x").agg(F.max(F.struct("pw", "p")).alias("first"))
    homes = held.join(first, "x").where(F.col("first") > F.struct("pw", "p")).groupBy("p", F.col("first.p").alias("home")).agg(F.count(F.lit(1)).alias("n"))
    homes = homes.groupBy("p").agg(F.max(F.struct("n", "home")).alias("top")).select("p", "top.home")
    served = held.join(homes, "p").join(members.select(F.col("p").alias("home"), "x"), ["home", "x"]).select("p", "x", F.lit(False).alias("new"))
    held = scratch.save(held.join(served, ["p", "x"], "left").select("p", "x", "pc", "xc", F.coalesce("new", F.lit(True)).alias("new")))
    fresh = live.select("s", "p", "x").join(held, ["p", "x"])
    asked = fresh.groupBy("s").agg(F.min("xc").alias("lo"), F.max("xc").alias("hi"), F.max("new").alias("new")).where("lo < hi and new")
    active = held.join(fresh.join(asked.select("s"), "s").select("p", "x").distinct(), ["p", "x"])
    parts = merged_components(parts, _linked(_close_within(active, sets, percent, scratch), sets, percent), scratch)

    classes = classes.join(parts, F.col("x") == F.col("id"), "left").select("x", "class_id", F.coalesce("component", "x").alias("part"))
    least = classes.groupBy("part").agg(F.min("class_id").alias("component_id"))
    of_x = classes.join(least, "part").select("x", "component_id")
    of_id = rows.where("x is not null").join(of_x, "x").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    return rows.select("doc_id", "n_shingles").join(of_id, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce(own, "doc_id").alias("component_id"))


def op7(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL
), link AS (
    SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), e AS (
    SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), r(a, b) AS (
    SELECT DISTINCT a, a FROM e
    UNION
    SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (
    SELECT a, min(b) AS m FROM r GROUP BY a
)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.m, documents.doc_id) AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN c ON c.a = documents.doc_id
"""
