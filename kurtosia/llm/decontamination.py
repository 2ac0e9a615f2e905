"""Benchmark decontamination: pigeonhole pieces and Myers' bit-parallel edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed in an item: one in so many of its characters.
CHARACTERS_PER_EDIT = 20
#: Items are searched for in blocks of so many characters, so that a task's automaton stays small.
BLOCK_CHARACTERS = 4 << 20
HITS = "doc_id {id}, item_id {item}, distance int, item_chars int, start int, end int"

_SPACE = re.compile(r"\s+")


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space, trimmed."""
    return _SPACE.sub(" ", text or "").strip().lower()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget+1 pieces of nearly equal length; one of them survives ``budget`` edits."""
    n = budget + 1
    cut = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def best_match(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end in text) of the substring of ``text`` nearest to ``item``, if within ``budget``.

    Myers' bit-vector algorithm with one Python integer as the column; the first end of least distance counts.
    """
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, now, best, end = mask, 0, m, budget + 1, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if now < best:
            best, end = now, j
            if not best:
                break
    return (best, end) if best <= budget else None


class Finder:
    """Finds the items of one block of a benchmark in texts."""

    def __init__(self, items: list[tuple], characters_per_edit: int):
        self.items = []
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            budget = len(text) // characters_per_edit
            for at, piece in pieces(text, budget):
                where.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, text, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple]:
        """(item_id, distance, item length, start, end) of each item in the text, at its best place.

        Places are in the normal form of the text.  Piece hits at nearby diagonals
        are one candidate region, as wide as the budget asks, and searched once.
        """
        text = normal(text)
        if not self.items or not text:
            return []
        spots: dict[int, list[int]] = {}
        for end, (n, places) in self.automaton.iter(text):
            for item, at in places:
                spots.setdefault(item, []).append(end + 1 - n - at)
        out = []
        for item, begins in spots.items():
            item_id, want, budget = self.items[item]
            found = self._verify(want, budget, text, sorted(set(begins)))
            if found:
                out.append((item_id, found[0], len(want), found[1], found[2]))
        return out

    @staticmethod
    def _verify(want: str, budget: int, text: str, begins: list[int]) -> tuple[int, int, int] | None:
        for b in begins:
            if b >= 0 and text.startswith(want, b):
                return 0, b, b + len(want)
        best, i = None, 0
        while i < len(begins):
            lo = hi = begins[i]
            while i < len(begins) and begins[i] <= hi + 2 * budget:
                hi = begins[i]
                i += 1
            lo = max(0, lo - budget)
            region = text[lo : hi + len(want) + budget]
            found = best_match(want, region, budget)
            if found and (best is None or found[0] < best[0]):
                end = lo + found[1]
                back = best_match(want[::-1], text[max(0, end - len(want) - budget) : end][::-1], budget)
                best = (found[0], end - back[1] if back else max(0, end - len(want)), end)
        return best


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", characters_per_edit: int = CHARACTERS_PER_EDIT
) -> DataFrame:
    """Every pair of a document and a benchmark item that the document holds, up to a few edits.

    Texts and items are compared in lower case with single spaces.  An item of n
    characters may differ by k = n // ``characters_per_edit`` edits.  Cut into k+1
    pieces, one piece at least is left exact in every such place; an automaton finds
    all pieces of all items in one walk over the whole text, and Myers' algorithm
    measures the distance around each hit.

    The benchmark is searched in blocks of BLOCK_CHARACTERS, a pass over the
    documents each, so no task holds more of it, however large it is.

    Result, a row for each pair: doc_id, item_id, distance, item_chars, and start and
    end of the best place in the document's normal form.  Null and empty texts and
    items match nothing.  Rows that repeat an id, and repeated items, give a row each.
    Other columns are not looked at.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null and trim(text) <> ''")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = HITS.format(id=docs.schema[id_col].dataType.simpleString(), item=benchmark.schema[item_col].dataType.simpleString())
    out = None
    for block in _blocks(items):
        hits = slim.mapInArrow(_search(block, characters_per_edit), schema)
        out = hits if out is None else out.unionByName(hits)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", characters_per_edit: int = CHARACTERS_PER_EDIT
) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item (see ``contaminated``); nothing is joined or shuffled."""
    items = benchmark.select(F.lit(0).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null and trim(text) <> ''")
    for block in _blocks(items):
        docs = docs.where(~F.pandas_udf(_holds(block, characters_per_edit), "boolean")(F.col(text_col).cast("string")))
    return docs


def _holds(items: list[tuple], characters_per_edit: int):
    finders: list[Finder] = []

    def holds(texts):
        if not finders:
            finders.append(Finder(items, characters_per_edit))
        return texts.map(lambda x: bool(finders[0](x))).astype("bool")

    return holds


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks; the driver holds one partition of them at a time."""
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= BLOCK_CHARACTERS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(items: list[tuple], characters_per_edit: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(items, characters_per_edit)
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    for hit in find(text):
                        for col, v in zip(rows, (doc, *hit), strict=True):
                            col.append(v)
            if rows[0]:
                types = (b.schema.field("doc_id").type, None, *[pa.int32()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["doc_id", "item_id", "distance", "item_chars", "start", "end"])

    return search


def op5(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
