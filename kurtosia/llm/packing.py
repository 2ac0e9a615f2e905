"""Bounded-space online packing of tokenised documents into training windows."""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LENGTH = 1024
OPEN_WINDOWS = 64
LEAST_CUT = 16
MERGED_PARTITIONS = 16
END_ID = 0
PIECES = "doc_id {id}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, merge_group long"

_TWO_SPACES = re.compile(r"\s\s")
#: Runs of white space, as the pattern's engine knows it, that are too long for its look-ahead.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
_encoders: dict[str, tuple] = {}


def encoder(ranks_path: str = RANKS):
    """text -> ids of the byte-level BPE in the ranks file; special strings are ordinary text.

    The pattern's look-ahead only matters in runs of white space; texts without
    any use the pattern without it, which a faster engine runs.  A long run is cut out
    first, by the pattern's own rule: all of it but the last character, or all of it
    at the end of a text, is one piece.
    """
    import tiktoken

    if ranks_path not in _encoders:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = public_tokenizers.PATTERN
        make = lambda p: tiktoken.Encoding("bpe", pat_str=p, mergeable_ranks=ranks, special_tokens={})
        simple = pattern.replace(r"\s+(?!\S)|\s+", r"\s+")
        _encoders[ranks_path] = (make(pattern), make(simple) if simple != pattern else make(pattern))
    full, fast = _encoders[ranks_path]


    def encode(text: str) -> list[int]:
        if not _TWO_SPACES.search(text):
            return fast.encode_ordinary(text)
        ids, at = [], 0
        for run in _LONG_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += full.encode_ordinary(text[at : run.start()])
            ids += fast.encode_ordinary(text[run.start() : end])
            at = end
        return ids + full.encode_ordinary(text[at:])

    return encode


def document_encoder(ranks_path: str = RANKS, tokenizer_path: str = TOKENIZER):
    """text -> ids as ``tokenizers`` gives by default: texts are split at the file's added tokens, which have their own ids."""
    encode = encoder(ranks_path)
    with open(tokenizer_path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    if not added:
        return encode
    split = re.compile("(%s)" % "|".join(map(re.escape, sorted(added, key=len, reverse=True))))

    def ids(text: str) -> list[int]:
        parts = split.split(text)
        if len(parts) == 1:
            return encode(text)
        return [i for at, part in enumerate(parts) for i in ([added[part]] if at % 2 else encode(part))]

    return ids


class Packer:
    """Keeps at most ``most`` open windows; pieces go where they leave the least room.

    When a piece fits nowhere and no window may be opened, its head fills the
    fullest window, if that has room for LEAST_CUT ids, and that window is
    emitted.  ``closed`` holds (sequence, [(offset, piece, from, to)]) of emitted windows.
    """

    def __init__(self, length: int, most: int, first_sequence: int):
        self.length, self.most, self.next = length, most, first_sequence
        self.room: list[tuple[int, int]] = []  # (free ids, sequence), sorted
        self.open: dict[int, list] = {}
        self.closed: list[tuple[int, list]] = []

    def add(self, piece, n: int) -> None:
        at = 0
        while n - at >= self.length:
            self._emit(self._new(), [(0, piece, at, at + self.length)])
            at += self.length
        while at < n:
            i = bisect_left(self.room, (n - at, -1))
            if i < len(self.room):
                at = self._put(i, piece, at, n)
            elif len(self.room) < self.most:
                sequence = self._new()
                insort(self.room, (self.length, sequence))
                self.open[sequence] = []
            else:
                free = self.room[0][0]
                if free >= LEAST_CUT:
                    at = self._put(0, piece, at, at + free)
                else:
                    self._emit(self.room.pop(0)[1])

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _emit(self, sequence: int, content: list | None = None) -> None:
        self.closed.append((sequence, content if content is not None else self.open.pop(sequence)))

    def _put(self, i: int, piece, at: int, to: int) -> int:
        free, sequence = self.room.pop(i)
        self.open[sequence].append((self.length - free, piece, at, to))
        if free == to - at:
            self._emit(sequence)
        else:
            insort(self.room, (free - (to - at), sequence))
        return to

    def take_closed(self) -> list[tuple[int, list]]:
        out, self.closed = self.closed, []
        return out

    def leftovers(self) -> list:
        return [x for _, sequence in self.room for x in self.open[sequence]]

    def finish(self) -> list[tuple[int, list]]:
        """Closes all: the open windows' pieces, cut freely, fill windows to the end; at most one is part full."""
        rest = sorted(self.leftovers(), key=lambda x: x[2] - x[3])
        self.room, self.open = [], {}
        content, used = [], 0
        for _, piece, at, to in rest:
            while at < to:
                n = min(to - at, self.length - used)
                content.append((used, piece, at, at + n))
                at, used = at + n, used + n
                if used == self.length:
                    self._emit(self._new(), content)
                    content, used = [], 0
        if content:
            self._emit(self._new(), content)
        return self.take_closed()


class _Piece:
    """Ids of a document from ``start`` on."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, ids: np.ndarray, start: int, total: int):
        self.doc, self.ids, self.start, self.total = doc, ids, start, total


def _rows(windows: list[tuple[int | None, list]], keep_ids: bool, group: int | None, types: dict) -> pa.RecordBatch:
    cols: dict[str, list] = {k: [] for k in types}
    for sequence, content in windows:
        for offset, p, a, b in content:
            raw = p.ids[a:b].tobytes()
            for k, v in zip(types, (p.doc, p.start + a, b - a, raw if keep_ids else None, zlib.crc32(raw), p.total, sequence, offset, group), strict=True):
                cols[k].append(v)
    return pa.RecordBatch.from_pydict({k: pa.array(v, types[k]) for k, v in cols.items()})


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_path: str = RANKS,
    length: int = LENGTH,
    open_windows: int = OPEN_WINDOWS,
    keep_ids: bool = False,
) -> DataFrame:
    """Packs all documents, each with END_ID after its ids, into windows of at most ``length`` ids.

    Each input partition packs online with ``open_windows`` open windows (see
    ``Packer``).  What its open windows hold in the end, a bounded number of ids, is
    merged: the leftovers of MERGED_PARTITIONS partitions are packed again in one
    task, the last windows by cutting freely.  Windows are padded by fewer than
    LEAST_CUT ids, but for one a merge.

    Result, a row for each piece: doc_id, start (its document's ids before it),
    length, ids (little-endian unsigned 32-bit, where ``keep_ids``), ids_crc32,
    doc_tokens, sequence_id, offset.  Null and empty texts are documents of one
    id.  Null and repeated document ids are kept as they are, each row packed by
    itself.  Other columns are not looked at.  An empty table gives no pieces.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = PIECES.format(id=id_type)
    spark = docs.sparkSession

    def arrow_types(batch: pa.RecordBatch) -> dict:
        n = pa.int64()
        return {"doc_id": batch.schema.field("doc_id").type, "start": n, "length": n, "ids": pa.binary(), "ids_crc32": n, "doc_tokens": n, "sequence_id": n, "offset": n, "merge_group": n}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, partition, types = document_encoder(ranks_path), TaskContext.get().partitionId(), None
        packer = Packer(length, open_windows, partition << 33)
        for batch in batches:
            types = types or arrow_types(batch)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                    packer.add(_Piece(doc, ids, 0, len(ids)), len(ids))
                yield _rows(packer.take_closed(), keep_ids, None, types)
        if types:
            yield _rows([(None, packer.leftovers())], True, partition // MERGED_PARTITIONS, types)

    def merge(key, table):
        types = arrow_types(table)
        packer = Packer(length, open_windows, (1 << 62) + (key[0].as_py() << 33))
        rows = sorted(table.select(["length", "doc_id", "start", "ids", "doc_tokens"]).to_pylist(), key=lambda r: (-r["length"], zlib.crc32(r["ids"])))
        for r in rows:
            packer.add(_Piece(r["doc_id"], np.frombuffer(r["ids"], dtype="<u4"), r["start"], r["doc_tokens"]), r["length"])
        return pa.Table.from_batches([_rows(packer.take_closed() + packer.finish(), keep_ids, None, types)])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    placed = Scratch(spark, "packing").save(slim.mapInArrow(pack, schema))
    merged = placed.where("merge_group is not null").groupBy("merge_group").applyInArrow(merge, schema)
    out = placed.where("merge_group is null").unionByName(merged).drop("merge_group")
    return out if keep_ids else out.drop("ids")


def op3(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
