"""Substring deduplication: Rabin-Karp hashes of every word window, counted in Spark."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCKS, count_in_chunks, decode, in_chunks, pack, unpack
from .hashing import U, kept_texts, mix, other_window_hashes, utf8_slices, window_hashes, word_hashes, words
from .scratch import Scratch

RESULT = "doc_id {id}, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"


def _windows(text: pa.ChunkedArray, window: int):
    for row, data, offs in utf8_slices(text):
        s, e, bounds = words(data, offs)
        of_words = word_hashes(data, s, e)
        begin, h = window_hashes(of_words, bounds, window)
        yield row, data, s, e, bounds, begin, h, mix(h ^ other_window_hashes(of_words, begin, window))


def _member(h: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Whether each hash is among the sorted chosen ones; a bitmap of the top 20 bits spares most searches."""
    out = np.zeros(len(h), dtype=bool)
    if len(chosen):
        near = np.zeros(1 << 20, dtype=bool)
        near[chosen >> U(44)] = True
        at = np.flatnonzero(near[h >> U(44)])
        i = np.searchsorted(chosen, h[at])
        i[i == len(chosen)] = 0
        out[at] = chosen[i] == h[at]
    return out


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Words that stand in a window of ``window`` words whose word sequence starts elsewhere too, and the texts without them.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged.  Every window of
    one document is hashed (64 bits, rolling); Spark counts the hashes of the
    whole corpus.  The words of repeated windows merge into maximal intervals.
    Windows are judged on the input alone: the first occurrence goes as well.

    Result, a row for each input row: doc_id, n_words, n_removed, ``removed``
    (word intervals, end exclusive) and ``kept_text`` (kept words joined by a space).
    Null and empty texts, and texts of separators alone: 0 words, empty kept text.
    Texts with fewer words than ``window`` lose nothing.  Rows with a null or
    repeated id are texts like all others.  Other columns are not looked at.

    Windows whose hash occurs again are only candidates: they are counted once more by
    a hash that joins the first one with a second of another kind, 128 bits in all.
    """
    if window < 1:
        raise ValueError("window must be positive")
    chunked, plan = in_chunks(docs, id_col, text_col, Scratch(docs.sparkSession, "substrings"))
    flat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, dtype=U)

    exact = replace(plan, dropped_bits=0)

    def again(hashes: np.ndarray, replies) -> np.ndarray:
        """The sorted short hashes that occur more than once."""
        h, n = np.unique(plan.short(hashes), return_counts=True)
        return h[(n > 1) | (unpack(replies, h, plan) > 1)]

    def surely_again(hashes: np.ndarray, repeated) -> np.ndarray:
        """The sorted whole hashes that occur more than once."""
        h, n = np.unique(hashes, return_counts=True)
        return np.unique(np.concatenate([h[n > 1], *[decode(x.as_py()) for x in repeated["payload"]]]))

    def blocks(key, table):
        return pack(key[0].as_py(), np.unique(plan.short(flat([x[-2] for x in _windows(table["text"], window)]))), plan)

    def candidates(key, table, replies):
        if not replies.num_rows and not table.num_rows:
            return pack(0, np.zeros(0, dtype=U), exact)
        slices = [(x[-2], x[-1]) for x in _windows(table["text"], window)]
        first, both = flat([x[0] for x in slices]), flat([x[1] for x in slices])
        return pack(key[0].as_py(), np.unique(both[_member(plan.short(first), again(first, replies))]), exact)

    def cut(table, repeated):
        slices = list(_windows(table["text"], window))
        twice = surely_again(flat([x[-1] for x in slices]), repeated)
        out: list[list] = [[], [], [], []]
        for _, data, s, e, bounds, begin, _, hashes in slices:
            change = np.zeros(len(s) + 1, dtype=np.int64)
            hit = begin[_member(hashes, twice)]
            np.add.at(change, hit, 1)
            np.subtract.at(change, hit + window, 1)
            gone = np.cumsum(change)[:-1] > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            out[0].append(np.diff(bounds))
            out[1].append(total[bounds[1:]] - total[bounds[:-1]])
            out[2].extend(_intervals(gone, bounds))
            out[3].append(kept_texts(data, s, e, bounds, ~gone))
        longs = lambda x: pa.array(np.concatenate(x).astype(np.int64)) if x else pa.array([], pa.int64())
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_words": longs(out[0]),
                "n_removed": longs(out[1]),
                "removed": pa.array(out[2], pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()}))),
                "kept_text": pa.chunked_array(out[3], pa.large_string()).cast(pa.string()),
            }
        )

    replies = count_in_chunks(chunked.groupBy("chunk").applyInArrow(blocks, BLOCKS), plan)
    checked = chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(candidates, BLOCKS)
    schema = RESULT.format(id=chunked.schema["doc_id"].dataType.simpleString())
    return chunked.groupBy("chunk").cogroup(count_in_chunks(checked, exact, repeated=True).groupBy("chunk")).applyInArrow(cut, schema)


def _intervals(gone: np.ndarray, bounds: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
    if gone.any():
        first = np.zeros(len(gone) + 1, dtype=bool)
        first[bounds] = True
        start = np.flatnonzero(gone & (first[:-1] | ~np.concatenate(([False], gone[:-1]))))
        end = np.flatnonzero(gone & (first[1:] | ~np.concatenate((gone[1:], [False])))) + 1
        doc = np.searchsorted(bounds, start, side="right") - 1
        for d, a, b in zip(doc.tolist(), (start - bounds[doc]).tolist(), (end - bounds[doc]).tolist(), strict=True):
            out[d].append({"start": a, "end": b})
    return out


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4(spark, sf_dir: str) -> DataFrame:
    return digest(repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE_SQL = r"""
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
    SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w)
), dup AS (
    SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)
), gone AS (
    SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM dup)
), lost AS (
    SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ps, j)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id
"""
