"""How the words of sources differ: counts by chunk factorization, and exact divergences."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import utf8_slices
from .scratch import Scratch

LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_BYTES = 10 << 20
BLOCK_DOCUMENTS = 1 << 16
BUCKET_BYTES = 8 << 20
SCALE = 1_000_000_000
LEAST_DOCUMENTS = 10
TOP = 10
ENTRIES = "lang_id long, key string, docs binary, counts binary"
COUNTS = "lang_id long, group_id long, term string, n long"


@dataclass(frozen=True)
class Entries:
    """For each (language, key): numbers of documents that hold the key, and its occurrences by (language, source) group.

    ``docs`` and ``counts`` (group, occurrences) are flat; ``n_docs`` and ``n_counts`` say how many each entry has.
    """

    lang: np.ndarray
    key: pa.Array
    docs: np.ndarray
    n_docs: np.ndarray
    counts: np.ndarray
    n_counts: np.ndarray

    def table(self) -> pa.RecordBatch:
        def packed(values: np.ndarray, n: np.ndarray, width: int) -> pa.Array:
            offsets = np.concatenate(([0], np.cumsum(n * width))).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])

        return pa.RecordBatch.from_arrays([pa.array(self.lang), self.key, packed(self.docs, self.n_docs, 8), packed(self.counts, self.n_counts, 16)], ["lang_id", "key", "docs", "counts"])


def entries_of(table: pa.Table) -> Entries:
    def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        parts = [memoryview(c.buffers()[2])[_at(c, 0) : _at(c, len(c))] for c in column.chunks if len(c)]
        return np.frombuffer(b"".join(parts), dtype=np.int64), pc.binary_length(column).to_numpy().astype(np.int64) // 8

    docs, n_docs = flat(table["docs"])
    counts, n_counts = flat(table["counts"])
    key = table["key"].combine_chunks()
    return Entries(table["lang_id"].to_numpy(), key, docs, n_docs, counts.reshape(-1, 2), n_counts // 2)


def _at(c: pa.Array, i: int) -> int:
    """Where value i of a binary array begins."""
    return int(np.frombuffer(c.buffers()[1], dtype=np.int32, count=1, offset=4 * (c.offset + i))[0])


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    d = column.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Whether each place begins a new combination of the sorted keys."""
    out = np.ones(len(sorted_keys[0]), dtype=bool)
    out[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return out


def merged(x: Entries, least: int) -> Entries:
    """One entry for each (language, key); of its documents the first ``least`` numbers.

    Whether an entry has ``least`` documents is all that is asked, and that many different ones
    prove it: what is left out changes no answer, however entries are merged further.
    """
    code, keys = _coded(x.key)
    of, owner = np.unique(x.lang, return_inverse=True)
    owner = owner * max(1, len(keys)) + code
    del code
    ids, owner = np.unique(owner, return_inverse=True)

    d_owner = np.repeat(owner, x.n_docs)
    order = np.lexsort((x.docs, d_owner))
    d_owner, docs = d_owner[order], x.docs[order]
    new = _starts(d_owner, docs)
    d_owner, docs = d_owner[new], docs[new]
    kept = np.arange(len(docs)) - np.searchsorted(d_owner, np.arange(len(ids)))[d_owner] < least
    docs, n_docs = docs[kept], np.bincount(d_owner[kept], minlength=len(ids)).astype(np.int64)
    del d_owner, order, new, kept
    c_owner = np.repeat(owner, x.n_counts)
    order = np.lexsort((x.counts[:, 0], c_owner))
    c_owner, counts = c_owner[order], x.counts[order]
    del order, owner
    at = np.flatnonzero(_starts(c_owner, counts[:, 0]))
    counts = np.stack([counts[at, 0], np.add.reduceat(counts[:, 1], at) if len(at) else counts[:, 1]], axis=1)
    n_counts = np.bincount(c_owner[at], minlength=len(ids)).astype(np.int64)
    return Entries(of[ids // max(1, len(keys))], keys.take(pa.array(ids % max(1, len(keys)))), docs, n_docs, counts, n_counts)


def chunk_entries(texts: pa.Array, lang: np.ndarray, group: np.ndarray, first_number: int, least: int) -> Entries:
    """The entries of the whitespace chunks of some documents, which are numbered from ``first_number``; chunks that hold no letter are passed over."""
    split, n = pc.ascii_split_whitespace(texts), max(1, len(texts))
    coded = split.flatten().dictionary_encode()
    chunks = coded.dictionary
    pair = coded.indices.to_numpy().astype(np.int64)
    kept = pc.match_substring_regex(chunks, LETTER).to_numpy(zero_copy_only=False)[pair] if len(pair) else np.zeros(0, dtype=bool)
    pair *= n
    pair += np.repeat(np.arange(len(split), dtype=np.int32), np.diff(split.offsets.to_numpy()))
    del split, coded
    pair = pair[kept]
    pair.sort()  # by chunk, then document
    at = np.flatnonzero(_starts(pair))
    times = np.diff(np.append(at, len(pair)))  # each chunk's count in each document
    pair = pair[at]
    del at, kept
    own, one = pair % n, np.ones(len(pair), dtype=np.int64)
    pair //= n
    return merged(Entries(lang[own], chunks.take(pa.array(pair)), own + first_number, one, np.stack([group[own], times], axis=1).astype(np.int64), one), least)


def term_entries(x: Entries, least: int) -> Entries:
    """Entries of terms from entries of chunks: each distinct chunk is tokenized once, and its terms are joined back to its entries."""
    code, chunks = _coded(x.key)
    terms = pc.ascii_split_whitespace(pc.ascii_lower(pc.replace_substring_regex(chunks, NO_TERM, " ")))
    of = np.repeat(np.arange(len(chunks)), np.diff(terms.offsets.to_numpy()))
    flat = terms.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    term, names = _coded(flat.filter(pa.array(real)))
    pair, times = np.unique(of[real] * max(1, len(names)) + term, return_counts=True)
    of, term = pair // max(1, len(names)), pair % max(1, len(names))

    lo, hi = np.searchsorted(of, code), np.searchsorted(of, code, side="right")
    entry = np.repeat(np.arange(len(code)), hi - lo)
    place = np.arange(len(entry)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[entry]
    d_at = np.cumsum(x.n_docs) - x.n_docs
    c_at = np.cumsum(x.n_counts) - x.n_counts

    def gathered(start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(start[entry] - (np.cumsum(n[entry]) - n[entry]), n[entry]) + np.arange(int(n[entry].sum()))

    counts = x.counts[gathered(c_at, x.n_counts)]
    counts[:, 1] *= np.repeat(times[place], x.n_counts[entry])
    return merged(Entries(x.lang[entry], names.take(pa.array(term[place])), x.docs[gathered(d_at, x.n_docs)], x.n_docs[entry], counts, x.n_counts[entry]), least)


def term_counts(texts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """COUNTS of the terms that ``least`` documents of their language or more hold, from (text, lang_id, group_id) without nulls.

    1. Each document's whitespace chunks are counted; a task brings together the documents of a
       block of BLOCK_BYTES (a longer text is a block of its own) and sends an entry for each language and chunk.
    2. Buckets by chunk: each globally distinct chunk is tokenized once, its terms are
       joined back to the chunk's entries, and entries of a term are merged.
    3. Buckets by term: what different chunks say of a term is merged; distinct
       documents are counted as far as ``least``, occurrences add up by group.

    A hot chunk, language or source sends one entry a block, with ``least`` documents at most.
    """
    spark = texts.sparkSession
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, bytes_held = TaskContext.get().partitionId() << 40, [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            return chunk_entries(t["text"].chunk(0), t["lang_id"].to_numpy(), t["group_id"].to_numpy(), number, least).table()

        for batch in batches:
            for row, data, offs in utf8_slices(batch["text"], BLOCK_BYTES):
                if held and (bytes_held + len(data) > BLOCK_BYTES or sum(map(len, held)) > BLOCK_DOCUMENTS):
                    yield block()
                    number, held, bytes_held = number + sum(map(len, held)), [], 0
                held.append(batch.slice(row, len(offs) - 1))
                bytes_held += len(data)
        if held:
            yield block()

    dealt = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket")

    def tokenized(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([term_entries(entries_of(table), least).table()])

    def counted(table: pa.Table) -> pa.Table:
        x = merged(entries_of(table), least)
        enough = np.repeat(x.n_docs >= least, x.n_counts)
        of = np.repeat(np.arange(len(x.lang)), x.n_counts)[enough]
        return pa.table({"lang_id": x.lang[of], "group_id": x.counts[enough, 0], "term": x.key.take(pa.array(of)), "n": x.counts[enough, 1]})

    terms = dealt(texts.mapInArrow(count, ENTRIES)).applyInArrow(tokenized, ENTRIES)
    return dealt(terms).applyInArrow(counted, COUNTS)


def _share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kinds)); decimals hold the product for any count.  Null without terms."""
    top = (count.cast("decimal(20,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)")
    below = F.when(kinds > 0, (total + 2 * kinds).cast("decimal(20,0)"))
    return 1 + F.call_function("div", top, below)


def _difference(p: Column, q: Column) -> Column:
    """floor((p - q) * (p - q) / (p + q)); shares are SCALE + 1 at most, so the square fits in a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """How the word use of each (language, source) group differs from the language's other sources, and by which terms.

    Null texts, languages and sources read as empty strings.  Terms are runs of
    ASCII letters, in lower case, and of other characters beyond ASCII.  A language keeps the terms
    that ``least`` of its documents hold.  A group's share of a kept term with n occurrences is
    p = 1 + floor(SCALE * (n + 2) / (all + 2 * kept)), a language's is q likewise, and p and q differ by
    f = floor((p - q)**2 / (p + q)); all of it is integers.

    A row (lang, source, part, item, value, rank): part ``pair`` has every other source of the language
    with the sum of f over all kept terms (0 without any); part ``term`` the ``top`` terms of the group with p > q
    and their f.  Ranks go by value, largest first, then by the item's bytes.

    Terms that a group lacks all have one share.  So a pair's sum is made of terms that both
    have, of those that one has (by how many have each share), and of a
    product for the rest: no row is made for a term that a group lacks.  Every input
    row is a document, repeated and null ids included; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("text", text_col), ("lang", lang_col), ("source", source_col))])
    groups = scratch.save(slim.select("lang", "source").distinct().withColumn("group_id", F.monotonically_increasing_id()))
    groups = groups.join(groups.groupBy("lang").agg(F.min("group_id").alias("lang_id")), "lang")
    texts = slim.join(groups, ["lang", "source"]).select("text", "lang_id", "group_id")
    counts = scratch.save(term_counts(texts, least)).join(groups.select("group_id", "lang", "source"), "group_id").select("lang", "source", "term", "n")
    kinds = counts.groupBy("lang").agg(F.countDistinct("term").alias("kinds"), F.sum("n").alias("lang_total"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    groups = groups.select("lang", "source").join(own, ["lang", "source"], "left").join(kinds, "lang", "left").na.fill(0, ["kinds", "lang_total", "total", "held"])
    groups = scratch.save(groups.withColumn("none", _share(F.lit(0), F.col("total"), F.col("kinds"))))
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("kinds")))
    shares = scratch.save(shares.select("lang", "source", "term", "n", "p", "none"))

    side = lambda x: groups.select("lang", "kinds", F.col("source").alias(x), F.col("held").alias(f"held_{x}"), F.col("none").alias(f"none_{x}"))
    pairs = side("a").join(side("b").drop("kinds"), "lang").where("a < b")
    neither = pairs.select("lang", "a", "b", F.coalesce((F.col("kinds") - F.col("held_a") - F.col("held_b")) * _difference(F.col("none_a"), F.col("none_b")), F.lit(0)).alias("v"))
    alike = shares.groupBy("lang", F.col("source").alias("x"), "p").agg(F.count(F.lit(1)).alias("terms"))
    one = alike.join(side("y"), "lang").where("x <> y").select("lang", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("terms") * _difference(F.col("p"), F.col("none_y"))).alias("v"))
    has = lambda x: shares.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"p{x}"), F.col("none").alias(f"n{x}"))
    c = F.col
    common = _difference(c("pa"), c("pb")) - _difference(c("pa"), c("nb")) - _difference(c("na"), c("pb")) + _difference(c("na"), c("nb"))
    both = has("a").join(has("b"), ["lang", "term"]).where("a < b").select("lang", "a", "b", common.alias("v"))
    value = neither.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    part = value.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    part = part.unionByName(value.select("lang", F.col("b").alias("source"), F.lit("pair").alias("part"), F.col("a").alias("item"), "value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = part.withColumn("rank", F.row_number().over(by))

    of_lang = shares.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(kinds, "lang")
    of_lang = of_lang.select("lang", "term", _share(F.col("n"), F.col("lang_total"), F.col("kinds")).alias("q"))
    more = shares.join(of_lang, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _difference(F.col("p"), F.col("q")).alias("value"))
    return ranked.unionByName(more.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top))


def op12(spark, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
    SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
    SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), v AS (
    SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), c AS (
    SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
    SELECT lang, source, coalesce(v.v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS n
    FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang)
), p AS (
    SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (kept.n + 2)) // (v.n + 2 * v.v)::HUGEINT AS q
    FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), f AS (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), r AS (
    SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value
    FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 10
"""
