"""Periodic runs of words: seeds on diagonals, extended and merged lag by lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import GOLDEN, WORD_BASE, U, kept_texts, mix, rolling, utf8_slices, word_hashes, words

RESULT = "doc_id {id}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"
WORD = r"[^\x20\x09-\x0D]+"


def seed_classes(most: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(k, lo, hi): k-grams that find every run of a period from lo to hi, for all periods that fit into ``most`` words.

    A run of period q has ``max(least, times * q)`` words or more, and q fewer of them
    equal the word q places on.  k is the least such overlap of any period from lo on.
    """
    lo = 1
    while max(least, times * lo) <= most:
        k = min(max(least, times * q) - q for q in range(lo, max(lo, least) + 1))
        yield k, lo, k
        lo = k + 1


def _reach(h: np.ndarray, at: int, lag: int, end: int, step: int) -> int:
    """The first place from ``at`` on, in direction ``step``, whose word differs from the one ``lag`` further; ``end`` if none does before."""
    width = 64
    while at != end:
        to = min(at + width, end) if step > 0 else max(at - width, end)
        lo, hi = (at, to) if step > 0 else (to + 1, at + 1)
        odd = np.flatnonzero(h[lo:hi] != h[lo + lag : hi + lag])
        if len(odd):
            return lo + int(odd[0] if step > 0 else odd[-1])
        at, width = to, 2 * width
    return end


def runs_of(h: np.ndarray, bounds: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, ...]:
    """(document, start in it, length, period) of all runs in the words ``h`` of documents with these ``bounds``.

    For each class of periods the k-grams of a document are indexed by sorting, and a
    gram and its next occurrence are a seed on the diagonal of their lag.  Other
    pairs of occurrences need no look: k is no smaller than a period q of the class, so
    in a run of smallest period q a gram that recurred sooner would give the run a
    smaller period (Fine and Wilf).  Hence every place of the run is a seed of lag q,
    and seeds of lag q stand in no stretch with a smaller period.  A table of the furthest
    place covered by lag spares seeds in a stretch that one before them was extended to.
    A longer gram recurs only where a shorter one does, so each class looks at the
    places left by the one before: the work is that of sorting n places.
    """
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    last = np.repeat(bounds[1:], np.diff(bounds))
    n = np.repeat(np.diff(bounds), np.diff(bounds))
    at, found = np.arange(len(h)), []
    for k, lo, hi in seed_classes(int(np.diff(bounds).max(initial=0)), least, times):
        at = at[(at + k <= last[at]) & (n[at] >= max(least, times * lo))]
        if not len(at):
            break
        gram = mix(mix(rolling(h, at, at + k, WORD_BASE)) + document[at].astype(U) * U(GOLDEN))
        order = np.argsort(gram, kind="stable")  # equal grams stay in order of their places
        same = gram[order[1:]] == gram[order[:-1]]
        first, second = at[order[:-1][same]], at[order[1:][same]]
        again = np.zeros(len(h), dtype=bool)
        again[first] = again[second] = True
        lag = second - first
        seeds = (lag >= lo) & (lag <= hi)
        lag, first = lag[seeds], first[seeds]
        order = np.lexsort((first, lag))
        lag, first = lag[order], first[order]
        head = np.ones(len(lag), dtype=bool)  # seeds side by side are one stretch
        head[1:] = (lag[1:] != lag[:-1]) | (first[1:] != first[:-1] + 1)
        heads = np.flatnonzero(head)
        stretch = np.diff(np.append(heads, len(lag))) - 1 + k + lag[heads]
        heads = heads[stretch >= np.maximum(least, times * lag[heads])]
        furthest: dict[int, int] = {}
        for q, i in zip(lag[heads].tolist(), first[heads].tolist(), strict=True):
            if i < furthest.get(q, 0):
                continue
            d = int(document[i])
            end = _reach(h, i + k, q, int(bounds[d + 1]) - q, 1)
            start = _reach(h, i - 1, q, int(bounds[d]) - 1, -1) + 1
            furthest[q] = end
            if end - start + q >= max(least, times * q):
                found.append((d, start - int(bounds[d]), end - start + q, q))
        at = at[again[at]]
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 4
    d, start, length, period = np.array(found, dtype=np.int64).T
    order = np.lexsort((period, start, d))
    return d[order], start[order], length[order], period[order]


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first ``period`` words."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge)[:n] == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """Runs of words that repeat with a period, and the texts with each run cut to its first period.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, compared byte by byte (by hashes of
    64 bits) and numbered from 0.  A run is a stretch of ``max(least, times * q)`` consecutive words
    or more whose smallest period is q, as long as it keeps that period; ``times`` is 2 at least.

    A row for each input row: doc_id, n_words, runs (by start, then period) and
    collapsed_text, the words that no run contains after its first period, joined by
    one space.  Null, empty and separator-only texts have no words, no runs and an empty
    collapsed text.  Null and repeated ids are worked row by row, and other columns
    are not looked at.  A document is read by one task; its time grows as sorting its words.
    """
    if least < 2 or times < 2:
        raise ValueError("least and times must be 2 or more")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offs in utf8_slices(batch["text"]):
                s, e, bounds = words(data, offs)
                d, start, length, period = runs_of(word_hashes(data, s, e), bounds, least, times)
                keep = _kept(len(s), start + bounds[d], length, period)
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
                upto = np.searchsorted(d, np.arange(len(bounds)))
                columns = [
                    batch["doc_id"].slice(row, len(bounds) - 1),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(upto, pa.int32()), runs),
                    kept_texts(data, s, e, bounds, keep).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed_text"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(find, RESULT.format(id=slim.schema["doc_id"].dataType.simpleString()))


def longest_run(runs: Column) -> Column:
    """The run of greatest length; of equals the one of smallest start, then period.  Null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("period"))))
    return F.struct((-best["before"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` where the tail of every tenth document, by the CRC of its id, repeats its first words with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.withColumn("g", F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10")).withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))))
    chosen = chosen.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    chosen = chosen.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.expr("array_join(transform(sequence(0, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return chosen.withColumn("text", F.when(F.col("n") > 0, text).otherwise(F.col("text"))).drop("g", "w", "n", "a", "p")


def op11(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", longest_run(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


ORACLE_SQL = r"""
WITH RECURSIVE crc_table AS (
    SELECT list(v ORDER BY n) AS t
    FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) r(n))
), hashed AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
    FROM documents, crc_table
), planned AS (
    SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS parts FROM hashed
), texts AS (
    SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) ELSE w END AS w FROM planned
), tokens AS (
    SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS x FROM texts
), grams AS (
    SELECT doc_id, n, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g FROM tokens
), lags AS (
    SELECT DISTINCT x.doc_id, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i AND 4 * (y.i - x.i) <= x.n WHERE len(x.g) = 5
), equal AS (
    SELECT x.doc_id, q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, q ORDER BY x.i) AS island
    FROM lags JOIN tokens x USING (doc_id) JOIN tokens y ON y.doc_id = x.doc_id AND y.i = x.i + q AND y.x = x.x
), stretches AS (
    SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM equal GROUP BY doc_id, q, island HAVING count(*) >= 5
), runs AS (
    SELECT doc_id, s, l, q FROM stretches b
    WHERE l >= greatest(6, 4 * q) AND NOT EXISTS (SELECT 1 FROM stretches c WHERE c.doc_id = b.doc_id AND c.q < b.q AND c.s <= b.s AND c.s + c.l >= b.s + b.l)
), dropped AS (
    SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs
), kept AS (
    SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM tokens ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
), told AS (
    SELECT doc_id, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, arg_min({'s': s, 'l': l, 'q': q}, [-l, s, q]) AS best FROM runs GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(told.n, 0) AS BIGINT) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
