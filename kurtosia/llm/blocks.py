"""Counting of 64-bit hashes over a corpus, packed into blocks.

Documents are dealt to *chunks* of a few MB by a hash of their row.  A chunk
sorts its distinct hashes, shortened to a few bits more than tell all hashes of the
corpus apart, and sends each *range* of them as one block of byte-packed differences,
about three bytes a hash.  Spark brings the blocks of a range together; there it is counted
in how many chunks each hash occurs, and every block that shares a hash with another one is
answered.  As each chunk sends a hash once, no hash, however common, loads a range with
more entries than there are chunks.

A chunk is cut into FAN ranges at most, so blocks keep some size.  A larger corpus
needs more ranges: then the blocks of one range and FAN chunks are merged first, and
the merged block is cut again, level by level; answers come back the same way.
Shortened hashes may be shared by chance, one in some hundreds: answers are candidates.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U
from .scratch import Scratch

CHUNK_BYTES = 2 << 20
BUCKET_HASHES = 1 << 20
FAN = 4096
SPARE_BITS = 8
MOST_COUNT = 255  # a count of this means: this or more
_IN_ORDER = ("Project", "Filter", "Relation", "LogicalRDD", "LocalRelation")
BLOCKS = "chunk long, bucket long, payload binary, times binary"
REPLIES = "chunk long, bucket long, counts binary"
REPEATED = "chunk long, bucket long, payload binary"
_ARROW = {"chunk": pa.int64(), "bucket": pa.int64(), "payload": pa.binary(), "times": pa.binary(), "counts": pa.binary()}


@dataclass(frozen=True)
class Plan:
    """How hashes are shortened, and into how many ranges each level cuts."""

    chunks: int
    fans: tuple[int, ...]
    dropped_bits: int
    fan: int = FAN

    def short(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(self.dropped_bits)) << U(self.dropped_bits)

    def ranges(self, levels: int = 1) -> int:
        return math.prod(self.fans[:levels])


def plan_of(size: int, least: int, chunk_bytes: int = CHUNK_BYTES, bucket_hashes: int = BUCKET_HASHES, fan: int = FAN) -> Plan:
    """A plan for texts of ``size`` bytes, in ``least`` tasks at least."""
    buckets = max(least, math.ceil(size / 5 / bucket_hashes))
    fans = []
    while buckets > fan:
        fans.append(fan)
        buckets = math.ceil(buckets / fan)
    bits = min(64, max(24, (size // 2 + 1).bit_length() + SPARE_BITS))
    return Plan(max(2 * least, math.ceil(size / chunk_bytes)), (*fans, buckets), 64 - bits, fan)


def encode(h: np.ndarray, dropped_bits: int = 0) -> bytes:
    """Sorted distinct uint64 as differences of equal width: one byte for the width, then the bytes."""
    h = h >> U(dropped_bits)
    d = np.diff(h, prepend=U(0))
    first, d = d[:1], d[1:]
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    return bytes([width]) + first.astype("<u8").tobytes() + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def decode(b: bytes, dropped_bits: int = 0) -> np.ndarray:
    width = b[0]
    first = np.frombuffer(b, dtype="<u8", count=1, offset=1)
    packed = np.frombuffer(b, dtype=np.uint8, offset=9).reshape(-1, width)
    d = np.zeros((len(packed) + 1, 8), dtype=np.uint8)
    d[1:, :width] = packed
    d = d.view("<u8").ravel()
    d[0] = first[0]
    return np.cumsum(d, dtype=U) << U(dropped_bits)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the top 32 bits."""
    return ((h >> U(32)) * U(buckets)) >> U(32)


def pack(source: int, hashes: np.ndarray, plan: Plan, times: np.ndarray | None = None, levels: int = 1) -> pa.Table:
    """The blocks of one source from its sorted distinct short hashes and, where more than one chunk has them, their counts."""
    b = bucket_of(hashes, plan.ranges(levels))
    cut = np.flatnonzero(np.diff(b)) + 1 if len(b) else np.zeros(0, dtype=np.int64)
    parts = np.split(hashes, cut) if len(b) else []
    ids = b[np.concatenate(([0], cut)).astype(np.int64)] if len(b) else b
    counts = [None] * len(parts) if times is None else [zlib.compress(t.tobytes(), 1) for t in np.split(times, cut)] if len(b) else []
    columns = ([source] * len(parts), ids.astype(np.int64), [encode(p, plan.dropped_bits) for p in parts], counts)
    return pa.table({k: pa.array(v, _ARROW[k]) for k, v in zip(("chunk", "bucket", "payload", "times"), columns, strict=True)})


def _summed(blocks, plan: Plan) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The hashes of each block, all distinct ones in order, and in how many chunks each occurs."""
    parts = [decode(x.as_py(), plan.dropped_bits) for x in blocks["payload"]]
    counts = [np.ones(len(p)) if t is None else np.frombuffer(zlib.decompress(t), dtype=np.uint8) for p, t in zip(parts, blocks["times"].to_pylist(), strict=True)]
    seen, where = np.unique(np.concatenate(parts), return_inverse=True)
    return parts, seen, np.minimum(np.bincount(where, weights=np.concatenate(counts)), MOST_COUNT).astype(np.uint8)


def _replies(blocks, parts: list[np.ndarray], seen: np.ndarray, times: np.ndarray, plan: Plan, repeated: bool) -> pa.Table:
    """For each block with a shared hash the counts of all its hashes, or (``repeated``) those that are shared."""
    out: dict[str, list] = {"chunk": [], "bucket": [], "payload" if repeated else "counts": []}
    for chunk, bucket, part in zip(blocks["chunk"].to_pylist(), blocks["bucket"].to_pylist(), parts, strict=True):
        n = times[np.searchsorted(seen, part)]
        if (n > 1).any():
            told = encode(part[n > 1], plan.dropped_bits) if repeated else zlib.compress(n.tobytes(), 1)
            for k, v in zip(out, (chunk, bucket, told), strict=True):
                out[k].append(v)
    return pa.table({k: pa.array(v, _ARROW[k]) for k, v in out.items()})


def count_in_chunks(blocks: DataFrame, plan: Plan, repeated: bool = False, levels: int = 1) -> DataFrame:
    """REPLIES: for each block with a shared hash, in how many chunks (MOST_COUNT at most) each of its hashes occurs.

    With ``repeated``, REPEATED: the hashes of each block that occur in more than one chunk.
    """
    schema = REPEATED if repeated else REPLIES
    if levels == len(plan.fans):
        return blocks.groupBy("bucket").applyInArrow(lambda b: _replies(b, *_summed(b, plan), plan, repeated), schema)
    merger = F.floor(F.col("chunk") / plan.fan) * plan.ranges(levels) + F.col("bucket")
    keyed = blocks.withColumn("merger", merger.cast("long"))

    def merge(key, b):
        _, seen, times = _summed(b, plan)
        return pack(key[0].as_py(), seen, plan, times, levels + 1)

    def pass_on(b, answers):
        if not b.num_rows:
            return pa.table({c.split()[0]: pa.array([], _ARROW[c.split()[0]]) for c in schema.split(", ")})
        parts, seen, own = _summed(b, plan)
        told = unpack(answers, seen, plan, levels + 1)
        return _replies(b, parts, seen, np.maximum(told, own), plan, repeated)

    answers = count_in_chunks(keyed.groupBy("merger").applyInArrow(merge, BLOCKS), plan, False, levels + 1).withColumnRenamed("chunk", "merger")
    return keyed.groupBy("merger").cogroup(answers.groupBy("merger")).applyInArrow(pass_on, schema)


def unpack(replies: pa.Table, hashes: np.ndarray, plan: Plan, levels: int = 1) -> np.ndarray:
    """The counts of a source's sorted distinct short hashes; 1 where no other has the hash."""
    out = np.ones(len(hashes), dtype=np.uint8)
    b = bucket_of(hashes, plan.ranges(levels))
    for bucket, counts in zip(replies["bucket"].to_pylist(), replies["counts"].to_pylist(), strict=True):
        lo = np.searchsorted(b, U(bucket))
        n = np.frombuffer(zlib.decompress(counts), dtype=np.uint8)
        out[lo : lo + len(n)] = n
    return out


def _reads_in_order(df: DataFrame) -> bool:
    """Whether each run over the rows meets them in the same places: plain reads do, shuffles need not."""
    nodes = re.findall(r"^[\s:+-]*(\w+)", df._jdf.queryExecution().optimizedPlan().toString(), re.MULTILINE)
    return all(n in _IN_ORDER for n in nodes)


def in_chunks(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, Plan]:
    """(doc_id, text, chunk), and a plan by the bytes of all texts.

    Rows are dealt by their content and their place in the input, so equal rows spread over
    chunks.  Where a second run could meet rows in other places, they are written first.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slim = slim if _reads_in_order(slim) else scratch.save(slim)
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    plan = plan_of(size, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return slim.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(plan.chunks))), plan
