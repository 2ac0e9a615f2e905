"""Counting of hashes in chunks, in one level and in several."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from kurtosia.llm import blocks
from kurtosia.llm.hashing import other_window_hashes, window_hashes, word_hashes


@pytest.mark.parametrize("fan", [2, 4096])
def test_counts_of_all_hashes(spark, fan):
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    plan = blocks.plan_of(1 << 20, 8, bucket_hashes=1 << 14, fan=fan)
    assert len(plan.fans) == (1 if fan > 8 else 4)
    chunks = {c: np.unique(plan.short(rng.choice(pool, 60))) for c in range(23)}
    chunks[23] = np.unique(plan.short(rng.integers(0, 1 << 63, 50, dtype=np.uint64)))
    want = Counter(h for x in chunks.values() for h in x.tolist())
    sent = spark.createDataFrame([(c,) for c in chunks], "c long").repartition(5)

    def send(key, table):
        return blocks.pack(key[0].as_py(), chunks[key[0].as_py()], plan)

    replies = blocks.count_in_chunks(sent.groupBy("c").applyInArrow(send, blocks.BLOCKS), plan).toArrow()
    for c, x in chunks.items():
        own = replies.filter(pa.compute.equal(replies["chunk"], c))
        assert blocks.unpack(own, x, plan).tolist() == [want[h] for h in x.tolist()]
    repeated = blocks.count_in_chunks(sent.groupBy("c").applyInArrow(send, blocks.BLOCKS), plan, repeated=True).toArrow()
    for c, x in chunks.items():
        own = repeated.filter(pa.compute.equal(repeated["chunk"], c))
        got = [h for p in own["payload"] for h in blocks.decode(p.as_py(), plan.dropped_bits).tolist()]
        assert sorted(got) == [h for h in x.tolist() if want[h] > 1]


def test_ranges_stay_large_in_any_corpus():
    for size in (10**9, 10**11, 10**14):
        plan = blocks.plan_of(size, 200)
        assert max(plan.fans) <= blocks.FAN
        assert size / 5 / plan.ranges(len(plan.fans)) <= blocks.BUCKET_HASHES
        assert 64 - plan.dropped_bits > np.log2(size / 5) + 4


def test_encoding_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(20) << np.uint64(20))
        assert (blocks.decode(blocks.encode(h, 20), 20) == h).all()


def test_hashes_tell_patterns_apart():
    parity = "".join("ab"[bin(i).count("1") % 2] for i in range(1024)).encode()
    words = [parity, parity.translate(bytes.maketrans(b"ab", b"ba")), b"ab", b"ba", b"a", b"b", b"", b"ab" * 512, b"aa", b"A", "é".encode()]
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    h = word_hashes(data, ends - [len(w) for w in words], ends)
    assert len(set(h.tolist())) == len(words)
    items = np.array([h[0], h[1]] * 40, dtype=np.uint64)
    for width in (1, 5, 35):
        begin, first = window_hashes(items, np.array([0, len(items)]), width)
        second = other_window_hashes(items, begin, width)
        assert len(set(first.tolist())) == len(set(second.tolist())) == 2
        assert (first[::2] == first[0]).all() and (second[::2] == second[0]).all()
