"""Divergences against brute force in Python integers, with blocks of any size."""

import re
from collections import Counter, defaultdict

import pytest

from kurtosia.llm import source_divergence

DOCS = "doc_id long, text string, lang string, source string, term string, block long, chunk string, p long, a string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    docs = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    holds, own, groups = defaultdict(Counter), defaultdict(Counter), {(lang, s) for _, lang, s in docs}
    for t, lang, s in docs:
        terms = TERM.findall(t.translate(LOWER))
        holds[lang].update(set(terms))
        own[lang, s].update(terms)
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in holds[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        total = sum((own[g] for g in groups if g[0] == lang), Counter())
        q, f = share(total), lambda a, b: (a - b) ** 2 // (a + b)
        for s in (s for x, s in groups if x == lang):
            p = share(own[lang, s])
            value = {}
            for o in (o for x, o in groups if x == lang and o != s):
                po = share(own[lang, o])
                value[o] = sum(f(p[t], po[t]) for t in kept)
            out |= {(lang, s, "pair", o, v, i + 1) for i, (o, v) in enumerate(sorted(value.items(), key=lambda x: (-x[1], x[0].encode())))}
            more = sorted(((t, f(p[t], q[t])) for t in kept if own[lang, s][t] and p[t] > q[t]), key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, s, "term", t, v, i + 1) for i, (t, v) in enumerate(more[:top])}
    return out


ROWS = [
    (1, None, "en", "a"), (2, "", None, None), (2, "", None, None), (3, "The the, THE\tbox-cat é", "en", "a"), (4, "the\n\ncat É", "en", "b"), (5, "a1b2c3 the", "en", None), (None, "the cat", "en", "c"),
    (6, "cat", None, "a"), (6, "cat", None, "a"), (7, "12 34 !!", "de", "a"), (8, "日本 語x日本", "de", "b"), (9, "日本", "de", "b"), (10, "x" * 300_000 + " cat", "en", "b"), (11, "cat " * 20_000, "en", "b"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 5, "c", 7, "a") for r in rows], DOCS)


@pytest.mark.parametrize("size", [1, 50, 16 << 20])
@pytest.mark.parametrize(("least", "top"), [(1, 3), (2, 10), (99, 10)])
def test_against_brute_force(spark, monkeypatch, size, least, top):
    monkeypatch.setattr(source_divergence, "BLOCK_BYTES", size)
    out = source_divergence.divergences(frame(spark, ROWS).repartition(2), least=least, top=top)
    got = [tuple(r) for r in out.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(ROWS, least, top)


def test_no_rows(spark):
    assert source_divergence.divergences(frame(spark, [])).collect() == []


def test_shares_of_huge_counts(spark):
    from pyspark.sql import functions as F

    n = 9_000_000_000_000
    got = spark.range(1).select(source_divergence._share(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (3 * n + 14)
