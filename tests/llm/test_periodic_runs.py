"""Runs against brute force, and rows with nulls, no words, repeats and clashing columns."""

import random
import time

import numpy as np
import pytest

from kurtosia.llm import periodic_runs
from kurtosia.llm.hashing import U, mix

DOCS = "doc_id long, text string, runs string, n_words string, w string"


def brute(w, least, times):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            smaller = any(all(w[x] == w[x + r] for x in range(i, i + n - r)) for r in range(1, q))
            if j > i and n >= max(least, times * q) and not smaller:
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_words(rng):
    kinds = rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(kinds) for _ in range(rng.choice([0, 1, 5, 6, 7, 20, 60]))]
    if rng.random() < 0.7:
        unit = [rng.randrange(kinds + 1) for _ in range(rng.randint(1, 14))]
        unit = unit + unit + [9] if rng.random() < 0.3 else unit
        w += (unit * 8)[: rng.randint(1, 8 * len(unit))] + w[:5]
    return w


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (6, 2), (5, 3), (10, 3)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least * times)
    for _ in range(300):
        docs = [some_words(rng) for _ in range(rng.randint(1, 4))]
        bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        d, s, n, q = periodic_runs.runs_of(mix(np.array([x for w in docs for x in w], dtype=U) + U(5)), bounds, least, times)
        for i, w in enumerate(docs):
            assert [x[1:] for x in zip(d.tolist(), s.tolist(), n.tolist(), q.tolist(), strict=True) if x[0] == i] == brute(w, least, times)


def test_a_period_in_which_each_short_gram_recurs():
    unit = [0, 0, 1, 0, 1, 1, 0, 0, 0, 1, 1, 1, 0, 1, 0] * 2 + [2] + [0, 0, 1, 0, 1, 1] * 3
    w = unit * 5
    d, s, n, q = periodic_runs.runs_of(mix(np.array(w, dtype=U)), np.array([0, len(w)]))
    assert (0, len(w), len(unit)) in zip(s.tolist(), n.tolist(), q.tolist(), strict=True)


@pytest.mark.parametrize("kinds", [1, 2])
def test_time_is_in_proportion(kinds):
    took = []
    for n in (100_000, 800_000):
        h = mix(np.random.default_rng(1).integers(0, kinds, n).astype(U))
        began = time.perf_counter()
        periodic_runs.runs_of(h, np.array([0, n]))
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] + 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 5), (5, "a\n" * 6), (5, "a\n" * 6), (None, "x a b a b a b a b y"), (6, " ".join(f"w{i}" for i in range(50_000)) + " z" * 50_000), (7, "é é é é é é E e e e e e")]
    out = periodic_runs.periodic_runs(spark.createDataFrame([(i, t, "r", "n", "w") for i, t in rows], DOCS)).collect()
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in out), key=str)
    want = []
    for i, t in rows:
        w = (t or "").split()
        runs = brute(w, 6, 4) if len(w) < 1000 else [(50_000, 50_000, 1)]
        want.append((i, len(w), runs, collapsed(w, runs)))
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []


def test_longest_run_of_ties(spark):
    text = "a a a a a a x " + "b b b b b b y " + "c d c d c d c d"
    out = periodic_runs.periodic_runs(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"))
    best = {r.doc_id: r.best for r in out.select("doc_id", periodic_runs.longest_run(out["runs"]).alias("best")).collect()}
    assert tuple(best[1]) == (14, 8, 2) and tuple(best[2]) == (None, None, None)


def test_planted_rows_keep_their_columns(spark):
    rows = [(i, f"a{i} b c d e f g h i j k l m n o p", "r", "n", "w") for i in range(60)] + [(None, "x y", "r", "n", "w"), (3, None, "r", "n", "w")]
    out = periodic_runs.with_planted_runs(spark.createDataFrame(rows, DOCS).select("doc_id", "text")).collect()
    assert len(out) == len(rows) and any(r.text is None for r in out)
    assert 0 < sum(r.text not in {x[1] for x in rows} for r in out) < 20
