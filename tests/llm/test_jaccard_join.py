"""The exact Jaccard join against brute force, and the promise of its signatures."""

import itertools

import numpy as np
import pytest

from kurtosia.llm import jaccard_join
from kurtosia.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, x string, p string, s long, set_key string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "p", 1, "k", 2) for i, t in rows], SCHEMA)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows, percent=80):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((i, len(shingles(t)), root(i) if shingles(t) else i) for i, t in rows)


def found(spark, rows, **how):
    return sorted(tuple(r) for r in jaccard_join.jaccard_components(docs(spark, rows), **how).collect())


def edited(rng, words, edits, fresh):
    words = list(words)
    for _ in range(edits):
        at, kind = int(rng.integers(0, len(words))), int(rng.integers(0, 4))
        if kind == 0 and len(words) > 6:
            del words[at]
        elif kind == 1:
            words.insert(at, fresh())
        else:
            words[at] = fresh()
    return words


@pytest.mark.parametrize("percent", [80, 60])
def test_mixed_rows(spark, percent):
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(45)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (5, "one two"), (6, "One  TWO"), (7, "one two three four five")]
    base = [[f"b{k}_{i}" for i in range(n)] for k, n in enumerate((6, 12, 40, 90, 200))]
    for i in range(100, 220):
        words = edited(rng, base[i % 5], int(rng.integers(0, 1 + len(base[i % 5]) // 18)), lambda: f"e{rng.integers(0, 9)}")
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join([*common, *[f"t{i}_{j}" for j in range(int(rng.integers(1, 14)))]])) for i in range(300, 340)]  # a common passage
    assert found(spark, rows, percent=percent) == brute(rows, percent)


def test_large_groups_of_near_copies(spark):
    """Copies with many edits, whose links run through other copies: none may be lost however far the pivot is."""
    rng = np.random.default_rng(11)
    rows, i = [], 0
    for k, n in enumerate((60, 150, 150)):
        base = [f"g{k}_{j}" for j in range(n)]
        variants = [base, edited(rng, base, n // 20, lambda: f"v{rng.integers(0, 1 << 30)}"), edited(rng, base, n // 12, lambda: f"v{rng.integers(0, 1 << 30)}")]
        for m in range(140):
            words = edited(rng, variants[m % 3], int(rng.integers(0, n // 16)), lambda: f"e{rng.integers(0, 1 << 30)}" if k < 2 else f"e{rng.integers(0, 5)}")
            i += 1
            rows.append((i, " ".join(words)))
            if m % 7 == 0:  # a chain: each link close to the last one, far from the base
                for _ in range(4):
                    words = edited(rng, words, n // 40, lambda: f"c{rng.integers(0, 1 << 30)}")
                    i += 1
                    rows.append((i, " ".join(words)))
    order = rng.permutation(len(rows))
    rows = [(int(order[j]), t) for j, (_, t) in enumerate(rows)]
    want = brute(rows)
    assert len({c for _, _, c in want}) > 20
    assert found(spark, rows) == want


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "alone"), (None, None), (None, "alone"), (4, long), (8, long + " more"), (5, "one two"), (5, "one two"), (6, "one two")]
    out = jaccard_join.jaccard_components(docs(spark, rows)).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 1, None), (None, 1, None), (None, 0, None), (4, 59996, 4), (8, 59997, 4), (5, 1, 5), (5, 1, 5), (6, 1, 5)], key=str)
    assert jaccard_join.jaccard_components(docs(spark, [])).collect() == []


def test_rows_that_repeat_an_id_are_one_node(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, one), (2, two), (3, one), (3, two), (3, three), (4, three), (5, "other words"), (3, "no partner here"), (3, "")]
    assert found(spark, rows) == sorted([(1, 26, 1), (2, 26, 1), (3, 26, 1), (3, 26, 1), (3, 26, 1), (4, 26, 1), (5, 1, 5), (3, 1, 1), (3, 0, 3)])


def test_ids_of_text(spark):
    rows = docs(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")]).selectExpr("'d' || doc_id AS name", "text AS body")
    out = jaccard_join.jaccard_components(rows, "name", "body").collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [("d1", "d1"), ("d2", "d1"), ("d3", "d3")]


def test_words_that_cancel_in_a_polynomial(spark):
    """The parity word of 1,024 letters and its complement have one polynomial hash modulo 2**64, whatever its base."""
    parity = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = parity.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{parity} x y z"), (2, f"{other} x y z")]
    assert found(spark, rows) == [(1, 1, 1), (2, 1, 2)]


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_similar_sets_share_a_signature(percent):
    """Whatever is bland: the sets keep a signature in common if all others may go that the rule lets go."""
    rng = np.random.default_rng(7)
    met = 0
    for n in (1, 2, 3, 4, 5, 7, 8, 9, 13, 15, 16, 17, 22, 40, 63, 64, 100, 300, 2000):
        for _ in range(25):
            items = np.unique(rng.integers(0, 1 << 63, 3 * n + 2, dtype=np.uint64) * np.uint64(2))
            rng.shuffle(items)
            most = n * (100 - percent) // 150 + 2
            gone, more = int(rng.integers(0, most)), int(rng.integers(0, most))
            a, b = np.sort(items[:n]), np.sort(items[min(gone, n - 1) : n + more])
            if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
                continue
            met += 1
            tables = jaccard_join.signatures([a, b], percent)
            distinct, times = np.unique(jaccard_join._all(tables), return_counts=True)
            for share in (0.0, 0.05, 0.3, 1.0):  # of signatures that are everywhere
                heard = np.where(rng.random(len(distinct)) < share, jaccard_join.MOST_COUNT, times)
                _, keep, needs = jaccard_join._wanted(tables, 2, lambda s: s, distinct, heard)
                pieces = [np.broadcast_to(x[4][:, None], x[1].shape) for x in tables]
                owner, sig, kept, piece = jaccard_join._by_set(tables, [x[1] for x in tables], keep, pieces)
                x, y = sig[kept & (owner == 0)], sig[kept & (owner == 1)]
                assert len(np.intersect1d(x, y)), (n, gone, more)
                for i in (0, 1):  # and in as many parts of some instance as each needs
                    both = np.unique(piece[kept & (owner == i) & np.isin(sig, np.intersect1d(x, y))])
                    assert any((both >> 40 == up).sum() >= needs[up, i] and (both >> 40 == up).any() for up in (0, 1))
    assert met > 100


def test_subsets_of_parts_are_enumerated():
    for row_set, sig, empty, sure, _ in jaccard_join.signatures([np.arange(n, dtype=np.uint64) * np.uint64((1 << 63) // n) for n in (9, 200)], 80):
        assert sig.shape[1] > 1 and sig.shape == empty.shape and len(row_set) == len(sig)
        assert (sure > 0).all()


def test_items_that_no_other_member_holds_are_not_laid_out_by_pivot(spark):
    """40 sets far from each of 6 pivots and from one another, and two that are similar: only the items of these are laid out."""
    sets = {p: list(range(80)) for p in range(6)}
    sets |= {x: [*range(60), *range(1000 * x, 1000 * x + 60)] for x in range(10, 50)}
    sets |= {50: [*range(60), *range(9000, 9060)], 51: [*range(60), *range(9005, 9065)]}
    sets |= {52: [*range(60), *range(9000, 9060), 7]}  # in the component of 50: what only these two hold counts for nothing
    table = spark.createDataFrame([(x, len(set(items)), sorted(set(items))) for x, items in sets.items()], "x long, n long, shingles array<long>")
    component = lambda x: 50 if x == 52 else x
    members = spark.createDataFrame([(p, x, p, component(x), True) for p in range(6) for x in sets if x >= 10], "p long, x long, pc long, xc long, new boolean")
    saved = []

    class Kept(Scratch):
        def save(self, df):
            saved.append(super().save(df))
            return saved[-1]

    pairs = jaccard_join._close_within(members, table, 80, Kept(spark, "test")).collect()
    assert {(r.a, r.b) for r in pairs} >= {(50, 51), (51, 52)}
    laid_out = [t.selectExpr("sum(size(own)) AS n").first().n for t in saved if "own" in t.columns]
    assert 0 < laid_out[0] <= 6 * 3 * 60
