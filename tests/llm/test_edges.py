"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kurtosia.llm import decontamination, html_text, nn_descent, packing, secret_scan, substring_dedup, toxicity, url_filter, warc

DOCS = "doc_id long, text string, chunk string, bucket long, base string, weak string, spans string, a long, s string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "b", "w", "s", 9, "s") for i, t in rows], DOCS)


LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "alone"), (None, None), (4, LONG), (5, "one two"), (5, "one two"), (6, "one two")]


def test_substring_dedup_handles_odd_rows(spark):
    out = substring_dedup.repeated_windows(docs(spark, ODD))
    rows = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()), key=str)
    assert rows == sorted([(1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, ""), (None, 1, 0, "alone"), (None, 0, 0, ""), (4, 60000, 0, LONG), *[(i, 2, 0, "one two") for i in (5, 5, 6)]], key=str)
    assert substring_dedup.repeated_windows(docs(spark, [])).collect() == []


def test_substring_dedup_against_brute_force(spark):
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(30):
        words = [f"u{rng.integers(0, 50)}" for _ in range(rng.integers(0, 60))]
        if i % 3 == 0:
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = passage[: 34 + i % 7]
        rows.append((i, " \n".join(words)))
    rows.append((99, " ".join(["ha"] * 50)))  # overlaps itself
    seen = defaultdict(list)
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 34):
            seen[tuple(w[j : j + 35])].append((i, j))
    gone = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                gone[i].update(range(j, j + 35))
    for r in substring_dedup.repeated_windows(docs(spark, rows)).collect():
        w = dict(rows)[r.doc_id].split()
        assert r.n_removed == len(gone[r.doc_id])
        assert r.kept_text == " ".join(x for j, x in enumerate(w) if j not in gone[r.doc_id])
        assert {k for x in r.removed for k in range(x.start, x.end)} == gone[r.doc_id]


def test_substring_dedup_of_words_that_cancel_in_a_polynomial(spark):
    parity = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    tail = " ".join(f"t{i}" for i in range(35))
    rows = [(1, f"{parity} {tail[:-4]}"), (2, f"{parity.translate(str.maketrans('ab', 'ba'))} {tail[:-4]}")]
    assert all(r.n_removed == 0 for r in substring_dedup.repeated_windows(docs(spark, rows)).collect())
    assert all(r.n_removed == r.n_words for r in substring_dedup.repeated_windows(docs(spark, rows), window=33).collect()) is False


def test_packing_round_trip(spark):
    rows = [*ODD, *[(i, "word " * (i * 37 % 3000)) for i in range(10, 60)]]
    texts = defaultdict(list)
    encode = packing.encoder()
    for i, t in rows:
        texts[i].append([*encode(t or ""), 0])
    out = packing.pack_documents(docs(spark, rows).repartition(3), keep_ids=True).collect()
    sequences, pieces = defaultdict(list), defaultdict(int)
    for r in out:
        ids = np.frombuffer(bytes(r.ids), dtype="<u4").tolist()
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(ids) == r.length
        assert any(d[r.start : r.start + r.length] == ids and len(d) == r.doc_tokens for d in texts[r.doc_id])
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id] += r.length
    assert pieces == {i: sum(map(len, d)) for i, d in texts.items()}
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    filled = sum(n for parts in sequences.values() for _, n in parts)
    assert len(sequences) <= filled / packing.LENGTH * 1.02 + 1
    assert packing.pack_documents(docs(spark, [])).collect() == []


def test_tokens_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    encode = packing.encoder()
    for text in ("", " ", "a  b\n\n c", "it's <|endoftext|> x\x1c y", "été 12 ½ 東京\t\tend ", "x\n", "a\u00a0\u00a0b"):
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def _distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(11)
    items = [(k, "".join(rng.choice(list("abcdefg "), 60 + 30 * k))) for k in range(3)] + [(7, None), (8, " ")]
    rows = [(1, None), (2, ""), (None, "prefix " + items[0][1] + " suffix"), (3, items[1][1].upper())]
    for i in range(20, 50):
        words = list(items[i % 3][1])
        for _ in range(int(rng.integers(0, 9))):
            words[int(rng.integers(0, len(words)))] = "z"
        rows.append((i, "begin  " + "".join(words) + "\nend"))
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.contaminated(docs(spark, rows), bench).collect()}
    want = {}
    for (i, t), (k, item) in itertools.product(rows, items):
        a, b = decontamination.normal(item), decontamination.normal(t)
        if a and b and (d := _distance(a, b)) <= len(a) // decontamination.CHARACTERS_PER_EDIT:
            want[i, k] = d
    assert got == want
    kept = {r.doc_id for r in decontamination.drop_contaminated(docs(spark, rows), bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}
    assert decontamination.contaminated(docs(spark, []), bench).collect() == []
    assert decontamination.contaminated(docs(spark, rows), bench.limit(0)).collect() == []


def test_secret_links_need_complementary_parts(spark):
    key = "AKIA" + "Q" * 16
    rows = [*ODD, (10, f"{key} and password: hunter2ab"), (11, "password: hunter2ab"), (12, f"user=bob at https://db.example.com/x with secret=abcdefghijklmnop {key}"), (13, f"{key}" + " x" * 300 + " password: hunter2ab")]
    out = {r.doc_id: [(secret_scan.KINDS[s.rank], s.start, s.end) for s in r.spans] for r in secret_scan.find_secrets(docs(spark, rows)).collect() if r.doc_id}
    assert out[10] == [("access", 0, 20), ("short_secret", 25, 44)]
    assert out[11] == [] and out[13] == [("access", 0, 20)] and out[1] == []
    assert [k for k, _, _ in out[12]] == ["login", "endpoint", "assign", "access"]
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs(spark, rows)).collect() if r.doc_id and r.doc_id > 9}
    assert clean[10] == "<ACCESS> and <SHORT_SECRET>" and clean[11] == "password: hunter2ab"
    assert secret_scan.redact(docs(spark, rows)).count() == len(rows)
    assert secret_scan.redact(docs(spark, rows)).columns == docs(spark, rows).columns
    assert secret_scan.find_secrets(docs(spark, [])).collect() == []


def test_toxicity_grammar_and_odd_rows(spark):
    scorer = toxicity.Scorer({"idiot": 5.0, "xyzz*": 4.0})
    name = dict(zip(toxicity.FEATURES, scorer("You idiot."), strict=True))
    assert name["plain_top"] == 5 and name["aimed_top"] == 5
    assert dict(zip(toxicity.FEATURES, scorer("He is not an idiot."), strict=True))["negated_top"] == 5
    assert dict(zip(toxicity.FEATURES, scorer("They said idiot"), strict=True))["reported_top"] == 5
    assert dict(zip(toxicity.FEATURES, scorer("I will kill you"), strict=True))["aimed_threat"] == 1
    assert dict(zip(toxicity.FEATURES, scorer("XYZZable words"), strict=True))["plain_top"] == 4
    assert not scorer("all fine here").any() and not scorer(None).any()
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(100, 160)], "doc_id long, quality int, toxic int")
    rows = [*ODD, *[(i, f"plain words {i} and {'you idiot' if i % 2 else 'nice day'} end") for i in range(100, 160)]]
    out = {r.doc_id: r.toxicity for r in toxicity.score(docs(spark, rows), labels).collect()}
    assert all((out[i] >= 0.5) == bool(i % 2) for i in range(100, 160)) and out[1] == out[2] < 0.5
    assert toxicity.score(docs(spark, rows), labels.limit(0)).count() == len(rows)
    assert toxicity.score(docs(spark, []), labels).collect() == []


def test_toxicity_on_held_out_documents(spark):
    at = "/root/testdata/sf0.01"
    rows = toxicity.op8(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93
    assert all(0 <= r.score <= 1 for r in rows)


PAGES = "page_id long, url string, html string, text string, host string, rule string"


def test_main_text(spark):
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=#>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site all the time.</p></div><article><h1>Head &amp; line</h1><p>First   para
with &eacute; words.<script>var x = "<p>no</p>";</script><aside>Side words here</aside><p>Second one.<form><p>Join us</p></form></article>
<div class="comments"><p>I think that this is a comment of many words</p></div><footer>&copy; us</footer></body></html>"""
    rows = [(1, "u", page, "old", "h", "r"), (2, None, None, None, None, None), (3, "u", "", "", "", ""), (4, "u", "<p>open <b>never closed", "", "", ""), (5, "u", "just words", "", "", ""), (5, "u", "just words", "", "", "")]
    out = sorted((r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect())
    assert out == [(1, "Head & line\nFirst para with é words.\nSecond one."), (2, ""), (3, ""), (4, "open never closed"), (5, "just words"), (5, "just words")]
    assert html_text.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_url_filter(spark):
    rows = [(1, "http://www.Spam.example.org/a/?q#f"), (2, "https://spam.example.org/a.html"), (3, "https://x.example.com/en/1"), (4, "http://www.example.com/en/1"), (5, None), (6, "no scheme"), (7, "http://a.net/fr/"), (8, "http://host"), (9, "s://other.org/b")]
    pages = spark.createDataFrame([(i, u, "", "", "h", "r") for i, u in rows], PAGES)
    listing = spark.createDataFrame([("spam.example.org/a",), ("spam.example.org/a",), (None,)], "canonical string")
    for limit in (url_filter.BROADCAST_BYTES, 0):
        out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listing, broadcast_bytes=limit).collect()}
        assert out[1] == ("www.spam.example.org", "/a/", None, "block") and out[2][3] == "block" and out[9][3] == "allow"
        assert out[3][2:] == ("example.com/en/", "block") and out[4][2:] == ("www.example.com/en/", "allow")
        assert out[5] == ("", "", None, "allow") and out[6] == ("", "", None, "allow") and out[7][2:] == ("net/fr/", "block") and out[8] == ("host", "", None, "allow")
    assert url_filter.filter_urls(pages, listing.limit(0)).where("verdict = 'block'").count() == 2
    assert url_filter.filter_urls(pages.limit(0), listing).collect() == []


def test_bloom_filter_passes_all_listed(spark):
    urls = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("canonical"))
    bloom = url_filter.bloom_filter(urls, 256)
    probe = urls.unionByName(spark.range(3000).select(F.concat(F.lit("v"), "id").alias("canonical"))).select("canonical", *url_filter._block_and_masks(F.col("canonical"), 256))
    passes = F.expr(" AND ".join(f"(m{w} & w{w}) = m{w}" for w in range(url_filter.WORDS)))
    hit = probe.join(bloom, "block", "left").where(passes)
    assert hit.where("canonical like 'u%'").count() == 3000
    assert hit.where("canonical like 'v%'").count() < 60


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<title>A &amp; b</title><p>one<p>two <a href=x>l</a>", "", "", ""), (2, None, None, "", "", ""), (2, None, None, "", "", "")]
    out = warc.derive_records(warc.responses_of_pages(spark.createDataFrame(rows, PAGES)))
    records = [r.asDict() for r in out.collect()]
    assert len(records) == 6 and all(r["refers_to"].startswith("<urn:uuid:") for r in records)
    text = next(r for r in records if r["record_type"] == "conversion" and r["target_uri"])
    assert text["block"] == "one\ntwo l" and text["content_length"] == 9
    about = next(r for r in records if r["record_type"] == "metadata" and r["target_uri"])
    assert f"conversionRecordId: {text['record_id']}" in about["block"] and "title: A & b" in about["block"] and "http-header: Content-Type" in about["block"]
    warc.write_warc(out, str(tmp_path / "w"))
    again = [r.asDict() | {"block": bytes(r.block).decode()} for r in warc.read_warc(spark, str(tmp_path / "w")).collect()]
    key = lambda r: (r["record_id"], r["record_type"])
    assert sorted(again, key=key) == sorted(records, key=key)
    assert all(warc.digest(r["block"].encode()) == r["block_digest"] for r in again)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(13)
    centres = rng.standard_normal((12, 16)) * 2
    vectors = {i: centres[i % 12] + rng.standard_normal(16) for i in range(900)}
    rows = [(i, v.tolist()) for i, v in vectors.items()]
    rows += [(1001, None), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0, None] * 8), (None, [1.0] * 16), (1005, [1.0] * 3), (5, [9.0] * 16), (1006, [float("inf")] * 16), (2000, [1e300] * 16)]
    table = spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<double>, id long, vec long")
    vectors[5] = min(vectors[5].tolist(), [9.0] * 16)
    vectors[2000] = [1.0] * 16
    ids = np.array(sorted(vectors))
    m = np.stack([np.asarray(vectors[i], dtype=float) for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in nn_descent.nearest_neighbours(table, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    queries = [int(i) for i in ids if i % 50 == 0]
    assert sorted(got) == queries
    hits = 0
    for q in queries:
        s = m @ m[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        hits += len({i for i, _ in got[q]} & set(best.tolist()))
        assert all(score == pytest.approx(s[np.searchsorted(ids, i)], abs=1e-12) for i, score in got[q])
    assert hits / (5 * len(queries)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.id) for r in nn_descent.nearest_neighbours(few, F.col("id") % 50 == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert nn_descent.nearest_neighbours(table.limit(0), F.lit(True)).collect() == []
