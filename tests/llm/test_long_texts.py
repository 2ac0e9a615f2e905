"""Very long texts take time in proportion, and odd bytes and attributes are kept apart."""

import random
import time

import numpy as np
import pytest

from kurtosia.llm import blocks, html_text, packing, toxicity, warc
from kurtosia.llm.scratch import Scratch


def seconds(f):
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 1_000_000, " \n\t\x0b" * 2_500_000 + "end", "a" * 1_000_000])
def test_long_runs_are_encoded_whole(text):
    import tiktoken

    ids = packing.document_encoder()(text)
    full = tiktoken.Encoding("bpe", pat_str="(?s).", mergeable_ranks=_ranks(), special_tokens={})
    assert full.decode(ids) == text


def _ranks():
    import base64

    with open(packing.RANKS, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_long_runs_equal_the_tokenizer():
    from tokenizers import Tokenizer

    whole, encode, rng = Tokenizer.from_file(packing.TOKENIZER), packing.document_encoder(), random.Random(3)
    for _ in range(30):
        text = "".join(rng.choice(["a", "bc ", " " * rng.randint(990, 3000), "\n" * rng.randint(990, 2000), " \n\t  " * 300, "\x1c" * 1200, "x", ".", "　" * 1000]) for _ in range(8))
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("make", [lambda n: "you idiot. " * n, lambda n: '"you idiot" ' * n, lambda n: 'she said "' + "word " * n + "idiot. idiot " * n, lambda n: "idiot " * n, lambda n: '"a a a idiot. ' * n])
def test_toxicity_in_proportion(make):
    score = toxicity.Scorer({"idiot": 5.0})
    few, many = seconds(lambda: score(make(4_000))), seconds(lambda: score(make(64_000)))
    assert many < 40 * few + 1


@pytest.mark.parametrize("make", [lambda n: "<b>" * n + "</i>x" * n, lambda n: "<b>" * n + "<p></p>" * n, lambda n: "<p><body>" + "<b>" * n + "<p></p>" * n, lambda n: "<div>" * n + "</div>" * n])
def test_markup_in_proportion(make):
    few, many = (seconds(lambda n=n: html_text.main_text(make(n), {})) for n in (3_000, 48_000))
    assert many < 40 * few + 1


@pytest.mark.parametrize(
    ("text", "context"),
    [('"You idiot", she said.', "reported"), ('"You idiot!" he shouted', "reported"), ('"Go home" you idiot', "plain"), ('"You idiot" and left', "plain"), ('She wrote: "Go. You idiot." Idiot', "plain reported")],
)
def test_speech_reported_after_a_quotation(text, context):
    found = dict(zip(toxicity.FEATURES, toxicity.Scorer({"idiot": 5.0})(text), strict=True))
    assert {c for c in toxicity.CONTEXTS if found[f"{c}_top"]} == set(context.split())


@pytest.mark.parametrize(
    ("text", "threat", "aimed"),
    [("I'll burn your house down", 1, 1), ("you should die", 1, 1), ("je te tue", 1, 1), ("ich bringe dich um", 1, 1), ("I could kill for a coffee you know", 0, 0), ("we kill time here", 0, 0), ("I kill you for it", 1, 1)],
)
def test_more_threats(text, threat, aimed):
    found = dict(zip(toxicity.FEATURES, toxicity.Scorer({"idiot": 5.0})(text), strict=True))
    assert (found["threat"], found["aimed_threat"]) == (threat, aimed)


def test_names_inside_other_attributes_name_nothing():
    words = "word " * 40
    page = f'<article><p>{words}</p><p title="see class=ads">Short note.</p><p data-x=\'id="nav"\' class=ads>gone</p></article>'
    assert html_text.main_text(page, {}) == f"{words.strip()}\nShort note."


def test_sources_keep_digests_and_bytes(spark, tmp_path):
    latin = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n<p>caf\xe9</p>".encode("latin-1")
    binary = b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe\x00<p>x"
    rows = [
        ("<urn:uuid:1>", "response", "http://a", latin, warc.digest(latin), "sha1:PAYLOAD", len(latin)),
        ("<urn:uuid:2>", "Response", "http://b", binary, None, None, None),
        ("<urn:uuid:3>", "request", "http://c", b"GET / HTTP/1.1\r\n\r\n", None, None, None),
        ("<urn:uuid:4>", "warcinfo", None, b"software: x", None, None, None),
    ]
    df = spark.createDataFrame([(*r, "d") for r in rows], "record_id string, record_type string, target_uri string, block binary, block_digest string, payload_digest string, content_length long, date string")
    by = {(r.refers_to, r.record_type): r for r in warc.derive_records(df).collect()}
    assert len(by) == 4 and by["<urn:uuid:1>", "conversion"].block == "café"
    about = by["<urn:uuid:1>", "metadata"].block.split("\r\n")
    assert {f"sourceBlockDigest: {warc.digest(latin)}", "sourcePayloadDigest: sha1:PAYLOAD", f"sourceContentLength: {len(latin)}"} <= set(about)
    assert f"sourceBlockDigest: {warc.digest(binary)}" in by["<urn:uuid:2>", "metadata"].block and f"sourceContentLength: {len(binary)}" in by["<urn:uuid:2>", "metadata"].block

    files = tmp_path / "in"
    files.mkdir()
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:9>\r\nWARC-Block-Digest: sha1:GIVEN\r\nContent-Length: %d\r\n\r\n" % len(latin)
    (files / "a.warc").write_bytes(head + latin + b"\r\n\r\n")
    read = warc.read_warc(spark, str(files))
    assert bytes(read.first().block) == latin
    assert "sourceBlockDigest: sha1:GIVEN" in next(r.block for r in warc.derive_records(read).collect() if r.record_type == "metadata")
    warc.write_warc(read.union(read), str(tmp_path / "out"))
    assert [bytes(r.block) for r in warc.read_warc(spark, str(tmp_path / "out")).collect()] == [latin, latin]


def test_equal_rows_spread_over_chunks(spark):
    df = spark.createDataFrame([(1, "same text")] * 400, "doc_id long, text string")
    chunked, plan = blocks.in_chunks(df, "doc_id", "text", Scratch(spark, "t"))
    assert chunked.select("chunk").distinct().count() > plan.chunks / 2
    assert blocks._reads_in_order(df.where("doc_id > 0")) and not blocks._reads_in_order(df.distinct())
    shuffled, _ = blocks.in_chunks(df.repartition(3), "doc_id", "text", Scratch(spark, "t"))
    assert np.isclose(shuffled.count(), 400)
