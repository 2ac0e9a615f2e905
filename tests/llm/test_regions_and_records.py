"""The best region against all regions, page extraction against labelled pages, and WARC records against a parser of its own."""

import base64
import hashlib
from html.parser import HTMLParser

import numpy as np

from kurtosia.llm import html_text, warc


def test_best_region_against_all_regions():
    rng = np.random.default_rng(3)
    for _ in range(400):
        x = np.round(rng.normal(-0.2, 2, int(rng.integers(0, 14))), 1).tolist()
        a, b = html_text.best_region(x)
        sums = {(i, j): sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        most = max([0.0, *sums.values()])
        assert abs(sum(x[a:b]) - most) < 1e-9
        if most <= 1e-9:
            assert (a, b) == (0, 0)


def test_articles_keep_their_text_whatever_their_classes():
    for page in (
        '<div class="content with-sidebar"><article><p>Real words of the article here</p></article></div>',
        '<article class="post has-header"><p>Real words of the article here</p></article>',
        '<article><p class="ad-free">Real words of the article here</p></article>',
        '<article><p title="x>Real words of the article here</p></article>',
        '<main class="comments-open"><p>Real words of the article here</p></main>',
    ):
        assert "Real words of the article here" in html_text.main_text(page, {}), page


def test_pages_against_the_parts_they_name(spark):
    """Of pages with one article and no more than plain markup in it, its words are found; of all others' words few are."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    found = right = wanted = 0
    for r in html_text.extract(pages).collect():
        body = r.html or ""
        if body.count("<article") != 1 or "</article>" not in body:
            continue
        part = body[body.index("<article") : body.index("</article>")]
        if any(t in part for t in ("<aside", "<form", "<nav", "<script", "<style", "<figure", "<footer", "<header", "class=", "<!--", "<svg")):
            continue
        words = " ".join(_Visible.of(part).split()).split()
        got = r.text.split()
        found += len(got)
        wanted += len(words)
        left = {}
        for w in words:
            left[w] = left.get(w, 0) + 1
        for w in got:
            if left.get(w, 0):
                left[w] -= 1
                right += 1
    assert wanted == 0 or (right / wanted > 0.98 and right / found > 0.98)


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    @classmethod
    def of(cls, page):
        p = cls()
        p.feed(page)
        p.close()
        return "".join(p.out)

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in ("p", "div", "br", "li", "h1", "h2", "h3", "ul", "section", "article"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def _sha1(x):
    return "sha1:" + base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()


def test_derived_records_field_by_field(spark):
    body = "<p>one &lt; two</p><div>three</div>" + "<p>long words </p>" * 20_000
    http = "HTTP/1.1 200 OK\r\nServer: s\r\nX-Note: a: b\r\n\r\n"
    rows = [("<urn:uuid:1>", "http://a/1\r\nWARC-Type: fake", "2024-01-01T00:00:00Z", http + body, "sha1:GIVEN", "extra"), (None, None, None, None, None, "extra"), ("<urn:uuid:2>", "u", None, "no header", None, "x")]
    df = spark.createDataFrame(rows, "record_id string, target_uri string, date string, block string, payload_digest string, header string")
    out = warc.derive_records(df).collect()
    assert len(out) == 6
    by = {(r.refers_to, r.record_type): r for r in out}
    m, c = by["<urn:uuid:1>", "metadata"], by["<urn:uuid:1>", "conversion"]
    lines = [" ".join(x.split()) for x in _Visible.of(body).split("\n")]
    assert c.block == "\n".join(x for x in lines if x) and c.content_length == len(c.block.encode())
    assert c.block_digest == c.payload_digest == _sha1(c.block) and m.block_digest == _sha1(m.block)
    for line in ("sourceRecordId: <urn:uuid:1>", "sourcePayloadDigest: sha1:GIVEN", f"sourceBlockDigest: {_sha1(http + body)}", f"conversionRecordId: {c.record_id}", "http-status: HTTP/1.1 200 OK", "http-header: Server: s", "http-header: X-Note: a: b"):
        assert line in m.block.split("\r\n")
    assert [x.split(":")[0] for x in m.header.split("\r\n")[1:-1]].count("WARC-Type") == 1 and "WARC-Refers-To: <urn:uuid:1>" in m.header
    assert m.header.endswith("\r\n") and f"Content-Length: {m.content_length}\r\n" in m.header and "WARC-Date: 2024-01-01T00:00:00Z" in c.header
    empty = [r for r in out if r.target_uri is None]
    assert len(empty) == 2 and len({r.refers_to for r in empty}) == 1 and all("WARC-Target-URI" not in r.header for r in empty)
    assert f"sourcePayloadDigest: {_sha1('no header')}" in by["<urn:uuid:2>", "metadata"].block
    assert by["<urn:uuid:2>", "conversion"].block == "no header"
    assert len({r.record_id for r in out}) == 6
