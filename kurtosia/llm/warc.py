"""WARC: derived metadata and plain-text conversion records, and Spark reading and writing of WARC files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_text import raw_end

#: Of records made from tables that know no time of capture.
NO_DATE = "1970-01-01T00:00:00Z"
RECORD = "record_id string, record_type string, target_uri string, date string, refers_to string, content_type string, content_length long, block_digest string, payload_digest string, header string, block string"
_COLUMNS = [c.split()[0] for c in RECORD.split(", ")]

_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>")
_BREAK = re.compile(r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|aside|main|blockquote|pre|form|hr|dd|dt|figure)\b[^>]*>")
_TAG = re.compile(r"(?s)<[a-zA-Z/!?][^>]*(?:>|\Z)")
_TITLE = re.compile(r"(?is)<title(?=[\s/>])[^>]*>(?:(.*?)</title\s*>|([^<]*))")
_LINK = re.compile(r"(?i)<a\b[^>]*\bhref\s*=")
_CHARSET = re.compile(r"(?im)^content-type:[^\r\n]*?charset\s*=\s*[\"']?([\w.:-]+)")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _shown(page: str) -> str:
    """Without hidden elements; a head needs no end tag, since all it may hold is hidden or void."""
    parts, at, missing = [], 0, set()
    while m := _HIDDEN.search(page, at):
        parts.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            at = raw_end(page, name, m[2], at, missing)
            if name == "title" and at == m.end() and not m[2].endswith("/"):
                next_tag = page.find("<", at)
                at = next_tag if next_tag >= 0 else len(page)
    return " ".join([*parts, page[at:]])


def plain_text(page: str) -> str:
    """Visible text: hidden elements left out, a line for each block, character references decoded."""
    text = _TAG.sub("", _BREAK.sub("\n", _shown(page)))
    lines = (" ".join(html.unescape(x).split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def _record(kind: str, source: dict, content_type: str, block: str, payload: str | None = None) -> dict:
    data = block.encode()
    out = {
        "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source["record_id"]} {kind}')}>",
        "record_type": kind,
        "target_uri": source["target_uri"],
        "date": source["date"],
        "refers_to": source["record_id"],
        "content_type": content_type,
        "content_length": len(data),
        "block_digest": digest(data),
        "payload_digest": payload,
        "block": block,
    }
    return out | {"header": header(out)}


def header(r: dict) -> str:
    """The WARC header of a record, a line for each field it has."""
    named = (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    )
    return "WARC/1.1\r\n" + "".join(f"{k}: {_one_line(r[v])}\r\n" for k, v in named if r.get(v) is not None)


def _one_line(value) -> str:
    """A header's value; line breaks, which would end the field, become spaces."""
    return re.sub(r"[\r\n]+", " ", str(value))


def _split_http(block: bytes) -> tuple[str, bytes]:
    head, gap, body = block.partition(b"\r\n\r\n")
    return (head.decode("utf-8", "replace"), body) if gap else ("", block)


def decoded(body: bytes, head: str) -> str:
    """A body as text by the charset of its header, or UTF-8 where that names none that is known; other bytes become replacement characters."""
    named = _CHARSET.search(head)
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derive_records(responses: DataFrame) -> DataFrame:
    """For each response record its metadata and its conversion record, linked to it.

    ``responses`` holds record_id, target_uri, date and block (HTTP header, empty
    line, body; binary, or a string of UTF-8) and, optionally, record_type, block_digest,
    payload_digest and content_length of the source.  Both derived records refer to the
    response (WARC-Refers-To) and keep its URI and date.  The metadata block
    (application/warc-fields) keeps the response's identifier, digests, lengths and
    every HTTP header line, with title, link count and the conversion's identifier;
    the conversion block (text/plain) is the page's visible text, decoded by the charset of the header.
    Digests and lengths that the source states are kept as they are; others are those of its bytes.

    Result, two rows for each response: RECORD.  Rows with a record_type other than ``response``
    are passed over.  A null block is an empty page,
    with an empty conversion; null URIs and dates stay null and their header lines are
    left out; line breaks in them become spaces in headers.  Responses with a null record_id are given one by their content.
    Repeated responses give repeated records.  Other columns are not looked at.
    """
    if "record_type" in responses.columns:
        responses = responses.where("record_type is null or lower(record_type) = 'response'")
    stated = [(F.col(c) if c in responses.columns else F.lit(None)).cast(t).alias(c) for c, t in (("block_digest", "string"), ("payload_digest", "string"), ("content_length", "long"))]
    slim = responses.select(*[F.col(c).cast("string").alias(c) for c in ("record_id", "target_uri", "date")], F.col("block").cast("binary").alias("block"), *stated)

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                for r in b.slice(at, 256).to_pylist():
                    out += derived(r)
                yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in out], pa.int64() if c == "content_length" else pa.string()) for c in _COLUMNS})

    return slim.mapInArrow(derive, RECORD)


def derived(source: dict) -> list[dict]:
    block = source["block"] or b""
    source = source | {"record_id": source["record_id"] or f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(block).digest()[:16], version=5)}>"}
    head, raw = _split_http(block)
    body = decoded(raw, head)
    text = plain_text(body)
    conversion = _record("conversion", source, "text/plain; charset=utf-8", text, digest(text.encode()))
    title = _TITLE.search(body)
    status, *lines = head.split("\r\n")
    length = source.get("content_length")
    fields = [
        ("sourceRecordId", source["record_id"]), ("sourceBlockDigest", source.get("block_digest") or digest(block)), ("sourcePayloadDigest", source.get("payload_digest") or digest(raw)),
        ("sourceContentLength", len(block) if length is None else length), ("conversionRecordId", conversion["record_id"]), ("title", " ".join(html.unescape(title[1] or title[2] or "").split()) if title else ""),
        ("linkCount", len(_LINK.findall(body))), ("http-status", status), *[("http-header", x) for x in lines if x],
    ]
    return [_record("metadata", source, "application/warc-fields", "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields)), conversion]


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Response records of a table (page_id, url, html); identifiers follow from the row's content."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    key = F.md5(F.concat_ws("\x1f", F.col("page_id").cast("string"), "url", F.sha2(body, 256)))
    hyphened = F.concat_ws("-", *[F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.concat(F.lit("<urn:uuid:"), hyphened, F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(NO_DATE).alias("date"), F.concat(head, body).alias("block"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes ``header`` and ``block`` (text or bytes, which stay as they are) of records as WARC files, one a partition, with Spark's text writer."""
    whole = records.select(F.concat("header", F.lit("\r\n"), F.coalesce(F.col("block").cast("string"), F.lit(""))).alias("value"))
    whole.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """RECORD of every record below ``path``, with ``block`` in bytes; a file is read by one task, so files should be of usual size (1 GB).

    Bytes of headers that are not UTF-8 read as replacement characters.  A cut-off last record is left out.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"]:
                rows = []
                for r in _parse(content.as_py()):
                    rows.append(r)
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return files.mapInArrow(parse, RECORD.replace("block string", "block binary"))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"content_length": pa.int64(), "block": pa.binary()}
    return pa.RecordBatch.from_pydict({c: pa.array([r.get(c) for r in rows], kinds.get(c, pa.string())) for c in _COLUMNS})


def _parse(data: bytes) -> Iterator[dict]:
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    names = {
        "warc-type": "record_type", "warc-record-id": "record_id", "warc-date": "date", "warc-target-uri": "target_uri", "warc-refers-to": "refers_to",
        "warc-block-digest": "block_digest", "warc-payload-digest": "payload_digest", "content-type": "content_type", "content-length": "content_length",
    }
    at = data.find(b"WARC/")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = data[at : end + 2].decode(errors="replace")
        pairs = (x.partition(":") for x in head.split("\r\n")[1:] if ":" in x)
        r = {names[k.strip().lower()]: v.strip() for k, _, v in pairs if k.strip().lower() in names}
        r["content_length"] = int(r.get("content_length", 0))
        start = end + 4
        if start + r["content_length"] > len(data):
            return
        yield r | {"header": head, "block": data[start : start + r["content_length"]]}
        at = data.find(b"WARC/", start + r["content_length"])


def op6(spark, sf_dir: str) -> DataFrame:
    return derive_records(responses_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
