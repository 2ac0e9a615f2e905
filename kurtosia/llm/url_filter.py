"""URL filter: a blocked Bloom filter of listed URLs before an exact join, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict): a host with all its subdomains, and the beginning of a path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: A stand-in for a block list: pages of which a part of a host label is one of these words make the listing of ``op2``.
LISTED_TERMS = ("casino", "pills", "bets", "spam", "ads")
_LISTED = "(^|[.-])(" + "|".join(LISTED_TERMS) + ")([.-]|$)"
BITS_PER_URL = 16
WORDS = 4
BITS_SET = 8
#: The filter is broadcast up to this size; a larger one is joined by block.
BROADCAST_BYTES = 8 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def canonical(host: Column, path: Column) -> Column:
    """Scheme, query, fragment, www. and m., a final .html and final slashes left out."""
    return F.concat(F.regexp_replace(host, "^(www|m)[.]", ""), F.regexp_replace(F.regexp_replace(path, "[.]html$", ""), "/+$", ""))


def _best_rule(host: Column, path: Column) -> Column:
    """The longest rule that fits, as (rule, verdict)."""
    out = F.lit(None)
    for rule, verdict in sorted(RULES, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _block_and_masks(url: Column, blocks: int) -> list[Column]:
    """The block of a URL and, for each of its words, the mask of its bits."""
    where, bits = F.xxhash64(url), F.xxhash64(url, F.lit("bits"))
    bit = [F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS_SET)]
    masks = [reduce(lambda a, b: a.bitwiseOR(b), [_one(b) for b in bit[w::WORDS]]) for w in range(WORDS)]
    return [F.pmod(where, F.lit(blocks)).alias("block"), *[m.alias(f"m{w}") for w, m in enumerate(masks)]]


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom_filter(listing: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3): each URL sets BITS_SET bits of one block of WORDS 64-bit words."""
    return listing.select(*_block_and_masks(F.col("canonical"), blocks)).groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(WORDS)])


def filter_urls(pages: DataFrame, listing: DataFrame, url_col: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with host, path, rule, listed and verdict of their URL.

    A fitting rule decides, the longest first.  Without one a URL in ``listing``
    (a column ``canonical``) is blocked and others are allowed.  The filter of the
    listing passes URLs that may be in it; an exact join drops its false positives,
    so results do not depend on its size.

    Null URLs and URLs without ``://`` have an empty host and path, no rule, and are
    allowed unless the listing has an empty string.  Repeated rows are judged one
    by one; an empty listing lists nothing.  Columns of ``pages`` named host, path,
    rule, listed or verdict give way to the result's.
    """
    listing = listing.select("canonical").where("canonical is not null").distinct()
    n = listing.count()
    blocks = 1
    while blocks * WORDS * 64 < n * BITS_PER_URL:
        blocks *= 2
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.struct("*").alias("row"), F.col(url_col).cast("string").alias("url")).select("row", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("canonical", canonical(F.col("host"), F.col("path"))).withColumn("best", _best_rule(F.col("host"), F.col("path")))
    probe = rows.select("*", *_block_and_masks(F.col("canonical"), blocks))
    bloom = bloom_filter(listing, blocks)
    if blocks * (WORDS + 1) * 8 <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    near = probe.join(bloom, "block", "left")
    passes = F.coalesce(reduce(and_, [F.col(f"m{w}").bitwiseAND(F.col(f"w{w}")) == F.col(f"m{w}") for w in range(WORDS)]), F.lit(False))
    hits = near.where(passes).join(listing.withColumn("listed", F.lit(True)), "canonical", "left")
    others = near.where(~passes).withColumn("listed", F.lit(False))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "listed", "verdict")]
    listed = F.coalesce("listed", F.lit(False))
    out = [*[F.col(f"row.`{c}`").alias(c) for c in keep], "host", "path", F.col("best.rule").alias("rule"), listed.alias("listed")]
    verdict = F.coalesce("best.verdict", F.when(listed, "block").otherwise("allow"))
    cols = ["row", "host", "path", "best", "listed"]
    return others.select(cols).unionByName(hits.select(cols)).select(*out, verdict.alias("verdict"))


def listed_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Canonical URLs of the pages of whose host labels a part is a listed term."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(url_col).cast("string").alias("url")).select(host.alias("host"), path.alias("path"))
    return urls.where(F.col("host").rlike(_LISTED)).select(canonical(F.col("host"), F.col("path")).alias("canonical"))


def op2(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    fits = []
    for rule, verdict in RULES:
        h, slash, p = rule.partition("/")
        fits.append(f"SELECT '{rule}' AS rule, '{verdict}' AS v, '{h}' AS h, '{slash}{p}' AS p")
    return rf"""
WITH r AS ({" UNION ALL ".join(fits)}),
u AS (
    SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hp AS (
    SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u
), c AS (
    SELECT *, regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(regexp_replace(path, '[.]html$', ''), '/+$', '') AS canonical FROM hp
), listing AS (
    SELECT DISTINCT canonical FROM c WHERE regexp_matches(host, '{_LISTED}')
), best AS (
    SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
    FROM c JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN canonical IN (SELECT canonical FROM listing) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best USING (k)
"""


ORACLE_SQL = _oracle()
