"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_QUOTE = """["']?"""
_IS = rf"{_QUOTE}\x20*[:=]\x20*{_QUOTE}"
#: Base kinds, in order: pattern, group whose length counts, least length.
BASE = {
    "assign": ("(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + rf"){_IS}([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
}
#: Weak parts: kind, role, pattern, group whose length counts, least and most length.
#: A mixed token also needs a lower-case and an upper-case letter and a digit.
WEAK = (
    ("key_id", "id", BASE["access"][0], 0, 8, 17),
    ("login", "id", "(" + "|".join(map(_any_case, ("username", "user", "login", "client_?id", "access_?key_?id"))) + rf"){_IS}([A-Za-z0-9@_.-]+)", 2, 3, 1 << 30),
    ("short_secret", "secret", BASE["assign"][0], 2, 6, 11),
    ("mixed_token", "secret", "[A-Za-z0-9+/]{24,}", 0, 24, 1 << 30),
    ("endpoint", "endpoint", r"[a-z][a-z0-9+]{1,14}://[A-Za-z0-9._:@/?&=%-]+", 0, 8, 1 << 30),
    ("address", "endpoint", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", 0, 7, 15),
)
#: Of each pattern, how it is scanned and what a text has to hold for it to match at all.
#: A run of hex digits of the least length is a whole match of the base pattern that passes, and the other way round.
_SCAN = {BASE["hex"][0]: "[0-9a-f]{16,}"}
_HOLDS = {BASE["access"][0]: "AKIA", WEAK[4][2]: "://"}
BLOCK = 256
KINDS = (*BASE, *(w[0] for w in WEAK))
ROLES = {"assign": "secret", "access": "id", "hex": "secret"} | {w[0]: w[1] for w in WEAK}
SPAN = "array<struct<start:int,rank:int,end:int>>"
REACH = 256
KEY = ("doc_id", "text_hash", "text_length")


def _placed(lengths: Column) -> Column:
    """(start, end, n, mixed) of matches from (gap, hit, n, mixed): lengths before them add up, block by block, so that no array grows match by match."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda t, x: t + x["gap"] + x["hit"]))
    starts = F.aggregate(sums, F.array(F.lit(0)), lambda ts, x: F.concat(ts, F.array(F.element_at(ts, -1) + x)))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        span = F.struct(start.alias("start"), end.alias("end"), x["n"].alias("n"), x["mixed"].alias("mixed"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    none = F.expr("cast(array() as array<struct<start:int,end:int,n:int,mixed:boolean>>)")
    inner = F.zip_with(blocks, F.slice(starts, 1, F.size(sums)), lambda xs, at: F.aggregate(xs, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
    return F.when(F.size(lengths) > 0, F.flatten(inner)).otherwise(none)


def _none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def _is(rank: Column, role: str) -> Column:
    return rank.isin([i for i, k in enumerate(KINDS) if ROLES[k] == role])


def _scanned(docs: DataFrame, text: Column) -> DataFrame:
    """docs with ``base`` and ``weak`` spans, in order of start, then kind.

    Each pattern is searched once, kinds that share one by their lengths; the pieces
    between matches are only cut where there are any.
    """
    kinds = [(k, p, g, least, 1 << 30) for k, (p, g, least) in BASE.items()] + [(k, p, g, least, most) for k, _, p, g, least, most in WEAK]
    groups = {p: g for _, p, g, _, _ in kinds}
    mixed = {p for k, p, *_ in kinds if k == "mixed_token"}
    names = {p: f"_m{i}" for i, p in enumerate(groups)}
    scan = lambda p: F.lit(_SCAN.get(p, p))
    empty = F.expr("cast(array() as array<string>)")

    def hits(p: str) -> Column:
        found = F.regexp_extract_all(text, scan(p), F.lit(0))
        return F.when(F.contains(text, F.lit(_HOLDS[p])), found).otherwise(empty) if p in _HOLDS else found

    def lengths(p: str) -> Column:
        found = F.col(names[p])
        gaps = F.slice(F.split(text, _SCAN.get(p, p), -1), 1, F.size(found))
        n = (lambda h: F.length(F.regexp_extract(h, p, groups[p]))) if groups[p] else F.length
        both = (lambda h: h.rlike("[a-z]") & h.rlike("[A-Z]") & h.rlike("[0-9]")) if p in mixed else (lambda h: F.lit(True))
        each = F.zip_with(gaps, found, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"), n(h).alias("n"), both(h).alias("mixed")))
        return F.when(F.size(found) > 0, each).otherwise(F.expr("cast(array() as array<struct<gap:int,hit:int,n:int,mixed:boolean>>)"))

    def spans(rank: int) -> Column:
        _, p, _, least, most = kinds[rank]
        inside = F.filter(names[p], lambda m: m["n"].between(least, most) & m["mixed"])
        return F.transform(inside, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))

    kept = [F.col(f"`{c}`") for c in docs.columns]
    found = docs.select(*kept, *[hits(p).alias(n) for p, n in names.items()])
    measured = found.select(*kept, *[lengths(p).alias(n) for p, n in names.items()])
    placed = measured.select(*kept, *[_placed(F.col(n)).alias(n) for n in names.values()])
    base, weak = range(len(BASE)), range(len(BASE), len(kinds))
    return placed.select(*kept, *[F.array_sort(F.concat(*map(spans, ranks))).alias(name) for name, ranks in (("base", base), ("weak", weak))])


def _linked(scanned: DataFrame, reach: int) -> DataFrame:
    """(KEY, linked): weak spans whose complement lies within ``reach`` code points.

    An interval join: parts of a document meet in bins of ``reach`` code points.
    Bins hold a bounded number of parts, as a part has seven characters at least.
    A weak identifier needs a secret, a weak secret an identifier, an endpoint
    both.  What overlaps a base span is part of it and no candidate.
    """
    many = scanned.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1))
    parts = many.select(*KEY, F.explode(F.concat("base", "weak")).alias("p")).distinct().select(*KEY, "p.*")
    bins = lambda margin: F.explode(F.sequence(F.floor((F.col("start") - margin) / reach), F.floor((F.col("end") + margin) / reach)))
    weak = parts.where(F.col("rank") >= len(BASE)).withColumn("bin", bins(reach)).alias("w")
    near = parts.where(_is(F.col("rank"), "id") | _is(F.col("rank"), "secret")).withColumn("bin", bins(0)).alias("o")
    s, e, start, end, other = (F.col(c) for c in ("o.start", "o.end", "w.start", "w.end", "o.rank"))
    met = weak.join(near, reduce(and_, [F.col(f"w.{k}").eqNullSafe(F.col(f"o.{k}")) for k in (*KEY, "bin")]) & (s < end + reach) & (e > start - reach))
    apart = (s >= end) | (e <= start)
    seen = met.groupBy(*[F.col(f"w.{k}").alias(k) for k in KEY], F.struct("w.start", "w.rank", "w.end").alias("span")).agg(
        F.bool_or(apart & _is(other, "id")).alias("with_id"),
        F.bool_or(apart & _is(other, "secret")).alias("with_secret"),
        F.bool_or(~apart & (other < len(BASE))).alias("covered"),
    )
    rank = F.col("span.rank")
    complete = F.when(_is(rank, "id"), F.col("with_secret")).when(_is(rank, "secret"), F.col("with_id")).otherwise(F.col("with_id") & F.col("with_secret"))
    return seen.where(complete & ~F.col("covered")).groupBy(*KEY).agg(F.collect_list("span").alias("linked"))


def _with_linked(scanned: DataFrame, reach: int) -> DataFrame:
    linked = _linked(scanned, reach).alias("k")
    on = reduce(and_, [F.col(f"d.{k}").eqNullSafe(F.col(f"k.{k}")) for k in KEY])
    spans = F.array_sort(F.concat("d.base", F.coalesce("k.linked", _none())))
    return scanned.alias("d").join(linked, on, "left").select("d.*", spans.alias("spans"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Secrets of every whole text: base patterns, and weak parts where complementary ones co-occur.

    Base spans are the passing leftmost matches of each kind in ``BASE``.  Weak
    parts (``WEAK``: short keys and passwords, logins, mixed tokens, endpoints) are
    reported only beside their complement (see ``_linked``).  Offsets are code
    points, ends exclusive; spans come by start, then kind.

    Result, a row for each input row: doc_id, ``base`` and ``spans`` (arrays of
    start, rank in ``KINDS``, end).  Null and empty texts have no spans.  Rows with
    null or repeated ids are told apart by their texts; equal rows get equal spans.
    Other columns are not looked at, whatever their names.

    One pass reads the texts; the spans, far smaller, are kept as a table, as the
    interval join and the result both read them.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = slim.select("doc_id", F.xxhash64("text").alias("text_hash"), F.length("text").alias("text_length"), "text")
    kept = Scratch(docs.sparkSession, "secrets").save(_scanned(keyed, F.col("text")).drop("text"))
    return _with_linked(kept, reach).select("doc_id", "base", "spans")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` with every span of ``find_secrets`` replaced by <KIND>; overlapping spans become the first one's tag.

    All rows and columns stay.  The texts are scanned once; the spans, far smaller,
    are kept as a table and joined to the rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = [F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.length(text).alias("text_length")]
    keyed = docs.select(F.struct("*").alias("row"), *key)
    kept = Scratch(docs.sparkSession, "redaction").save(_scanned(docs.select(*key, text.alias("text")), F.col("text")).drop("text"))
    found = kept.where("size(base) + size(weak) > 0").dropDuplicates(list(KEY))
    spans = _with_linked(found, reach).where("size(spans) > 0").select(*KEY, "spans").alias("k")
    on = reduce(and_, [F.col(f"d.{k}").eqNullSafe(F.col(f"k.{k}")) for k in KEY])
    spanned = keyed.alias("d").join(spans, on, "left").select("d.row", "d.text_length", "k.spans")
    body = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(body, acc["at"] + 1, x["start"] - acc["at"])
        new = F.concat(acc["out"], gap, F.element_at(names, x["rank"] + 1))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    tail = lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.col("text_length")))
    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, tail)
    changed = F.when(F.col("spans").isNotNull(), clean).otherwise(F.col(f"row.`{text_col}`"))
    return spanned.select(*[changed.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, text))


def op10(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def _oracle() -> str:
    """DuckDB SQL for op10, its patterns spelled from the tables above."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = [(k, p, g, least, 1 << 30) for k, (p, g, least) in BASE.items()] + [(k, p, g, lo, hi) for k, _, p, g, lo, hi in WEAK]
    ctes = []
    for rank, (k, p, g, lo, hi) in enumerate(kinds):
        value = f"regexp_extract(m[i], {q(p)}, {g})" if g else "m[i]"
        mixed = " AND regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[0-9]')" if k == "mixed_token" else ""
        ctes.append(
            f"""m{rank} AS (
    SELECT d, {rank} AS rank, s + 0 AS s, s + length(m[i]) AS e FROM (
        SELECT d, m, i, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
        FROM (SELECT d, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT d, regexp_extract_all(t, {q(p)}) AS m, string_split_regex(t, {q(p)}) AS g FROM docs))
    ) WHERE length({value}) BETWEEN {lo} AND {hi}{mixed}
)"""
        )
    ids = ", ".join(str(i) for i, k in enumerate(KINDS) if ROLES[k] == "id")
    secrets = ", ".join(str(i) for i, k in enumerate(KINDS) if ROLES[k] == "secret")
    nb = len(BASE)
    names = "[" + ", ".join(q(k) for k in KINDS) + "]"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(ctes)},
parts AS ({" UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(len(KINDS)))}),
seen AS (
    SELECT w.d, w.rank, w.s, w.e, bool_or(apart AND o.rank IN ({ids})) AS with_id, bool_or(apart AND o.rank IN ({secrets})) AS with_secret, bool_or(NOT apart AND o.rank < {nb}) AS covered
    FROM (SELECT w.*, o.rank AS orank, o.s AS os, o.e AS oe, (o.s >= w.e OR o.e <= w.s) AS apart FROM parts w JOIN parts o ON w.d = o.d AND o.s < w.e + {REACH} AND o.e > w.s - {REACH} WHERE w.rank >= {nb}) w
    JOIN (SELECT DISTINCT rank FROM parts) o ON o.rank = w.orank
    GROUP BY ALL
), spans AS (
    SELECT d, rank, s, e FROM parts WHERE rank < {nb}
    UNION ALL
    SELECT d, rank, s, e FROM seen WHERE NOT covered AND CASE WHEN rank IN ({ids}) THEN with_secret WHEN rank IN ({secrets}) THEN with_id ELSE with_id AND with_secret END
), told AS (
    SELECT d, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS h,
           string_agg({names}[rank + 1] || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {nb}) AS base,
           string_agg({names}[rank + 1] || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
    FROM spans GROUP BY d
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (d)
"""


ORACLE_SQL = _oracle()
