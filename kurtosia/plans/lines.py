"""Queries of record validation: lines made from events, each with its numbers and one of many faults, and SQL over DuckDB's JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kurtosia.operators import records as r

#: A good record; @ becomes the event's number.
RECORD = '{"reason":"ok","fs_hz":400.0,"fg_hz":null,"rpm":@,"amp_1x_g":[0.1,0.2,0.3],"ratio_1x":1.5,"imbalance":"normal","imbalance_votes":3,"samples":512,"acquisition":{"v":1,"session":"00112233aabbCCDD","seq":@4,"start_us":@1000,"end_us":@1278501000,"gap_us":@,"valid":true,"reason":"ok"},"runtime":{"v":1,"pre_emit_us":@,"previous_emit":{"seq":@3,"call_us":7},"heap":{"free_bytes":@10,"min_free_bytes":@05,"largest_free_bytes":@09}}}'
RECORD = RECORD.replace('"start_us":@1000,"end_us":@1278501000', '"start_us":9000000000000,"end_us":9000001277500')
_A, _R = '"acquisition":', ',"runtime":{"v":1,"pre_emit_us":@,"previous_emit":{"seq":@3,"call_us":7},"heap":{"free_bytes":@10,"min_free_bytes":@05,"largest_free_bytes":@09}}'
FAULTS = [
    ("", ""), ('"imbalance_votes":3', '"imbalance_votes":true'), ('"rpm":@', '"rpm":"@"'), ('"imbalance_votes":3', '"imbalance_votes":3.5'), ("[0.1,0.2,0.3]", "[0.1,0.2]"), ("[0.1,0.2,0.3]", "[0.1,0.2,true]"), ("[0.1,0.2,0.3]", "null"),
    ('"seq":@4', '"seq":9007199254740992'), ("00112233aabbCCDD", "0011"), ('"valid":true', '"valid":1'), ('"valid":true', '"valid":false'), ("9000001277500", "9000002277500"), ('"seq":@3', '"seq":@2'), ('"min_free_bytes":@05', '"min_free_bytes":9@00'),
    ('"samples":512', '"samples":1'), ('"end_us":9000001277500', '"end_us":9000000000000'), ('"reason":"ok","fs_hz"', '"fs_hz"'), ('"v":1,"pre', '"v":2,"pre'), ('"samples":512', '"samples":400'), ('"samples":512', '"samples":0'), ('"samples":512', '"samples":513'), ('"samples":512,', ""), (_R, ""), (_R, ',"runtime":[]'),
    ('"v":1,"session"', '"session"'), ('"gap_us":@,', ""), ('"gap_us":@', '"gap_us":9900000000000'), ('"end_us":9000001277500', '"end_us":1'), ('"valid":true,"reason":"ok"', '"valid":false,"reason":"no_samples"'), ('"previous_emit":{"seq":@3,"call_us":7}', '"previous_emit":null'),
    ('"call_us":7', '"call_us":-7'), ('"heap":{', '"heap":[],"other":{'), ('"imbalance":"normal"', '"imbalance":null'), ('"fs_hz":400.0', '"fs_hz":null,"context_id":"c-1","baseline_id":@1'), ('"fs_hz":400.0', '"fs_hz":1,"context_id":null,"baseline_id":7'),
    ('"fs_hz":400.0', '"fs_hz":1,"context_id":"<script>","baseline_id":7'), ('"fs_hz":400.0', '"fs_hz":1,"baseline_id":7'), ('"fs_hz":400.0', '"fs_hz":1,"context_id":"a","baseline_id":0'), ('"fs_hz":400.0', '"fs_hz":1,"collector_report_transport":{}'), (_A, '"acquisition":7,"was":'), ("{", "{{"),
]
#: One sample, whose start and end are one time; and such a record whose times differ.
ONE_SAMPLE = RECORD.replace('"samples":512', '"samples":1').replace('"valid":true,"reason":"ok"', '"valid":false,"reason":"partial_window"')
LINES = [RECORD.replace(old, new, 1) if old else RECORD for old, new in FAULTS] + [ONE_SAMPLE, ONE_SAMPLE.replace("9000001277500", "9000000000000"), "  ", "boot @ ok", '[1,"@"]', "{}", '{"reason":']

_BASE = '{"id":@%d,"context_id":"pump-1","ppr":2,"amplitude_g":[0.05,0.1,4],"learn_count":336,"origin":"learned","session":"0123456789abcdef","seq":@}'
PROFILE = '{"event":"profile","v":1,"command":"approve","ok":true,"reason":"saved","firmware":"postreport_v2","profile":{"selected":{"context_id":"pump-1","ppr":2},"current":%s,"candidate":null,"previous":%s,"baseline_ready":true,"learning":false,"learn_count":0,"paused":false,"storage":{"hold":false,"reason":"saved","generation":@},"legacy":{"valid":false,"reason":"none"}}}' % (_BASE % 1, _BASE % 2)
PROFILE_FAULTS = [
    ("", ""), ('"v":1', '"v":true'), ('"v":1', '"v":2'), ('"event":"profile"', '"event":"unknown"'), ('"command":"approve"', '"command":"fly"'), ('"command":"approve"', '"command":[]'), ('"ok":true', '"ok":1'), ('"reason":"saved","firmware"', '"reason":"<img>","firmware"'), ("postreport_v2", "v3"),
    ('"pump-1","ppr":2},', '"pump-1","ppr":17},'), ('"pump-1","ppr":2},', '"pump-1","ppr":true},'), ('"pump-1","ppr":2},', 'null,"ppr":0},'), ('"pump-1","ppr":2},', '"pump-2","ppr":2},'), ('"id":@1', '"id":0'), ('"id":@1', '"id":4294967296'), ('"id":@1', '"id":@2'), ('"context_id":"pump-1","ppr":2,', '"context_id":null,"ppr":2,'),
    ('"ppr":2,"amp', '"ppr":0,"amp'), ('"seq":@}', '"seq":-1}'), ("0123456789abcdef", "0123456789ABCDEF"), ("[0.05,0.1,4]", "[0,0.1,4]"), ("[0.05,0.1,4]", "[0.05,0.1,4.01]"), ("[0.05,0.1,4]", "[]"), ('"learn_count":336', '"learn_count":335'), ('"origin":"learned"', '"origin":"legacy_import"'), ('"origin":"learned"', '"origin":[]'),
    ('"generation":@', '"generation":-1'), ('"hold":false', '"hold":true'), ('"hold":false', '"hold":1'), ('"learn_count":0', '"learn_count":1'), ('"learning":false,"learn_count":0', '"learning":true,"learn_count":1'), ('"learn_count":0', '"learn_count":337'), ('"paused":false', '"paused":1'), ('"valid":false', '"valid":1'),
    ('"candidate":null', '"candidate":null,"more":1'), ('"candidate":null,', ""), ('"reason":"none"}', '"reason":"none","x":1}'), ('"event":', '"x":1,"event":'), ('"current":{"id"', '"current":{"x":1,"id"'), ('"selected":{', '"selected":[],"chosen":{'), ('"baseline_ready":true', '"baseline_ready":false'),
]
PROFILE_LINES = [PROFILE.replace(old, new, 1) if old else PROFILE for old, new in PROFILE_FAULTS] + ['{"event":"profile"}', "boot"]


def _made(spark: SparkSession, sf_dir: str, lines: list[str]) -> DataFrame:
    """A line for each event: the one at its number among ``lines``, with the number in it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    line = F.element_at(F.array(*[F.lit(x) for x in lines]), (F.col("event_id") % len(lines) + 1).cast("int"))
    number = F.when(F.col("event_id") > 0, F.col("event_id").cast("string")).otherwise("1")
    return events.select("event_id", F.replace(line, F.lit("@"), number).alias("line"))


def record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement lines with acquisition and runtime."""
    return r.measurements(_made(spark, sf_dir, LINES), "line").select("event_id", "kind", F.array_join("errors", ";").alias("errors"))


def profile_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.profile_events(_made(spark, sf_dir, PROFILE_LINES), "line").select("event_id", "kind", F.array_join("errors", ";").alias("errors"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _type(path: str) -> str:
    return f"json_type(j, '$.{path}')"


def _whole(path: str) -> str:
    return f"CASE WHEN {_type(path)} IN ('UBIGINT', 'BIGINT') THEN TRY_CAST(json_extract_string(j, '$.{path}') AS HUGEINT) END"


def _text(path: str) -> str:
    return f"CASE WHEN {_type(path)} = 'VARCHAR' THEN json_extract_string(j, '$.{path}') END"


def _true(path: str) -> str:
    return f"CASE WHEN {_type(path)} = 'BOOLEAN' THEN json_extract_string(j, '$.{path}') = 'true' END"


def _fits(path: str, kind: str) -> str:
    if kind in r.RANGES:
        return f"{_whole(path)} BETWEEN {r.RANGES[kind][0]} AND {r.RANGES[kind][1]}"
    if kind in r.WORDS:
        return f"{_text(path)} IN ({', '.join(map(_quoted, r.WORDS[kind]))})"
    if kind in r.PATTERNS:
        return f"regexp_full_match({_text(path)}, '{r.PATTERNS[kind]}')"
    number = lambda p: f"{_type(p)} IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT', 'DOUBLE')"
    if kind == "number":
        return number(path)
    if kind.startswith("three_"):
        each = [number(f"{path}[{i}]") + (f" AND TRY_CAST(json_extract_string(j, '$.{path}[{i}]') AS DOUBLE) BETWEEN 0.001 AND 4" if kind == "three_amplitudes" else "") for i in range(3)]
        return f"{_type(path)} = 'ARRAY' AND json_array_length(j, '$.{path}') = 3 AND {' AND '.join(each)}"
    return f"{_type(path)} = '{ {'string': 'VARCHAR', 'boolean': 'BOOLEAN', 'object': 'OBJECT'}.get(kind, '')}'" if kind != "integer" else f"{_type(path)} IN ('UBIGINT', 'BIGINT')"


def _typed(fields: dict[str, str], at: str = "", given: str = "TRUE") -> list[tuple[str, str]]:
    out = []
    for name, kind in fields.items():
        p, k = at + name, kind.rstrip("?")
        null = f" AND {_type(p)} <> 'NULL'" if kind.endswith("?") else ""
        out += [(f"{given} AND {_type(p)} IS NULL", f"{p}:missing"), (f"{given} AND {_type(p)} IS NOT NULL AND NOT coalesce({_fits(p, k)}, FALSE){null}", f"{p}:not_{k}")]
    return out


def _told(checks: list[tuple[str, str]]) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for bad, code in checks) + ")"


def _optional(path: str, told: str) -> str:
    return f"CASE WHEN {_type(path)} IS NULL THEN NULL WHEN {_type(path)} <> 'OBJECT' THEN '{path}:not_object' ELSE nullif({told}, '') END"


_LINE = "CASE WHEN line IS NULL OR trim(line) = '' THEN 'blank' WHEN NOT starts_with(trim(line), '{') THEN 'console' WHEN j IS NULL THEN 'bad_json' ELSE 'record' END AS kind"


def _sql(lines: list[str], errors: str, before: str = "") -> str:
    made = f"SELECT event_id, replace([{', '.join(map(_quoted, lines))}][event_id % {len(lines)} + 1], '@', CASE WHEN event_id > 0 THEN CAST(event_id AS VARCHAR) ELSE '1' END) AS line FROM events"
    return f"""
WITH l AS ({made}), j AS (SELECT *, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS j FROM l){before}
SELECT event_id, {_LINE}, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'record:not_object' ELSE {errors} END AS errors FROM {"j" if not before else "k"}
"""


def _record_sql() -> str:
    own = _typed(r.MEASUREMENT)
    c, b = _type("context_id"), _type("baseline_id")
    own += [
        (f"({c} IS NULL) <> ({b} IS NULL)", "context_and_baseline:apart"),
        (f"{b} IS NOT NULL AND {c} <> 'NULL' AND NOT coalesce({_fits('context_id', 'context')}, FALSE)", "context_id:not_context"),
        (f"{c} IS NOT NULL AND {b} <> 'NULL' AND NOT coalesce({_fits('baseline_id', 'id')}, FALSE)", "baseline_id:not_id"),
        (f"{b} <> 'NULL' AND {c} = 'NULL'", "baseline_id:without_context"),
        (f"{_type(r.RESERVED)} IS NOT NULL", f"{r.RESERVED}:reserved"),
    ]
    n, q, s, e, g, v, why = ("n", "q", "s", "e", "g", "v", "why")
    cols = f"{_whole('samples')} AS n, {_whole('acquisition.seq')} AS q, {_whole('acquisition.start_us')} AS s, {_whole('acquisition.end_us')} AS e, {_whole('acquisition.gap_us')} AS g, {_true('acquisition.valid')} AS v, {_text('acquisition.reason')} AS why"
    relations = [
        (f"{n} = 0 AND NOT ({s} IS NULL AND {e} IS NULL AND {g} IS NULL AND {why} = 'no_samples' AND NOT {v})", "acquisition:empty_window"),
        (f"{n} > 0 AND ({s} IS NULL OR {e} IS NULL OR {e} < {s} OR ({n} > 1 AND {e} = {s}) OR ({n} = 1 AND {e} <> {s}))", "acquisition:times_unordered"),
        (f"{n} BETWEEN 1 AND 511 AND NOT ({why} = 'partial_window' AND NOT {v})", "acquisition:partial_window"),
        (f"{n} = 512 AND {why} IN ('no_samples', 'partial_window')", "acquisition:full_window"),
        (f"{v} <> ({why} = 'ok')", "acquisition:validity"),
        (f"{v} AND {e} > {s} AND NOT 511e6 / ({e} - {s}) BETWEEN 380 AND 420", "acquisition:rate"),
        (f"{q} = 0 AND {g} IS NOT NULL", "acquisition:gap_of_first"),
        (f"{g} > {s}", "acquisition:gap_before_boot"),
    ]
    types = _told(_typed(r.ACQUISITION, "acquisition.") + [(f"NOT coalesce({_fits('samples', 'samples')}, FALSE)", "samples:not_samples")])
    acquisition = _optional("acquisition", f"CASE WHEN {types} <> '' THEN {types} ELSE {_told(relations)} END")
    previous, heap = f"{_type('runtime.previous_emit')} = 'OBJECT'", f"{_type('runtime.heap')} = 'OBJECT'"
    h = [_whole(f"runtime.heap.{x}") for x in r.HEAP]
    runtime = _typed(r.RUNTIME, "runtime.") + _typed(r.PREVIOUS_EMIT, "runtime.previous_emit.", previous) + _typed(r.HEAP, "runtime.heap.", heap)
    runtime += [
        (f"NOT coalesce({_fits('acquisition.seq', 'counter')}, FALSE)", "runtime:without_sequence"),
        (f"{previous} AND {_whole('runtime.previous_emit.seq')} <> {q} - 1", "runtime:previous_emit"),
        (f"{_type('runtime.previous_emit')} = 'NULL' AND {q} <> 0", "runtime:no_previous_emit"),
        (f"greatest({h[1]}, {h[2]}) > {h[0]}", "runtime:heap"),
    ]
    errors = f"concat_ws(';', nullif({_told(own)}, ''), {acquisition}, {_optional('runtime', _told(runtime))})"
    return _sql(LINES, errors, f", k AS (SELECT *, {cols} FROM j)")


def _closed(path: str, fields: dict[str, str]) -> str:
    p = f", '$.{path}'" if path else ""
    kind = _type(path) if path else "json_type(j)"
    return f"coalesce({kind} = 'OBJECT' AND len(json_keys(j{p})) = {len(fields)} AND list_has_all(json_keys(j{p}), [{', '.join(map(_quoted, fields))}]), FALSE)"


def _profile_sql() -> str:
    parts = {"selected": r.SELECTED, "storage": r.STORAGE, "legacy": r.LEGACY}
    level = [(f"NOT {_closed(f'profile.{p}', fields)}", f"profile.{p}:keys") for p, fields in parts.items()]
    for p, fields in parts.items():
        level += _typed(fields, f"profile.{p}.", _closed(f"profile.{p}", fields))
    ids = []
    for b in r.BASELINES:
        at = f"profile.{b}"
        good = _closed(at, r.BASELINE)
        level.append((f"{_type(at)} <> 'NULL' AND NOT {good}", f"{at}:keys"))
        level += _typed(r.BASELINE, f"{at}.", good)
        level.append((f"{good} AND {_whole(f'{at}.learn_count')} <> CASE WHEN {_text(f'{at}.origin')} = 'learned' THEN 336 ELSE 0 END", f"{at}:origin"))
        ids.append(f"CASE WHEN {good} AND {_fits(f'{at}.id', 'id')} AND {_fits(f'{at}.context_id', 'context')} AND {_fits(f'{at}.ppr', 'ppr')} THEN {_whole(f'{at}.id')} END")
    known = f"list_filter([{', '.join(ids)}], lambda x: x IS NOT NULL)"
    level += [(f"len({known}) <> len(list_distinct({known}))", "profile:repeated_id"), (f"NOT {_true('profile.learning')} AND {_whole('profile.learn_count')} <> 0", "profile.learn_count:not_learning")]
    flat = {k: v for k, v in r.PROFILE.items() if k not in parts and k not in r.BASELINES}
    inner = f"CASE WHEN NOT {_closed('profile', r.PROFILE)} THEN 'profile:keys' ELSE nullif({_told(_typed(flat, 'profile.') + level)}, '') END"
    same = [f"{_text('profile.current.context_id')} IS NOT DISTINCT FROM {_text('profile.selected.context_id')}", f"{_whole('profile.current.ppr')} IS NOT DISTINCT FROM {_whole('profile.selected.ppr')}"]
    ready = f"{_true('profile.baseline_ready')} AND NOT ({_type('profile.current')} = 'OBJECT' AND NOT {_true('profile.storage.hold')} AND {same[0]} AND {same[1]})"
    return f"""
WITH k AS ({_sql(PROFILE_LINES, f"CASE WHEN NOT {_closed('', r.EVENT)} THEN 'event:keys' ELSE concat_ws(';', nullif({_told(_typed(r.EVENT))}, ''), {inner}) END").replace(" AS errors FROM j", " AS errors, j FROM j")})
SELECT event_id, kind, CASE WHEN errors = '' AND {ready} THEN 'profile.baseline_ready:unmatched' ELSE errors END AS errors FROM k
"""


QUERIES = {
    "record_errors": (record_errors, _record_sql()),
    "profile_errors": (profile_errors, _profile_sql()),
}
