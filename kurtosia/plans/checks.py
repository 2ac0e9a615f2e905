"""Queries of checked joins, gates, scenarios and continuity, over events, embeddings, orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kurtosia.operators import asof, baseline, framing, gates, joins, metrics, scenarios, sequences, spectrum, voting, waveform
from kurtosia.operators.records import acquisition_reason
from kurtosia.streaming import keyed

from .signals import _LONG, _MAGS, FS, SIZE, vectors
from .stream import _ROWS, KEY, ORDER, events
from .stream import _rows as numbered_events


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def channel_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as four channels of a member; some are missing and some there twice."""
    v = vectors(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 4).alias("member"), (F.col("vec_id") % 4).alias("channel"), F.col("x")[0].alias("x"))
    rows = v.where("vec_id % 37 <> 5").unionByName(v.where("vec_id % 41 = 7"))
    return joins.channel_matrix(rows, ["member"], "channel", [0, 1, 2, 3], ["x"]).select("member", *[_r(f"x_{c}").alias(f"x_{c}") for c in range(4)], "reason")


CHANNEL_SQL = f"""
WITH v AS (SELECT vec_id, vec_id // 4 AS member, vec_id % 4 AS channel, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), r AS (SELECT * FROM v WHERE vec_id % 37 <> 5 UNION ALL SELECT * FROM v WHERE vec_id % 41 = 7)
SELECT member, {", ".join(f"round(max(x) FILTER (channel = {c}), 6) AS x_{c}" for c in range(4))},
       CASE WHEN greatest({", ".join(f"count(*) FILTER (channel = {c})" for c in range(4))}) > 1 THEN 'repeated_channel'
            WHEN least({", ".join(f"count(x) FILTER (channel = {c})" for c in range(4))}) < 1 THEN 'missing_channel' ELSE 'ok' END AS reason
FROM r GROUP BY member
"""


def merged_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in two overlapping caches that disagree here and there."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price"))
    key = F.col("o_orderkey")
    second = o.where(key % 3 != 1).select("o_orderkey", F.when(key % 70 == 5, "X").otherwise(F.col("status")).alias("status"), (F.col("price") + F.when(key % 50 == 2, 0.01).otherwise(0.0)).alias("price"))
    return joins.merged_caches(o.where(key % 3 != 0), second, ["o_orderkey"], ["status"], ["price"]).withColumn("price", _r("price", 2))


MERGED_SQL = """
WITH o AS (SELECT o_orderkey, o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS price FROM orders),
f AS (SELECT o_orderkey, count(*) AS n, min({'status': status, 'price': price}) AS v FROM o WHERE o_orderkey % 3 <> 0 GROUP BY o_orderkey),
s AS (SELECT o_orderkey, count(*) AS n, min({'status': CASE WHEN o_orderkey % 70 = 5 THEN 'X' ELSE status END, 'price': price + CASE WHEN o_orderkey % 50 = 2 THEN 0.01 ELSE 0 END}) AS v FROM o WHERE o_orderkey % 3 <> 1 GROUP BY o_orderkey)
SELECT coalesce(f.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(f.v, s.v).status AS status, round(coalesce(f.v, s.v).price, 2) AS price,
       CASE WHEN f.n IS NULL THEN 'second' WHEN s.n IS NULL THEN 'first' ELSE 'both' END AS source,
       CASE WHEN f.n > 1 OR s.n > 1 THEN 'repeated_key' WHEN f.v.status <> s.v.status THEN 'provenance' WHEN abs(f.v.price - s.v.price) > 1e-14 + 1e-12 * abs(s.v.price) THEN 'values' ELSE 'ok' END AS reason
FROM f FULL JOIN s ON f.o_orderkey = s.o_orderkey
"""


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values relative to the one calibration row of their speed."""
    rows = events(spark, sf_dir).withColumn("speed", F.floor("value") % 400)
    out = joins.relative_to_calibration(rows, ["speed"], ["value"], F.col("event_id") % 29 == 0)
    return out.select("event_id", "speed", _r("value_relative").alias("relative"), "reason")


CALIBRATED_SQL = """
WITH r AS (SELECT event_id, value, CAST(floor(value) AS BIGINT) % 400 AS speed FROM events), c AS (SELECT speed, count(*) AS n, max(value) AS v FROM r WHERE event_id % 29 = 0 GROUP BY speed)
SELECT event_id, r.speed, CASE WHEN n = 1 THEN round(value - v, 6) END AS relative, CASE WHEN n IS NULL THEN 'no_calibration' WHEN n > 1 THEN 'repeated_calibration' ELSE 'ok' END AS reason FROM r LEFT JOIN c ON r.speed = c.speed
"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rows of trials: five a label, a fold each."""
    return vectors(spark, sf_dir).select("vec_id", "label", "x", (F.col("vec_id") % 5).cast("int").alias("fold"), (F.col("label") * 5 + F.col("vec_id") % 5).alias("trial"))


_TRIALS = "t AS (SELECT vec_id, label, embedding, CAST(vec_id % 5 AS INT) AS fold, label * 5 + vec_id % 5 AS trial FROM embeddings)"
_ROLES = "x AS (SELECT label, trial, fold, h.range AS holdout FROM (SELECT DISTINCT label, trial, fold FROM t), range(5) h), k AS (SELECT *, row_number() OVER (PARTITION BY holdout, label, fold <> holdout ORDER BY trial) AS rk FROM x)"


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.memberships(trials(spark, sf_dir), "label", "trial", "fold", range(5), 2).select("vec_id", "holdout", "role")


MEMBERSHIPS_SQL = f"""
WITH {_TRIALS}, {_ROLES}
SELECT vec_id, CAST(holdout AS INT) AS holdout, CASE WHEN k.fold = holdout THEN 'test' WHEN rk <= 2 THEN 'train' ELSE 'unused' END AS role FROM t JOIN k ON t.label = k.label AND t.trial = k.trial AND t.fold = k.fold
"""


def held_out_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.held_out_centroids(trials(spark, sf_dir), "label", "x", "fold", "vec_id").select("vec_id", "fold", "predicted", _r("distance").alias("distance"))


HELD_OUT_SQL = f"""
WITH {_LONG}, f AS (SELECT *, vec_id % 5 AS fold FROM s),
m AS (SELECT h.range AS fold, label, i, avg(x) AS x FROM f JOIN range(5) h ON f.fold <> h.range GROUP BY h.range, label, i),
d AS (SELECT vec_id, f.fold, m.label, sum((f.x - m.x) * (f.x - m.x)) AS d FROM f JOIN m ON f.i = m.i AND f.fold = m.fold GROUP BY vec_id, f.fold, m.label)
SELECT vec_id, CAST(any_value(fold) AS INT) AS fold, arg_min(label, (d, label)) AS predicted, round(min(d), 6) AS distance FROM d GROUP BY vec_id
"""


def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.centroid_learning_curve(trials(spark, sf_dir), "label", "x", "trial", "fold", "vec_id", range(5), (1, 2, 3, 4))
    return out.withColumn("accuracy", _r("accuracy"))


LEARNING_SQL = f"""
WITH {_TRIALS}, {_ROLES}, {_LONG},
tr AS (SELECT c.range AS trials, k.holdout, t.vec_id FROM t JOIN k ON t.label = k.label AND t.trial = k.trial JOIN range(1, 5) c ON k.fold <> holdout AND rk <= c.range),
m AS (SELECT tr.trials, tr.holdout, label, i, avg(x) AS x FROM tr JOIN s ON tr.vec_id = s.vec_id GROUP BY ALL),
d AS (SELECT m.trials, s.vec_id, s.label AS truth, m.label, sum((s.x - m.x) * (s.x - m.x)) AS d FROM s JOIN m ON s.i = m.i AND s.vec_id % 5 = m.holdout GROUP BY ALL),
p AS (SELECT trials, vec_id, any_value(truth) AS truth, arg_min(label, (d, label)) AS predicted FROM d GROUP BY trials, vec_id)
SELECT CAST(trials AS INT) AS trials, count(*) AS n, count(*) FILTER (truth = predicted) AS hits, round(count(*) FILTER (truth = predicted) / count(*), 6) AS accuracy FROM p GROUP BY trials
"""


def pinned_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as artifacts against a manifest with some wrong and some absent pins."""
    text = F.coalesce("text", F.lit(""))
    d = _read(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = d.where("doc_id % 9 <> 4").select("doc_id", F.sha2(F.concat(text, F.when(F.col("doc_id") % 7 == 0, "x").otherwise("")), 256).alias("pin"))
    return joins.pinned(manifest, d.where("doc_id % 11 <> 3").select("doc_id", F.sha2(text, 256).alias("found")), "doc_id", "pin", "found").select("doc_id", "status")


PINNED_SQL = """
WITH m AS (SELECT doc_id, sha256(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS pin FROM documents WHERE doc_id % 9 <> 4), a AS (SELECT doc_id, sha256(coalesce(text, '')) AS found FROM documents WHERE doc_id % 11 <> 3)
SELECT coalesce(m.doc_id, a.doc_id) AS doc_id, CASE WHEN found IS NULL THEN 'missing' WHEN pin IS NULL THEN 'unlisted' WHEN pin = found THEN 'ok' ELSE 'hash_differs' END AS status FROM m FULL JOIN a ON m.doc_id = a.doc_id
"""


def member_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return joins.member_sets(e.where("event_type = 'click' and value > 150"), e.where("event_type = 'error' and value > 150"), KEY)


MEMBER_SETS_SQL = """
SELECT user_id, CASE WHEN bool_or(event_type = 'click') AND bool_or(event_type = 'error') THEN 'both' WHEN bool_or(event_type = 'click') THEN 'first' ELSE 'second' END AS side
FROM events WHERE value > 150 AND event_type IN ('click', 'error') GROUP BY user_id
"""


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines dealt to both sides by whole suppliers."""
    rows = _read(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey")
    return joins.group_split(rows, "l_returnflag", "l_suppkey").groupBy("draw", "test", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("groups"))


GROUP_SPLIT_SQL = """
WITH g AS (SELECT DISTINCT l_returnflag, l_suppkey, d.range AS draw FROM lineitem, range(50) d), t AS (SELECT *, CAST('0x' || substr(md5(concat_ws(':', draw, l_suppkey)), 1, 8) AS BIGINT) / 4294967296.0 < 0.3 AS test FROM g),
b AS (SELECT draw, l_returnflag, bool_or(test) AND bool_or(NOT test) AS both_ FROM t GROUP BY draw, l_returnflag), c AS (SELECT min(draw) AS draw FROM (SELECT draw FROM b GROUP BY draw HAVING bool_and(both_)))
SELECT CAST(t.draw AS INT) AS draw, test, l.l_returnflag, count(*) AS n, count(DISTINCT l.l_suppkey) AS groups FROM lineitem l JOIN t ON l.l_suppkey = t.l_suppkey AND l.l_returnflag = t.l_returnflag JOIN c ON c.draw = t.draw GROUP BY ALL
"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven rows of each equipment."""
    return joins.last_rows(events(spark, sf_dir), KEY, ORDER, 7).select("user_id", "event_id", "value", "position")


HISTORY_SQL = """
SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events) WHERE b <= 7
"""


def spaced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spaced_sample(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("price")), ["o_orderkey", "o_custkey", "price"], 100)


SPACED_SQL = """
WITH r AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS price, row_number() OVER (ORDER BY o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE)) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_custkey, price FROM r WHERE n <= 100 OR i IN (SELECT CAST(round_even(j.range * (c.n - 1) / 99, 0) AS BIGINT) FROM range(100) j, (SELECT count(*) AS n FROM orders) c)
"""


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("fs", 396.0 + F.col("vec_id") % 27)
    long = framing.samples(v, ["vec_id", "fs"], "x")
    late = F.when((F.col("vec_id") % 13 == 3) & (F.col("i") == 20), 600).otherwise(0)
    return long.select("vec_id", "fs", "i", (F.col("i") * 2500 + late).alias("t_us"), (F.col("x") * F.when(F.col("vec_id") % 17 == 2, 100.0).otherwise(1.0)).alias("x"))


def _live_gates(spark: SparkSession, sf_dir: str, live: DataFrame) -> DataFrame:
    faults = gates.sample_faults(live, ["vec_id", "fs"], "fs").join(vectors(spark, sf_dir).select("vec_id", "label"), "vec_id")
    reason = gates.live_reason(F.col("vec_id") % 11 != 0, F.col("fs"), F.col("label") * 100.0, (F.col("vec_id") % 7).cast("double"), F.col("bad_sample"), F.col("bad_step"), F.col("seconds"), 0.15)
    return faults.select("vec_id", _r("seconds").alias("seconds"), "bad_sample", "bad_step", reason.alias("reason"))


def live_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live_gates(spark, sf_dir, _live(spark, sf_dir))


def live_gates_of_wrapped_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``live_gates`` of clocks that wrap at 2 ** 32 within most windows, each at another sample: they change nothing."""
    start = F.lit((1 << 32) - 1) - F.col("vec_id") % 90 * 2500
    return _live_gates(spark, sf_dir, _live(spark, sf_dir).withColumn("t_us", F.pmod(F.col("t_us") + start, F.lit(1 << 32))))


LIVE_SQL = f"""
WITH {_LONG}, l AS (SELECT vec_id, label, 396.0 + vec_id % 27 AS fs, i, i * 2500 + CASE WHEN vec_id % 13 = 3 AND i = 20 THEN 600 ELSE 0 END AS t, x * CASE WHEN vec_id % 17 = 2 THEN 100 ELSE 1 END AS x FROM s),
p AS (SELECT *, t - lag(t) OVER (PARTITION BY vec_id ORDER BY i) AS st FROM l),
g AS (SELECT vec_id, any_value(label) AS label, any_value(fs) AS fs, (max(t) - min(t)) / 1e6 AS sec, min(CASE WHEN abs(x) >= 3.95 THEN i END) AS bs, min(CASE WHEN abs(st - 1e6 / fs) > 0.05 * 1e6 / fs THEN i END) AS bt FROM p GROUP BY vec_id)
SELECT vec_id, round(sec, 6) AS seconds, bs AS bad_sample, bt AS bad_step, CASE WHEN vec_id % 11 = 0 THEN 'invalid_acquisition' WHEN fs > 420 OR label <= 0 THEN 'invalid_fs_or_rpm' WHEN vec_id % 7 > 5 THEN 'rotation_spread'
       WHEN bs IS NOT NULL AND bs <= coalesce(bt, 1000000) THEN 'invalid_sensor_sample' WHEN bt IS NOT NULL THEN 'invalid_time_axis' WHEN sec < 0.15 THEN 'insufficient_one_second' ELSE 'ok' END AS reason FROM g
"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten events of an equipment."""
    return numbered_events(spark, sf_dir).withColumn("win", F.floor((F.col("rn") - 1) / 10)).groupBy("user_id", "win").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value") > 150).alias("clipped"), F.bool_or(F.col("value") > 250).alias("over"), F.sum("value").alias("total")
    )


_WINDOWS = f"{_ROWS}, w AS (SELECT user_id, (rn - 1) // 10 AS win, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 150) AS clipped, bool_or(value > 250) AS over_, sum(value) AS total FROM rows_ GROUP BY ALL)"


def sensor_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault, clipped = gates.sensor_state(F.col("failed"), F.col("clipped"), 100)
    reason = acquisition_reason(F.col("n"), F.col("failed") == 0, F.col("failed") > 3, F.col("over"), F.col("total"), 10)
    return _windows(spark, sf_dir).select("user_id", "win", fault.alias("fault"), clipped.alias("clipped"), reason.alias("reason"))


SENSOR_SQL = f"""
WITH {_WINDOWS}
SELECT user_id, win, failed > 2 AS fault, clipped > 1 AS clipped, CASE WHEN n = 0 THEN 'no_samples' WHEN n <> 10 THEN 'partial_window' WHEN failed = 0 THEN 'sample_time' WHEN failed > 3 THEN 'numeric_input' WHEN over_ THEN 'sensor_range' WHEN total < 380 OR total > 420 THEN 'sample_rate' ELSE 'ok' END AS reason FROM w
"""


def support_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows against a baseline whose rates and speeds were 50 to 60 and 20 to 100."""
    w = _windows(spark, sf_dir)
    lit, u = F.lit, F.col("user_id") + F.col("win")
    fields = {
        "sensor_max_hz": lit(100.0), "upper_band_min_hz": lit(80.0), "energy_floor": lit(1e-9), "log_mad_floor": lit(0.1), "z_start": lit(2.0), "z_full": F.when(u % 19 == 0, 2.0).otherwise(6.0), "support_tolerance": F.when(u % 23 == 0, 0.06).otherwise(0.05),
        "relative_abnormality_min": lit(20.0), "relative_strength_sum_min": lit(20.0), "ewma_alpha": F.when(u % 29 == 0, 0.0).otherwise(0.4), "pulses_per_turn": F.when(u % 31 == 0, 0).otherwise(2), "relative_min_windows": lit(3),
    }
    c = w.withColumn("c", F.struct(*[v.alias(k) for k, v in fields.items()])).withColumn("valid", gates.configuration_valid("c"))
    reason = gates.support_reason(
        F.col("valid"), u % 13 != 0, u % 17 != 0, u % 8, F.when(u % 11 == 0, 9).otherwise(u % 8), F.col("clipped") * 3.0 + 50, (lit(50.0), lit(60.0)), F.col("total") / 10, (lit(20.0), lit(100.0)), lit(15), F.when(u % 7 == 0, 14).otherwise(15), F.col("c.support_tolerance")
    )
    return c.select("user_id", "win", "valid", reason.alias("reason"))


SUPPORT_SQL = f"""
WITH {_WINDOWS}, c AS (SELECT *, user_id + win AS u FROM w), v AS (SELECT *, u % 19 <> 0 AND u % 23 <> 0 AND u % 29 <> 0 AND u % 31 <> 0 AS valid FROM c)
SELECT user_id, win, valid, CASE WHEN NOT valid THEN 'invalid_argument' WHEN u % 13 = 0 THEN 'baseline_not_ready' WHEN u % 17 = 0 THEN 'config_changed' WHEN u % 11 = 0 THEN 'axis_support_changed'
       WHEN NOT clipped * 3.0 + 50 BETWEEN 50 * (1 - 0.05::DOUBLE) AND 60 * (1 + 0.05::DOUBLE) THEN 'fs_unsupported' WHEN NOT total / 10 BETWEEN 20 * (1 - 0.05::DOUBLE) AND 100 * (1 + 0.05::DOUBLE) THEN 'rpm_unsupported' WHEN u % 7 = 0 THEN 'band_support_changed' ELSE 'ok' END AS reason FROM v
"""


def top_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda a: F.transform(F.slice("x", a, 3), lambda v: F.abs(v))
    best = gates.top_axis(part(1), F.transform(part(4), lambda v: v - 0.05), 0.02)
    return vectors(spark, sf_dir).select("vec_id", best.alias("b")).select("vec_id", "b.axis", _r("b.ratio").alias("ratio"))


_AXES = ", ".join(f"CASE WHEN abs(CAST(embedding[{i + 4}] AS DOUBLE)) - 0.05 >= 0.02 THEN abs(CAST(embedding[{i + 1}] AS DOUBLE)) / (abs(CAST(embedding[{i + 4}] AS DOUBLE)) - 0.05) ELSE 0 END" for i in range(3))
TOP_AXES_SQL = f"SELECT vec_id, CASE WHEN list_max(r) > 0 THEN CAST(list_position(r, list_max(r)) - 1 AS INT) END AS axis, CASE WHEN list_max(r) > 0 THEN round(list_max(r), 6) END AS ratio FROM (SELECT vec_id, [{_AXES}] AS r FROM embeddings)"


def scenario_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equipments as trials that turn faulty after 30 rows, by plant."""
    rows = numbered_events(spark, sf_dir).withColumns({"plant": F.col("user_id") % 4, "faulty": F.col("rn") > 30, "suspect": F.col("value") > 90})
    judged = voting.confirm_by_rate(rows, KEY, ORDER, "suspect")
    out = scenarios.scenario_statistics(judged, ["plant"], KEY, ORDER, "faulty", "suspect", "confirmed", 25)
    return out.withColumns({c: _r(c) for c in ("false_positive_rate", "false_negative_rate", "confirmed_false_positive_rate", "mean_latency")})


SCENARIO_SQL = f"""
WITH {_ROWS}, c AS (SELECT user_id, event_id, rn, value > 90 AS su, count(*) OVER w = 5 AND sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) OVER w >= 3 AS co FROM rows_ WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING)),
t AS (SELECT user_id % 4 AS plant, user_id, count(*) FILTER (rn <= 30) AS nn, count(*) FILTER (rn <= 30 AND su) AS fs, count(*) FILTER (rn <= 30 AND co) AS fc, count(*) FILTER (rn > 30) AS nf, count(*) FILTER (rn > 30 AND NOT su) AS mi, min(rn - 30) FILTER (rn > 30 AND rn <= 55 AND co) AS la FROM c GROUP BY user_id)
SELECT plant, CASE WHEN sum(nn) > 0 THEN round(sum(fs) / sum(nn), 6) END AS false_positive_rate, CASE WHEN sum(nf) > 0 THEN round(sum(mi) / sum(nf), 6) END AS false_negative_rate, CASE WHEN sum(nn) > 0 THEN round(sum(fc) / sum(nn), 6) END AS confirmed_false_positive_rate,
       count(*) FILTER (nf > 0) AS trials, count(la) AS detected, count(*) FILTER (nf > 0 AND la IS NULL) AS missed_trials, round(avg(la), 6) AS mean_latency FROM t GROUP BY plant
"""


def sensitivity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    fitted = rows.join(baseline.fit_mean_std(rows, KEY, ["value"]), KEY)
    return scenarios.sensitivity_curve(fitted, [], "value", "value_mean", "value_std", (0.25, 0.5, 1.0), (0.0, 0.1, 0.3, 1.0)).withColumn("rate", _r("rate"))


SENSITIVITY_SQL = """
WITH f AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY user_id), g AS (SELECT noise, strength FROM (SELECT unnest([0.25, 0.5, 1.0]) AS noise), (SELECT unnest([0.0, 0.1, 0.3, 1.0]) AS strength))
SELECT CAST(noise AS DOUBLE) AS noise, CAST(strength AS DOUBLE) AS strength, count(*) AS n, count(*) FILTER (abs(value * (1 + CAST(strength AS DOUBLE)) - m) > 3 * s * CAST(noise AS DOUBLE)) AS detected, round(count(*) FILTER (abs(value * (1 + CAST(strength AS DOUBLE)) - m) > 3 * s * CAST(noise AS DOUBLE)) / count(*), 6) AS rate
FROM events JOIN f ON events.user_id = f.user_id, g GROUP BY noise, strength
"""


def harmonic_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mags = spectrum.amplitude(spectrum.fft(vectors(spark, sf_dir), ["vec_id"], "x"), SIZE)
    out = spectrum.harmonic_capture(mags, ["vec_id"], 1.0, 6.0, (-1.5, -0.5, 0.0, 0.5, 1.5), width=2.0)
    return out.groupBy("error", "harmonic").agg(_r(F.avg("captured"), 5).alias("captured"))


CAPTURE_SQL = f"""
WITH {_MAGS}, g AS (SELECT error, harmonic FROM (SELECT unnest([-1.5, -0.5, 0.0, 0.5, 1.5]) AS error), (SELECT unnest([1, 2, 3]) AS harmonic)),
hb AS (SELECT vec_id, error, harmonic, sum(CASE WHEN abs(k - (6 + error) * harmonic) <= 2 THEN mag ELSE 0 END) / sum(CASE WHEN abs(k - 6 * harmonic) <= 2 THEN mag ELSE 0 END) AS c FROM m, g GROUP BY ALL)
SELECT CAST(error AS DOUBLE) AS error, harmonic, round(avg(c), 5) AS captured FROM hb GROUP BY error, harmonic
"""


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imbalance where the caller counts votes; the current window has to be positive too."""
    v = F.col("value")
    rows = events(spark, sf_dir).withColumns({"ratio": F.when(F.col("event_type") != "view", v / 64), "phase": F.when(F.col("event_type") != "login", (v % 10) / 10)})
    rows = voting.votes(rows.withColumn("imbalance", (F.col("ratio") >= 1.1) & (F.col("phase") >= 0.2)), KEY, ORDER, "imbalance")
    status = voting.advisory_status(F.col("ratio"), F.col("phase"), F.col("votes_positive"), F.when(v > 120, "confirmed").otherwise("normal"), 1.1, 0.2, 2)
    return rows.select("user_id", "event_id", status.alias("status"))


ADVISORIES_SQL = """
WITH r AS (SELECT user_id, event_id, value, CASE WHEN event_type <> 'view' THEN value / 64 END AS ratio, CASE WHEN event_type <> 'login' THEN (value % 10) / 10 END AS phase FROM events), f AS (SELECT *, ratio >= 1.1 AND phase >= 0.2 AS b FROM r),
p AS (SELECT *, CASE WHEN b IS NOT NULL THEN sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, b IS NOT NULL ORDER BY event_id ROWS 4 PRECEDING) END AS p0 FROM f),
v AS (SELECT *, coalesce(last_value(p0 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS n FROM p)
SELECT user_id, event_id, CASE WHEN ratio IS NULL OR phase IS NULL THEN 'unavailable' WHEN NOT (ratio >= 1.1 AND phase >= 0.2) OR n < 2 THEN 'normal' WHEN value > 120 THEN 'inspection_required' ELSE 'suspected' END AS status FROM v
"""

_WORST = [f"f{i}" for i in range(4)]


def worst_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", "label", *[F.col("x")[i].alias(f) for i, f in enumerate(_WORST)])
    z = baseline.z_scores(rows, baseline.fit_mean_std(rows, ["label"], _WORST), ["label"], _WORST, logs=False)
    return z.select("vec_id", baseline.worst_feature(_WORST).alias("worst"), _r(F.array_max(F.array(*[F.abs(f"{f}_z") for f in _WORST])), 5).alias("z"))


_Z = ", ".join(f"abs((f{i} - avg(f{i}) OVER w) / stddev_pop(f{i}) OVER w)" for i in range(4))
WORST_SQL = f"""
WITH r AS (SELECT vec_id, label, {", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(4))} FROM embeddings), z AS (SELECT vec_id, [{_Z}] AS z FROM r WINDOW w AS (PARTITION BY label))
SELECT vec_id, 'f' || (list_position(z, list_max(z)) - 1) AS worst, round(list_max(z), 5) AS z FROM z
"""


def refitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit of rows 21 to 40 that keeps the means of the first 20, and the drift against them."""
    rows = numbered_events(spark, sf_dir)
    first, later = (baseline.fit_mean_std(rows.where(F.col("rn").between(a, a + 19)), KEY, ["value"]) for a in (1, 21))
    out = baseline.refit(first, later, KEY, ["value"])
    return out.select("user_id", _r("value_mean").alias("mean"), _r("value_original").alias("original"), baseline.drift_ratio(F.col("value_mean"), F.col("value_original"), 1.2).alias("drift"))


REFITTED_SQL = f"""
WITH {_ROWS}, f AS (SELECT user_id, avg(value) AS m FROM rows_ WHERE rn BETWEEN 1 AND 20 GROUP BY user_id), l AS (SELECT user_id, avg(value) AS m FROM rows_ WHERE rn BETWEEN 21 AND 40 GROUP BY user_id)
SELECT l.user_id, round(l.m, 6) AS mean, round(f.m, 6) AS original, CASE WHEN abs(f.m) >= 1e-9 THEN l.m / f.m >= 1.2 END AS drift FROM l JOIN f ON l.user_id = f.user_id
"""


def pulse_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten pulses, the later ones of an equipment unevenly spaced."""
    late = F.when(F.col("event_type") == "error", F.col("value") * 30).otherwise(F.col("value") * 2)
    pulses = numbered_events(spark, sf_dir).select("user_id", F.floor(F.col("rn") / 10).alias("win"), (F.col("rn") * 10000 + late).alias("t_us"), F.col("rn").alias("ordinal"))
    starts = pulses.groupBy("user_id", "win").agg((F.min("t_us") - 400).alias("start"))
    return asof.window_continuity(pulses, starts, KEY, "win", "start").select("user_id", "win", _r("period", 3).alias("period"), _r("tail", 3).alias("tail"), "continuous")


CONTINUITY_SQL = f"""
WITH {_ROWS}, p AS (SELECT user_id, rn // 10 AS win, rn * 10000 + CASE WHEN event_type = 'error' THEN value * 30 ELSE value * 2 END AS t, rn AS o FROM rows_),
g AS (SELECT user_id, win, min(t) AS ft, max(t) AS lt, arg_min(o, t) AS fo, arg_max(o, t) AS lo, min(t) - 400 AS st, (max(t) - min(t)) / nullif(count(*) - 1, 0) AS pe FROM p GROUP BY user_id, win),
q AS (SELECT *, lag(lt) OVER w AS plt, lag(lo) OVER w AS plo, lag(pe) OVER w AS pp FROM g WINDOW w AS (PARTITION BY user_id ORDER BY win))
SELECT user_id, win, round(pe, 3) AS period, round(st - plt, 3) AS tail, CASE WHEN plt IS NOT NULL THEN coalesce(pp BETWEEN 3000 AND 100000 AND fo - plo = 1 AND abs(ft - plt - pp) <= 0.15 * pp AND st - plt BETWEEN 0 AND 1.1 * pp, FALSE) END AS continuous FROM q
"""


def confirmed_after_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes that begin anew after logins with a gap: temporal resets and reset commands."""
    rows = numbered_events(spark, sf_dir).withColumn("flag", F.when(F.col("event_type") != "error", F.col("value") > 40))
    parts = sequences.segments(rows, KEY, ORDER, (F.col("event_type") == "login") & (F.col("value") > 60))
    return voting.confirm(parts, ["user_id", "segment"], ORDER, "flag").select("user_id", "event_id", "segment", "votes_positive", "votes_valid", "status")


RESETS_SQL = f"""
WITH {_ROWS}, s AS (SELECT *, CASE WHEN event_type <> 'error' THEN value > 40 END AS flag, CAST(sum(CASE WHEN event_type = 'login' AND value > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM rows_),
p AS (SELECT *, CASE WHEN flag IS NOT NULL THEN sum(CASE WHEN flag THEN 1 ELSE 0 END) OVER w END AS p0, CASE WHEN flag IS NOT NULL THEN count(flag) OVER w END AS n0 FROM s WINDOW w AS (PARTITION BY user_id, segment, flag IS NOT NULL ORDER BY event_id ROWS 4 PRECEDING)),
c AS (SELECT *, CAST(coalesce(last_value(p0 IGNORE NULLS) OVER w, 0) AS BIGINT) AS vp, coalesce(last_value(n0 IGNORE NULLS) OVER w, 0) AS vn FROM p WINDOW w AS (PARTITION BY user_id, segment ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, segment, vp AS votes_positive, vn AS votes_valid, CASE WHEN flag IS NULL OR vn < 5 THEN 'unavailable' WHEN vp >= 4 THEN 'confirmed' ELSE 'normal' END AS status FROM c
"""


def bearing_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a bearing detector with gaps, repeats, new sessions, ticks of the clock and unusable windows among them."""
    rn, v = F.col("rn"), F.col("value")
    rows = numbered_events(spark, sf_dir).select(
        "user_id", "event_id", F.concat(F.lit("s"), F.floor(rn / 25).cast("string")).alias("session"),
        F.when(F.floor(v) % 29 != 3, rn - F.when(F.floor(v) % 31 == 5, 1).otherwise(0)).alias("sequence"), (rn * 2048 + F.when(F.floor(v) % 37 == 7, 5).otherwise(0)).alias("start"),
        F.when(rn % 40 < 20, 1797.0).otherwise(1750.0).alias("rpm"), (rn * 1000 + F.when(rn % 17 > 13, 3000).otherwise(0)).alias("now"), (F.floor(v) % 41 != 9).alias("usable"), (v > 20).alias("flag"),
    )
    return sequences.bearing_continuity(rows, KEY, ORDER, "session", "sequence", "start", "rpm", "now", "usable", "flag")


BEARING_SQL = f"""
WITH RECURSIVE {_ROWS},
c AS (SELECT user_id, event_id, rn, 's' || (rn // 25) AS ses, CASE WHEN CAST(floor(value) AS BIGINT) % 29 <> 3 THEN rn - CASE WHEN CAST(floor(value) AS BIGINT) % 31 = 5 THEN 1 ELSE 0 END END AS seq, rn * 2048 + CASE WHEN CAST(floor(value) AS BIGINT) % 37 = 7 THEN 5 ELSE 0 END AS sta,
             CASE WHEN rn % 40 < 20 THEN 1797.0 ELSE 1750.0 END AS rpm, rn * 1000 + CASE WHEN rn % 17 > 13 THEN 3000 ELSE 0 END AS now_, CAST(floor(value) AS BIGINT) % 41 <> 9 AS usable, CASE WHEN value > 20 THEN '1' ELSE '0' END AS f FROM rows_),
t(user_id, event_id, rn, ses, seq, sta, rpm, now_, h, outcome) AS (
    SELECT DISTINCT user_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DECIMAL(5, 1)), CAST(NULL AS BIGINT), CAST('' AS VARCHAR), CAST('' AS VARCHAR) FROM c
    UNION ALL
    SELECT user_id, event_id, rn, CASE WHEN o IN ('first', 'continued', 'restarted') THEN nses WHEN o = 'time' THEN ses END, CASE WHEN o IN ('first', 'continued', 'restarted') THEN nseq WHEN o = 'time' THEN seq END, CASE WHEN o IN ('first', 'continued', 'restarted') THEN nsta WHEN o = 'time' THEN sta END,
           CASE WHEN o IN ('first', 'continued', 'restarted') THEN nrpm WHEN o = 'time' THEN rpm END, CASE WHEN o IN ('first', 'continued', 'restarted') THEN nnow WHEN o = 'time' THEN now_ END,
           CASE WHEN o = 'continued' THEN right(h || f, 5) WHEN o IN ('first', 'restarted') THEN f WHEN o = 'time' THEN h ELSE '' END, o
    FROM (SELECT c.user_id, c.event_id, c.rn, t.ses, t.seq, t.sta, t.rpm, t.now_, t.h, c.ses AS nses, c.seq AS nseq, c.sta AS nsta, c.rpm AS nrpm, c.now_ AS nnow, c.f,
                 CASE WHEN c.seq IS NULL THEN CASE WHEN t.seq IS NOT NULL AND c.now_ - t.now_ > 2000 THEN 'expired' ELSE 'time' END WHEN NOT c.usable THEN 'rejected_unusable' WHEN t.seq IS NULL THEN 'first'
                      WHEN c.ses = t.ses AND (c.seq <= t.seq OR c.sta <= t.sta) THEN 'rejected_repeated' WHEN c.ses <> t.ses OR c.rpm <> t.rpm OR c.seq <> t.seq + 1 OR c.sta <> t.sta + 2048 OR c.now_ - t.now_ > 2000 THEN 'restarted' ELSE 'continued' END AS o
          FROM t JOIN c ON c.user_id = t.user_id AND c.rn = t.rn + 1)
)
SELECT user_id, event_id, outcome, CAST(length(replace(h, '0', '')) AS INT) AS votes_positive, CAST(length(h) AS INT) AS votes_valid, CASE WHEN length(h) < 5 THEN 'unavailable' WHEN length(replace(h, '0', '')) >= 4 THEN 'confirmed' ELSE 'normal' END AS status FROM t WHERE rn > 0
"""

SILENCE_MS = 200_000


def votes_with_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of each user's events in order of time; errors are commands that begin them anew, and silence ends them."""
    timed = _read(spark, sf_dir, "events").withColumns({"t": F.timestamp_seconds("event_id"), "flag": F.when(F.floor("value") % 7 != 3, F.col("value") > 20), "command": F.lit("reset")})
    return keyed.confirmed(timed.where("event_type <> 'error'"), timed.where("event_type = 'error'"), KEY, "t", "event_id", "flag", forget_ms=SILENCE_MS)


VOTES_SQL = f"""
WITH e AS (SELECT user_id, event_id, event_id * 1000 AS ms, event_type = 'error' AS command, CASE WHEN CAST(floor(value) AS BIGINT) % 7 <> 3 THEN CAST(value > 20 AS INT) END AS f FROM events),
g AS (SELECT *, lag(ms) OVER w AS was, lead(ms) OVER w AS next FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT *, sum(CASE WHEN command OR ms - was > {SILENCE_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM g),
v AS (SELECT user_id, event_id, ms, f, list_slice(coalesce(list(f) FILTER (f IS NOT NULL) OVER (PARTITION BY user_id, part ORDER BY event_id), []), -5, -1) AS l FROM p WHERE NOT command)
SELECT user_id, ms AS "at", event_id AS place, CAST(coalesce(list_sum(l), 0) AS BIGINT) AS votes_positive, CAST(len(l) AS BIGINT) AS votes_valid,
       CASE WHEN f IS NULL OR len(l) < 5 THEN 'unavailable' WHEN list_sum(l) >= 4 THEN 'confirmed' ELSE 'normal' END AS status FROM v
UNION ALL SELECT user_id, ms + {SILENCE_MS}, NULL, 0, 0, 'expired' FROM p WHERE next IS NULL OR next - ms > {SILENCE_MS}
"""

COMMAND_LINES = ("context pump-1", "ppr 2", "learn", "learned", "approve 1", "learn", "learned", "approve 2", "rollback", "discard", "context pump-2", "stop", "start", "import fan-3", "clear", "storage_error", "recover", "profile", "dance", "ppr 99", "approve 7")


def profile_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command lines of a baseline store, one for each event."""
    lines = F.array(*[F.lit(x) for x in COMMAND_LINES])
    rows = numbered_events(spark, sf_dir).withColumn("line", F.element_at(lines, (F.when(F.col("event_type") == "view", F.col("rn") - 1).otherwise(F.floor("value")) % len(COMMAND_LINES) + 1).cast("int")))
    return sequences.profile_store(rows, KEY, ORDER, "line")


def _commands_sql() -> str:
    """The store's rules row by row: the reason of each command from the state before it, and what each reason changes."""
    matches = lambda r: f"({r} IS NOT NULL AND {r}_context IS NOT DISTINCT FROM context AND {r}_ppr = ppr)"
    fits = "(length(rest) BETWEEN 1 AND 12 AND regexp_full_match(rest, '[A-Za-z0-9_-]+'))"
    reason = f"""CASE WHEN w = 'storage_error' THEN 'storage_hold' WHEN w = 'profile' THEN 'status' WHEN w = 'stop' THEN 'paused'
        WHEN w = 'recover' THEN CASE WHEN hold THEN 'recovered' ELSE 'recovery_not_required' END
        WHEN w NOT IN ('start', 'learn', 'learned', 'context', 'ppr', 'approve', 'discard', 'rollback', 'import', 'clear') THEN 'unknown_command'
        WHEN hold THEN 'storage_hold' WHEN w = 'start' THEN 'sampling' WHEN w IN ('context', 'import') AND NOT {fits} THEN 'context_invalid'
        WHEN w = 'ppr' AND (number < 1 OR number > 16) THEN 'ppr_invalid' WHEN w = 'learned' AND NOT learning THEN 'not_learning'
        WHEN w IN ('learn', 'learned', 'import') AND candidate IS NOT NULL THEN 'candidate_exists' WHEN w = 'learn' AND learning THEN 'learning_in_progress'
        WHEN w IN ('learn', 'learned') AND context IS NULL OR w IN ('learn', 'learned', 'import') AND ppr = 0 THEN 'selection_required' WHEN w = 'learn' THEN 'started'
        WHEN w = 'approve' AND number = 0 THEN 'candidate_id_invalid' WHEN w = 'approve' AND number IS DISTINCT FROM candidate THEN 'candidate_id_mismatch'
        WHEN w = 'approve' AND NOT {matches("candidate")} THEN 'condition_mismatch' WHEN w = 'discard' AND candidate IS NULL THEN 'candidate_missing'
        WHEN w = 'rollback' AND previous IS NULL THEN 'previous_missing' WHEN w = 'rollback' AND NOT {matches("previous")} THEN 'condition_mismatch' ELSE 'saved' END"""
    made = "reason = 'saved' AND w IN ('learned', 'import')"
    saved = lambda *words: f"reason = 'saved' AND w IN ({', '.join(map(repr, words))})"
    part = lambda r, p: r + p
    profiles = []
    for p, new in (("", "next_id"), ("_context", "CASE WHEN w = 'import' THEN rest ELSE context END"), ("_ppr", "ppr")):
        profiles += [
            f"CASE WHEN {saved('approve')} THEN {part('candidate', p)} WHEN {saved('rollback')} THEN {part('previous', p)} WHEN {saved('clear')} THEN NULL ELSE {part('current', p)} END AS {part('current', p)}",
            f"CASE WHEN {made} THEN {new} WHEN {saved('approve', 'discard', 'clear')} THEN NULL ELSE {part('candidate', p)} END AS {part('candidate', p)}",
            f"CASE WHEN {saved('approve', 'rollback')} THEN {part('current', p)} WHEN {saved('clear')} THEN NULL ELSE {part('previous', p)} END AS {part('previous', p)}",
        ]
    state = [f"{r}{p}" for p in ("", "_context", "_ppr") for r in ("current", "candidate", "previous")]
    lines = "[" + ", ".join(f"'{x}'" for x in COMMAND_LINES) + "]"
    return f"""
WITH RECURSIVE {_ROWS}, l AS (SELECT user_id, event_id, rn, {lines}[1 + CASE WHEN event_type = 'view' THEN rn - 1 ELSE CAST(floor(value) AS BIGINT) END % {len(COMMAND_LINES)}] AS line FROM rows_),
k AS (SELECT user_id, event_id, rn, split_part(line, ' ', 1) AS w, CASE WHEN line LIKE '% %' THEN substr(line, instr(line, ' ') + 1) ELSE '' END AS rest,
             coalesce(try_cast(CASE WHEN regexp_full_match(split_part(line, ' ', 2), '[0-9]+') THEN split_part(line, ' ', 2) END AS BIGINT), 0) AS number FROM l),
t AS (
    SELECT DISTINCT user_id, CAST(-1 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS rn, CAST('' AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS context, CAST(0 AS BIGINT) AS ppr,
           {", ".join(f"CAST(NULL AS {'VARCHAR' if x.endswith('_context') else 'BIGINT'}) AS {x}" for x in state)}, CAST(1 AS BIGINT) AS next_id, CAST(0 AS BIGINT) AS generation, FALSE AS learning, TRUE AS paused, FALSE AS hold FROM k
    UNION ALL
    SELECT user_id, event_id, rn, reason, CASE WHEN {saved("context", "import")} THEN rest WHEN {saved("clear")} THEN NULL ELSE context END, CASE WHEN {saved("ppr")} THEN number WHEN {saved("clear")} THEN 0 ELSE ppr END,
           {", ".join(sorted(profiles, key=lambda x: state.index(x.rpartition(" AS ")[2])))}, next_id + CASE WHEN {made} THEN 1 ELSE 0 END, generation + CASE WHEN reason IN ('saved', 'recovered') THEN 1 ELSE 0 END,
           reason = 'started', CASE WHEN reason = 'paused' OR w = 'recover' THEN TRUE WHEN reason IN ('sampling', 'started') THEN FALSE ELSE paused END, CASE WHEN w = 'storage_error' THEN TRUE WHEN w = 'recover' THEN FALSE ELSE hold END
    FROM (SELECT k.user_id, k.event_id, k.rn, w, rest, number, context, ppr, {", ".join(state)}, next_id, generation, learning, paused, hold, {reason} AS reason FROM t JOIN k ON k.user_id = t.user_id AND k.rn = t.rn + 1)
)
SELECT user_id, event_id, reason IN ('status', 'paused', 'recovered', 'sampling', 'saved', 'started') AS ok, reason, context, CAST(ppr AS INT) AS ppr,
       {", ".join(f"CAST({x} AS INT) AS {x}" if x.endswith("_ppr") else f'{x} AS "{x}"' for x in state)}, next_id, generation, learning, paused, hold FROM t WHERE rn > 0
"""


_WAVE = ["log_rms", *(f"log_h{k}" for k in (1, 2, 3)), "log_hf_fraction", "log_crest", "log_kurtosis", "log_impulse", "log_shape", "skewness", "log_order_1.0", "log_order_abs_1.0", "log_hz_band_0_10", "log_hz_band_10_20", "log_hz_band_20_30", "spectral_entropy", "log_spectral_flatness", "rms_cv", "envelope_cv"]


def waveform_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of the wide feature vector that SQL can express: all but autoregression and envelope orders, by example."""
    names = waveform.feature_names(SIZE, FS, 4.0)
    out = waveform.waveform_features(vectors(spark, sf_dir), "x", FS, 4.0)
    return out.select("vec_id", *[_r(F.col("features")[names.index(n)], 5).alias(n.replace(".", "_")) for n in _WAVE])


def _waveform_sql() -> str:
    band = lambda lo, hi: f"sum(CASE WHEN k >= {lo} AND k < {hi} THEN p ELSE 0 END)"
    log = lambda x: f"ln(greatest({x}, 1e-20))"
    bands = {f"log_h{k}": (4 * k - 7, 4 * k + 7) for k in (1, 2, 3)} | {"log_hf_fraction": (18, 32)} | {"log_order_1_0": (3.4, 4.6)} | {f"log_hz_band_{a}_{a + 10}": (a, a + 10) for a in (0, 10, 20)}
    return f"""
WITH {_LONG}, c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM s), b AS (SELECT i.range AS i, k.range AS k FROM range(64) i, range(33) k),
pz AS (SELECT vec_id, b.k, sum(x * (0.5 - 0.5 * cos(2 * pi() * b.i / 64.0)) * cos(2 * pi() * ((b.i * b.k) % 64) / 64)) AS re, sum(x * (0.5 - 0.5 * cos(2 * pi() * b.i / 64.0)) * sin(2 * pi() * ((b.i * b.k) % 64) / 64)) AS im FROM c JOIN b ON c.i = b.i GROUP BY vec_id, b.k),
p AS (SELECT vec_id, k, (re * re + im * im) / 1024 * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM pz),
t AS (SELECT vec_id, sum(p) AS total, avg(p) AS mean, avg(ln(p + 1e-20)) AS ml, {", ".join(f"{band(lo, hi)} AS {n}" for n, (lo, hi) in bands.items())} FROM p GROUP BY vec_id),
en AS (SELECT p.vec_id, -sum(p / total * ln(p / total + 1e-20)) / ln(33) AS entropy FROM p JOIN t ON p.vec_id = t.vec_id GROUP BY p.vec_id),
st AS (SELECT vec_id, sqrt(avg(x * x)) AS rms, avg(pow(x, 4)) / pow(avg(x * x), 2) AS ku, avg(pow(x, 3)) / pow(avg(x * x), 1.5) AS skew, max(abs(x)) AS peak, avg(abs(x)) AS ma FROM c GROUP BY vec_id),
pa AS (SELECT vec_id, CASE WHEN i < 28 THEN i // 7 ELSE 4 + (i - 28) // 6 END AS part, sqrt(avg(x * x)) AS r FROM c GROUP BY ALL), pv AS (SELECT vec_id, stddev_pop(r) / avg(r) AS v FROM pa GROUP BY vec_id),
z AS (SELECT vec_id, b.k, sum(x * cos(2 * pi() * ((b.i * b.k) % 64) / 64)) AS re, -sum(x * sin(2 * pi() * ((b.i * b.k) % 64) / 64)) AS im FROM c JOIN b ON c.i = b.i GROUP BY vec_id, b.k),
a AS (SELECT z.vec_id, b.i, sum((CASE WHEN z.k IN (0, 32) THEN 1 ELSE 2 END) * (re * cos(2 * pi() * ((b.i * z.k) % 64) / 64) - im * sin(2 * pi() * ((b.i * z.k) % 64) / 64))) / 64 AS ar,
             sum((CASE WHEN z.k IN (0, 32) THEN 1 ELSE 2 END) * (re * sin(2 * pi() * ((b.i * z.k) % 64) / 64) + im * cos(2 * pi() * ((b.i * z.k) % 64) / 64))) / 64 AS ai FROM z JOIN b ON z.k = b.k GROUP BY z.vec_id, b.i),
ev AS (SELECT vec_id, stddev_pop(sqrt(ar * ar + ai * ai)) / avg(sqrt(ar * ar + ai * ai)) AS v FROM a GROUP BY vec_id)
SELECT t.vec_id, round({log("rms")}, 5) AS log_rms, {", ".join(f"round({log(f'{n} / total')}, 5) AS {n}" for n in bands)}, round({log("log_order_1_0")}, 5) AS log_order_abs_1_0,
       round(ln(peak / rms), 5) AS log_crest, round(ln(ku), 5) AS log_kurtosis, round(ln(peak / ma), 5) AS log_impulse, round(ln(rms / ma), 5) AS log_shape, round(skew, 5) AS skewness, round(entropy, 5) AS spectral_entropy,
       round({log("exp(ml) / mean")}, 5) AS log_spectral_flatness, round(pv.v, 5) AS rms_cv, round(ev.v, 5) AS envelope_cv
FROM t JOIN en ON t.vec_id = en.vec_id JOIN st ON t.vec_id = st.vec_id JOIN pv ON t.vec_id = pv.vec_id JOIN ev ON t.vec_id = ev.vec_id
"""


QUERIES = {
    "channel_matrix": (channel_matrix, CHANNEL_SQL),
    "merged_caches": (merged_caches, MERGED_SQL),
    "calibrated": (calibrated, CALIBRATED_SQL),
    "memberships": (memberships, MEMBERSHIPS_SQL),
    "held_out_centroids": (held_out_centroids, HELD_OUT_SQL),
    "learning_curve": (learning_curve, LEARNING_SQL),
    "pinned_artifacts": (pinned_artifacts, PINNED_SQL),
    "member_sets": (member_sets, MEMBER_SETS_SQL),
    "group_split": (group_split, GROUP_SPLIT_SQL),
    "history": (history, HISTORY_SQL),
    "spaced_sample": (spaced_sample, SPACED_SQL),
    "live_gates": (live_gates, LIVE_SQL),
    "live_gates_of_wrapped_clocks": (live_gates_of_wrapped_clocks, LIVE_SQL),
    "sensor_states": (sensor_states, SENSOR_SQL),
    "support_gates": (support_gates, SUPPORT_SQL),
    "top_axes": (top_axes, TOP_AXES_SQL),
    "scenario_statistics": (scenario_statistics, SCENARIO_SQL),
    "sensitivity_curve": (sensitivity_curve, SENSITIVITY_SQL),
    "harmonic_capture": (harmonic_capture, CAPTURE_SQL),
    "advisories": (advisories, ADVISORIES_SQL),
    "worst_features": (worst_features, WORST_SQL),
    "refitted": (refitted, REFITTED_SQL),
    "pulse_continuity": (pulse_continuity, CONTINUITY_SQL),
    "confirmed_after_resets": (confirmed_after_resets, RESETS_SQL),
    "bearing_continuity": (bearing_continuity, BEARING_SQL),
    "votes_with_commands": (votes_with_commands, VOTES_SQL),
    "profile_commands": (profile_commands, _commands_sql()),
    "waveform_shape": (waveform_shape, _waveform_sql()),
}
