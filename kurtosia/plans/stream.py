"""Queries over the event stream: user_id stands in for equipment, event_id for the order of its windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kurtosia.functions.numbers import ramp, wrapping_difference
from kurtosia.operators import asof, baseline, evidence, folds, medians, recordings, sequences, voting

KEY, ORDER = ["user_id"], ["event_id"]
CALIBRATION = 20
SIGMA = 1.0


def _r(c, digits: int = 6):
    return F.round(c, digits)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "value", "ts", "props")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.numbered(events(spark, sf_dir), KEY, ORDER, "rn")


_ROWS = "rows_ AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after the calibration rows with z and flag; errors abstain."""
    rows = events(spark, sf_dir)
    fit = baseline.fit_log(rows, KEY, ORDER, ["value"], CALIBRATION)
    z = baseline.z_scores(baseline.numbered(rows, KEY, ORDER), fit, KEY, ["value"]).where(F.col("row") > CALIBRATION)
    return z.withColumn("flag", F.when(F.col("event_type") != "error", baseline.deviates(["value"], SIGMA)))


_VERDICTS = f"""
e AS (SELECT user_id, event_id, event_type, value, ln(greatest(value, 0) + 1e-6) AS lv, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
b AS (SELECT user_id, avg(lv) AS m, greatest(stddev_samp(lv), 0.02 * abs(avg(lv)), 1e-6) AS s FROM e WHERE rn <= {CALIBRATION} GROUP BY user_id HAVING count(*) = {CALIBRATION}),
v AS (SELECT e.user_id, event_id, event_type, value, (lv - m) / s AS z, CASE WHEN event_type = 'error' THEN NULL ELSE abs((lv - m) / s) > {SIGMA} END AS flag FROM e LEFT JOIN b ON e.user_id = b.user_id WHERE rn > {CALIBRATION})"""


def confirmed_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = voting.confirm(verdicts(spark, sf_dir), KEY, ORDER, "flag")
    return out.select("user_id", "event_id", _r("value_z").alias("z"), "flag", "votes_positive", "votes_valid", "status", "reason")


CONFIRMED_SQL = f"""
WITH {_VERDICTS},
p AS (SELECT *, CASE WHEN flag IS NOT NULL THEN sum(CASE WHEN flag THEN 1 ELSE 0 END) OVER w END AS p0, CASE WHEN flag IS NOT NULL THEN count(flag) OVER w END AS n0 FROM v
      WINDOW w AS (PARTITION BY user_id, flag IS NOT NULL ORDER BY event_id ROWS 4 PRECEDING)),
c AS (SELECT *, coalesce(last_value(p0 IGNORE NULLS) OVER w, 0) AS votes_positive, coalesce(last_value(n0 IGNORE NULLS) OVER w, 0) AS votes_valid FROM p
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, round(z, 6) AS z, flag, CAST(votes_positive AS BIGINT) AS votes_positive, CAST(votes_valid AS BIGINT) AS votes_valid,
       CASE WHEN flag IS NULL OR votes_valid < 5 THEN 'unavailable' WHEN votes_positive >= 4 THEN 'confirmed' ELSE 'normal' END AS status,
       CASE WHEN flag IS NULL THEN 'current_window_invalid' WHEN votes_valid < 5 THEN 'confirmation_buffer_incomplete' END AS reason
FROM c
"""


def vote_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("hit", F.col("value") > 150)
    return voting.confirm_by_rate(rows, KEY, ORDER, "hit").select("user_id", "event_id", "confirmed")


VOTE_RATE_SQL = """
SELECT user_id, event_id, count(*) OVER w = 5 AND sum(CASE WHEN value > 150 THEN 1 ELSE 0 END) OVER w >= 3 AS confirmed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING)
"""


def vote_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("hit", F.col("value") > 100)
    return voting.confirm_in_file(rows, KEY, ORDER, "hit").select("user_id", "event_id", "confirmed")


VOTE_IN_FILE_SQL = """
SELECT user_id, event_id, confirmed FROM (
    SELECT user_id, event_id, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) OVER (w ROWS 4 PRECEDING) >= 4 AS confirmed, row_number() OVER w AS rn
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
) WHERE rn >= 5
"""


def vote_with_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("ratio", F.col("value") / 64).withColumn("phase", F.col("value") / 100)
    out = voting.confirm_with_phase(rows, KEY, ORDER, "ratio", "phase", 1.25, least_concentration=0.75)
    return out.select("user_id", "event_id", _r("concentration").alias("concentration"), "confirmed")


VOTE_WITH_PHASE_SQL = """
SELECT user_id, event_id, CASE WHEN n = 5 THEN round(c, 6) END AS concentration, CASE WHEN n = 5 THEN hits >= 4 AND c >= 0.75 END AS confirmed
FROM (SELECT user_id, event_id, count(*) OVER w AS n, sum(CASE WHEN value / 64 > 1.25 THEN 1 ELSE 0 END) OVER w AS hits,
             sqrt(pow(avg(cos(value / 100)) OVER w, 2) + pow(avg(sin(value / 100)) OVER w, 2)) AS c
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING))
"""


def four_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, kind = F.col("value"), F.col("event_type")
    rows = events(spark, sf_dir).select(
        "user_id", "event_id",
        F.when(kind != "error", v > 60).alias("bearing"), (v > 40).alias("misalignment"), F.when(kind != "click", v < 120).alias("belt"),
        F.when(kind != "view", v / 32).alias("ratio"), F.lit(0.5).alias("phase"),
    )
    out = voting.four_faults(rows, KEY, ORDER)
    return out.select("user_id", "event_id", *[f"{x}_status" for x in ("bearing", "misalignment", "belt", "imbalance")])


def _votes_sql(name: str) -> str:
    return f"coalesce(last_value(CASE WHEN {name} IS NOT NULL THEN {name}_p END IGNORE NULLS) OVER w, 0) AS {name}_p, coalesce(last_value(CASE WHEN {name} IS NOT NULL THEN {name}_n END IGNORE NULLS) OVER w, 0) AS {name}_n"


_FAULTS = ("bearing", "misalignment", "belt", "imbalance")
FOUR_FAULTS_SQL = f"""
WITH f AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN value > 60 END AS bearing, value > 40 AS misalignment,
                  CASE WHEN event_type <> 'click' THEN value < 120 END AS belt, CASE WHEN event_type <> 'view' THEN value / 32 >= 1.1 END AS imbalance FROM events),
p AS (SELECT user_id, event_id, {", ".join(_FAULTS)}, {", ".join(f"sum(CASE WHEN {x} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, {x} IS NOT NULL ORDER BY event_id ROWS 4 PRECEDING) AS {x}_p, count({x}) OVER (PARTITION BY user_id, {x} IS NOT NULL ORDER BY event_id ROWS 4 PRECEDING) AS {x}_n" for x in _FAULTS)} FROM f),
c AS (SELECT user_id, event_id, {", ".join(_FAULTS)}, {", ".join(_votes_sql(x) for x in _FAULTS)} FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, {", ".join(f"CASE WHEN {x} IS NULL OR {x}_n < 5 THEN 'unavailable' WHEN {x}_p >= 4 THEN 'confirmed' ELSE 'normal' END AS {x}_status" for x in _FAULTS[:3])},
       CASE WHEN imbalance IS NULL OR imbalance_n < 5 THEN 'unavailable' WHEN imbalance_p < 4 THEN 'normal'
            WHEN misalignment IS NOT NULL AND misalignment_n = 5 AND misalignment_p >= 4 THEN 'inspection_required' ELSE 'suspected' END AS imbalance_status
FROM c
"""


def belt_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("rn") - 1
    rows = _rows(spark, sf_dir).select("user_id", "event_id", F.floor(n / 8).alias("block"), (n % 8).alias("window"), F.when(F.col("value") >= 2, F.col("value") > 100).alias("flag"), F.when(n < 60, "belt").otherwise("normal").alias("label"))
    return voting.recurrence(rows, KEY, "flag", "label", ["belt", "normal"]).select("user_id", "event_id", "recurs")


BELT_RECURRENCE_SQL = f"""
WITH {_ROWS},
r AS (SELECT user_id, event_id, rn, (rn - 1) // 8 AS block, (rn - 1) % 8 AS win, CASE WHEN value >= 2 THEN value > 100 END AS flag, CASE WHEN rn - 1 < 60 THEN 'belt' ELSE 'normal' END AS label FROM rows_),
f AS (SELECT *, CASE WHEN flag IS NOT NULL AND lag(flag) OVER w IS NOT NULL AND label = lag(label) OVER w
                       AND ((block = lag(block) OVER w AND win = lag(win) OVER w + 1) OR (block = lag(block) OVER w + 1 AND win = 0)) THEN 0 ELSE 1 END AS fresh
      FROM r WINDOW w AS (PARTITION BY user_id ORDER BY block, win)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY block, win ROWS UNBOUNDED PRECEDING) AS run, CASE WHEN flag THEN 1 ELSE 0 END AS h FROM f),
k AS (SELECT user_id, event_id, flag, count(*) OVER (w ROWS 19 PRECEDING) AS n, sum(h) OVER (w ROWS 19 PRECEDING) AS hits,
             max(h) OVER (w ROWS 4 PRECEDING) + max(h) OVER (w ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) + max(h) OVER (w ROWS BETWEEN 14 PRECEDING AND 10 PRECEDING) + max(h) OVER (w ROWS BETWEEN 19 PRECEDING AND 15 PRECEDING) AS blocks
      FROM g WINDOW w AS (PARTITION BY user_id, run ORDER BY block, win))
SELECT user_id, event_id, CASE WHEN n = 20 THEN blocks >= 3 AND hits >= 5 END AS recurs FROM k WHERE flag IS NOT NULL
"""


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.drifted(verdicts(spark, sf_dir), KEY, ORDER, "value_z", 20, 0.25).select("user_id", "event_id", "drift")


DRIFT_SQL = f"""
WITH {_VERDICTS}
SELECT user_id, event_id, CASE WHEN count(z) OVER w = 20 THEN abs(avg(z) OVER w) > 0.25 END AS drift FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 19 PRECEDING)
"""


def last_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.last_verdict(verdicts(spark, sf_dir), KEY, "event_id", "flag", "event_type")


LAST_VERDICT_SQL = f"WITH {_VERDICTS} SELECT user_id, max(event_type) AS event_type, arg_max(flag, event_id) FILTER (WHERE flag IS NOT NULL) AS verdict FROM v GROUP BY user_id"


def first_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voting.confirm_by_rate(events(spark, sf_dir).withColumn("hit", F.col("value") > 150), KEY, ORDER, "hit")
    return voting.first_confirmed(rows, KEY, ORDER, "confirmed")


FIRST_CONFIRMED_SQL = f"WITH c AS ({VOTE_RATE_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM c) SELECT user_id, min(rn) FILTER (WHERE confirmed) AS latency FROM r GROUP BY user_id"


def state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.transitions(events(spark, sf_dir), KEY, ORDER, "event_type").select("user_id", "event_id", "event_type", "previous")


STATE_LOG_SQL = "SELECT * FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE previous IS DISTINCT FROM event_type"


def three_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    fit = baseline.fit_mean_std(rows.where(F.col("rn") <= CALIBRATION), KEY, ["value"])
    out = rows.where(F.col("rn") > CALIBRATION).join(fit, KEY)
    outside = baseline.out_of_range(["value"], 2.0, {"value": 400.0})
    return out.select("user_id", "event_id", F.array_join(outside, ",").alias("reasons"), baseline.drift_ratio(F.col("value"), F.col("value_mean")).alias("drift"))


THREE_SIGMA_SQL = f"""
WITH {_ROWS}, f AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM rows_ WHERE rn <= {CALIBRATION} GROUP BY user_id)
SELECT rows_.user_id, event_id, concat_ws(',', CASE WHEN value < m - 2 * s OR value > m + 2 * s THEN 'value' END, CASE WHEN value > 400 THEN 'value_limit' END) AS reasons,
       CASE WHEN abs(m) >= 1e-9 THEN value / m >= 1.5 END AS drift
FROM rows_ JOIN f ON f.user_id = rows_.user_id WHERE rn > {CALIBRATION}
"""


def robust_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = baseline.fit_robust(events(spark, sf_dir), KEY, ["value"])
    return fit.select("user_id", _r("value_median").alias("median"), _r("value_scale").alias("scale"))


def robust_baseline_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``robust_baseline`` by counting in brackets, for keys of any size."""
    fit = medians.fit_robust(events(spark, sf_dir), KEY, ["value"])
    return fit.select("user_id", _r("value_median").alias("median"), _r("value_scale").alias("scale"))


ROBUST_SQL = "SELECT user_id, round(median(ln(value)), 6) AS median, round(greatest(1.4826 * mad(ln(value)), 0.2), 6) AS scale FROM events GROUP BY user_id"


def median_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.fit_medians(events(spark, sf_dir), ["user_id", "event_type"], ["value"], F.col("value") > 10).select("user_id", "event_type", _r("value_median").alias("median"))


def median_baseline_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of all events by type, few keys of many rows, by counting in brackets."""
    return medians.fit_medians(events(spark, sf_dir), ["event_type"], ["value", "event_id"]).select("event_type", _r("value_median").alias("median"), F.col("event_id_median").alias("middle_event"))


MEDIAN_COUNTED_SQL = "SELECT event_type, round(median(value), 6) AS median, median(CAST(event_id AS DOUBLE)) AS middle_event FROM events GROUP BY event_type"


MEDIAN_SQL = "SELECT user_id, event_type, round(median(value), 6) AS median FROM events WHERE value > 10 GROUP BY user_id, event_type"


def speed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("bin", baseline.speed_bin(F.col("value"), (25.0, 40.0, 52.0)))
    bins = baseline.fit_mean_std(rows, ["user_id", "bin"], ["value"])
    default = baseline.fit_mean_std(rows, [], ["value"])
    out = baseline.with_fallback(rows, bins, default, ["user_id", "bin"], ["value_mean", "value_std"], 15)
    return out.select("user_id", "event_id", "bin", _r("value_mean").alias("mean"), _r("value_std").alias("std"))


SPEED_BINS_SQL = """
WITH r AS (SELECT user_id, event_id, value, CAST(value >= 25 AS INT) + CAST(value >= 40 AS INT) + CAST(value >= 52 AS INT) AS bin FROM events),
b AS (SELECT user_id, bin, avg(value) AS m, stddev_pop(value) AS s FROM r GROUP BY user_id, bin HAVING count(*) >= 15), d AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM r)
SELECT r.user_id, event_id, r.bin, round(coalesce(b.m, d.m), 6) AS mean, round(coalesce(b.s, d.s), 6) AS std FROM r LEFT JOIN b ON r.user_id = b.user_id AND r.bin = b.bin CROSS JOIN d
"""


def median_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = baseline.relative_to_median(events(spark, sf_dir), ["value"], F.col("event_type") == "view")
    return out.select("event_id", _r("value_relative").alias("relative"))


MEDIAN_RELATIVE_SQL = "SELECT event_id, round(value - (SELECT median(value) FROM events WHERE event_type = 'view'), 6) AS relative FROM events"


def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.leading_share(events(spark, sf_dir), KEY, ORDER).groupBy("user_id", "leading").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("value")).alias("mean"))


TIME_SPLIT_SQL = """
SELECT user_id, rn <= floor(n * 0.6) AS leading, count(*) AS n, round(avg(value), 6) AS mean
FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY ALL
"""


def rotation_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("candidate", F.when(F.col("event_type") != "error", 40 + F.col("value") % 16))
    return sequences.track_rotation(rows, KEY, ORDER, "candidate", 5.0, 3).select("user_id", "event_id", _r("hz").alias("hz"))


def rotation_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rotation_tracking`` with the rows of an equipment dealt by spans of 500 windows."""
    rows = events(spark, sf_dir).withColumn("candidate", F.when(F.col("event_type") != "error", 40 + F.col("value") % 16))
    return folds.track_rotation(rows, KEY, ORDER, "candidate", F.floor(F.col("event_id") / 500), 5.0, 3).select("user_id", "event_id", _r("hz").alias("hz"))


ROTATION_SQL = f"""
WITH RECURSIVE {_ROWS},
c AS (SELECT user_id, event_id, rn, CASE WHEN event_type <> 'error' THEN 40 + value % 16 END AS c FROM rows_),
t(user_id, event_id, rn, hz, pending, rejected) AS (
    SELECT user_id, event_id, rn, c, CAST(NULL AS DOUBLE), 0 FROM c WHERE rn = 1
    UNION ALL
    SELECT c.user_id, c.event_id, c.rn,
           CASE WHEN c.c IS NULL THEN hz WHEN hz IS NULL OR abs(c.c - hz) <= 5 OR CASE WHEN rejected > 0 AND abs(c.c - pending) <= 5 THEN rejected + 1 ELSE 1 END >= 3 THEN c.c ELSE hz END,
           CASE WHEN c.c IS NULL THEN pending WHEN hz IS NULL OR abs(c.c - hz) <= 5 OR CASE WHEN rejected > 0 AND abs(c.c - pending) <= 5 THEN rejected + 1 ELSE 1 END >= 3 THEN NULL ELSE c.c END,
           CASE WHEN c.c IS NULL THEN rejected WHEN hz IS NULL OR abs(c.c - hz) <= 5 OR CASE WHEN rejected > 0 AND abs(c.c - pending) <= 5 THEN rejected + 1 ELSE 1 END >= 3 THEN 0
                ELSE CASE WHEN rejected > 0 AND abs(c.c - pending) <= 5 THEN rejected + 1 ELSE 1 END END
    FROM t JOIN c ON c.user_id = t.user_id AND c.rn = t.rn + 1
)
SELECT user_id, event_id, round(hz, 6) AS hz FROM t
"""


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.run_state(events(spark, sf_dir), KEY, ORDER, "value", 40.0, 3)
    return sequences.learning_mode(out, KEY, ORDER, "running", 5, 20).select("user_id", "event_id", "running", "just_started", "mode")


RUN_STATES_SQL = """
WITH h AS (SELECT user_id, event_id, CASE WHEN count(*) OVER w = 3 THEN CASE WHEN min(value) OVER w >= 40 THEN TRUE WHEN max(value) OVER w < 40 THEN FALSE END END AS held
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING)),
r AS (SELECT user_id, event_id, coalesce(last_value(held IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), FALSE) AS running FROM h),
m AS (SELECT *, running AND NOT coalesce(lag(running) OVER (PARTITION BY user_id ORDER BY event_id), FALSE) AS just_started,
             sum(CASE WHEN running THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM r)
SELECT user_id, event_id, running, just_started, CASE WHEN n <= 5 THEN 'warm_up' WHEN n <= 25 THEN 'learning' ELSE 'monitoring' END AS mode FROM m
"""


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("x"), (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + 5).alias("end"))
    return sequences.smooth(rows, KEY, ORDER, "x", "start", "end", 0.4, 2000).select("user_id", "event_id", _r("value").alias("value"), F.col("count").alias("n"))


def smoothed_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``smoothed`` with the rows of an equipment dealt by spans of 500 windows."""
    rows = events(spark, sf_dir).select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("x"), (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + 5).alias("end"))
    return folds.smooth(rows, KEY, ORDER, "x", "start", "end", F.floor(F.col("event_id") / 500), 0.4, 2000).select("user_id", "event_id", _r("value").alias("value"), F.col("count").alias("n"))


SMOOTHED_SQL = f"""
WITH RECURSIVE {_ROWS},
c AS (SELECT user_id, event_id, rn, CASE WHEN event_type <> 'error' THEN value END AS x, event_id * 10 AS st, event_id * 10 + 5 AS en FROM rows_),
t(user_id, event_id, rn, v, n, en) AS (
    SELECT user_id, event_id, rn, x, CASE WHEN x IS NULL THEN 0 ELSE 1 END, en FROM c WHERE rn = 1
    UNION ALL
    SELECT c.user_id, c.event_id, c.rn, CASE WHEN x IS NULL THEN NULL WHEN c.st < t.en OR c.st - t.en > 2000 OR n = 0 THEN x ELSE v + 0.4 * (x - v) END,
           CASE WHEN x IS NULL THEN 0 WHEN c.st < t.en OR c.st - t.en > 2000 OR n = 0 THEN 1 ELSE n + 1 END, c.en
    FROM t JOIN c ON c.user_id = t.user_id AND c.rn = t.rn + 1
)
SELECT user_id, event_id, round(v, 6) AS value, n FROM t
"""


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings.blocks(_rows(spark, sf_dir), KEY, F.col("rn") - 1, "value", 37)


def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every equipment's values, a recording in blocks of 37, at two fifths of their rate."""
    out = recordings.resampled(_recordings(spark, sf_dir), KEY, "first", "signal", 2, 5, 100)
    return recordings.samples(out, KEY).select("user_id", "i", _r("x").alias("x"))


RESAMPLED_SQL = f"""
WITH {_ROWS},
raw AS (
    SELECT k, CASE WHEN k = 0 THEN 1 ELSE sin(pi() * k / 5.0) / (pi() * k / 5.0) END * list_sum(list_transform(range(0, 40), lambda q: power(6.25 * (1 - k * k / 2500.0), q) / power(CAST(factorial(CAST(least(q, 30) AS INTEGER)) AS DOUBLE), 2) * CASE WHEN q <= 30 THEN 1 ELSE 0 END)) AS t
    FROM (SELECT unnest(range(-50, 51)) AS k)
),
taps AS (SELECT k, 2 * t / (SELECT sum(t) FROM raw) AS t FROM raw),
m AS (SELECT user_id, unnest(range(0, (2 * count(*) + 4) // 5)) AS i FROM rows_ GROUP BY user_id)
SELECT m.user_id, i, round(sum(value * t), 6) AS x
FROM m JOIN rows_ ON rows_.user_id = m.user_id AND 2 * (rn - 1) BETWEEN 5 * i - 50 AND 5 * i + 50 JOIN taps ON k = 5 * i - 2 * (rn - 1)
GROUP BY m.user_id, i
"""


def framed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 16 values, one each 5, over the borders of blocks."""
    out = recordings.frames(_recordings(spark, sf_dir), KEY, "first", "signal", 16, 5, 50)
    return out.select("user_id", "start", _r(F.aggregate("frame", F.lit(0.0), lambda t, v: t + v), 4).alias("total"), _r(F.col("frame")[0]).alias("opens"), _r(F.col("frame")[15]).alias("ends"))


FRAMED_BLOCKS_SQL = f"""
WITH {_ROWS}
SELECT a.user_id, a.rn - 1 AS start, round(sum(b.value), 4) AS total, round(min_by(b.value, b.rn), 6) AS opens, round(max_by(b.value, b.rn), 6) AS ends
FROM rows_ a JOIN rows_ b ON b.user_id = a.user_id AND b.rn BETWEEN a.rn AND a.rn + 15
WHERE (a.rn - 1) % 5 = 0 GROUP BY a.user_id, a.rn HAVING count(*) = 16
"""


def transport_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("user_id", "event_id", F.when(F.col("event_type") != "login", F.concat(F.lit("S"), F.floor(F.col("rn") / 30).cast("string"))).alias("session"), F.floor(F.col("rn") + F.col("value") % 3).cast("long").alias("seq"), (F.col("event_type") == "error").alias("bad"))
    rows = rows.withColumn("seq", F.when(F.col("session").isNotNull(), F.col("seq")))
    return sequences.sequence_status(rows, KEY, ORDER, "session", "seq", "bad").select("user_id", "event_id", "status", "missing")


TRANSPORT_SQL = f"""
WITH RECURSIVE {_ROWS},
c AS (SELECT user_id, event_id, rn, CASE WHEN event_type <> 'login' THEN 's' || CAST(rn // 30 AS VARCHAR) END AS se, CASE WHEN event_type <> 'login' THEN CAST(floor(rn + value % 3) AS BIGINT) END AS q, event_type = 'error' AS bad FROM rows_),
t(user_id, event_id, rn, status, missing, se, q) AS (
    SELECT user_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST('' AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT user_id FROM c)
    UNION ALL
    SELECT c.user_id, c.event_id, c.rn,
           CASE WHEN bad OR c.q IS NULL THEN 'unknown' WHEN t.se IS NULL THEN 'first' WHEN c.se <> t.se THEN 'session_changed' WHEN c.q = t.q THEN 'duplicate' WHEN c.q < t.q THEN 'out_of_order' WHEN c.q > t.q + 1 THEN 'gap' ELSE 'contiguous' END,
           CASE WHEN bad OR c.q IS NULL OR t.se IS NULL OR c.se <> t.se OR c.q < t.q THEN NULL WHEN c.q = t.q THEN 0 ELSE c.q - t.q - 1 END,
           CASE WHEN bad OR c.q IS NULL THEN NULL ELSE c.se END,
           CASE WHEN bad OR c.q IS NULL THEN NULL WHEN t.se IS NOT NULL AND c.se = t.se AND c.q <= t.q THEN t.q ELSE c.q END
    FROM t JOIN c ON c.user_id = t.user_id AND c.rn = t.rn + 1
)
SELECT user_id, event_id, status, missing FROM t WHERE rn > 0
"""


def window_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("start", F.col("event_id") * 10).withColumn("end", F.when(F.col("event_type") != "error", F.col("event_id") * 10 + 7))
    return sequences.gap_since(rows, KEY, ORDER, "start", "end").select("user_id", "event_id", "gap")


WINDOW_GAPS_SQL = """
SELECT user_id, event_id, CASE WHEN event_id * 10 >= b THEN event_id * 10 - b END AS gap
FROM (SELECT user_id, event_id, last_value(CASE WHEN event_type <> 'error' THEN event_id * 10 + 7 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)
"""


def clock_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of a 32-bit clock that wraps."""
    from pyspark.sql import Window

    clock = F.pmod(F.col("event_id") * 715827883, F.lit(1 << 32))
    step = wrapping_difference(clock, F.lag(clock).over(Window.partitionBy(*KEY).orderBy(*ORDER)))
    return events(spark, sf_dir).select("user_id", "event_id", step.alias("step"))


CLOCK_SQL = """
SELECT user_id, event_id, ((c - lag(c) OVER (PARTITION BY user_id ORDER BY event_id) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS step
FROM (SELECT user_id, event_id, (event_id * 715827883) % 4294967296 AS c FROM events)
"""


#: Microseconds of a key that a task takes at a time in as-of joins.
TIME_BUCKET = 20_000


def pulse_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    pulses = rows.where("event_type = 'click'").select("user_id", F.col("event_id").alias("t_us"), F.col("value").alias("pulse"))
    samples = rows.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("t_us"), "value")
    out = asof.as_of(samples, pulses, KEY, "t_us", ["pulse"], bucket=TIME_BUCKET)
    return out.select("user_id", "t_us", "value", "pulse")


PULSE_JOIN_SQL = """
WITH p AS (SELECT user_id, event_id AS t_us, value AS pulse FROM events WHERE event_type = 'click'), s AS (SELECT user_id, event_id AS t_us, value FROM events WHERE event_type <> 'click')
SELECT s.user_id, s.t_us, s.value, p.pulse FROM s ASOF LEFT JOIN p ON s.user_id = p.user_id AND s.t_us >= p.t_us
"""


def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    known = rows.where("event_type = 'click'").select("user_id", F.col("event_id").alias("t_us"), F.col("value").alias("x"))
    grid = rows.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("t_us"))
    return asof.interpolate(grid, known, KEY, "t_us", "x", bucket=TIME_BUCKET).select("user_id", "t_us", _r("x", 4).alias("x"))


INTERPOLATED_SQL = """
WITH p AS (SELECT user_id, event_id AS t_us, value AS x FROM events WHERE event_type = 'click'), s AS (SELECT user_id, event_id AS t_us FROM events WHERE event_type <> 'click'),
a AS (SELECT s.user_id, s.t_us, p.t_us AS t0, p.x AS x0 FROM s ASOF LEFT JOIN p ON s.user_id = p.user_id AND s.t_us >= p.t_us),
b AS (SELECT a.*, p.t_us AS t1, p.x AS x1 FROM a ASOF LEFT JOIN p ON a.user_id = p.user_id AND a.t_us < p.t_us)
SELECT user_id, t_us, round(x0 + CAST((x1 - x0) * (t_us - t0) AS DOUBLE) / (t1 - t0), 4) AS x FROM b
"""


def pulse_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).select("user_id", F.floor(F.col("rn") / 10).alias("win"), (F.col("rn") * 10000 + F.col("value") * 4).alias("t_us"), F.col("rn").alias("ordinal"))
    return asof.pulse_quality(rows, ["user_id", "win"]).select("user_id", "win", _r("fg_hz").alias("fg_hz"), "reason")


PULSE_QUALITY_SQL = f"""
WITH {_ROWS}, p AS (SELECT user_id, rn // 10 AS win, rn * 10000 + value * 4 AS t, rn FROM rows_),
s AS (SELECT *, t - lag(t) OVER w AS st, rn - lag(rn) OVER w AS j FROM p WINDOW w AS (PARTITION BY user_id, win ORDER BY t)),
o AS (SELECT *, avg(st) OVER (PARTITION BY user_id, win) AS m FROM s),
g AS (SELECT user_id, win, count(st) AS n, avg(st) AS mean, min(st) AS lo, max(st) AS hi, max(abs(st - m) / m) AS off, bool_and(j = 1) AS ok FROM o GROUP BY user_id, win),
r AS (SELECT *, CASE WHEN n < 3 THEN 'fg_missing' WHEN NOT ok OR lo < 3000 OR hi > 100000 OR off > 0.15 THEN 'fg_unstable' ELSE 'ok' END AS reason FROM g)
SELECT user_id, win, CASE WHEN reason = 'ok' THEN round(1e6 / mean, 6) END AS fg_hz, reason FROM r
"""


def evidence_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    part = lambda n: v % n / n
    rows = _rows(spark, sf_dir).select(
        "user_id", "event_id", F.col("rn").alias("windows"), ramp(v / 20).alias("dev_1x"), part(7).alias("dev_2x"), part(11).alias("dev_3x"), part(5).alias("dev_orders"),
        (100 * part(13)).alias("share_1x"), (100 * part(17)).alias("share_orders"), part(19).alias("irregularity"),
        F.when(F.col("event_type") != "error", part(23)).alias("phase"), F.when(F.col("event_type") != "click", part(29)).alias("direction"),
        F.when(F.col("event_type") == "view", part(31)).alias("envelope"), F.lit(None).cast("double").alias("transmission"),
    )
    spectral = F.greatest("dev_1x", "dev_2x", "dev_3x", "dev_orders")
    physical = F.greatest(F.coalesce("direction", F.lit(0.0)), F.coalesce("envelope", F.lit(0.0)))
    out = evidence.relative_shares(evidence.strengths(rows.withColumn("abnormality", evidence.abnormality(spectral, F.col("irregularity"), physical))), "windows")
    return out.select("user_id", "event_id", _r("abnormality", 4).alias("abnormality"), *[_r(f"{c}_strength", 4).alias(f"{c}_strength") for c in evidence.CANDIDATES], *[_r(f"{c}_share", 4).alias(f"{c}_share") for c in evidence.CANDIDATES], "belt_reason")


EVIDENCE_SQL = f"""
WITH {_ROWS},
i AS (SELECT user_id, event_id, rn, greatest(0, least(1, (value / 20 - 2) / 4)) AS d1, value % 7 / 7 AS d2, value % 11 / 11 AS d3, value % 5 / 5 AS d0, 100 * (value % 13 / 13) AS s1, 100 * (value % 17 / 17) AS so, value % 19 / 19 AS ir,
             CASE WHEN event_type <> 'error' THEN value % 23 / 23 END AS ph, CASE WHEN event_type <> 'click' THEN value % 29 / 29 END AS di, CASE WHEN event_type = 'view' THEN value % 31 / 31 END AS en FROM rows_),
a AS (SELECT *, 100 * greatest(0, least(1, 1 - (1 - greatest(d1, d2, d3, d0)) * (1 - 0.5 * ir) * (1 - 0.75 * greatest(coalesce(di, 0), coalesce(en, 0))))) AS ab FROM i),
s AS (SELECT *, ab * sqrt(d1 * greatest(0, least(1, s1 / 70))) * ph AS im, ab * sqrt(d0 * greatest(0, least(1, so / 50)) * ir) AS lo, ab * sqrt(greatest(d1, d2, d3) * di) AS mi, ab * en AS be FROM a),
t AS (SELECT *, coalesce(im, 0) + coalesce(lo, 0) + coalesce(mi, 0) + coalesce(be, 0) AS tot FROM s)
SELECT user_id, event_id, round(ab, 4) AS abnormality, round(im, 4) AS imbalance_strength, round(lo, 4) AS looseness_strength, round(mi, 4) AS misalignment_strength, round(be, 4) AS bearing_strength, CAST(NULL AS DOUBLE) AS belt_strength,
       CASE WHEN rn >= 3 AND ab >= 20 AND tot >= 20 THEN round(100 * im / tot, 4) END AS imbalance_share, CASE WHEN rn >= 3 AND ab >= 20 AND tot >= 20 THEN round(100 * lo / tot, 4) END AS looseness_share,
       CASE WHEN rn >= 3 AND ab >= 20 AND tot >= 20 THEN round(100 * mi / tot, 4) END AS misalignment_share, CASE WHEN rn >= 3 AND ab >= 20 AND tot >= 20 THEN round(100 * be / tot, 4) END AS bearing_share, CAST(NULL AS DOUBLE) AS belt_share,
       'missing_transmission_evidence' AS belt_reason
FROM t
"""


QUERIES = {
    "confirmed_anomaly": (confirmed_anomaly, CONFIRMED_SQL),
    "vote_rate": (vote_rate, VOTE_RATE_SQL),
    "vote_in_file": (vote_in_file, VOTE_IN_FILE_SQL),
    "vote_with_phase": (vote_with_phase, VOTE_WITH_PHASE_SQL),
    "four_faults": (four_faults, FOUR_FAULTS_SQL),
    "belt_recurrence": (belt_recurrence, BELT_RECURRENCE_SQL),
    "drift": (drift, DRIFT_SQL),
    "last_verdict": (last_verdict, LAST_VERDICT_SQL),
    "first_confirmed": (first_confirmed, FIRST_CONFIRMED_SQL),
    "state_log": (state_log, STATE_LOG_SQL),
    "three_sigma": (three_sigma, THREE_SIGMA_SQL),
    "robust_baseline": (robust_baseline, ROBUST_SQL),
    "robust_baseline_counted": (robust_baseline_counted, ROBUST_SQL),
    "median_baseline_counted": (median_baseline_counted, MEDIAN_COUNTED_SQL),
    "median_baseline": (median_baseline, MEDIAN_SQL),
    "speed_bins": (speed_bins, SPEED_BINS_SQL),
    "median_relative": (median_relative, MEDIAN_RELATIVE_SQL),
    "time_split": (time_split, TIME_SPLIT_SQL),
    "rotation_tracking": (rotation_tracking, ROTATION_SQL),
    "rotation_in_buckets": (rotation_in_buckets, ROTATION_SQL),
    "run_states": (run_states, RUN_STATES_SQL),
    "smoothed": (smoothed, SMOOTHED_SQL),
    "smoothed_in_buckets": (smoothed_in_buckets, SMOOTHED_SQL),
    "resampled": (resampled, RESAMPLED_SQL),
    "framed_blocks": (framed_blocks, FRAMED_BLOCKS_SQL),
    "transport_sequence": (transport_sequence, TRANSPORT_SQL),
    "window_gaps": (window_gaps, WINDOW_GAPS_SQL),
    "clock_steps": (clock_steps, CLOCK_SQL),
    "pulse_join": (pulse_join, PULSE_JOIN_SQL),
    "interpolated": (interpolated, INTERPOLATED_SQL),
    "pulse_quality": (pulse_quality, PULSE_QUALITY_SQL),
    "evidence_shares": (evidence_shares, EVIDENCE_SQL),
}
