"""Operators on fixtures worked out by hand or by a plain-Python model."""

import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from kurtosia.functions import numbers
from kurtosia.operators import asof, baseline, framing, gates, joins, metrics, records, scoring, sequences, spectrum, voting, waveform

T, N = True, None


def _flags(spark, flags, session="s"):
    return spark.createDataFrame([("e", session, i, f) for i, f in enumerate(flags)], "equipment string, session string, seq int, flag boolean")


@pytest.mark.parametrize(
    ("flags", "statuses"),
    [
        ([T] * 5, ["unavailable"] * 4 + ["confirmed"]),
        ([T, T, T, False, T], ["unavailable"] * 4 + ["confirmed"]),
        ([T, T, False, False, T], ["unavailable"] * 4 + ["normal"]),
        ([T] * 5 + [N, T], ["unavailable"] * 4 + ["confirmed", "unavailable", "confirmed"]),
    ],
)
def test_votes(spark, flags, statuses):
    out = voting.confirm(_flags(spark, flags), ["equipment", "session"], ["seq"], "flag").orderBy("seq").collect()
    assert [r.status for r in out] == statuses
    if N in flags:
        assert (out[5].votes_positive, out[5].votes_valid, out[5].reason) == (5, 5, "current_window_invalid")


def test_votes_against_a_deque(spark):
    rng = np.random.default_rng(1)
    flags = [[T, False, N][i] for i in rng.integers(0, 3, 200)]
    out = voting.votes(_flags(spark, flags), ["equipment", "session"], ["seq"], "flag").orderBy("seq").collect()
    recent = deque(maxlen=5)
    for f, r in zip(flags, out, strict=True):
        if f is not None:
            recent.append(f)
        assert (r.votes_positive, r.votes_valid) == (sum(recent), len(recent))


def test_imbalance_is_never_confirmed(spark):
    rows = [("e", i, None, m, None, 1.1, 0.0) for i, m in enumerate([False] * 5 + [T] * 5)] + [("f", i, None, T, None, 1.099, 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "e string, seq int, bearing boolean, misalignment boolean, belt boolean, ratio double, phase double")
    out = {(r.e, r.seq): r for r in voting.four_faults(df, ["e"], ["seq"]).collect()}
    assert out["e", 4].imbalance_status == "suspected" and out["e", 9].imbalance_status == "inspection_required"
    assert out["f", 4].imbalance_status == "normal" and out["e", 9].bearing_status == "unavailable"


def _recurs(spark, rows):
    df = spark.createDataFrame([("k", i // 8, i % 8, f, label) for i, (f, label) in enumerate(rows)], "k string, block int, window int, flag boolean, label string")
    return [r.recurs for r in voting.recurrence(df, ["k"], "flag", "label", ["belt"]).orderBy("block", "window").collect()]


def test_recurrence(spark):
    hits = lambda at: [(i in at, "belt") for i in range(20)]
    assert _recurs(spark, hits({0, 1, 5, 6, 10})) == [None] * 19 + [True]
    assert _recurs(spark, hits({0, 5, 6, 10}))[-1] is False  # four hits
    assert _recurs(spark, hits(set(range(10))))[-1] is False  # two blocks
    assert _recurs(spark, [*hits({0, 1, 5, 6, 10})[:10], (None, "belt"), *hits({0})[:10]]) == [None] * 20  # an abstention starts anew


@pytest.mark.parametrize(
    ("candidates", "tracked"),
    [
        ([50, 52, 49.5], [50, 52, 49.5]),
        ([50, 68, 31, 67, 30, 69, 32, 66], [50] * 8),
        ([50, *[62] * 5, 62.5], [50] * 5 + [62, 62.5]),
        ([50, 62, 62, 51, *[62] * 4], [50, 50, 50, 51, 51, 51, 51, 51]),
        ([None, 50, None], [None, 50, 50]),
    ],
)
def test_rotation_tracker(spark, candidates, tracked):
    df = spark.createDataFrame([("k", i, None if c is None else float(c)) for i, c in enumerate(candidates)], "k string, seq int, hz0 double")
    assert [r.hz for r in sequences.track_rotation(df, ["k"], ["seq"], "hz0").orderBy("seq").collect()] == tracked


@pytest.mark.parametrize(
    ("rows", "told"),
    [
        ([("a", 0), ("a", 1)], [("first", None), ("contiguous", 0)]),
        ([("a", 1), ("A", 1)], [("first", None), ("duplicate", 0)]),
        ([("a", 1), ("a", 4), ("a", 2), ("a", 5)], [("first", None), ("gap", 2), ("out_of_order", None), ("contiguous", 0)]),
        ([("a", 1), ("b", 7)], [("first", None), ("session_changed", None)]),
        ([("a", 1), None, ("a", 2)], [("first", None), ("unknown", None), ("first", None)]),
    ],
)
def test_sequence_status(spark, rows, told):
    df = spark.createDataFrame([("k", i, *(r or (None, None)), r is None) for i, r in enumerate(rows)], "k string, line int, session string, seq long, bad boolean")
    out = sequences.sequence_status(df, ["k"], ["line"], "session", "seq", "bad").orderBy("line").collect()
    assert [(r.status, r.missing) for r in out] == told


def _told(spark, lines):
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(lines)], "k string, seq int, line string")
    return sequences.profile_store(df, ["k"], ["seq"], "line").orderBy("seq").collect()


def test_profile_store_follows_the_protocol(spark):
    out = _told(spark, ["context a", "ppr 2", "learn", "learned", "approve 1", "learn", "learned", "import b", "approve 2", "context b", "rollback", "context a", "rollback", "clear", "rollback"])
    assert [r.reason for r in out] == ["saved", "saved", "started", "saved", "saved", "started", "saved", "candidate_exists", "saved", "saved", "condition_mismatch", "saved", "saved", "saved", "previous_missing"]
    assert [(r.current, r.candidate, r.previous) for r in out][-8:] == [(1, 2, N), (2, N, 1), (2, N, 1), (2, N, 1), (2, N, 1), (1, N, 2), (N, N, N), (N, N, N)]
    assert out[-1].next_id == 3 and out[-1].context is None and out[-1].ppr == 0


def test_a_failed_import_changes_nothing(spark):
    (a, b, c) = _told(spark, ["import fan-3", "import bad name", None])
    assert (a.reason, a.context, a.generation) == ("selection_required", None, 0)
    assert (b.reason, c.reason) == ("context_invalid", "unknown_command")


def test_log_baseline_floors_deviations(spark):
    df = spark.createDataFrame([("k", i, 2.0) for i in range(4)] + [("short", 0, 1.0)], "k string, seq int, x double")
    (r,) = baseline.fit_log(df, ["k"], ["seq"], ["x"], 4).collect()
    assert r.k == "k" and r.x_std == pytest.approx(0.02 * math.log(2 + 1e-6))


def _wave(spark, f, size=64, **cols):
    return spark.createDataFrame([(1, i, float(f(i))) for i in range(size)], "w int, i int, x double")


def test_spectra_recover_amplitudes(spark):
    tone = _wave(spark, lambda i: 0.1 * math.sin(2 * math.pi * 9 * i / 64) + 0.98)
    for kind, scale in (("none", spectrum.amplitude), ("hann_symmetric", spectrum.amplitude_hann)):
        mags = {r.k: r.mag for r in scale(spectrum.dft(tone, ["w"], 64, kind), 64).collect()}
        assert mags[9] == pytest.approx(0.1, abs=0.003) and mags[0] == pytest.approx(0, abs=1e-3)
    array = tone.groupBy("w").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("a"))
    fast = {r.k: (r.re, r.im) for r in spectrum.fft(array, ["w"], "a", "hann_periodic").collect()}
    slow = {r.k: (r.re, r.im) for r in spectrum.dft(tone, ["w"], 64, "hann_periodic").collect()}
    assert all(slow[k] == pytest.approx(fast[k], abs=1e-9) for k in slow)
    (r,) = spectrum.synchronous(tone, ["w"], 9.0, 64.0, 64).collect()
    assert r.amplitude == pytest.approx(0.1) and r.phase == pytest.approx(-math.pi / 2)


def test_three_kinds_of_band(spark):
    df = spark.createDataFrame([(k, 1.0) for k in range(10)], "k int, v double")
    k, v = F.col("k"), F.col("v")
    (r,) = df.agg(spectrum.band_within(v, k * 1.0, F.lit(4.0), 1.0).alias("a"), spectrum.band_bins(v, k, F.lit(2.5), F.lit(4.5), 1.0, 10).alias("b"), spectrum.band_half_open(v, k, 2, 5).alias("c")).collect()
    assert (r.a, r.b, r.c) == (3.0, 4.0, 3.0)


def test_frames_drop_the_tail(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(10)]), (2, [1.0])], "w int, x array<double>")
    assert [(r.start, r.frame) for r in framing.frames(df, "x", 4, 3).collect()] == [(0, [0.0, 1.0, 2.0, 3.0]), (3, [3.0, 4.0, 5.0, 6.0]), (6, [6.0, 7.0, 8.0, 9.0])]
    long = framing.samples(df, ["w"], "x")
    assert {(r.frame, r.i) for r in framing.frames_of_samples(long, ["w"], "i", 4, 3).collect()} == {(f, f * 3 + j) for f in range(3) for j in range(4)}


def test_order_projection_recovers_amplitudes(spark):
    step, n = 2500, 512
    samples = spark.createDataFrame([(1, i * step, 0.12 * math.sin(2 * math.pi * i * step / 40000)) for i in range(n)], "w int, t_us long, x double")
    pulses = spark.createDataFrame([(1, k * 40000, k) for k in range(33)], "w int, t_us long, ordinal long")
    (r,) = asof.order_projection(samples, pulses, ["w"]).collect()
    assert r.amp_1x == pytest.approx(0.12, rel=1e-3) and r.ratio_1x == pytest.approx(1, rel=1e-3)
    (none,) = asof.order_projection(samples, pulses.where("t_us > 0"), ["w"]).collect()
    assert none.amp_1x is None


def test_as_of_ties_and_ends(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 0, "b"), (2, 5, "c")], "k int, t int, v string")
    right = spark.createDataFrame([(1, 5, 1.0), (1, 5, 2.0), (1, 9, 3.0)], "k int, t int, x double")
    assert {r.v: r.x for r in asof.as_of(left, right, ["k"], "t", ["x"]).collect()} == {"a": 2.0, "b": None, "c": None}


RECORD = '{"reason":"ok","fs_hz":400.0,"fg_hz":null,"rpm":1200,"amp_1x_g":[0.1,0.2,0.3],"ratio_1x":1.0,"imbalance":"normal","imbalance_votes":3,"samples":512,"acquisition":{"v":1,"session":"00112233aabbccdd","seq":4,"start_us":1000,"end_us":1278500,"gap_us":500,"valid":true,"reason":"ok"},"runtime":{"v":1,"pre_emit_us":5,"previous_emit":{"seq":3,"call_us":7},"heap":{"free_bytes":10,"min_free_bytes":5,"largest_free_bytes":9}}}'


@pytest.mark.parametrize(
    ("old", "new", "word"),
    [
        ("", "", None),
        ('"imbalance_votes":3', '"imbalance_votes":true', "imbalance_votes"),
        ('"rpm":1200', '"rpm":"1200"', "rpm"),
        ('"imbalance_votes":3', '"imbalance_votes":3.0', "imbalance_votes"),
        ("[0.1,0.2,0.3]", "[0.1,0.2]", "amp_1x_g"),
        ('"seq":4', '"seq":9007199254740992', "acquisition.seq"),
        ("00112233aabbccdd", "0011", "acquisition.session"),
        ('"valid":true', '"valid":1', "acquisition.valid"),
        ('"valid":true', '"valid":false', "acquisition:validity"),
        ('"end_us":1278500', '"end_us":2278500', "acquisition:rate"),
        ('"previous_emit":{"seq":3', '"previous_emit":{"seq":2', "runtime:previous_emit"),
        ('"min_free_bytes":5', '"min_free_bytes":50', "runtime:heap"),
        ('"reason":"ok","fs_hz"', '"fs_hz"', "reason"),
        ('"v":1,"pre', '"v":2,"pre', "runtime.v"),
    ],
)
def test_record_errors(spark, old, new, word):
    line = RECORD.replace(old, new, 1) if old else RECORD
    (r,) = records.measurements(spark.createDataFrame([(line,)], "line string"), "line").collect()
    assert r.kind == "record" and ((r.errors == []) if word is None else any(word in x for x in r.errors))


def test_line_kinds(spark):
    df = spark.createDataFrame([(None,), (" ",), ("boot",), ("{bad",), ('{"a":NaN}',), ("{}",)], "line string")
    assert [r.kind for r in records.measurements(df, "line").collect()] == ["blank", "blank", "console", "bad_json", "bad_json", "record"]


def test_profile_keys_are_closed(spark):
    from kurtosia.plans.lines import PROFILE

    good = PROFILE.replace("@", "5")
    lines = [good, good.replace('"v":1', '"v":1,"more":2'), good.replace('"ok":true,', ""), good.replace("approve", "fly"), good.replace('"hold":false', '"hold":true'), good.replace('"id":51', '"id":52'), good.replace('"paused":false', '"paused":0')]
    told = [r.errors for r in records.profile_events(spark.createDataFrame([(x,) for x in lines], "line string"), "line").collect()]
    assert told == [[], ["event:keys"], ["event:keys"], ["command:not_command"], ["profile.baseline_ready:unmatched"], ["profile:repeated_id"], ["profile.paused:not_boolean"]]


def test_rows_keep_their_columns_beside_record_errors(spark):
    df = spark.createDataFrame([(1, "{}", "old", "k")], "id int, line string, errors string, kind string")
    (r,) = records.measurements(df, "line").collect()
    assert r.id == 1 and r.kind == "record" and "reason:missing" in r.errors


def test_profile_store_follows_commands(spark):
    lines = ["learn", "context pump-1", "ppr 2", "learn", "learn", "learned", "approve 9", "context pump-2", "approve 1", "context pump-1", "approve 1", "learn", "learned", "approve 2", "rollback", "storage_error", "context x", "recover", "start", "clear", "rollback", "dance", "ppr 17", "context much-too-long-a-name"]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(lines)], "k string, seq int, line string")
    out = sequences.profile_store(df, ["k"], ["seq"], "line").orderBy("seq").collect()
    assert [r.reason for r in out] == [
        "selection_required", "saved", "saved", "started", "learning_in_progress", "not_learning", "candidate_id_mismatch", "saved", "candidate_id_mismatch", "saved", "candidate_id_mismatch", "started", "saved",
        "candidate_id_mismatch", "previous_missing", "storage_hold", "storage_hold", "recovered", "sampling", "saved", "previous_missing", "unknown_command", "ppr_invalid", "context_invalid",
    ]
    assert out[12].candidate == 1 and out[12].candidate_context == "pump-1" and out[19].candidate is None and out[19].next_id == 2


def test_profile_store_swaps_and_checks_conditions(spark):
    lines = ["context a", "ppr 1", "learn", "learned", "context b", "approve 1", "context a", "approve 1", "learn", "learned", "approve 2", "rollback", "ppr 3", "rollback", "import c", "discard", "discard"]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(lines)], "k string, seq int, line string")
    out = sequences.profile_store(df, ["k"], ["seq"], "line").orderBy("seq").collect()
    assert out[5].reason == "condition_mismatch" and (out[7].current, out[7].candidate) == (1, None)
    assert (out[10].current, out[10].previous) == (2, 1) and (out[11].current, out[11].previous) == (1, 2)
    assert out[13].reason == "condition_mismatch" and out[14].candidate == 3 and out[14].context == "c" and out[15].candidate is None and out[16].reason == "candidate_missing"


def test_numbers(spark):
    df = spark.createDataFrame([(5, 4294967290), (4294967290, 5)], "a long, b long")
    assert [r.d for r in df.select(numbers.wrapping_difference(F.col("a"), F.col("b")).alias("d")).collect()] == [11, -11]
    (r,) = spark.range(1).select(numbers.rate(F.lit(1), F.lit(0)).alias("none"), numbers.ramp(F.lit(4.0)).alias("half"), numbers.condition(F.lit("정상")).alias("c"), numbers.condition(F.lit("?")).alias("u"), numbers.finite(F.lit(float("inf"))).alias("i")).collect()
    assert (r.none, r.half, r.c, r.u, r.i) == (None, 0.5, "normal", None, None)


def test_waveform_features():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(400)
    f = waveform.features(x)
    assert len(f) == 101 and list(f)[0] == "log_rms" and list(f)[-1] == "log_ar24_residual_fraction"
    assert len(waveform.family(list(f), "base5")) == 5 and len(waveform.family(list(f), "ar24")) == 26
    tone = waveform.features(np.sin(2 * np.pi * waveform.ROTATION_HZ * np.arange(400) / 400))
    assert tone["log_h1"] > -0.05 and tone["log_crest"] == pytest.approx(0.5 * math.log(2), abs=0.03) and tone["log_kurtosis"] == pytest.approx(math.log(1.5), abs=0.02)
    t = np.arange(1000) / 1000
    half = waveform.resample(np.sin(2 * np.pi * 20 * t), 2, 5)
    assert len(half) == 400 and np.allclose(half[40:-40], np.sin(2 * np.pi * 20 * np.arange(400) / 400)[40:-40], atol=2e-3)
    assert np.allclose(waveform.envelope(np.cos(2 * np.pi * 8 * np.arange(128) / 128)), 1)


def test_folded_models_score_as_their_mean():
    rng = np.random.default_rng(3)
    models = [(rng.random(3).tolist(), (rng.random(3) + 0.5).tolist(), rng.random((2, 3)).tolist(), rng.random(2).tolist()) for _ in range(5)]
    w, b = scoring.folded(models)
    x = rng.random(3)
    want = np.mean([np.array(m[2]) @ ((x - m[0]) / np.array(m[1])) + m[3] for m in models], axis=0)
    assert np.allclose(np.array(w) @ x + b, want)


def test_contracts_and_samples(spark):
    df = spark.range(10)
    assert metrics.assert_contract(df, {"ten rows": F.count(F.lit(1)) == 10}).count() == 10
    with pytest.raises(Exception, match="nine rows"):
        metrics.assert_contract(df, {"nine rows": F.count(F.lit(1)) == 9}).collect()
    assert [r.id for r in metrics.spaced_sample(df, ["id"], 4).orderBy("id").collect()] == [0, 3, 6, 9]
    assert metrics.spaced_sample(df, ["id"], 50).count() == 10 and metrics.spaced_sample(df.limit(0), ["id"], 3).collect() == []


def test_spaced_samples_count_and_place_rows_in_the_same_ranges(spark):
    n, k = 400_001, 41
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("more")).repartition(16)
    assert [r.id for r in metrics.spaced_sample(df, ["id"], k).orderBy("id").collect()] == list(range(0, n, 10_000))


def test_group_split_fails_where_no_draw_can_do(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "label string, g int")
    with pytest.raises(Exception, match="no draw has all classes"):
        joins.group_split(df, "label", "g").collect()


def test_checksums_are_of_bytes(spark):
    (r,) = spark.createDataFrame([("é",)], "t string").select(numbers.fnv1a(F.col("t")).alias("f"), numbers.fold31(F.col("t")).alias("m"), numbers.fnv1a(F.lit("")).alias("e")).collect()
    h = 2166136261
    for c in "é".encode():
        h = (h ^ c) * 16777619 % (1 << 32)
    assert r.f == h and r.m == 0xC3 * 31 + 0xA9 and r.e == 2166136261


def test_forward_as_of_and_exact_ends(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 0, "b"), (1, 9, "c")], "k int, t int, v string")
    right = spark.createDataFrame([(1, 5, 1.0), (1, 9, 3.0), (1, 9, 4.0)], "k int, t int, x double")
    assert {r.v: r.x for r in asof.as_of(left, right, ["k"], "t", ["x"], forward=True).collect()} == {"a": 4.0, "b": 1.0, "c": None}


def test_features_of_a_batch_equal_those_of_each_window(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(n).tolist()) for i, n in enumerate((400, 300, 400, 20, 400))] + [(9, None), (10, [float("nan")] * 400)]
    out = {r.i: r.features for r in waveform.waveform_features(spark.createDataFrame(rows, "i int, x array<double>"), "x").collect()}
    assert all(out[i] == pytest.approx(list(waveform.features(np.array(x)).values())) for i, x in rows if i in (0, 1, 2, 4))
    assert out[3] is None and out[9] is None and out[10] is None
    silent = waveform.feature_matrix(np.zeros((2, 400)))
    assert np.isfinite(silent).all()


def test_windows_of_other_kinds_give_no_bins(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 0.0, 1.0]), (2, None), (3, [1.0, float("inf"), 0.0, 0.0]), (4, [1.0, 2.0])], "w int, x array<double>")
    assert {(r.w, r.k) for r in spectrum.fft(df, ["w"], "x").collect()} == {(1, 0), (1, 1), (1, 2), (4, 0), (4, 1)}
    long = spark.createDataFrame([(1, 0, 1.0), (1, 2, 3.0), (1, 3, 2.0)], "w int, i int, x double")
    got = {r.k: r.re for r in spectrum.dft(long, ["w"], 4).collect()}
    assert got == pytest.approx({0: 0.0, 1: -2.0, 2: 0.0})
    twice = long.unionAll(spark.createDataFrame([(1, 2, 9.0), (1, 3, 2.0), (1, None, 5.0), (1, 4, 5.0)], "w int, i int, x double"))
    assert {r.k: r.re for r in spectrum.dft(twice, ["w"], 4).collect()} == pytest.approx(got)


def test_content_hash_is_of_the_samples_bytes(spark):
    import hashlib
    import struct

    df = spark.createDataFrame([([1.5, -2.0],), ([],), (None,), ([1.5, -2.0],)], "x array<double>")
    got = [r[0] for r in df.select(waveform.content_hash(F.col("x"))).collect()]
    want = hashlib.sha256(struct.pack("<2d", 1.5, -2.0)).hexdigest()
    assert got == [want, hashlib.sha256(b"").hexdigest(), None, want]


def test_clocks_that_go_back_are_uneven(spark):
    times = [2**32 - 3000, 2**32 - 500, 2000, 1900, 4400]
    df = spark.createDataFrame([(1, i, t, 0.5, 400.0) for i, t in enumerate(times)], "k int, i int, t_us long, x double, fs double")
    (r,) = gates.sample_faults(df, ["k"], "fs").collect()
    assert (r.bad_step, r.seconds) == (3, (4400 + 3000) / 1e6)
