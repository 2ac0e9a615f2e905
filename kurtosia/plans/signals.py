"""Queries over embeddings: each vector stands in for a window of 64 samples at 64 Hz with a class label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kurtosia.operators import asof, framing, metrics, models, scoring, spectrum, waveform

SIZE, FS = 64, 64.0
KEY = ["vec_id"]


def _r(c, digits: int = 6):
    return F.round(c, digits)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("x", F.col("embedding").cast("array<double>"))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.samples(vectors(spark, sf_dir), KEY, "x")


_LONG = "s AS (SELECT vec_id, label, CAST(i - 1 AS INT) AS i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def _spectrum_sql(taper: str) -> str:
    w = {"none": "1.0", "hann_symmetric": "(0.5 - 0.5 * cos(2 * pi() * b.i / 63.0))", "hann_periodic": "(0.5 - 0.5 * cos(2 * pi() * b.i / 64.0))"}[taper]
    return f"""{_LONG},
c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM s),
b AS (SELECT i.range AS i, k.range AS k FROM range(64) i, range(33) k),
z AS (SELECT vec_id, b.k, sum(x * {w} * cos(2 * pi() * ((b.i * b.k) % 64) / 64)) AS re, sum(-x * {w} * sin(2 * pi() * ((b.i * b.k) % 64) / 64)) AS im FROM c JOIN b ON c.i = b.i GROUP BY vec_id, b.k)"""


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.amplitude(spectrum.fft(vectors(spark, sf_dir), KEY, "x"), SIZE)


def _hann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.amplitude_hann(spectrum.fft(vectors(spark, sf_dir), KEY, "x", "hann_symmetric"), SIZE)


def amplitude_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark, sf_dir).select("vec_id", "k", _r("mag").alias("mag"))


AMPLITUDE_SQL = f"WITH {_spectrum_sql('none')} SELECT vec_id, k, round(sqrt(re * re + im * im) * 2 / 64, 6) AS mag FROM z WHERE k < 32"


def hann_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hann(spark, sf_dir).select("vec_id", "k", _r("mag").alias("mag"))


HANN_SQL = f"WITH {_spectrum_sql('hann_symmetric')} SELECT vec_id, k, round(sqrt(re * re + im * im) * 2 / 64 / 0.5 / CASE WHEN k = 0 THEN 2 ELSE 1 END, 6) AS mag FROM z WHERE k < 32"


def fft_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Hann spectrum from samples in long form, window by window gathered."""
    z = spectrum.dft(long(spark, sf_dir), KEY, SIZE, "hann_symmetric")
    return spectrum.amplitude_hann(z, SIZE).select("vec_id", "k", _r("mag").alias("mag"))


def power_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = spectrum.power_spectrum(spectrum.fft(vectors(spark, sf_dir), KEY, "x", "hann_periodic"), SIZE)
    band = lambda lo: spectrum.band_half_open(F.col("power"), F.col("k") * 1.0, float(lo), float(lo + 8))
    return z.groupBy("vec_id").agg(*[_r(band(lo)).alias(f"band_{lo}") for lo in (0, 8, 16, 24)], _r(F.sum("power")).alias("total"))


POWER_BANDS_SQL = f"""
WITH {_spectrum_sql("hann_periodic")}, p AS (SELECT vec_id, k, (re * re + im * im) / 1024 * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM z)
SELECT vec_id, {", ".join(f"round(sum(CASE WHEN k >= {lo} AND k < {lo + 8} THEN p ELSE 0 END), 6) AS band_{lo}" for lo in (0, 8, 16, 24))}, round(sum(p), 6) AS total FROM p GROUP BY vec_id
"""


def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectrum.rotation_measure(_hann(spark, sf_dir), KEY, 12.0, 1.0, 32)
    return out.select("vec_id", _r("rotation_hz", 4).alias("rotation_hz"), _r("snr", 4).alias("snr"))


_ROTATION = f"""{_spectrum_sql("hann_symmetric")},
m AS (SELECT vec_id, k, sqrt(re * re + im * im) * 2 / 64 / 0.5 / CASE WHEN k = 0 THEN 2 ELSE 1 END AS mag FROM z WHERE k < 32),
t AS (SELECT vec_id, arg_min(k, (-mag, k)) AS peak FROM m WHERE k BETWEEN 7 AND 17 GROUP BY vec_id),
y AS (SELECT m.vec_id, peak, max(CASE WHEN k = peak - 1 THEN mag END) AS y0, max(CASE WHEN k = peak THEN mag END) AS y1, max(CASE WHEN k = peak + 1 THEN mag END) AS y2,
             avg(CASE WHEN k BETWEEN 7 AND 17 AND abs(k - peak) > 2 THEN mag END) AS fl FROM m JOIN t ON m.vec_id = t.vec_id GROUP BY m.vec_id, peak),
rot AS (SELECT vec_id, peak + CASE WHEN abs(y0 - 2 * y1 + y2) > 1e-12 THEN greatest(-0.5, least(0.5, 0.5 * (y0 - y2) / (y0 - 2 * y1 + y2))) ELSE 0 END AS hz, CASE WHEN fl > 1e-20 THEN y1 / fl ELSE 0 END AS snr FROM y)"""
ROTATION_SQL = f"WITH {_ROTATION} SELECT vec_id, round(hz, 4) AS rotation_hz, round(snr, 4) AS snr FROM rot"


def v2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    mags = _hann(spark, sf_dir)
    speed = spectrum.rotation_measure(mags, KEY, 6.0, 1.0, 32, 0.4, 1.6)
    out = spectrum.features_v2(mags, KEY, speed, 6.0, 1.0, 32, 1.0, 31.0)
    return out.select("vec_id", *[_r(c, 5).alias(c) for c in ("harmonic1_ratio", "harmonic2_ratio", "harmonic3_ratio", "high_freq_ratio")])


def _band(lo: str, hi: str) -> str:
    return f"sum(CASE WHEN k BETWEEN greatest(floor({lo}), 1) AND least(ceil({hi}), 31) THEN e ELSE 0 END)"


V2_SQL = f"""
WITH {_ROTATION.replace("BETWEEN 7 AND 17", "BETWEEN 2 AND 10")},
e AS (SELECT m.vec_id, k, mag * mag AS e, hz FROM m JOIN rot ON m.vec_id = rot.vec_id)
SELECT vec_id, {", ".join(f"round({_band(f'{h} * hz - 1', f'{h} * hz + 1')} / greatest(sum(CASE WHEN k > 0 THEN e END), 1e-20), 5) AS harmonic{h}_ratio" for h in (1, 2, 3))},
       round({_band("27", "31")} / greatest(sum(CASE WHEN k > 0 THEN e END), 1e-20), 5) AS high_freq_ratio
FROM e GROUP BY vec_id
"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.window_statistics(long(spark, sf_dir), KEY)


def six_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectrum.features_six(_plain(spark, sf_dir), _stats(spark, sf_dir).select("vec_id", "rms", "kurtosis"), KEY, 10.0, 1.0, 32.0)
    return out.select("vec_id", "rotation_hz", *[_r(c, 5).alias(c) for c in ("rms", "kurtosis", "harmonic1_ratio", "harmonic2_ratio", "harmonic3_ratio", "high_freq_ratio")])


def v1_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectrum.features_v1(_plain(spark, sf_dir), _stats(spark, sf_dir).select("vec_id", "rms", "kurtosis"), KEY, 1.0, 2.0, (3.0, 9.0), (20.0, 28.0), 5.0)
    return out.select("vec_id", "rotation_hz", "peak_hz", *[_r(c, 5).alias(c) for c in ("peak_magnitude", "rms", "kurtosis", "harmonic1", "harmonic2", "harmonic3", "high_freq")])


_STATS = """st AS (SELECT vec_id, sqrt(avg(x * x)) AS rms, avg(pow(x, 4)) / pow(avg(x * x), 2) - 3 AS kurt, avg(pow(x, 3)) / pow(avg(x * x), 1.5) AS skew, max(abs(x)) AS peak FROM c GROUP BY vec_id)"""
_MAGS = f"{_spectrum_sql('none')}, m AS (SELECT vec_id, k, sqrt(re * re + im * im) * 2 / 64 AS mag FROM z WHERE k < 32), {_STATS}"
SIX_SQL = f"""
WITH {_MAGS}, t AS (SELECT vec_id, CAST(arg_min(k, (-mag, k)) AS DOUBLE) AS hz FROM m WHERE k BETWEEN 8 AND 12 GROUP BY vec_id),
a AS (SELECT m.vec_id, hz, sum(CASE WHEN k > 1 THEN mag END) + 1e-12 AS tot, {", ".join(f"sum(CASE WHEN abs(k - {h} * hz) <= 5 THEN mag ELSE 0 END) AS h{h}" for h in (1, 2, 3))}, sum(CASE WHEN k >= 10 * hz AND k <= 25.6 THEN mag ELSE 0 END) AS hf FROM m JOIN t ON m.vec_id = t.vec_id GROUP BY m.vec_id, hz)
SELECT a.vec_id, hz AS rotation_hz, round(rms, 5) AS rms, round(kurt, 5) AS kurtosis, {", ".join(f"round(h{h} / tot, 5) AS harmonic{h}_ratio" for h in (1, 2, 3))}, round(hf / tot, 5) AS high_freq_ratio FROM a JOIN st ON a.vec_id = st.vec_id
"""
V1_SQL = f"""
WITH {_MAGS}, t AS (SELECT vec_id, CAST(arg_min(k, (-mag, k)) AS DOUBLE) AS hz FROM m WHERE k BETWEEN 3 AND 9 GROUP BY vec_id),
a AS (SELECT m.vec_id, hz, CAST(arg_min(CASE WHEN k > 1 THEN k END, (-mag, k)) FILTER (WHERE k > 1) AS DOUBLE) AS pk, max(CASE WHEN k > 1 THEN mag END) AS pm, {", ".join(f"sum(CASE WHEN abs(k - {h} * hz) <= 2 THEN mag ELSE 0 END) AS h{h}" for h in (1, 2, 3))}, sum(CASE WHEN k BETWEEN 20 AND 28 THEN mag ELSE 0 END) AS hf FROM m JOIN t ON m.vec_id = t.vec_id GROUP BY m.vec_id, hz)
SELECT a.vec_id, hz AS rotation_hz, pk AS peak_hz, round(pm, 5) AS peak_magnitude, round(rms, 5) AS rms, round(kurt, 5) AS kurtosis, round(h1, 5) AS harmonic1, round(h2, 5) AS harmonic2, round(h3, 5) AS harmonic3, round(hf, 5) AS high_freq FROM a JOIN st ON a.vec_id = st.vec_id
"""


def window_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("vec_id", *[_r(c, 5).alias(c) for c in ("rms", "kurtosis", "skewness", "crest")])


STATISTICS_SQL = f"WITH {_LONG}, c AS (SELECT vec_id, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM s), {_STATS} SELECT vec_id, round(rms, 5) AS rms, round(kurt, 5) AS kurtosis, round(skew, 5) AS skewness, round(peak / rms, 5) AS crest FROM st"


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framing.frames(vectors(spark, sf_dir), "x", 16, 8)
    return out.select("vec_id", "start", _r(framing.rms(F.col("frame"))).alias("rms"), _r(framing.rms(framing.centred(F.col("frame")))).alias("ac_rms"))


FRAMED_SQL = f"""
WITH {_LONG}, f AS (SELECT vec_id, st.range * 8 AS start, i, x FROM s JOIN range(7) st ON i >= st.range * 8 AND i < st.range * 8 + 16)
SELECT vec_id, CAST(start AS INT) AS start, round(sqrt(avg(x * x)), 6) AS rms, round(sqrt(avg(x * x) - avg(x) * avg(x)), 6) AS ac_rms FROM f GROUP BY vec_id, start
"""


def framed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = framing.frames_of_samples(long(spark, sf_dir), KEY, "i", 20, 10)
    return out.groupBy("vec_id", "frame").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("x")).alias("mean"))


FRAMED_SAMPLES_SQL = f"""
WITH {_LONG} SELECT vec_id, st.range AS frame, count(*) AS n, round(avg(x), 6) AS mean FROM s JOIN range(5) st ON i >= st.range * 10 AND i < st.range * 10 + 20 GROUP BY vec_id, st.range
"""


def radial_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = long(spark, sf_dir).withColumn("axis", F.col("i") % 2).withColumn("i", F.floor(F.col("i") / 2))
    out = framing.radial_shape(axes, KEY, 32)
    return out.select("vec_id", *[_r(c, 5).alias(c) for c in ("kurtosis", "crest", "rms_variability")])


RADIAL_SQL = f"""
WITH {_LONG}, a AS (SELECT vec_id, i % 2 AS axis, i // 2 AS i, x - avg(x) OVER (PARTITION BY vec_id, i % 2) AS x FROM s),
r AS (SELECT vec_id, i, sum(x * x) AS r2 FROM a GROUP BY vec_id, i), p AS (SELECT vec_id, sqrt(avg(r2)) AS sub FROM r GROUP BY vec_id, i * 8 // 32),
v AS (SELECT vec_id, stddev_pop(sub) / avg(sub) AS v FROM p GROUP BY vec_id)
SELECT r.vec_id, round(avg(r2 * r2) / pow(avg(r2), 2), 5) AS kurtosis, round(sqrt(max(r2) / avg(r2)), 5) AS crest, round(greatest(any_value(v), 1e-8), 5) AS rms_variability FROM r JOIN v ON r.vec_id = v.vec_id GROUP BY r.vec_id
"""


def owned_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = spectrum.power(spectrum.fft(vectors(spark, sf_dir), KEY, "x", "hann_periodic"), KEY, SIZE)
    return spectrum.owned_bands(z, KEY, 1.0, 10.0, 25.0, upper_hz=20.0).select("vec_id", "owner", _r("energy").alias("energy"), _r("share", 4).alias("share"))


OWNED_SQL = f"""
WITH {_spectrum_sql("hann_periodic")}, p AS (SELECT vec_id, k, (re * re + im * im) / (64 * 64 * 0.375) * CASE WHEN k = 32 THEN 1 ELSE 2 END AS p FROM z WHERE k BETWEEN 1 AND 25),
o AS (SELECT vec_id, p, CASE WHEN k BETWEEN 3 AND 7 THEN '0.5x' WHEN k BETWEEN 8 AND 12 THEN '1x' WHEN k BETWEEN 13 AND 17 THEN '1.5x' WHEN k BETWEEN 18 AND 22 THEN '2x' WHEN k >= 20 THEN 'upper' ELSE 'other' END AS owner FROM p),
e AS (SELECT vec_id, owner, sum(p) AS energy FROM o GROUP BY vec_id, owner)
SELECT vec_id, owner, round(energy, 6) AS energy, round(100 * energy / sum(energy) OVER (PARTITION BY vec_id), 4) AS share FROM e
"""


def synchronous(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectrum.synchronous(long(spark, sf_dir), KEY, 5.0, FS, SIZE)
    return out.select("vec_id", _r("amplitude").alias("amplitude"), _r("phase", 5).alias("phase"))


SYNCHRONOUS_SQL = f"""
WITH {_LONG}, c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM s),
z AS (SELECT vec_id, 2.0 / 64 * sum(x * cos(2 * pi() * 5 * i / 64)) AS re, -2.0 / 64 * sum(x * sin(2 * pi() * 5 * i / 64)) AS im FROM c GROUP BY vec_id)
SELECT vec_id, round(sqrt(re * re + im * im), 6) AS amplitude, round(atan2(im, re), 5) AS phase FROM z
"""


def order_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = long(spark, sf_dir).select("vec_id", (F.col("i") * 1000).alias("t_us"), "x")
    pulses = vectors(spark, sf_dir).select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("ordinal")).select("vec_id", (F.col("ordinal") * 7000).cast("int").alias("t_us"), "ordinal")
    out = asof.order_projection(samples, pulses, KEY)
    return out.select("vec_id", *[_r(f"amp_{k}x", 5).alias(f"amp_{k}x") for k in (1, 2, 3)], *[_r(f"ratio_{k}x", 5).alias(f"ratio_{k}x") for k in (1, 2, 3)], _r("phase_1x", 4).alias("phase_1x"))


ORDER_SQL = f"""
WITH {_LONG}, c AS (SELECT vec_id, x - avg(x) OVER (PARTITION BY vec_id) AS x, 2 * pi() * (i // 7 % 1 + (i * 1000 - i // 7 * 7000) / 7000.0) AS a FROM s),
z AS (SELECT vec_id, avg(x * x) AS ms, {", ".join(f"2 * sqrt(pow(sum(x * cos({k} * a)), 2) + pow(sum(x * sin({k} * a)), 2)) / 64 AS a{k}" for k in (1, 2, 3))}, atan2(-sum(x * sin(a)), sum(x * cos(a))) AS ph FROM c GROUP BY vec_id)
SELECT vec_id, {", ".join(f"round(a{k}, 5) AS amp_{k}x" for k in (1, 2, 3))}, {", ".join(f"round(0.5 * a{k} * a{k} / ms, 5) AS ratio_{k}x" for k in (1, 2, 3))}, round(ph, 4) AS phase_1x FROM z
"""


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return metrics.nearest_centroid(v, v, "label", "x", "vec_id").select("vec_id", "predicted", _r("distance").alias("distance"))


CENTROIDS_SQL = f"""
WITH {_LONG}, m AS (SELECT label, i, avg(x) AS x FROM s GROUP BY label, i),
d AS (SELECT s.vec_id, m.label, sum((s.x - m.x) * (s.x - m.x)) AS d FROM s JOIN m ON s.i = m.i GROUP BY s.vec_id, m.label)
SELECT vec_id, arg_min(label, (d, label)) AS predicted, round(min(d), 6) AS distance FROM d GROUP BY vec_id
"""

#: Three fixed linear models of four classes on the first four components; a stand-in for fitted ones.
_MODELS = [([0.01 * f, 0.0, -0.01 * f, 0.02], [1.0 + f, 2.0, 0.5, 0.25], [[(c * 3 + i * 5 + f) % 7 - 3.0 for i in range(4)] for c in range(4)], [0.1 * c - 0.05 * f for c in range(4)]) for f in range(3)]
_TREE = {"feature": 0, "threshold": 0.0, "left": {"feature": 1, "threshold": 0.05, "left": {"label": 0}, "right": {"label": 1}}, "right": {"feature": 2, "threshold": -0.05, "left": {"label": 2}, "right": {"feature": 3, "threshold": 0.1, "left": {"label": 3}, "right": {"label": 1}}}}


def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, bias = scoring.folded(_MODELS)
    v = vectors(spark, sf_dir).withColumn("f", F.slice("x", 1, 4)).withColumn("scores", scoring.margins(F.col("f"), weights, bias))
    columns = v.withColumns({f"f{i}": F.col("f")[i] for i in range(4)})
    added = F.aggregate(scoring.contributions(F.col("f"), weights[0]), F.lit(bias[0]), lambda t, x: t + x)
    return columns.select("vec_id", scoring.best_class(F.col("scores")).alias("best"), _r(metrics.top_margin(F.col("scores"))).alias("margin"), _r(added).alias("score_0"), scoring.tree(_TREE, [f"f{i}" for i in range(4)]).alias("tree"))


def _linear_sql() -> str:
    weights, bias = scoring.folded(_MODELS)
    f = [f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(4)]
    scores = ", ".join(" + ".join(f"({w!r}) * {x}" for w, x in zip(ws, f, strict=True)) + f" + ({b!r})" for ws, b in zip(weights, bias, strict=True))
    return f"""
WITH s AS (SELECT vec_id, embedding, [{scores}] AS sc FROM embeddings)
SELECT vec_id, CAST(list_position(sc, list_max(sc)) - 1 AS INT) AS best, round(list_sort(sc)[4] - list_sort(sc)[3], 6) AS margin, round(sc[1], 6) AS score_0,
       CASE WHEN {f[0]} <= 0 THEN CASE WHEN {f[1]} <= 0.05 THEN 0 ELSE 1 END WHEN {f[2]} <= -0.05 THEN 2 WHEN {f[3]} <= 0.1 THEN 3 ELSE 1 END AS tree
FROM s
"""


def waveform_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide feature vector of every window, in long form."""
    out = waveform.waveform_features(vectors(spark, sf_dir), "x", FS, 4.0)
    return out.select("vec_id", F.posexplode("features").alias("feature", "value")).withColumn("value", _r("value"))


def held_out_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shallow trees of the labels, each fold of vectors by a model of the others: rows and hits of each class."""
    rows = vectors(spark, sf_dir).select("vec_id", "label", "x", F.pmod(F.xxhash64("vec_id"), F.lit(3)).alias("fold"))
    out = models.held_out_predictions(rows, "label", "x", "fold", models.shallow_tree, 3)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("hits"))


QUERIES = {
    "held_out_trees": (held_out_trees, None),
    "waveform_features": (waveform_features, None),
    "amplitude_spectrum": (amplitude_spectrum, AMPLITUDE_SQL),
    "hann_spectrum": (hann_spectrum, HANN_SQL),
    "fft_spectrum": (fft_spectrum, HANN_SQL),
    "power_bands": (power_bands, POWER_BANDS_SQL),
    "rotation": (rotation, ROTATION_SQL),
    "v1_features": (v1_features, V1_SQL),
    "v2_features": (v2_features, V2_SQL),
    "six_features": (six_features, SIX_SQL),
    "window_statistics": (window_statistics, STATISTICS_SQL),
    "framed": (framed, FRAMED_SQL),
    "framed_samples": (framed_samples, FRAMED_SAMPLES_SQL),
    "radial_shape": (radial_shape, RADIAL_SQL),
    "owned_bands": (owned_bands, OWNED_SQL),
    "synchronous": (synchronous, SYNCHRONOUS_SQL),
    "order_tracking": (order_tracking, ORDER_SQL),
    "centroids": (centroids, CENTROIDS_SQL),
    "linear_scores": (linear_scores, _linear_sql()),
}
