"""Readers of recordings and logs, and writers of results."""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kurtosia.operators.metrics import by_class
from kurtosia.operators.records import measurements

from .archives import members, parsed

WAVES = "path string, name string, signal array<double>"


def _wave(path: str, name: str, signal: np.ndarray) -> pa.RecordBatch:
    """One row whose samples are the array's own memory."""
    x = np.ascontiguousarray(signal, dtype=float).ravel()
    samples = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), samples], ["path", "name", "signal"])


def _files(spark: SparkSession, path: str, parse) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                for name, signal in parse(content.as_py()):
                    yield _wave(p, name, signal)

    return files.mapInArrow(run, WAVES)


# Numeric types of MATLAB level-5 elements.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def mat_variables(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Real numeric variables of a level-5 MAT file."""

    def element(at: int) -> tuple[int, bytes, int]:
        kind, size = struct.unpack_from("<II", data_, at)
        if kind >> 16:  # small element
            return kind & 0xFFFF, data_[at + 4 : at + 4 + (kind >> 16)], at + 8
        return kind, data_[at + 8 : at + 8 + size], at + 8 + size + (-size % 8 if kind != 15 else 0)

    queue, data_ = [data[128:]], b""
    while queue:
        data_ = queue.pop()
        at = 0
        while at + 8 <= len(data_):
            kind, body, at = element(at)
            if kind == 15:
                queue.append(zlib.decompress(body))
            elif kind == 14:
                outer, data_ = data_, body
                _, _, i = element(0)
                _, _, i = element(i)
                _, name, i = element(i)
                value, raw, _ = element(i)
                data_ = outer
                if value in MAT_TYPES:
                    yield name.decode("ascii"), np.frombuffer(raw, dtype="<" + MAT_TYPES[value]).astype(float)


def read_mat(spark: SparkSession, path: str, suffix: str = "_DE_time") -> DataFrame:
    """(path, name, signal) of the variables of MAT files whose names end in ``suffix``."""
    return _files(spark, path, lambda content: [(n, v) for n, v in mat_variables(content) if n.endswith(suffix)])


def read_npy_zip(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(path, name, trial, member, signal) of the .npy members of ZIP files.

    trial is the number in the archive's name, member the one in the member's.  A bad
    checksum, samples that are not finite or numeric, more than one dimension beside
    those of length 1 or, where ``size`` is given, another number of samples fail the read.
    """

    def parse(path: str, name: str, content: bytes):
        x = np.load(io.BytesIO(content), allow_pickle=False)
        if x.dtype.kind not in "fiu" or np.squeeze(x).ndim > 1:
            raise ValueError(f"{name}: not one signal of numbers")
        if size is not None and x.size != size:
            raise ValueError(f"{name}: {x.size} samples, expected {size}")
        if not np.isfinite(x).all():
            raise ValueError(f"{name}: samples are not finite")
        return _wave(path, name, x)

    waves = parsed(members(spark, path).where(F.endswith("name", F.lit(".npy"))), parse, WAVES)
    number = lambda c: F.regexp_extract(c, r"([0-9]+)[^0-9/]*$", 1).try_cast("int")
    return waves.select("path", "name", number(F.element_at(F.split("path", "/"), -1)).alias("trial"), number(F.col("name")).alias("member"), "signal")


def read_csv_zip(spark: SparkSession, path: str, column: int = 0, header: bool = True) -> DataFrame:
    """(path, name, condition, number, role, signal) of one column of the CSV members of ZIP files (see ``member_role``)."""

    def parse(path: str, name: str, content: bytes):
        rows = content.decode("utf-8-sig").splitlines()[int(header) :]
        return _wave(path, name, np.array([r.split(",")[column] for r in rows if r.strip()], dtype=float))

    condition, number, role = member_role(F.col("name"))
    waves = parsed(members(spark, path).where(F.endswith(F.lower("name"), F.lit(".csv"))), parse, WAVES)
    return waves.select("path", "name", condition.alias("condition"), number.alias("number"), role.alias("role"), "signal")


def read_rotation_csv(spark: SparkSession, path: str, column: int = 1, columns: int = 8) -> DataFrame:
    """(path, rotation_hz, x) of one column of CSV files named after their speed in Hz."""
    schema = ", ".join(f"c{i} double" for i in range(columns))
    hz = F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]+(?:[.][0-9]+)?)[.]csv", 1).cast("double")
    return spark.read.schema(schema).csv(path).select(F.col("_metadata.file_path").alias("path"), hz.alias("rotation_hz"), F.col(f"c{column}").alias("x"))


def member_role(name: Column) -> tuple[Column, Column, Column]:
    """(condition, number, role) of a member name like <prefix>_<condition>_<two digits>.csv; role by number: baseline, calibration, evaluation."""
    pattern = r"rpm_(.+)_([0-9][0-9])[.]csv$"
    n = F.regexp_extract(name, pattern, 2).try_cast("int")
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), n, F.when(n <= 7, "baseline").when(n <= 11, "calibration").when(n.isNotNull(), "evaluation")


TRACE = "group string, session string, block int, window int, ending_member int, source_label string, instant_valid boolean, instant_flag boolean, confirmed_valid boolean, is_anomaly boolean, z array<double>"


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Verdict traces (JSON lines, gzip or not); a wrong type fails, and a row's group has to be its folder's name."""
    rows = spark.read.schema(TRACE).option("mode", "FAILFAST").json(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.withColumn("_ok", F.assert_true(F.col("group") == folder, "group differs from its folder")).where("_ok is null").drop("_ok")


def read_records(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(line, kind, errors) of serial logs, as a batch or a stream; nothing is dropped."""
    lines = (spark.readStream if stream else spark.read).text(path).select(F.col("value").alias("line"))
    return measurements(lines, "line").withColumn("errors", F.when(F.col("kind") == "record", F.col("errors")))


def read_verified(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """(path, content) of a file whose SHA-256 has to be the given one."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    ok = F.assert_true(F.sha2("content", 256) == sha256, F.concat(F.lit("hash differs: "), "path"))
    return files.withColumn("_ok", ok).where("_ok is null").drop("_ok")


def write_jsonl(df: DataFrame, path: str, day: str | None = None, zone: str = "UTC") -> None:
    """Appends JSON lines; with ``day``, a UTC timestamp column, into a folder for each local day."""
    if day is None:
        df.write.mode("append").json(path)
    else:
        local = F.to_date(F.from_utc_timestamp(day, zone))
        df.withColumn("day", local).write.mode("append").partitionBy("day").json(path)


def cached_features(spark: SparkSession, path: str, key: str, build) -> DataFrame:
    """The feature table at ``path`` if it was written under ``key`` (a hash of sources, code and profile), else built and written anew."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(f"{path}/{key}")
    return spark.read.parquet(f"{path}/{key}")


def cache_key(**parts) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


# What injected faults do to the amplitudes of the turning frequency's multiples and of the high band ("hf").
FAULTS = {
    "normal": {},
    "unbalance": {1: 2.2},
    "misalignment": {2: 3.5},
    "looseness": {2: 1.8, 3: 3.0, 4: 3.0},
    "high_frequency": {"hf": 4.0},
    "power_off": {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, "hf": 0.0},
}


def synthetic(
    spark: SparkSession, windows: int, size: int, fs: float, hz: float, harmonics: dict[int, float], noise: float = 0.05, wear: float = 0.0, seed: int = 1, jitter_hz: float = 0.0, amp_jitter: float = 0.0, fault: str = "normal", hf: tuple[float, float] = (0.0, 240.0)
) -> DataFrame:
    """(window_id, i, x): a rotation with harmonics, a high tone (amplitude, Hz) and hashed noise.

    ``wear`` grows the harmonics from the first window to the last; speed and amplitudes of a
    window vary by Gaussian jitter; ``fault`` multiplies amplitudes as FAULTS says.
    """
    rows = spark.range(windows * size).select(F.floor(F.col("id") / size).alias("window_id"), (F.col("id") % size).cast("int").alias("i"))
    u = lambda *of: F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    gauss = lambda tag, *of: F.sqrt(-2 * F.ln(u(*of, F.lit(f"{tag}1")) + 1e-12)) * F.cos(2 * np.pi * u(*of, F.lit(f"{tag}2")))
    t = (F.col("window_id") * size + F.col("i")) / fs
    grown = 1 + wear * F.col("window_id") / max(windows - 1, 1)
    turn = hz + jitter_hz * gauss("hz", "window_id") if jitter_hz else F.lit(float(hz))
    level = 1 + amp_jitter * gauss("amp", "window_id") if amp_jitter else F.lit(1.0)
    factor = FAULTS[fault]
    wave = F.lit(0.0)
    for k, a in harmonics.items():
        wave = wave + a * factor.get(k, 1.0) * (F.lit(1.0) if k == 1 else grown) * level * F.sin(2 * np.pi * k * turn * t)
    wave = wave + hf[0] * factor.get("hf", 1.0) * F.sin(2 * np.pi * hf[1] * t)
    return rows.withColumn("x", wave + noise * gauss("x", "window_id", "i"))


def write_results(predictions: DataFrame, path: str, truth: str, predicted: str) -> None:
    """A run's predictions as CSV, its errors as CSV and its class metrics as JSON, each in a folder of ``path``."""
    wrong = ~F.col(truth).eqNullSafe(F.col(predicted))
    predictions.write.mode("overwrite").option("header", True).csv(f"{path}/predictions")
    predictions.where(wrong).write.mode("overwrite").option("header", True).csv(f"{path}/errors")
    by_class(predictions, [], truth, predicted).write.mode("overwrite").json(f"{path}/by_class")
