import gzip
import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kurtosia.sources import readers


def _mat(variables):
    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    out = b"MATLAB 5.0".ljust(124) + struct.pack("<HH", 0x0100, 0x4D49)
    for name, x in variables.items():
        body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", len(x), 1)) + element(1, name.encode()) + element(9, np.asarray(x, "<f8").tobytes())
        packed = zlib.compress(element(14, body))
        out += struct.pack("<II", 15, len(packed)) + packed
    return out


def test_mat_and_npy(spark, tmp_path):
    (tmp_path / "a.mat").write_bytes(_mat({"X097_DE_time": [1.0, 2.0], "X097_FE_time": [3.0]}))
    assert [(r.name, r.signal) for r in readers.read_mat(spark, str(tmp_path / "a.mat")).collect()] == [("X097_DE_time", [1.0, 2.0])]
    for name, x in (("ok", [1.5, 2.5]), ("bad", [float("nan")])):
        data = io.BytesIO()
        np.save(data, np.array(x))
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("m1.npy", data.getvalue())
    assert readers.read_npy_zip(spark, str(tmp_path / "ok.zip")).first().signal == [1.5, 2.5]
    with pytest.raises(Exception, match="not finite"):
        readers.read_npy_zip(spark, str(tmp_path / "bad.zip")).collect()


def test_rotation_from_file_names(spark, tmp_path):
    (tmp_path / "12.288.csv").write_text("1,2,3\n4,5,6\n")
    assert {(r.rotation_hz, r.x) for r in readers.read_rotation_csv(spark, str(tmp_path), 1, 3).collect()} == {(12.288, 2.0), (12.288, 5.0)}
    names = spark.createDataFrame([("MA342_1200rpm_AW__D_03.csv",), ("MA342_1200rpm_A__D_12.csv",), ("other",)], "n string")
    c, n, role = readers.member_role(F.col("n"))
    assert [tuple(r) for r in names.select(c, n, role).collect()] == [("AW__D", 3, "baseline"), ("A__D", 12, "evaluation"), (None, None, None)]


def test_trace_types_are_strict(spark, tmp_path):
    row = {"group": "g1", "session": "s", "block": 0, "window": 1, "ending_member": None, "source_label": "belt", "instant_valid": True, "instant_flag": False, "confirmed_valid": False, "is_anomaly": None, "z": [0.1] * 5}
    for folder, r in (("g1", row), ("g2", row), ("g3", row | {"group": "g3", "block": "x"})):
        (tmp_path / folder).mkdir()
        with gzip.open(tmp_path / folder / "t.jsonl.gz", "wt") as f:
            f.write(json.dumps(r) + "\n")
    assert readers.read_trace(spark, str(tmp_path / "g1")).first().z == [0.1] * 5
    for folder in ("g2", "g3"):
        with pytest.raises(Exception, match="folder|BLOCK|MALFORMED|Malformed"):
            readers.read_trace(spark, str(tmp_path / folder)).collect()


def test_logs_sinks_and_hashes(spark, tmp_path):
    (tmp_path / "log.txt").write_text('boot\n{"reason":1}\n')
    rows = readers.read_records(spark, str(tmp_path / "log.txt")).collect()
    assert [r.kind for r in rows] == ["console", "record"] and any("reason" in e for e in rows[1].errors)
    import hashlib

    digest = hashlib.sha256((tmp_path / "log.txt").read_bytes()).hexdigest()
    assert readers.read_verified(spark, str(tmp_path / "log.txt"), digest).count() == 1
    with pytest.raises(Exception, match="hash differs"):
        readers.read_verified(spark, str(tmp_path / "log.txt"), "0" * 64).collect()
    df = spark.sql("select timestamp'2024-01-01 20:00:00' as at, '가' as v")
    readers.write_jsonl(df, str(tmp_path / "out"), "at", "Asia/Seoul")
    assert [p.name for p in (tmp_path / "out").glob("day=*")] == ["day=2024-01-02"]
    built = []
    for _ in range(2):
        readers.cached_features(spark, str(tmp_path / "cache"), readers.cache_key(code=1), lambda: built.append(1) or spark.range(3))
    assert len(built) == 1


def test_synthetic_repeats_and_wears(spark):
    a = readers.synthetic(spark, 4, 64, 64.0, 8.0, {1: 1.0, 2: 0.5}, wear=1.0)
    assert a.exceptAll(readers.synthetic(spark, 4, 64, 64.0, 8.0, {1: 1.0, 2: 0.5}, wear=1.0)).count() == 0
    power = [r.p for r in a.groupBy("window_id").agg(F.avg(F.col("x") * F.col("x")).alias("p")).orderBy("window_id").collect()]
    assert power == sorted(power)


def test_csv_in_zip_and_sizes_of_npy(spark, tmp_path):
    import io
    import zipfile

    with zipfile.ZipFile(tmp_path / "rotor_03.zip", "w") as z:
        z.writestr("rpm_normal_05.csv", "t,x\n0,1.5\n1,2.5\n")
        z.writestr("rpm_belt_12.csv", "t,x\n0,3\n")
    out = {(r.condition, r.number, r.role): list(r.signal) for r in readers.read_csv_zip(spark, str(tmp_path / "rotor_03.zip"), 1).collect()}
    assert out == {("normal", 5, "baseline"): [1.5, 2.5], ("belt", 12, "evaluation"): [3.0]}
    raw = io.BytesIO()
    np.save(raw, np.arange(6.0))
    with zipfile.ZipFile(tmp_path / "trial7.zip", "w") as z:
        z.writestr("wave_11.npy", raw.getvalue())
    (r,) = readers.read_npy_zip(spark, str(tmp_path / "trial7.zip"), 6).collect()
    assert (r.trial, r.member, len(r.signal)) == (7, 11, 6)
    with pytest.raises(Exception, match="expected 5"):
        readers.read_npy_zip(spark, str(tmp_path / "trial7.zip"), 5).collect()


def test_injected_faults_and_result_sinks(spark, tmp_path):
    from kurtosia.operators import spectrum

    def amplitudes(fault):
        rows = readers.synthetic(spark, 1, 256, 256.0, 20.0, {1: 0.3, 2: 0.08, 3: 0.05, 4: 0.03}, noise=0.0, fault=fault, hf=(0.02, 100.0))
        return {r.k: r.mag for r in spectrum.amplitude(spectrum.dft(rows, ["window_id"], 256), 256).collect()}

    normal = amplitudes("normal")
    assert amplitudes("unbalance")[20] == pytest.approx(2.2 * normal[20]) and amplitudes("misalignment")[40] == pytest.approx(3.5 * normal[40])
    assert amplitudes("looseness")[80] == pytest.approx(3 * normal[80]) and amplitudes("high_frequency")[100] == pytest.approx(4 * normal[100]) and max(amplitudes("power_off").values()) < 1e-9
    jittered = readers.synthetic(spark, 6, 64, 64.0, 8.0, {1: 1.0}, noise=0.0, jitter_hz=0.8, amp_jitter=0.1)
    assert jittered.groupBy("window_id").max("x").select("max(x)").distinct().count() == 6
    told = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "truth string, predicted string")
    readers.write_results(told, str(tmp_path / "run"), "truth", "predicted")
    assert spark.read.option("header", True).csv(str(tmp_path / "run/errors")).count() == 1 and spark.read.json(str(tmp_path / "run/by_class")).count() == 2
