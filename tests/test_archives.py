"""Archives are read member by member, feature views source by source."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kurtosia.sources import archives, features, readers


def npy(x):
    raw = io.BytesIO()
    np.save(raw, x)
    return raw.getvalue()


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_members_spread_over_tasks(spark, tmp_path, method):
    with zipfile.ZipFile(tmp_path / "trial4.zip", "w", method) as z:
        z.mkdir("waves")
        for i in range(40):
            z.writestr(f"waves/wave_{i:02}.npy", npy(np.arange(500.0) + i), compress_type=method)
        z.writestr("notes.txt", "")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = readers.read_npy_zip(spark, str(tmp_path), 500).withColumn("task", F.spark_partition_id())
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted((r.member, r.signal[0], len(r.signal)) for r in rows) == [(i, float(i), 500) for i in range(40)]
    assert len({r.task for r in rows}) >= 6
    assert {(r.name, r.size) for r in archives.members(spark, str(tmp_path)).where("name not like '%.npy'").collect()} == {("notes.txt", 0)}


def test_only_chosen_members_are_read(spark, tmp_path):
    """A member whose bytes are damaged fails no read that leaves it out by name."""
    at = tmp_path / "a.zip"
    with zipfile.ZipFile(at, "w") as z:
        z.writestr("good_1.npy", npy(np.array([1.0, 2.0])))
        z.writestr("bad_2.npy", npy(np.array([7.25, 7.5])))
    data = at.read_bytes()
    at.write_bytes(data.replace(np.array([7.25]).tobytes(), np.array([7.75]).tobytes()))
    chosen = archives.members(spark, str(at))
    parse = lambda path, name, content: readers._wave(path, name, np.load(io.BytesIO(content)))
    (r,) = archives.parsed(chosen.where("name like 'good%'"), parse, readers.WAVES).collect()
    assert r.signal == [1.0, 2.0]
    with pytest.raises(Exception, match="Bad CRC-32"):
        archives.parsed(chosen, parse, readers.WAVES).collect()


def test_archives_without_members(spark, tmp_path):
    zipfile.ZipFile(tmp_path / "none.zip", "w").close()
    assert archives.members(spark, str(tmp_path)).collect() == readers.read_csv_zip(spark, str(tmp_path)).collect() == []


def test_views_build_what_changed(spark, tmp_path):
    for i in range(10):
        (tmp_path / f"in_{i}.txt").write_text(f"{i}\n{i + 1}\n")
    view, built = str(tmp_path / "view"), []

    def build(changed):
        names = [r.source for r in changed.collect()]
        built.append(sorted(n[-5] for n in names))
        return spark.read.text(names).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.sum(F.col("value").cast("long")).alias("total")).select(F.regexp_replace("path", "^file:/+", "file:/").alias("source"), "total")

    def refreshed(version=""):
        return features.refresh(spark, view, features.fingerprints(spark, str(tmp_path / "in_*.txt")), build, version)

    def totals(generation=None):
        return {r.source[-5]: r.total for r in features.features(spark, view, generation).collect()}

    with pytest.raises(FileNotFoundError):
        totals()
    assert refreshed() == 1 and refreshed() == 1 and len(built[0]) == 10 and len(built) == 1
    first = {str(i): 2 * i + 1 for i in range(10)}
    assert totals() == first
    (tmp_path / "in_3.txt").write_text("100\n")
    (tmp_path / "in_7.txt").unlink()
    assert refreshed() == 2 and built[1:] == [["3"]]
    assert totals() == {**{k: v for k, v in first.items() if k != "7"}, "3": 100} and totals(1) == first
    (tmp_path / "in_8.txt").write_text("no number\n")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        refreshed()
    assert features.generations(spark, view) == [1, 2] and totals()["8"] == 17
    (tmp_path / "in_8.txt").write_text("5\n")
    assert refreshed() == 3 and built[-1] == ["8"] and totals()["8"] == 5
    assert refreshed("new code") == 4 and len(built[-1]) == 9


def test_views_refuse_unclear_sources_and_second_writers(spark, tmp_path):
    view = str(tmp_path / "view")
    build = lambda changed: changed.withColumn("x", F.lit(1))
    twice = spark.createDataFrame([("a", "1"), ("a", "2")], "source string, fingerprint string")
    with pytest.raises(Exception, match="two fingerprints"):
        features.refresh(spark, view, twice, build)
    with pytest.raises(Exception, match="no name"):
        features.refresh(spark, view, spark.createDataFrame([(None, "1")], "source string, fingerprint string"), build)

    def overtaken(changed):
        (tmp_path / "view" / "claims").mkdir(parents=True)
        (tmp_path / "view" / "claims" / "1").write_text("")
        return build(changed)

    with pytest.raises(Exception, match="(?i)exist"):
        features.refresh(spark, view, twice.limit(1), overtaken)
    assert features.generations(spark, view) == []
    assert features.refresh(spark, view, twice.limit(1), build) == 2  # the claim left behind blocks nothing
    assert features.features(spark, view).count() == 1
