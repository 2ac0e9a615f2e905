import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(shared / "checkpoint"))
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Asserts that a query and its SQL give the same rows on the smallest tables."""
    import duckdb

    db = duckdb.connect()
    at = DATA / "sf0.001"
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")

    def told(v):
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)

    def check(query, sql):
        df = query(spark, str(at))
        cursor = db.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted("|".join(map(told, r)) for r in cursor.fetchall())
        got = sorted("|".join(told(r[n]) for n in names) for r in df.collect())
        assert got == want

    return check
