"""Tables written once, so that all that is built on them reads the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` as rows in the checkpoint folder: what is built on it carries no fitted model, and lost executors lose no prediction."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
