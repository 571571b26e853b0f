"""Limits of the Arrow batches in which rows go through Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Documents that are taken apart at a time: as Python objects they are many times the size of their batch.
SLICE = 64


def bounded_batches(df: DataFrame, rows: int = 1000, size: str = "16m") -> DataFrame:
    """``df``, after limiting the Arrow batches of its session, so whole texts fit into a Python worker.

    Spark reads these settings when a plan runs, so they stay; smaller limits of the caller are kept.
    """
    conf = df.sparkSession.conf
    as_bytes = df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", as_bytes(size))):
        now = conf.get(key)
        if now.startswith("-") or not 0 < as_bytes(now) <= most:
            conf.set(key, str(most))
    return df
