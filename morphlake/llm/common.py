"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import bounded_batches  # noqa: F401  the operators take it from here

#: Regular expression of a word: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is missing, as in a local session, a folder of this machine is used.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "morphlake-shared")
        os.makedirs(folder[len("file://") :], exist_ok=True)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    return Scratch().write(df, name)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM delete a folder when it ends, for results that are read until then."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


class Scratch:
    """Tables of the shared folder that one operator writes for itself, to be deleted together."""

    def __init__(self) -> None:
        self.written: list[tuple[SparkSession, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(df.sparkSession, name)
        df.write.parquet(path)
        remove_at_exit(df.sparkSession, path)
        self.written.append((df.sparkSession, path))
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete all of them; nothing may read them any more."""
        for spark, path in self.written:
            remove(spark, path)
        self.written.clear()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder once nothing reads it any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are written.

    It does so when the driver has collected their plans; this asks for that, and results do not
    depend on it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    blank = " \t\n\u000b\f\r"
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(blank))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
