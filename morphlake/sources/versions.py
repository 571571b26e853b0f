"""Tables that are replaced whole while others read them.

A versioned folder has a folder for each state of the table and the file POINTER, which names the state
that counts. A new state is written beside the others and the pointer is then exchanged by one rename, so
readers see the old or the new state, and a job that is lost on the way changes nothing. A table may be
read, changed and written back under its own name: the state that it was read from stays, and so do
readers that have begun. States older than the last one kept are deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The file that names the current state.
POINTER = "_current"


def _files(spark: SparkSession, path: str):
    """The file system of a path and a maker of paths."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def is_folder(spark: SparkSession, path: str) -> bool:
    files, make = _files(spark, path)
    return files.exists(make(path)) and files.getFileStatus(make(path)).isDirectory()


def current(spark: SparkSession, path: str) -> str:
    """The folder of the current state; the path itself where it is not versioned."""
    path = path.rstrip("/")
    files, make = _files(spark, path)
    pointer = make(f"{path}/{POINTER}")
    if not files.exists(pointer):
        return path
    stream = files.open(pointer)
    try:
        return f"{path}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def _point(spark: SparkSession, folder: str, state: str) -> None:
    """Exchange the pointer: a file of its own, renamed over the old one."""
    files, make = _files(spark, folder)
    jvm = spark.sparkContext._jvm
    new = make(f"{folder}/{POINTER}-{uuid.uuid4().hex}")
    stream = files.create(new)
    stream.write(bytearray(state.encode()))
    stream.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(new), files.makeQualified(make(f"{folder}/{POINTER}")), options)


def states(spark: SparkSession, path: str) -> list[str]:
    """Names of the states of a versioned folder, oldest first."""
    files, make = _files(spark, path)
    found = [f.getPath().getName() for f in files.listStatus(make(path.rstrip("/"))) if f.isDirectory()]
    return sorted(name for name in found if name.startswith("v"))


def write(table: DataFrame, path: str, kind: str = "parquet", keep: int = 1, **options) -> None:
    """Make ``table`` the state of a versioned folder, and keep ``keep`` states before it.

    ``table`` may read the folder itself. A plain file or folder of that name becomes its first state; only
    then there is a moment in which the name is not there. Of writers at the same time the last one counts.
    """
    spark, path = table.sparkSession, path.rstrip("/")
    files, make = _files(spark, path)
    plain = files.exists(make(path)) and not files.exists(make(f"{path}/{POINTER}"))
    number = 1 + max((int(s[1:11]) for s in (states(spark, path) if not plain and files.exists(make(path)) else [])), default=0)
    state = f"v{number:010d}-{uuid.uuid4().hex[:8]}"
    if plain:
        stage = f"{path}-{uuid.uuid4().hex}"
        table.write.format(kind).options(**options).save(f"{stage}/{state}")
        _point(spark, stage, state)
        old = f"{path}-{uuid.uuid4().hex}"
        files.rename(make(path), make(old))
        files.rename(make(stage), make(path))
        if files.getFileStatus(make(old)).isDirectory():
            files.rename(make(old), make(f"{path}/v{0:010d}-plain"))
        else:
            files.mkdirs(make(f"{path}/v{0:010d}-plain"))
            files.rename(make(old), make(f"{path}/v{0:010d}-plain/{make(path).getName()}"))
    else:
        table.write.format(kind).options(**options).save(f"{path}/{state}")
        _point(spark, path, state)
    for name in [s for s in states(spark, path) if s < state][: -keep or None]:
        files.delete(make(f"{path}/{name}"), True)


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """The current state. What is read stays that state, whatever is written later, until it is deleted."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(current(spark, path))
