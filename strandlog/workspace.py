"""Tables written between steps, in the folder all executors share."""

from __future__ import annotations

import atexit
import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder, as in tests on one machine.
LOCAL_DEFAULT = "/tmp/checkpoints/strandlog"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a local one, but never on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_DEFAULT).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the Python process ends."""
    path = f"{shared_dir(spark)}/strandlog-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: With this setting Spark removes an execution's shuffle files when it ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to Python at a time, at most: each task holds a few such batches of texts or sets outside Spark's heap, and its worker as many.
_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 4096


@contextmanager
def _held(spark: SparkSession, **settings: str):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _lean(spark: SparkSession):
    """Shuffle files go when an execution ends, and batches for Python are small."""
    rows = int(spark.conf.get(_ROWS))
    return _held(spark, **{_CLEANUP: "true", _ROWS: str(min(rows, ROWS) if rows > 0 else ROWS)})


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it again: later steps survive a lost executor and don't compute it twice.

    What the write shuffled isn't needed again and goes at once.
    """
    path = new_path(df.sparkSession, name)
    with _lean(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(df: DataFrame) -> None:
    """Delete what materialize wrote for df, which must not be read again."""
    for entry in [e for e in _written if e[1] == df.written_to]:
        _written.remove(entry)
        discard(*entry)


@contextmanager
def passing():
    """Delete what is written within, at the end of the block, but for the tables given to keep()."""
    before, kept = set(_written), set()
    yield lambda df: kept.add(df.written_to)
    for entry in [e for e in _written if e not in before and e[1] not in kept]:
        _written.remove(entry)
        discard(*entry)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def discard(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            discard(spark, path)
        except Exception:  # the JVM or the file may be gone by now; the others still have to go
            continue
