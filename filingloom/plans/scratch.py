"""Tables written in the shared folder of the cluster, to cut lineage and to read a costly stage more than once.

They stay until the driver ends, or, inside ``with scope():``, until the block does.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where a session in one process (a test) has none.

    A cluster without one is an error: its executors can't read each other's local folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="filingloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


def folder_for(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed like the tables."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clear)
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: later plans start from files that every executor can read."""
    spark = df.sparkSession
    path = folder_for(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialise` as soon as all that needs them is written, so the folder holds less at once."""
    gone = {t._scratch_path for t in tables}
    for spark, path in [x for x in _written if x[1] in gone]:
        _delete(spark, path)
        _written.remove((spark, path))


@contextmanager
def scope() -> Iterator[None]:
    """Removes at its end what was written inside; results must have been used or saved by then."""
    before = len(_written)
    try:
        yield
    finally:
        clear(before)


def clear(keep: int = 0) -> None:
    """Remove what :func:`materialise` wrote, but for the first ``keep`` tables; harmless at any time."""
    while len(_written) > keep:
        _delete(*_written.pop())


def _delete(spark: object, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; the folder is the cluster's to clean then
        pass
