"""Shared working folder: where lineage is cut and side files are written.

The cluster names it in ``spark.checkpoint.dir``; every executor reaches it. Only a
session that names none (tests, a laptop) gets a folder of its own.

Tables written here are removed once the table that replaces them is whole, and the shuffle
files of a write go with it, so that the disk holds what is still to be read and no more.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Shuffle files go when the write that needed them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    base = spark.conf.get(SETTING, None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='histlake-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/histlake/{label}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write(df: DataFrame, path: str, *, by: Iterable[str] = (), options: dict[str, str] | None = None) -> None:
    """Write Parquet; the shuffle files of the write go with it."""
    with _setting(df.sparkSession, CLEANUP, "true"):
        df.write.options(**(options or {})).partitionBy(*by).parquet(path)


def write_and_read(df: DataFrame, label: str, replaces: Iterable[DataFrame] = ()) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.

    Unlike a cached or local copy, the files outlive the executor that wrote them.
    ``replaces``: tables of this function that nothing reads any more once this one is whole.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    write(df, path)
    remove(*replaces)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def remove(*tables: DataFrame) -> None:
    """Delete tables that ``write_and_read`` gave; others are left alone."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
