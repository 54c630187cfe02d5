"""Tables written to the folder that driver and executors share, and their end.

A table lives until the ``scratch`` block that it was written in ends, or, outside of any,
until the driver's JVM ends: its shutdown deletes what is left, also after ``spark.stop()``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths and catalog tables of the open ``scratch`` blocks, the innermost last.
_OPEN: list[tuple[list[str], list[str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    On a local master, where every worker runs on the driver's machine, a temporary folder
    is set if none is named. Any other master without that setting is an error: executors
    would write where others cannot read.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if context.getCheckpointDir() is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trailweave-"))
    return context.getCheckpointDir().rstrip("/")


def folder(spark: SparkSession) -> str:
    """The driver's own part of the shared folder, which goes when its JVM ends."""
    path = f"{shared_dir(spark)}/trailweave/{spark.sparkContext.applicationId}"
    files, target = _files(spark, path)
    if not files.exists(target):
        files.mkdirs(target)
        files.deleteOnExit(target)
    return path


def place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which is deleted as told above."""
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1][0].append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost
    executor costs no recomputation."""
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int, label: str) -> DataFrame:
    """As ``written``, in hash buckets of ``keys`` with a file each, so that a join on ``keys``
    leaves the rows where they are."""
    spark = df.sparkSession
    path = place(spark, label)
    name = "trailweave_" + path.rsplit("-", 1)[1]
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    if _OPEN:
        _OPEN[-1][1].append(name)
    return spark.table(name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at the end of the block; what reads them must have run by then."""
    paths, tables = [], []
    _OPEN.append((paths, tables))
    try:
        yield
    finally:
        _OPEN.remove((paths, tables))
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in paths:
            removed(spark, path)


def _files(spark: SparkSession, path: str):
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder; nothing happens once the session has ended."""
    if spark.sparkContext._jsc is not None:
        files, target = _files(spark, path)
        files.delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` that a write has completed."""
    files, target = _files(spark, path)
    if not files.exists(target):
        return []
    found = [s.getPath() for s in files.listStatus(target) if s.isDirectory()]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(p.getName() for p in found if files.exists(done(p, "_SUCCESS")))
