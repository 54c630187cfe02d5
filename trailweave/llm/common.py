"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.sources.shared import shared_dir, written

__all__ = ["crc_of_id", "importable", "most_frequent", "partitions", "shared_dir", "swept", "table", "written"]


#: Bytes of an Arrow batch at most: a worker holds few texts at once besides a long one.
BATCH_BYTES = 4 << 20


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver was started,
    and send them small batches. On a cluster the package is shipped with the job (``--py-files``)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parent.parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A table of the data folder, pruned to ``cols`` (a missing column reads as null)."""
    importable(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not cols:
        return df
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in cols])


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def swept(spark: SparkSession) -> None:
    """Let the driver's JVM free what ended jobs have left (results, plans, broadcasts) and give heap
    back. In the course of many small jobs it would grow to its limit first."""
    spark.sparkContext._jvm.System.gc()


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id written as text, as the hold-out rules define it."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def most_frequent(counts: DataFrame, word: str, size: int) -> set[str]:
    """The ``size`` words of (word, n) with the greatest n, equal ones by name. A limit alone would
    send the driver that many words of each task."""
    cut, total = 0, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(size).collect():
        cut, total = r["n"], total + r["words"]
        if total >= size:
            break
    return {r[word] for r in counts.filter(F.col("n") >= cut).orderBy(F.desc("n"), word).limit(size).collect()}
