"""A corpus from documents: quality rules, toxicity, near duplicates, secrets, packing.

Every stage takes all that the one before kept, is written as Parquet and read again. All
but the last return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import packing, quality_rules, secret_scan, similarity, toxicity
from trailweave.llm.common import crc_of_id, importable, table
from trailweave.llm.queries import TOKENIZERS
from trailweave.sources.shared import place, removed

#: No SQL states the trained stages; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps."""
    return quality_rules.keep(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not find toxic. It learns from the labels of what is
    left, without the held-out fifth."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(F.pmod(crc_of_id(), F.lit(5)) != 0)
    importable(spark)
    chain = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.keep_clean(docs, chain)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the least id."""
    importable(spark)
    return similarity.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    importable(spark)
    return secret_scan.redact(docs, secret_scan.learn(docs.select("doc_id", "text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    importable(spark)
    return packing.pack(docs, f"{TOKENIZERS}/byte_bpe_50k.json", keep_ids=True, memo=200_000, forget=True)


STAGES = [("quality rules", quality), ("toxicity", toxic), ("near duplicates", near_duplicates), ("secret scan", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; the result is the last one's. A stage's input
    is deleted once the next has been written, the result when the driver ends."""
    folder = place(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return docs
