"""A Bloom filter as a table of bounded size, to keep rows out of a shuffle (SQL functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a sieve.
WORDS = 1 << 19


def sieve(wanted: DataFrame) -> DataFrame:
    """A blocked Bloom filter of keys (column ``k``, 64-bit hashes): (word, bits), WORDS rows at
    most, so it may be broadcast whatever the data. Once it is full it lets everything pass."""
    return wanted.select(_word("k").alias("word"), _bits("k").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _word(k: str) -> Column:
    return F.pmod(F.col(k), F.lit(WORDS)).cast("int")


def _bits(k: str) -> Column:
    one = F.lit(1).cast("long")
    out = None
    for at in (20, 27, 34, 41):
        bit = F.call_function("shiftleft", one, F.shiftrightunsigned(k, at).bitwiseAND(63).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def maybe(rows: DataFrame, filter_: DataFrame, name: str) -> DataFrame:
    """``rows`` (with a key ``k``) and ``name``: may the key be in the sieve? False is certain."""
    hit = rows.join(F.broadcast(filter_.withColumnRenamed("word", "_word").withColumnRenamed("bits", "_bits")), _word("k") == F.col("_word"), "left")
    return hit.withColumn(name, F.coalesce(F.col("_bits").bitwiseAND(_bits("k")) == _bits("k"), F.lit(False))).drop("_word", "_bits")
