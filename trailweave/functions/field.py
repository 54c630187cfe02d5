"""GF(2^d) by a primitive polynomial.

The tables take x as generator, which is right for primitive polynomials only; an
irreducible one that is not primitive is refused.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions import polynomials as P


class Field:
    """Log and power tables of one field; use ``field()`` to share instances."""

    def __init__(self, d: int, poly: int):
        if P.degree(poly) != d or not P.is_primitive(poly):
            raise ValueError(f"{poly} is not a primitive polynomial of degree {d}")
        self.degree, self.poly, self.size = d, poly, 1 << d
        self.power, self.log = [1] * (self.size - 1), [0] * self.size
        for i in range(1, self.size - 1):
            x = self.power[i - 1] << 1
            self.power[i] = x ^ poly if x >> d else x
        for i, x in enumerate(self.power):
            self.log[x] = i

    @staticmethod
    def add(x: int, y: int) -> int:
        return x ^ y

    def multiply(self, x: int, y: int) -> int:
        if not x or not y:
            return 0
        return self.power[(self.log[x] + self.log[y]) % (self.size - 1)]

    def table(self, spark: SparkSession) -> DataFrame:
        """(a, b, prod) for all pairs."""
        ab = spark.range(self.size * self.size).select(F.floor(F.col("id") / self.size).cast("int").alias("a"), (F.col("id") % self.size).cast("int").alias("b"))
        return ab.withColumn("prod", self.col_multiply(F.col("a"), F.col("b")).cast("int"))

    def col_multiply(self, a: Column, b: Column) -> Column:
        """Product by two literal arrays of the field's size, inside generated code."""
        log = F.array(*[F.lit(x) for x in self.log])
        power = F.array(*[F.lit(self.power[i % (self.size - 1)]) for i in range(2 * self.size - 2)])
        value = F.get(power, F.get(log, a.cast("int")) + F.get(log, b.cast("int")))
        return F.when((a == 0) | (b == 0), F.lit(0)).otherwise(value).cast("long")


@lru_cache(64)
def field(d: int, poly: int | None = None) -> Field:
    """The field of 2^d elements; by default with the least primitive polynomial."""
    return Field(d, poly or next(p for p in range(1 << d, 2 << d) if P.is_primitive(p)))


def field_degree(k: int) -> int:
    """Degree of the field for paths on k vertices: 3 + floor(log2 k)."""
    return 3 + max(k, 1).bit_length() - 1


#: The classic field of 256 elements.
def byte_field() -> Field:
    return field(8, 285)
