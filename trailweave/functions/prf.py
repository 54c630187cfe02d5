"""Randomness by hash: the same draw for the same (seed, place), in Spark and in SQL.

A retried task draws the same numbers, and edge weights repeat in all iterations, which
the cancellation of non-simple walks rests on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | str | int) -> Column:
    """32-bit draw for a tuple of labels and columns."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]).cast("binary")), 1, 8), 16, 10).cast("long")


def assignment(seed: int, k: int, vertex: Column) -> Column:
    """A vertex's uniform vector in F_2^k, as an integer."""
    return F.pmod(draw("a", seed, vertex), F.lit(1 << k))


def weight(seed: int, degree: int, level: int, src: Column, dst: Column) -> Column:
    """An edge's weight in GF(2^degree) at a level."""
    return F.pmod(draw("w", seed, level, src, dst), F.lit(1 << degree))


def sql(*parts: str) -> str:
    """The draw as DuckDB SQL; parts are SQL expressions or quoted labels."""
    return "CAST('0x' || substr(md5(concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")), 1, 8) AS BIGINT)"


def _spark(*parts: str) -> str:
    """The draw as Spark SQL; for plans that are spelled out as text."""
    return "CAST(conv(substring(md5(CAST(concat_ws(':', " + ", ".join(f"CAST({p} AS STRING)" for p in parts) + ") AS BINARY)), 1, 8), 16, 10) AS BIGINT)"


def assignment_sql(seed: int, k: int, vertex: str) -> str:
    """``assignment`` as Spark SQL."""
    return f"pmod({_spark(chr(39) + 'a' + chr(39), str(seed), vertex)}, {1 << k}L)"


def weight_sql(seed: int, degree: int, level: int, src: str, dst: str) -> str:
    """``weight`` as Spark SQL."""
    return f"pmod({_spark(chr(39) + 'w' + chr(39), str(seed), str(level), src, dst)}, {1 << degree}L)"
