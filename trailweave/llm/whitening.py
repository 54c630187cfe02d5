"""Whitening of vectors: exact integer entries, covariance by generated SQL, LAPACK.

Two passes fit: one sums every dimension, the other sums the centred products of all
dimension pairs of the upper triangle in one aggregation of generated SQL expressions. The
driver gets d * (d + 1) / 2 sums, whatever the number of rows, assembles the covariance and
decomposes it. Rows are projected where they lie; nothing but sums is shuffled.

Partial sums of all tasks meet in GROUPS rows and then by their place, so no task adds the
whole triangles of all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm import words as W

#: Components at most, rows in which partial sums meet, pairs in one aggregation.
COMPONENTS, GROUPS, PAIRS = 32, 64, 2080
#: Components below this share of the greatest eigenvalue are rounding errors.
LEAST = 1e-12
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000


@dataclass(frozen=True)
class Basis:
    """n: vectors of the fit; sums: of each dimension; values, vectors: eigenvalues, falling,
    and their unit vectors as columns; trace: of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    odd = F.exists("_v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.select("*", F.col(vector).cast("array<double>").alias("_v")).filter(F.col("_v").isNotNull()).filter(~odd)


def width(rows: DataFrame, vector: str = "embedding") -> int:
    """The commonest length of the usable vectors (ties: the greatest); 0 without any."""
    sizes = _usable(rows.select(F.col(vector).alias("_e")), "_e").groupBy(F.size("_v").alias("w")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("w")).first()
    return top["w"] if top else 0


def entries(rows: DataFrame, size: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and x0, x1, ...: the integer entries of the vectors of length ``size``. Null
    vectors and those with null or non-finite entries go, and so do those of another length,
    which lack entries or have some of no dimension. Repeated rows stay."""
    kept = _usable(rows.select(F.col(key).alias("_k"), F.col(vector).alias("_e")), "_e").filter(F.size("_v") == size)
    return kept.selectExpr("_k", *[f"coalesce(CAST(floor({SCALE}D * _v[{d}]) AS BIGINT) + {SHIFT}, 0L) AS x{d}" for d in range(size)])


def _added(arrays: DataFrame) -> list:
    """Sums, place by place, of the column ``a`` of equally long arrays."""
    got = arrays.select(F.posexplode("a").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    return [r["v"] for r in sorted(got)]


def _summed(rows: DataFrame, sums: list[str]) -> list:
    """One number for each SQL expression: its sum over all rows (empty: no rows)."""
    every = ", ".join(f"sum({e})" for e in sums)
    return _added(rows.sparkSession.sql(f"SELECT array({every}) AS a FROM {{rows}} GROUP BY spark_partition_id() % {GROUPS}", rows=rows))


def fit(x: DataFrame) -> Basis | None:
    """The basis of all rows of ``entries``; None without rows or dimensions."""
    size = len(x.columns) - 1
    n, *sums = _summed(x, ["1L", *[f"x{d}" for d in range(size)]]) or [0]
    if not n or not size:
        return None
    # x - S / n, from the exact integer n * x - S; never null, so the sums check no nulls.
    centred = x.selectExpr(*[f"coalesce(CAST({n}L * x{d} - {s}L AS DOUBLE) / {n}D, 0D) AS c{d}" for d, s in enumerate(sums)])
    pairs, cov = [(i, j) for i in range(size) for j in range(i, size)], np.zeros((size, size))
    for at in range(0, len(pairs), PAIRS):  # a plan of bounded size; one aggregation up to 64 dimensions
        some = pairs[at : at + PAIRS]
        for (i, j), total in zip(some, _summed(centred, [f"c{i} * c{j}" for i, j in some])):
            cov[i, j] = cov[j, i] = total / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    # Either sign is right; the greatest entry's is made positive, so runs agree.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)])
    kept = int((values > values[0] * LEAST).sum()) if values[0] > 0 else 0
    return Basis(n, tuple(sums), values[:kept], vectors[:, :kept], float(np.trace(cov)))


def _whitener(basis: Basis, count: int):
    """From a batch of integer rows to their whitened components."""
    sums, scaled = np.array(basis.sums, dtype=np.int64), basis.vectors[:, :count] / np.sqrt(basis.values[:count])
    return lambda x: ((basis.n * x - sums) / basis.n) @ scaled


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _deviation(n: int, sums: tuple[int, ...]) -> str:
    """SQL of the sum over the dimensions of (n * x - S)^2, exact."""
    off = ", ".join(f"CAST({n}L * x{d} - {s}L AS DECIMAL(19, 0))" for d, s in enumerate(sums))
    return f"CAST(aggregate(array({off}), CAST(0 AS DECIMAL(38, 0)), (t, y) -> CAST(t + y * y AS DECIMAL(38, 0))) AS BIGINT)"


def deviations(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, n, deviation of every usable vector, as in ``whitened``, without components."""
    x = entries(rows, width(rows, vector), key, vector)
    n, *sums = _summed(x, ["1L", *[c for c in x.columns if c != "_k"]]) or [0]
    return x.selectExpr(f"_k AS `{key}`", f"{n}L AS n", f"{_deviation(n, tuple(sums)) if sums else '0L'} AS deviation")


def whiten(x: DataFrame, basis: Basis, count: int = COMPONENTS) -> DataFrame:
    """_k, ``deviation`` (sum over the dimensions of (n * x - S)^2, exact) and ``white``, the
    whitened components as an array, of every row of ``entries``."""
    size, go = len(basis.sums), _whitener(basis, count)

    def run(batches):
        for b in batches:
            w = go(_matrix(b.column("x"), size))
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("deviation"), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], ["_k", "deviation", "white"])

    rows = x.selectExpr("_k", f"{_deviation(basis.n, basis.sums)} AS deviation", "array(" + ", ".join(f"x{d}" for d in range(size)) + ") AS x")
    kind = rows.schema["_k"].dataType.simpleString()
    return rows.mapInArrow(W.released(run), f"_k {kind}, deviation long, white array<double>")


def identity_error(x: DataFrame, basis: Basis, count: int = COMPONENTS) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured on them.
    Whitened rows are centred as they are made; what rounding leaves of their means is taken off."""
    size, go, k = len(basis.sums), _whitener(basis, count), min(count, len(basis.values))

    def run(batches):
        total = np.zeros((k + 1, k))
        for b in batches:
            w = go(_matrix(b.column("x"), size))
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["a"])

    rows = x.selectExpr("array(" + ", ".join(f"x{d}" for d in range(size)) + ") AS x")
    got = np.array(_added(rows.mapInArrow(W.released(run), "a array<double>"))).reshape(k + 1, k) / basis.n
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error of every
    usable vector and each of its first ``count`` components.

    A component without variance cannot be whitened and is not returned; so a table of one
    vector, or of equal ones, gives no rows, as an empty table does. Null and repeated keys
    stay as they are. ``deviation`` beyond a long is an arithmetic error, not a wrong number.
    """
    x = entries(rows, width(rows, vector), key, vector)
    basis = fit(x)
    if basis is None or not len(basis.values):
        kind = rows.schema[key].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(x, basis, count)
    explained = F.array(*[F.lit(float(v / basis.trace)) for v in basis.values[:count]])
    out = whiten(x, basis, count).select("_k", "deviation", F.posexplode("white").alias("_c", "_w"))
    return out.select(
        F.col("_k").alias(key),
        (F.col("_c") + 1).alias("component"),
        F.lit(basis.n).cast("long").alias("n"),
        "deviation",
        F.col("_w").alias("whitened"),
        F.get(explained, F.col("_c")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
