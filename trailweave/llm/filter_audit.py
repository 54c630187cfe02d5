"""What filters remove, in every order in which they may be applied.

The orders of five filters are the paths of a trie. It is walked depth-first: a state is
the persisted DataFrame of the documents that survive the filters applied so far, its
children are that DataFrame with one filter more. Which documents survive does not depend
on the order of the filters before, so orders that have applied the same set share a state,
and each of the 2^n states is made and counted once. Every edge's count is that of the
documents it removes from its state's survivors. At most n + 1 states are persisted at once;
a lost part of one is made again from the state above it, the first from a written table.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm import words as W
from trailweave.llm.common import written
from trailweave.operators import layout
from trailweave.sources.shared import place

#: A to E: short, repetitive, many capitals, a symbol, a copy of an earlier text.
FILTERS = "ABCDE"
WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 3
_CAPITALS, _SYMBOL, _SPACE = bytes(range(65, 91)), re.compile(rb"[#$%&*|]"), re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are split into words at once.
PIECE = 4_000_000


def pieces(raw: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut at white space."""
    at = 0
    while at < len(raw):
        end = _SPACE.search(raw, at + size)
        end = end.start() if end else len(raw)
        yield raw[at:end]
        at = end


def failures(text: str) -> int:
    """Bit i is set if the text fails filter A, B, C or D (i from 0); filter E needs the table."""
    raw, n, different = text.encode("utf-8", "surrogatepass"), 0, set()
    for piece in pieces(raw):
        words = piece.split()  # bytes are split at \x20 and \x09 to \x0D, and nowhere else
        n += len(words)
        different.update(words)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    found = n < WORDS, 100 * len(different) < DISTINCT_PERCENT * n, 100 * capitals > CAPITALS_PERCENT * len(text), bool(_SYMBOL.search(raw))
    return sum(x << i for i, x in enumerate(found))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails (bits of A to D), digest (SHA-256 of the text) of every document."""

    def run(batches):
        for ids, parts, texts in W.chunks(batches, "doc_id", "part", "text"):
            digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.string()), pa.array([failures(t) for t in texts], pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "fails", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(W.released(run), "doc_id long, part string, fails int, digest binary")


def facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bit i: fails filter i of FILTERS), good, toxic of every document.

    A text that many documents share, or an id that many rows have, is joined by broadcast
    (``layout.hub_join``), so no task gets all of them; of other texts only digests move.
    Labels that come twice count once. A document without an id is no copy of another.
    """
    rows = written(measured(docs), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = layout.hub_join(rows, "digest", first, how="left")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    rows = layout.hub_join(rows.select("doc_id", "part", "fails", "first"), "doc_id", marks.filter("doc_id IS NOT NULL"), layout.hubs(rows, "doc_id"), "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return rows.select("part", F.col("fails").bitwiseOR(copy).alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _fails(i: int) -> Column:
    return F.col("fails").bitwiseAND(1 << i) != 0


def _edges(state: DataFrame, left: list[int]) -> DataFrame:
    """For each part and filter not yet applied: what it removes from a state's survivors."""
    every = state.groupBy("part").agg(
        F.count("*").alias("total"),
        *[F.struct(F.lit(i).alias("filter"), F.count_if(_fails(i)).alias("removed"), F.count_if(_fails(i) & F.col("good")).alias("good_lost"), F.count_if(_fails(i) & F.col("toxic")).alias("toxic_lost")).alias(f"f{i}") for i in left],
    )
    return every.select("part", "total", F.explode(F.array(*[f"f{i}" for i in left])).alias("e")).select("part", "total", "e.*")


def walked(rows: DataFrame, n: int = len(FILTERS)) -> DataFrame:
    """state (bits of the filters applied), part, filter, total, removed, good_lost and
    toxic_lost of every edge of the trie that leads somewhere, from ``facts``."""
    spark, known = rows.sparkSession, set()
    folder = place(spark, "audit")

    def visit(state: int, survivors: DataFrame) -> None:
        known.add(state)
        left = [i for i in range(n) if not state >> i & 1]
        if not left:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        _edges(survivors, left).coalesce(1).write.parquet(f"{folder}/state={state}")
        for i in left:
            if state | 1 << i not in known:
                visit(state | 1 << i, survivors.filter(~_fails(i)))
        survivors.unpersist()

    visit(0, written(rows, "audit-facts"))
    return spark.read.schema("part string, total long, filter int, removed long, good_lost long, toxic_lost long, state int").parquet(folder)


def audit(rows: DataFrame, names: str = FILTERS) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. ``rows`` are ``facts``; an empty table gives no rows."""
    n, spark = len(names), rows.sparkSession
    steps = [("".join(names[i] for i in order), s + 1, sum(1 << i for i in order[:s]), f) for order in itertools.permutations(range(n)) for s, f in enumerate(order)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    counts = written(walked(rows, n), "audit-edges")
    numbers = ("total", "removed", "good_lost", "toxic_lost")
    dense = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("state"))
    dense = dense.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("filter")).filter("shiftright(state, filter) & 1 = 0")
    dense = dense.join(counts, ["part", "state", "filter"], "left").na.fill(0, numbers)
    own = "PARTITION BY part, filter"  # 2^(n - 1) rows
    all_others = f"{(1 << n) - 1} - shiftleft(1, filter)"
    dense = dense.select("*", F.expr(f"max(CASE WHEN state = 0 THEN removed END) OVER ({own})").alias("fails"), F.expr(f"max(CASE WHEN state = {all_others} THEN removed END) OVER ({own})").alias("unique_fails"))
    out = dense.join(F.broadcast(orders), ["state", "filter"])  # n * n! rows
    return out.select(
        "part", "filter_order", "step",
        (F.col("total") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost",
        F.expr(f"sum(removed) OVER ({own})").alias("shapley"),
    )
