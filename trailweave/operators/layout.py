"""Partition layout and message volume of a graph dealt out in contiguous blocks.

Positions come from ``ranked``, which never sorts all rows in one task; block numbers and
thread numbers are arithmetic on positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions import prf
from trailweave.sources.shared import written

#: Ranges into which rows are cut: one for each ROWS rows, within these bounds.
LEAST, MOST, ROWS = 256, 4096, 1_000_000


def _array(values: list) -> Column:
    """A literal array; whole numbers as one text, which is read at once."""
    if all(isinstance(v, int) for v in values):
        return F.expr("array(" + ", ".join(f"{v}L" for v in values) + ")")
    return F.array(*[F.lit(v) for v in values])


def range_of(value: Column, cuts: list[int]) -> Column:
    """Number of cuts (ascending) below ``value``, found through a coarse and a fine array."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    coarse, whole = _array(cuts[step - 1 :: step]), _array(cuts)
    skipped = F.size(F.filter(coarse, lambda c: c < value)) * step
    return skipped + F.size(F.filter(F.slice(whole, skipped + 1, step), lambda c: c < value))


def _cuts(df: DataFrame, order: str) -> list[int]:
    """Quantiles of a column, more of them the more rows there are; null counts as less than all."""
    n = min(MOST, max(LEAST, df.count() // ROWS))
    shares = "array(" + ", ".join(f"{i / n!r}D" for i in range(1, n)) + ")"
    found = df.agg(F.expr(f"percentile_approx(`{order}`, {shares}, {10 * n})").alias("q")).first()["q"]
    return sorted(set(found or []))


def prefix_sums(df: DataFrame, order: str, weight: Column, name: str) -> tuple[DataFrame, int]:
    """Sum of the weights of all rows before, by a numeric column (unique values), and the sum
    of all weights. ``df`` is read three times, so it should be a table.

    Quantiles cut the column into ranges; weights are summed within their range and shifted
    by the sum of the ranges before, whose sums (MOST at most) the driver adds up.
    """
    rows = df.withColumn("_r", range_of(F.col(order), _cuts(df, order))).withColumn("_w", weight.cast("long"))
    sums = {r["_r"]: r["w"] for r in rows.groupBy("_r").agg(F.sum("_w").alias("w")).collect()}
    before, total = [], 0
    for r in range(max(sums, default=0) + 1):
        before.append(total)
        total += sums.get(r) or 0
    own = F.sum("_w").over(Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_k", F.coalesce(own, F.lit(0))).withColumn(name, F.col("_k") + F.get(_array(before), F.col("_r"))).drop("_r", "_w", "_k"), total


def ranked(df: DataFrame, order: str, name: str) -> DataFrame:
    """0-based position by a numeric column (unique values); no task sorts all rows."""
    return prefix_sums(written(df, "ranked"), order, F.lit(1), name)[0]


def ranked_within(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """0-based position by a numeric column within each value of ``keys`` (unique together).

    As ``ranked``: no task sorts all rows of a key, only one range of them.
    """
    rows = written(df.withColumn("_r", range_of(F.col(order), _cuts(df, order))), "ranked")
    sizes = rows.groupBy(*keys, "_r").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select(*keys, "_r", F.coalesce(before, F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy(*keys, "_r").orderBy(order)) - 1
    return rows.withColumn("_k", own).join(shifts, [*keys, "_r"]).withColumn(name, F.col("_k") + F.col("_b")).drop("_r", "_k", "_b")


#: A hub has more than this share of all edges, so there are at most HUBS of them.
HUBS = 1000


def hubs(edges: DataFrame, end: str) -> DataFrame:
    """(``end``, degree) of the vertices at which more than 1 / HUBS of all edges end; HUBS rows
    at most, so it may be broadcast whatever the graph."""
    total = edges.count()
    return edges.groupBy(end).agg(F.count("*").alias("degree")).filter(F.col("degree") * HUBS > total)


def block_of(position: Column, total: Column, parts: int) -> Column:
    """Block of a position when the first (total mod parts) blocks have one row more."""
    small, more = F.floor(total / parts), total % parts
    edge = more * (small + 1)
    return F.when(position < edge, F.floor(position / (small + 1))).otherwise(more + F.floor((position - edge) / F.greatest(small, F.lit(1)))).cast("int")


def block_partition(vertices: DataFrame, parts: int, order: str = "id", position: str | None = None) -> DataFrame:
    """Add ``part`` (0 to parts - 1), contiguous in ``order``. ``position``: a column that holds
    the places from 0 on, such as the ``ordinal`` of a file's lines; then nothing is sorted."""
    if position:
        return vertices.withColumn("part", block_of(F.col(position), F.lit(vertices.count()), parts))
    rows, total = prefix_sums(written(vertices, "blocks"), order, F.lit(1), "_p")
    return rows.withColumn("part", block_of(F.col("_p"), F.lit(total), parts)).drop("_p")


def thread_partition(vertices: DataFrame, parts: int, threads: int, order: str = "id") -> DataFrame:
    """Add ``part`` and, by the same rule inside it, ``thread``."""
    rows, total = prefix_sums(written(vertices, "threads"), order, F.lit(1), "_p")
    small, more = divmod(total, parts)
    rows = rows.withColumn("part", block_of(F.col("_p"), F.lit(total), parts))
    start = F.col("part") * small + F.least(F.col("part"), F.lit(more))
    size = F.lit(small) + (F.col("part") < more).cast("int")
    return rows.withColumn("thread", block_of(F.col("_p") - start, size, threads)).drop("_p")


def degree_partition(vertices: DataFrame, edges: DataFrame, parts: int) -> DataFrame:
    """Add ``part``: contiguous in ``id``, with out-edges as even as whole vertices allow. A
    vertex lies where its first edge does if all edges are cut into ``parts`` equal runs, so a
    part's edges differ from the mean by less than the degree of one vertex."""
    degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_d"))
    rows = written(vertices.join(degrees, "id", "left"), "degrees")
    rows, total = prefix_sums(rows, "id", F.coalesce("_d", F.lit(0)), "_p")
    part = F.least(F.floor(F.col("_p") * parts / F.lit(max(1, total))), F.lit(parts - 1)) if total < 1 << 40 else F.least((F.col("_p").cast("decimal(38,0)") * parts / total).cast("long"), F.lit(parts - 1))
    return rows.withColumn("part", part.cast("int")).drop("_d", "_p")


def hash_partition(vertices: DataFrame, parts: int, seed: int = 0) -> DataFrame:
    """Add ``part`` by a hash of the id, for ids that lie unevenly."""
    return vertices.withColumn("part", F.pmod(prf.draw("h", seed, F.col("id")), F.lit(parts)).cast("int"))


def partition(vertices: DataFrame, parts: int, method: str = "count", edges: DataFrame | None = None, position: str | None = None) -> DataFrame:
    """Add ``part`` by a method: "count" (contiguous blocks of as many vertices), "degree"
    (contiguous blocks of as many edges) or "hash"."""
    if method == "count":
        return block_partition(vertices, parts, position=position)
    if method == "degree":
        return degree_partition(vertices, edges, parts)
    if method == "hash":
        return hash_partition(vertices, parts)
    raise ValueError(f"no partitioning is called {method}")


def partition_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part").agg(F.count("*").alias("n"))


def partition_displacements(parts: DataFrame) -> DataFrame:
    """part, n, and the rows of all parts before it."""
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return partition_counts(parts).withColumn("displacement", F.coalesce(before, F.lit(0)))


def hub_join(rows: DataFrame, key: str, table: DataFrame, few: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` (a row for each ``key``). The table's rows for hubs go to
    every task, so no task gets all rows of a key; other keys are joined by a shuffle.
    ``few`` are the hubs, if known. ``how``: inner or left."""
    few = (hubs(rows, key) if few is None else few).select(key)
    near = table.join(F.broadcast(few), key, "left_semi").withColumn("_hub", F.lit(True))
    flagged = rows.join(F.broadcast(near), key, "left")
    more = [c for c in table.columns if c != key]
    rest = flagged.filter("_hub IS NULL").drop("_hub", *more).join(table, key, how)
    return flagged.filter("_hub IS NOT NULL").drop("_hub").unionByName(rest)


#: Vertices whose parts (16 bytes each) may be sent to every task.
SMALL = 1_000_000


def edge_owner(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """src, dst, src_part, dst_part. Parts of up to SMALL vertices go to every task; beyond, edges
    are joined by shuffles, but for those of hubs, which one pass finds for both ends."""
    edges, parts = written(edges.select("src", "dst"), "owned-edges"), written(parts.select("id", "part"), "parts")
    ends = {e: parts.select(F.col("id").alias(e), F.col("part").alias(f"{e}_part")) for e in ("dst", "src")}
    out = edges
    if parts.count() <= SMALL:
        for end, table in ends.items():
            out = out.join(F.broadcast(table), end)
    else:
        both = edges.select(F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("id")) for e in ends])).alias("x")).select("x.*")
        many = written(both.groupBy("end", "id").agg(F.count("*").alias("n")).filter(F.col("n") * HUBS > edges.count()), "hubs")
        for end, table in ends.items():
            out = hub_join(out, end, table, many.filter(F.col("end") == end).select(F.col("id").alias(end)))
    return out.select("src", "dst", "src_part", "dst_part")


def cut_edges(owned: DataFrame) -> DataFrame:
    """Edges whose message leaves its part."""
    return owned.filter("src_part <> dst_part")


def routing_lists(owned: DataFrame) -> DataFrame:
    """For every vertex and part it sends to: the number of receivers and the receivers, ascending."""
    return owned.groupBy("src_part", "src", "dst_part").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("dst")).alias("labels"))


def routing_chunks(owned: DataFrame, size: int = 10_000) -> DataFrame:
    """``routing_lists`` in pieces of about ``size`` receivers at most, for graphs with hubs:
    src_part, src, dst_part, chunk, n, labels (ascending within the chunk)."""
    keys = ["src_part", "src", "dst_part"]
    large = owned.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > size)
    large = large.select(*keys, F.ceil(F.col("_n") / size).cast("int").alias("_c"))
    most = owned.count() // size  # there are no more long lists than this
    rows = owned.join(F.broadcast(large) if most <= HUBS * 100 else large, keys, "left")
    chunk = F.pmod(F.xxhash64("dst"), F.coalesce("_c", F.lit(1))).cast("int")
    return rows.groupBy(*keys, chunk.alias("chunk")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("dst")).alias("labels"))


def routing_size(owned: DataFrame) -> DataFrame:
    """Length of each part's encoded routing list (2 for every part it sends to, 1 for a
    single receiver, n + 1 for a group of n), and the buffer that holds the longest."""
    groups = owned.groupBy("src_part", "src", "dst_part").agg(F.count("*").alias("n"))
    own = groups.groupBy("src_part").agg((F.sum(F.when(F.col("n") > 1, F.col("n") + 1).otherwise(1)) + 2 * F.count_distinct("dst_part")).cast("long").alias("list_size"))
    return own.withColumn("buffer_size", F.max("list_size").over(Window.partitionBy(F.lit(1))) + 1)


def buffer_slots(owned: DataFrame) -> DataFrame:
    """A vertex's slot in the buffer from its part to another, in vertex order."""
    pairs = owned.select("src_part", "dst_part", "src").distinct()
    return ranked_within(pairs, ["src_part", "dst_part"], "src", "slot").withColumn("slot", F.col("slot").cast("int"))


def message_counts(owned: DataFrame, parts: int, dense: bool = True) -> DataFrame:
    """(src_part, dst_part, msg_count): one message for each vertex and part it sends to; for all
    pairs of parts, or (not ``dense``) those that have messages."""
    found = owned.select("src_part", "dst_part", "src").distinct().groupBy("src_part", "dst_part").agg(F.count("*").alias("msg_count"))
    if not dense:
        return found
    grid = owned.sparkSession.range(parts * parts).select(F.floor(F.col("id") / parts).cast("int").alias("src_part"), (F.col("id") % parts).cast("int").alias("dst_part"))
    return grid.join(found, ["src_part", "dst_part"], "left").na.fill(0, ["msg_count"])


def timing_summary(times: DataFrame, phase: str = "phase", ms: str = "ms") -> DataFrame:
    """Least, greatest and mean time of each phase over all ranks."""
    return times.groupBy(phase).agg(F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.round(F.avg(ms), 4).alias("avg_ms"))


def joined_text(rows: DataFrame, order: str, text: str) -> DataFrame:
    """The texts of all ranks, concatenated in rank order."""
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("joined"))
