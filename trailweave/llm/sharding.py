"""Balanced label propagation: linked documents move to common shards under quotas.

Documents that share a link key are linked. The state is one row per cell - a link
group and the shard its documents started in - so an iteration joins and moves counts,
never documents, and a group that holds a third of all rows is at most as many rows as
there are shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm.common import partitions, written

#: Gain classes, hash slices of groups, and parts into which a group's cells fall within its slice.
GAINS, SLICES, CUTS = 40, 32, 40


def _rank(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """0-based rank of each row within ``key``, without gathering a key in one task.

    Rows are ranked within (key, salt) and shifted by the rows of the salts before.
    """
    salts = max(64, 4 * partitions(df.sparkSession))
    salted = df.withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(key, "_s").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(key, "_s", F.coalesce(before, F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy(key, "_s").orderBy(*order)) - 1
    ranked = salted.withColumn("_r", own)
    return ranked.join(starts, [key, "_s"]).withColumn(name, F.col("_r") + F.col("_b")).drop("_s", "_r", "_b")


def propagate(cells: DataFrame, shards: int, room_total: int) -> DataFrame:
    """Move cells towards the shard where their group is largest.

    ``cells``: grp, home, n. Each round every cell outside its group's best shard that
    still has room asks to move there; requests are admitted by descending gain until
    the shard's quota is used. Quotas come from a table of counts by shard, gain and
    hash slice, whose size does not depend on the data. A group too large for the room is
    admitted in parts. A shard that could admit none of those who asked is closed until its
    room grows. Ends when of the rows that ask to move fewer than a tenth find room: the
    shards are full then, and ``settle`` brings together what is left, wherever this ends.
    Every admitted move adds to the sum of the squares of what groups hold in shards.
    Returns grp, home, n, shard.
    """
    state = written(cells.withColumn("shard", F.col("home")), "shard-cells")
    closed: dict[int, int] = {}  # shard -> the room with which it could admit none of those who asked
    while True:
        used = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        rooms = [max(0, room_total - used.get(s, 0)) for s in range(shards)]
        closed = {s: r for s, r in closed.items() if rooms[s] <= r}
        room = F.array(*[F.lit(0 if s in closed else rooms[s]).cast("long") for s in range(shards)])
        held = state.groupBy("grp", "shard").agg(F.sum("n").alias("held"))
        open_ = F.get(room, F.col("shard")) > 0
        total = held.groupBy("grp").agg(F.max(F.struct("held", open_.alias("open"), (-F.col("shard")).alias("m"))).alias("top"), F.max(F.when(open_, F.struct("held", (-F.col("shard")).alias("m")))).alias("best"), F.count("*").alias("spread"))
        # A group whose largest shard has room goes there; else to its largest open shard.
        best = total.filter("spread > 1 AND best IS NOT NULL").select("grp", (-F.col("best.m")).cast("int").alias("to"), F.col("best.held").alias("there"), (-F.col("top.m")).cast("int").alias("anchor"))
        asks = state.join(best, "grp", "left").join(held, ["grp", "shard"])
        moving = F.col("to").isNotNull() & (F.col("to") != F.col("shard")) & (F.col("shard") != F.col("anchor")) & (F.col("there") >= F.col("held"))
        gain = F.least(F.lit(GAINS - 1), F.floor(F.log2(F.col("there").cast("double") + 1))).cast("int")
        asks = asks.select(
            "grp", "home", "n", "shard",
            F.when(moving, F.col("to")).alias("to"),
            F.when(moving, gain).alias("gain"),
            (F.pmod(F.xxhash64("grp"), F.lit(SLICES)) * CUTS + F.pmod(F.col("home"), F.lit(CUTS))).cast("int").alias("slice"),
        )
        asks = written(asks, "shard-asks")
        asked = {r["to"]: r["n"] for r in asks.filter("to IS NOT NULL").groupBy("to").agg(F.sum("n").alias("n")).collect()}
        if not asked:
            break
        wanted = asks.filter("to IS NOT NULL").groupBy("to", "gain", "slice").agg(F.sum("n").alias("w"))
        running = F.sum("w").over(Window.partitionBy("to").orderBy(F.col("gain").desc(), "slice"))
        admitted = wanted.withColumn("c", running).filter(F.col("c") <= F.get(room, F.col("to"))).select("to", "gain", "slice", "w", F.lit(True).alias("ok"))
        admitted = written(admitted, "shard-admitted")
        taken = {r["to"]: r["w"] for r in admitted.groupBy("to").agg(F.sum("w").alias("w")).collect()}
        closed |= {s: rooms[s] for s in asked.keys() - taken.keys()}
        state = asks.join(F.broadcast(admitted.drop("w")), ["to", "gain", "slice"], "left")  # at most shards * GAINS * SLICES * CUTS rows
        moved = F.coalesce(F.col("ok"), F.lit(False))
        state = written(state.select("grp", "home", "n", F.when(moved, F.col("to")).otherwise(F.col("shard")).alias("shard")), "shard-cells")
        if 10 * sum(taken.values()) < sum(asked.values()):
            break
    return state


def pack(sizes: dict[int, int], room: list[int]) -> tuple[list[tuple], list[tuple]]:
    """Lay ``sizes`` (size -> number of groups) into ``room`` by shard, largest first.

    Returns (size, first, last, shard) for groups that stay whole, numbered from 0 within
    their size, and (size, number, first, last, shard) for the rows, numbered from 0, of
    those that fit nowhere: these fill the emptiest shards, each of them at least one, so
    there are no more of them than shards.
    """
    room, whole, cut = list(room), [], []
    for size in sorted(sizes, reverse=True):
        at = 0
        while at < sizes[size]:
            for s in range(len(room)):
                k = min(sizes[size] - at, room[s] // size)
                if k:
                    whole.append((size, at, at + k - 1, s))
                    room[s] -= k * size
                    at += k
            if at < sizes[size]:
                row = 0
                while row < size:
                    s = max(range(len(room)), key=lambda s: room[s])
                    k = min(size - row, room[s])
                    cut.append((size, at, row, row + k - 1, s))
                    room[s] -= k
                    row += k
                at += 1
    return whole, cut


def settle(state: DataFrame, quota: list[int]) -> tuple[DataFrame, DataFrame]:
    """Exchange between full shards: groups that propagation left cut, and all groups of
    shards beyond their quota, leave their shards at once and are laid out again.

    The driver lays out sizes, not groups: d different sizes take d * d / 2 rows or more.
    Returns (grp, home, shard) of whole groups and (grp, first, last, shard) of the rows of cut ones.
    """
    spark, shards = state.sparkSession, len(quota)
    groups = state.groupBy("grp").agg(F.sum("n").alias("size"), F.min("shard").alias("shard"), (F.min("shard") != F.max("shard")).alias("split"))
    groups = written(groups, "shard-groups")
    held = {r["shard"]: r["n"] for r in groups.filter("NOT split").groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    full = [s for s in range(shards) if held.get(s, 0) > quota[s]]
    lifted = F.col("split") | F.col("shard").isin(full)
    again = groups.filter(lifted).select("grp", "size")
    sizes = {r["size"]: r["n"] for r in again.groupBy("size").agg(F.count("*").alias("n")).collect()}
    whole, cut = pack(sizes, [q - (0 if s in full else held.get(s, 0)) for s, q in enumerate(quota)])
    whole = spark.createDataFrame(whole, "size long, first long, last long, shard int")
    cut = spark.createDataFrame(cut, "size long, _k long, first long, last long, shard int")
    ranked = written(_rank(again, "size", ["grp"], "_k"), "shard-ranked")
    placed = ranked.join(F.broadcast(whole), "size").filter("_k BETWEEN first AND last").select("grp", "shard")
    placed = groups.filter(~lifted).select("grp", "shard").unionByName(placed)
    cut = ranked.join(F.broadcast(cut), ["size", "_k"]).select("grp", "first", "last", "shard")
    return state.select("grp", "home").join(placed, "grp"), written(cut, "shard-cut")


def cut(placed: DataFrame, key: Column) -> DataFrame:
    """What a layout cuts, in one row: linked groups, groups in several shards, pairs of linked
    rows (edges), and pairs in different shards. Groups are counted by shard first."""
    parts = placed.filter(key.isNotNull()).groupBy(key.alias("_g"), "shard").agg(F.count("*").cast("double").alias("_n"))
    pairs = lambda n: n * (n - 1) / 2
    groups = parts.groupBy("_g").agg(F.sum("_n").alias("n"), F.count("*").alias("shards"), F.sum(pairs(F.col("_n"))).alias("kept")).filter("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("shards") > 1).alias("cut_groups"), F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).alias("edges"), F.coalesce(F.sum(pairs(F.col("n")) - F.col("kept")), F.lit(0.0)).alias("cut_edges"))


def assign(docs: DataFrame, key: Column, order: Column, shards: int = 40) -> DataFrame:
    """Give every row of ``docs`` a shard so that shard row counts differ by one at most.

    Rows with equal, non-null ``key`` are linked and pulled together: a group is cut only
    where no shard has room for it, at most as many groups as there are shards, and then
    fills the emptiest. Rows without a partner fill the quotas up.
    Null keys link to nothing, repeated rows count each, an empty table gives no rows.
    Adds ``shard`` (int) and ``slot`` (long, gapless from 0 within a shard); document columns
    of these names give way. ``order`` orders the rows.
    """
    n = docs.count()
    floor, over = divmod(n, shards)
    quota = [floor + (s < over) for s in range(shards)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]).alias("doc"), key.alias("grp"), order.alias("_row"))
    home = F.pmod(F.xxhash64("_row", F.lit(7)), F.lit(shards)).cast("int")
    groups = rows.filter("grp IS NOT NULL").groupBy("grp", home.alias("home")).agg(F.count("*").alias("n"))
    size = groups.groupBy("grp").agg(F.sum("n").alias("all")).filter("all > 1").select("grp")
    linked = groups.join(size, "grp", "left_semi")
    cells, cut = settle(propagate(linked, shards, floor), quota)
    placed = rows.withColumn("home", home).join(cells, ["grp", "home"], "left").drop("home")
    placed = placed.join(F.broadcast(cut.select("grp", F.lit(True).alias("cut")).distinct()), "grp", "left")
    placed = written(placed, "shard-placed")
    part = _rank(placed.filter("cut").select("doc", "_row", "grp"), "grp", ["_row"], "_k")
    part = part.join(F.broadcast(cut), "grp").filter("_k BETWEEN first AND last")
    placed = placed.filter("cut IS NULL").select("doc", "_row", "shard").unionByName(part.select("doc", "_row", "shard"))
    # Exact quotas: unlinked rows take what is free.
    held = {r["shard"]: r["n"] for r in placed.filter("shard IS NOT NULL").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    free, ends, total = [quota[s] - held.get(s, 0) for s in range(shards)], [], 0
    for f in free:
        total += f
        ends.append(total)
    loose = _rank(placed.filter("shard IS NULL").drop("shard").withColumn("_one", F.lit(0)), "_one", ["_row"], "_k").drop("_one")
    bounds = F.array(*[F.lit(e).cast("long") for e in ends])
    loose = loose.withColumn("shard", F.size(F.filter(bounds, lambda e: e <= F.col("_k")))).drop("_k")
    both = placed.filter("shard IS NOT NULL").unionByName(loose.select(placed.columns))
    return _rank(both, "shard", ["_row"], "slot").select("doc.*", "shard", F.col("slot").cast("long").alias("slot"))
