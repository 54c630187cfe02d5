"""Does a graph have a simple path on k vertices? Randomised multilinear detection.

Every vertex draws a vector in F_2^k, every edge a weight in GF(2^d) for each level. For
each of the 2^k masks t, walks over vertices whose vector is orthogonal to t are summed in
the field; over all masks, walks that visit a vertex twice cancel. A non-zero total
proves a path (no false positives); a path is found with probability above 0.2 a loop.

Two forms give the same totals. The plain form has a row for each (vertex, mask). The
sliced form packs 64 masks into d bit planes of BIGINT, one row for each (vertex, loop, block
of masks): a product by a weight is an XOR of planes, a sum is ``bit_xor`` of planes, so it
moves a 64th of the rows through each shuffle.

Edges lie in hash buckets of their source, so they are never shuffled: a level moves the
state to the edges and the sums to their vertices. Several loops, each with its own seed and
field, share the edges, the scans and the shuffles of a level. Masks are worked on in batches;
the totals of finished ones are kept, and a driver that starts anew goes on from there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions import prf
from trailweave.functions.field import Field, field, field_degree
from trailweave.functions.polynomials import random_primitive
from trailweave.operators import layout
from trailweave.sources import graphs
from trailweave.sources.shared import bucketed, children, place, removed, scratch, written

SUCCESS = 0.2
#: Messages of a task and edges of a bucket, about, from which the number of buckets follows.
TASK_MESSAGES, BUCKET_EDGES = 500_000, 10_000_000
#: A vertex with fewer edges is no hub, however small the graph.
HUB_EDGES = 10_000


@dataclass(frozen=True)
class KPathConfig:
    """k: vertices on the path; epsilon: allowed miss probability; poly: a primitive polynomial
    (None: the least, and in ``seeds`` one drawn for each loop); max_loops: bound on the loops
    (1: a single loop); loop_batch: loops worked on together; batch_rows: messages of a level
    worked on together, about; level_batch: levels in one plan, after which the state is written."""

    k: int
    epsilon: float = 0.1
    seed: int = 11
    poly: int | None = None
    max_loops: int | None = None
    loop_batch: int = 4
    batch_rows: int = 50_000_000
    level_batch: int = 5

    def __post_init__(self):
        if not 1 <= self.k <= 30:
            raise ValueError("k must be from 1 to 30")
        if not 0 < self.epsilon < 1:
            raise ValueError("epsilon must be between 0 and 1")

    @property
    def field(self) -> Field:
        return field(field_degree(self.k), self.poly)

    @property
    def loops(self) -> int:
        n = loop_count(self.epsilon)
        return n if self.max_loops is None else min(n, self.max_loops)


@dataclass(frozen=True)
class Graph:
    """Edges as the kernel reads them: src and dst in buckets of src, or, where there are hubs,
    src, dst and salt in buckets of (src, salt).

    The out-edges of a hub are dealt to ``slices`` salts and the hub's state is sent to each,
    so no task gets all edges of a vertex. ``hubs``: id, slices; 1000 rows at most (None: no
    hubs). count, mark: number of edges and the XOR of their hashes.
    """

    edges: DataFrame
    hubs: DataFrame | None
    count: int
    mark: int

    @property
    def keys(self) -> list[str]:
        return ["src"] if self.hubs is None else ["src", "salt"]


def loop_count(epsilon: float) -> int:
    """Loops after which a path is missed with probability epsilon at most."""
    return max(1, round(math.log(epsilon) / math.log(1 - SUCCESS)))


def seeds(cfg: KPathConfig) -> list[KPathConfig]:
    """The configuration of each loop: a seed and, unless one is given, a field of its own."""
    out = [replace(cfg, seed=cfg.seed + loop) for loop in range(cfg.loops)]
    return [c if c.poly else replace(c, poly=random_primitive(field_degree(c.k), c.seed)) for c in out]


def iteration_slices(k: int, instances: int) -> list[tuple[int, int, int]]:
    """(instance, low, high): an exact split of the 2^k masks. Totals of the slices of one
    seed XOR together; only then is the verdict read."""
    n = 1 << k
    return [(i, n * i // instances, n * (i + 1) // instances) for i in range(instances)]


def even(a: Column, t: Column) -> Column:
    """1 where the vector is orthogonal to the mask, else 0."""
    return (1 - F.bit_count(a.bitwiseAND(t)) % 2).cast("int")


def prepared(edges: DataFrame, cfg: KPathConfig) -> Graph:
    """Distinct edges (src, dst), written in buckets once for all levels and loops."""
    given = written(edges.select("src", "dst"), "kpath-given")
    seen = given.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("src", "dst")), F.lit(0)).alias("mark")).first()
    few = given.groupBy("src").agg(F.count("*").alias("degree")).filter((F.col("degree") * layout.HUBS > seen["n"]) & (F.col("degree") > HUB_EDGES))
    few = written(few.select(F.col("src").alias("id"), F.ceil(F.col("degree") * layout.HUBS / max(1, seen["n"])).cast("int").alias("slices")), "kpath-hubs")
    hubs = None if few.isEmpty() else few
    if hubs is not None:
        slices = F.broadcast(hubs.withColumnRenamed("id", "src"))
        given = given.join(slices, "src", "left").select("src", "dst", F.pmod(F.xxhash64("dst"), F.coalesce("slices", F.lit(1))).cast("int").alias("salt"))
    rows = min(seen["n"] * _blocks(cfg.k) * min(cfg.loops, cfg.loop_batch), cfg.batch_rows)
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    buckets = max(1, min(most, math.ceil(rows / TASK_MESSAGES)), math.ceil(seen["n"] / BUCKET_EDGES))
    keys = [c for c in given.columns if c != "dst"]
    return Graph(bucketed(given, keys, buckets, "kpath-edges"), hubs, seen["n"], seen["mark"])


def _blocks(k: int) -> int:
    return max(1, (1 << k) >> 6)


def _graph(edges: DataFrame | Graph, cfg: KPathConfig) -> Graph:
    return edges if isinstance(edges, Graph) else prepared(edges, cfg)


def _sent(state: DataFrame, graph: Graph) -> DataFrame:
    """The state's rows with the keys of the edges that they go to instead of id."""
    if graph.hubs is None:
        return state.withColumnRenamed("id", "src")
    dealt = state.join(F.broadcast(graph.hubs), "id", "left")
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))
    return dealt.withColumn("salt", salts).drop("slices").withColumnRenamed("id", "src")


# Plain form ---------------------------------------------------------------------------


def level1(vertices: DataFrame, cfg: KPathConfig, low: int = 0, high: int | None = None) -> DataFrame:
    """Plain form: (id, it, val = 1) for every vertex and mask it is orthogonal to."""
    top = (1 << cfg.k if high is None else high) - 1
    rows = vertices.select("id", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(top).cast("long"))).alias("it"))
    return rows.filter(even(prf.assignment(cfg.seed, cfg.k, F.col("id")), F.col("it")) == 1).withColumn("val", F.lit(1).cast("long"))


def messages(state: DataFrame, edges: DataFrame | Graph, cfg: KPathConfig) -> DataFrame:
    """What every vertex sends along its out-edges: (src, dst, it, val)."""
    graph = _graph(edges, cfg)
    return graph.edges.join(_sent(state, graph), graph.keys).select("src", "dst", "it", "val")


def next_level(state: DataFrame, edges: DataFrame | Graph, cfg: KPathConfig, level: int) -> DataFrame:
    """Plain form: from the walks with ``level - 1`` vertices to those with ``level``. Zeros
    and vertices that the mask rules out are dropped before and after the sum."""
    graph = _graph(edges, cfg)
    weighted = graph.edges.withColumn("w", prf.weight(cfg.seed, cfg.field.degree, level, F.col("src"), F.col("dst")))
    sent = weighted.join(_sent(state, graph), graph.keys)
    sent = sent.filter(even(prf.assignment(cfg.seed, cfg.k, F.col("dst")), F.col("it")) == 1)
    out = sent.groupBy(F.col("dst").alias("id"), "it").agg(F.bit_xor(cfg.field.col_multiply(F.col("w"), F.col("val"))).alias("val"))
    return out.filter("val <> 0")


def plain_totals(vertices: DataFrame, edges: DataFrame | Graph, cfg: KPathConfig, low: int = 0, high: int | None = None) -> DataFrame:
    """(id, total) of the vertices with a non-zero total over the masks from ``low`` to
    below ``high``, in the plain form."""
    state, graph = level1(vertices, cfg, low, high), _graph(edges, cfg)
    for level in range(2, cfg.k + 1):
        state = next_level(state, graph, cfg, level)
    return state.groupBy("id").agg(F.bit_xor("val").alias("total")).filter("total <> 0")


# Sliced form --------------------------------------------------------------------------

#: Bit t of entry a: is popcount(a & t) even, for 6-bit a and t.
_EVEN = [sum(1 << t for t in range(64) if not bin(a & t).count("1") % 2) for a in range(64)]


def _long(x: int) -> str:
    """A 64-bit pattern as a SQL literal."""
    x = x - (1 << 64) if x >> 63 else x
    return f"{x}L" if x > -(1 << 63) else f"(-{(1 << 63) - 1}L - 1L)"


def _longs(xs: list[int]) -> str:
    return "array(" + ", ".join(map(_long, xs)) + ")"


def _mask(a: str, block: str, k: int) -> str:
    """SQL of the 64 masks of a block to which a vector is orthogonal, as bits."""
    ones = (1 << min(64, 1 << k)) - 1
    own = f"get({_longs([e & ones for e in _EVEN])}, CAST({a} & 63 AS INT))"
    # The complement for an odd number of high bits is an XOR with all ones.
    return f"({own} ^ -CAST(bit_count(shiftright({a}, 6) & {block}) & 1 AS BIGINT))"


def slice_mask(a: Column, block: Column, k: int) -> Column:
    """The 64 masks of a block to which a vector is orthogonal, as bits."""
    own = F.get(F.expr(_longs([e & ((1 << min(64, 1 << k)) - 1) for e in _EVEN])), a.bitwiseAND(63).cast("int"))
    odd = F.bit_count(F.shiftright(a, 6).bitwiseAND(block)) % 2 == 1
    return F.when(odd, F.bitwise_not(own)).otherwise(own)


def _within(low: int, high: int) -> str:
    """SQL of the bits of a block's masks that lie from ``low`` to below ``high``."""
    ones = (1 << 64) - 1
    first = f"CASE WHEN block = {low >> 6} THEN {_long(ones << (low & 63) & ones)} ELSE -1L END"
    return f"(CASE WHEN block = {high >> 6} THEN {_long((1 << (high & 63)) - 1)} ELSE -1L END & {first})"


def _start(vertices: DataFrame, cfgs: list[KPathConfig], low: int, high: int) -> DataFrame:
    """Level 1: id, l (number of the loop), block and planes."""
    k, d = cfgs[0].k, cfgs[0].field.degree
    draws = ", ".join(prf.assignment_sql(c.seed, k, "id") for c in cfgs)
    rows = vertices.selectExpr("id", f"posexplode(array({draws})) AS (l, a)")
    rows = rows.selectExpr("id", "l", "a", f"explode(sequence({low >> 6}L, {(high - 1) >> 6}L)) AS block")
    return rows.selectExpr("id", "l", "block", f"{_mask('a', 'block', k)} & {_within(low, high)} AS p0", *[f"0L AS p{j}" for j in range(1, d)]).filter("p0 <> 0")


def _level(state: DataFrame, graph: Graph, cfgs: list[KPathConfig], level: int) -> DataFrame:
    """From the walks with ``level - 1`` vertices to those with ``level``."""
    k, d = cfgs[0].k, cfgs[0].field.degree
    # A weight's product is a d x d bit matrix over the planes, packed into one number. Weights
    # and vectors are drawn once for each edge and loop, not for each block.
    products = [f"get({_longs([sum(c.field.multiply(x, 1 << i) << i * d for i in range(d)) for x in range(c.field.size)])}, CAST({prf.weight_sql(c.seed, d, level, 'src', 'dst')} AS INT))" for c in cfgs]
    draws = [prf.assignment_sql(c.seed, k, "dst") for c in cfgs]
    edges = graph.edges.selectExpr(*graph.keys, "dst", f"array({', '.join(products)}) AS ms", f"array({', '.join(draws)}) AS vs")
    sent = edges.join(_sent(state, graph), graph.keys).selectExpr("dst", "l", "block", "get(vs, l) AS a", "get(ms, l) AS m", *[f"p{j}" for j in range(d)])
    # Plane i adds to plane j where w * x^i has bit j.
    planes = [" ^ ".join(f"(p{i} & -(shiftright(m, {i * d + j}) & 1L))" for i in range(d)) + f" AS q{j}" for j in range(d)]
    sums = sent.filter("m <> 0").selectExpr("dst AS id", "l", "block", "a", *planes).groupBy("id", "l", "block", "a").agg(*[F.bit_xor(f"q{j}").alias(f"q{j}") for j in range(d)])
    mask = _mask("a", "block", k)
    return sums.selectExpr("id", "l", "block", *[f"q{j} & {mask} AS p{j}" for j in range(d)]).filter(" OR ".join(f"p{j} <> 0" for j in range(d)))


def sliced_totals(vertices: DataFrame, graph: Graph, cfgs: list[KPathConfig], low: int, high: int) -> DataFrame:
    """(l, id, total) where it is not zero, over the masks from ``low`` to below ``high``, for
    each of the loops ``cfgs`` (of one k; l is the place among them)."""
    d, batch = cfgs[0].field.degree, cfgs[0].level_batch
    state = _start(vertices, cfgs, low, high)
    for level in range(2, cfgs[0].k + 1):
        state = _level(state, graph, cfgs, level)
        if (level - 1) % batch == 0 and level < cfgs[0].k:  # so that plans do not grow with k
            state = written(state, "kpath-level")
    folded = state.groupBy("l", "id").agg(*[F.bit_xor(f"p{j}").alias(f"p{j}") for j in range(d)])
    total = " | ".join(f"shiftleft(CAST(bit_count(p{j}) & 1 AS BIGINT), {j})" for j in range(d))
    return folded.selectExpr("l", "id", f"{total} AS total").filter("total <> 0")


class Ledger:
    """Totals of finished ranges of masks, a folder for each: ``low-high``.

    A range is finished when its folder is complete, so a driver that finds the ledger again
    knows what is left to do. After FOLD ranges their totals are XORed to one; if a driver dies
    between writing that and deleting the ranges in it, they are passed over.
    """

    FOLD = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def ranges(self) -> list[tuple[int, int]]:
        """Finished ranges, ascending, none inside another."""
        found = sorted((tuple(map(int, n.split("-"))) for n in children(self.spark, self.path) if n != "run"), key=lambda r: (r[0], -r[1]))
        out: list[tuple[int, int]] = []
        for a, b in found:
            if not out or b > out[-1][1]:
                out.append((a, b))
        return out

    def left(self, low: int, high: int) -> list[tuple[int, int]]:
        """What of ``low`` to ``high`` is not finished."""
        out, at = [], low
        for a, b in self.ranges():
            if b > at and a < high:
                if a > at:
                    out.append((at, a))
                at = max(at, b)
        return out + ([(at, high)] if at < high else [])

    def add(self, low: int, high: int, totals_: DataFrame) -> None:
        totals_.write.mode("overwrite").parquet(f"{self.path}/{low}-{high}")
        done = self.ranges()
        if len(done) >= self.FOLD and all(b == c for (_, b), (c, _) in zip(done, done[1:])):
            self._xored(done).write.mode("overwrite").parquet(f"{self.path}/{done[0][0]}-{done[-1][1]}")
            for a, b in done:
                removed(self.spark, f"{self.path}/{a}-{b}")

    def _xored(self, ranges: list[tuple[int, int]]) -> DataFrame:
        rows = self.spark.read.schema("l int, id long, total long").parquet(*[f"{self.path}/{a}-{b}" for a, b in ranges])
        return rows.groupBy("l", "id").agg(F.bit_xor("total").alias("total")).filter("total <> 0")

    def totals(self) -> DataFrame:
        """(l, id, total) over all finished ranges."""
        done = self.ranges()
        return self._xored(done) if done else self.spark.createDataFrame([], "l int, id long, total long")

    def claim(self, what: str) -> None:
        """Note what is counted here; a ledger of something else is a ValueError."""
        if "run" not in children(self.spark, self.path):
            self.spark.createDataFrame([(what,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/run")
        noted = self.spark.read.text(f"{self.path}/run").first()["value"]
        if noted != what:
            raise ValueError(f"{self.path} holds the totals of another run: {noted}, not {what}")


def loop_totals(vertices: DataFrame, graph: Graph, cfgs: list[KPathConfig], low: int = 0, high: int | None = None, ledger: str | None = None) -> DataFrame:
    """(l, id, total) where it is not zero, over the masks from ``low`` to below ``high`` (None:
    all), for each of the loops ``cfgs``.

    Masks are worked on in ranges of about ``batch_rows`` messages a level, each a job of its
    own, whose totals go to a ``Ledger``. With a ``ledger`` folder, which outlives the driver,
    ranges finished before are not counted again; without one, and with masks for a single
    range, the result is one plan.
    """
    cfg = cfgs[0]
    high = 1 << cfg.k if high is None else high
    blocks = max(1, cfg.batch_rows // max(1, graph.count * len(cfgs)))
    if ledger is None and (high - 1 >> 6) - (low >> 6) < blocks:
        if low < high:
            return sliced_totals(vertices, graph, cfgs, low, high)
        return vertices.sparkSession.createDataFrame([], "l int, id long, total long")
    spark = vertices.sparkSession
    book = Ledger(spark, ledger or place(spark, "kpath-ledger"))
    who = vertices.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("id")), F.lit(0)).alias("mark")).first()
    book.claim(f"k={cfg.k} loops={[(c.seed, c.field.poly) for c in cfgs]} vertices={who['n']}:{who['mark']} edges={graph.count}:{graph.mark}")
    for a, b in book.left(low, high):
        while a < b:
            end = min(b, ((a >> 6) + blocks) << 6)
            with scratch(spark):
                book.add(a, end, sliced_totals(vertices, graph, cfgs, a, end))
            a = end
    return book.totals()


def totals(vertices: DataFrame, edges: DataFrame | Graph, cfg: KPathConfig, low: int = 0, high: int | None = None, ledger: str | None = None) -> DataFrame:
    """(id, total) of one loop, as ``loop_totals``. Slices of one seed XOR to the whole (``merged``)."""
    return loop_totals(vertices, _graph(edges, cfg), [cfg], low, high, ledger).select("id", "total")


def merged(parts: list[DataFrame]) -> DataFrame:
    """Totals of slices of the masks as one: (id, total) where they do not cancel."""
    out = parts[0]
    if len(parts) == 1:
        return out
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.bit_xor("total").alias("total")).filter("total <> 0")


def verdict(totals_: DataFrame, k: int) -> DataFrame:
    """One row (k, found)."""
    return totals_.agg(F.coalesce(F.bool_or(F.col("total") != 0), F.lit(False)).alias("found")).select(F.lit(k).alias("k"), "found")


def loop_verdicts(vertices: DataFrame, edges: DataFrame | Graph, cfg: KPathConfig) -> DataFrame:
    """(loop, k, found) of every loop that epsilon asks for, all in one run."""
    cfgs, spark = seeds(cfg), vertices.sparkSession
    found = loop_totals(vertices, _graph(edges, cfg), cfgs).select(F.col("l").alias("loop")).distinct().withColumn("found", F.lit(True))
    every = spark.range(len(cfgs)).select(F.col("id").cast("int").alias("loop"))
    return every.join(found, "loop", "left").select("loop", F.lit(cfg.k).alias("k"), F.coalesce("found", F.lit(False)).alias("found"))


def detect(vertices: DataFrame, edges: DataFrame, cfg: KPathConfig, ledger: str | None = None) -> bool:
    """Loop with fresh seeds and fields, ``loop_batch`` loops at a time, until a path is proven
    or the miss probability is below epsilon. A graph that fails ``graphs.check`` is a
    ValueError. With a ``ledger`` folder a driver that starts anew goes on where the last ended."""
    graphs.check(vertices, edges)
    n = vertices.count()
    if cfg.k > n:
        return False
    if cfg.k == 1:
        return n > 0
    cfgs = seeds(cfg)
    with scratch(vertices.sparkSession):
        graph = prepared(edges, cfg)
        for at in range(0, len(cfgs), cfg.loop_batch):
            some = cfgs[at : at + cfg.loop_batch]
            if not loop_totals(vertices, graph, some, ledger=ledger and f"{ledger}/loops-{at}").isEmpty():
                return True
    return False


def report(found: bool, k: int) -> str:
    return f"Graph {'contains' if found else 'does not contain'} a {k}-path."


def exact_paths(edges: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """All directed simple paths on k vertices as arrays: ground truth for small graphs."""
    paths = vertices.select(F.array("id").alias("path"), F.col("id").alias("last"))
    for _ in range(k - 1):
        step = paths.join(edges, F.col("last") == F.col("src"))
        paths = step.filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last"))
    return paths.select("path")


def path_count(edges: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """One row (paths): the number of rows of ``exact_paths``, without listing them up to k = 4.

    A path a, b, c, d has a middle edge b, c; any other edge into b and any other edge out of c
    make one, unless they start and end at the same vertex, which closes a triangle. So edges are
    joined to degrees only, and triangles are sought from their vertex of least degree: the rows
    are at most the edges to the power 1.5, however large the hubs. An edge listed again or to
    its own vertex counts for nothing; all ends of edges are vertices.
    """
    if k == 1:
        return vertices.select("id").distinct().agg(F.count("*").alias("paths"))
    if k > 4:
        return exact_paths(edges, vertices, k).agg(F.count("*").alias("paths"))
    # ways: 1 from a to b, 2 from b to a, 3 both.
    pairs = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.bit_or(F.when(F.col("src") < F.col("dst"), 1).otherwise(2)).cast("int").alias("ways"))
    if k == 2:
        return pairs.agg(F.coalesce(F.sum(F.bit_count("ways")), F.lit(0)).cast("long").alias("paths"))
    pairs = written(pairs, "path-pairs")
    ends = pairs.selectExpr("inline(array(struct(a AS id, ways & 1 AS o, shiftright(ways, 1) AS i), struct(b AS id, shiftright(ways, 1) AS o, ways & 1 AS i)))")
    degrees = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum(F.expr("o * i")).alias("r"), F.count("*").alias("n"))
    if k == 3:
        return degrees.agg(F.coalesce(F.sum(F.expr("o * i - r")), F.lit(0)).alias("paths"))
    degrees = written(degrees.drop("r"), "path-degrees")
    few = degrees.filter(F.col("n") * layout.HUBS > pairs.count())
    for end in ("a", "b"):
        at = [F.col(c).alias(end if c == "id" else f"{c}{end}") for c in degrees.columns]
        pairs = layout.hub_join(pairs, end, degrees.select(*at), few.select(F.col("id").alias(end)))
    pairs = written(pairs, "path-edges")
    both = "CAST(ways = 3 AS INT)"
    walks = pairs.agg(F.sum(F.expr(f"(ways & 1) * (ia - {both}) * (ob - {both}) + shiftright(ways, 1) * (ib - {both}) * (oa - {both})")).alias("walks"))
    first = "(na < nb OR na = nb AND a < b)"  # each pair from the end of lower degree: x to y
    low = pairs.selectExpr(f"IF({first}, a, b) AS x", f"IF({first}, b, a) AS y", f"IF({first}, nb, na) AS ny", f"IF({first}, ways, shiftright(ways, 1) + 2 * (ways & 1)) AS ways")
    xy, xz, yz = low.alias("xy"), low.alias("xz"), low.selectExpr("x AS y", "y AS z", "ways AS ways_yz").alias("yz")
    wedges = xy.join(xz, F.expr("xy.x = xz.x AND (xy.ny < xz.ny OR xy.ny = xz.ny AND xy.y < xz.y)")).selectExpr("xy.y AS y", "xz.y AS z", "xy.ways AS ways_xy", "xz.ways AS ways_xz")
    rings = "(ways_xy & 1) * (ways_yz & 1) * shiftright(ways_xz, 1) + (ways_xz & 1) * shiftright(ways_yz, 1) * shiftright(ways_xy, 1)"
    closed = wedges.join(yz, ["y", "z"]).agg(F.sum(F.expr(rings).cast("long")).alias("rings"))
    # A ring is closed at each of its three edges.
    return walks.crossJoin(closed).select((F.coalesce("walks", F.lit(0)) - 3 * F.coalesce("rings", F.lit(0))).cast("long").alias("paths"))
