"""All named queries of the engine, each with the SQL that gives the same rows.

Graph queries run on the geo graph of the data folder (region - nation - customer and
supplier, both directions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions import polynomials as P
from trailweave.functions import prf
from trailweave.functions.field import field, field_degree
from trailweave.operators import kpath, layout
from trailweave.sources import binary, graphs
from trailweave.sources.shared import place

K, SEED, PARTS, THREADS = 5, 11, 9, 3
CFG = kpath.KPathConfig(K, seed=SEED)
GF = field(field_degree(K))
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return f

    return add


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = graphs.geo_edges(spark, d)
    return e.select(F.col("src").alias("id")).distinct(), e  # both directions: every vertex is a source


def _owned(spark: SparkSession, d: str) -> DataFrame:
    v, e = _graph(spark, d)
    return layout.edge_owner(e, layout.block_partition(v, PARTS))


def _file(spark: SparkSession, label: str, lines: DataFrame) -> str:
    """Write lines of text to the shared folder; the path."""
    path = place(spark, label)
    lines.write.text(path)
    return path


# SQL fragments -----------------------------------------------------------------------

GEO = """
one AS (
  SELECT CAST(n_regionkey AS BIGINT) * 4 AS src, CAST(n_nationkey AS BIGINT) * 4 + 1 AS dst FROM nation
  UNION ALL SELECT CAST(c_nationkey AS BIGINT) * 4 + 1, CAST(c_custkey AS BIGINT) * 4 + 2 FROM customer
  UNION ALL SELECT CAST(s_nationkey AS BIGINT) * 4 + 1, CAST(s_suppkey AS BIGINT) * 4 + 3 FROM supplier),
e AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM one UNION ALL SELECT dst, src FROM one)),
v AS (SELECT DISTINCT src AS id FROM e)"""
PART = f"parts AS (SELECT id, CAST(ntile({PARTS}) OVER (ORDER BY id) - 1 AS INTEGER) AS part FROM v)"
OWN = "own AS (SELECT e.src, e.dst, a.part AS src_part, b.part AS dst_part FROM e JOIN parts a ON a.id = e.src JOIN parts b ON b.id = e.dst)"


def _assign(x: str, k: int = K, seed: int = SEED) -> str:
    return f"({prf.sql(chr(39) + 'a' + chr(39), str(seed), x)} % {1 << k})"


def _weight(level: str, seed: int = SEED) -> str:
    return f"({prf.sql(chr(39) + 'w' + chr(39), str(seed), level, 'src', 'dst')} % {GF.size})"


def _times(a: str, b: str, d: int = GF.degree, poly: int = GF.poly) -> str:
    """Product in the field by shift and reduce, independent of the tables."""
    whole = "0"
    for i in range(d):
        whole = f"xor({whole}, CASE WHEN ({b} >> {i}) & 1 = 1 THEN ({a} << {i}) ELSE 0 END)"
    return f"list_reduce([{whole}] || [CAST(i AS BIGINT) FOR i IN range({2 * d - 2}, {d - 1}, -1)], lambda p, i: CASE WHEN (p >> i) & 1 = 1 THEN xor(p, {poly}::BIGINT << (i - {d})) ELSE p END)"


def _levels(low: int = 0, high: int = 1 << K, seed: int = SEED, poly: int = GF.poly) -> str:
    """The state after each level, over the masks from ``low`` to below ``high``."""
    out = f"""l1 AS (SELECT id, it, CAST(1 AS BIGINT) AS val FROM v, (SELECT unnest(range({low}, {high})) AS it) WHERE bit_count({_assign("id", seed=seed)} & it) % 2 = 0)"""
    for n in range(2, K + 1):
        out += f""",
w{n} AS (SELECT src, dst, {_weight(str(n), seed)} AS w FROM e),
l{n} AS (SELECT * FROM (SELECT dst AS id, it, bit_xor(CAST({_times("w", "val", poly=poly)} AS BIGINT)) AS val FROM w{n} JOIN l{n - 1} ON l{n - 1}.id = w{n}.src
       WHERE bit_count({_assign("dst", seed=seed)} & it) % 2 = 0 GROUP BY dst, it) WHERE val <> 0)"""
    return out


LEVELS = _levels()


def _totals(low: int = 0, high: int = 1 << K, seed: int = SEED, poly: int = GF.poly) -> str:
    return f"WITH {GEO}, {_levels(low, high, seed, poly)}, totals AS (SELECT id, bit_xor(val) AS total FROM l{K} GROUP BY id HAVING bit_xor(val) <> 0) "


TOTALS = _totals()


# Sources ------------------------------------------------------------------------------


@query("adjacency_scan", f"WITH {GEO} SELECT src AS id, CAST(src % 7 + 0.5 AS DOUBLE) AS weight, count(*) AS n_nbrs, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS nbrs FROM e GROUP BY src")
def adjacency_scan(spark, d):
    lines = graphs.render_adjacency(graphs.adjacency_of(_graph(spark, d)[1]))
    a = graphs.parse_adjacency(lines)
    return a.select("id", "weight", F.size("nbrs").cast("long").alias("n_nbrs"), F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"))


@query("edge_list_scan", f"WITH {GEO} SELECT src, dst FROM e")
def edge_list_scan(spark, d):
    e = _graph(spark, d)[1]
    head = spark.createDataFrame([("3",), ("4",)], "value string")
    return graphs.parse_edge_list(head.unionByName(e.select(F.concat_ws(" ", "src", "dst").alias("value"))))


@query("adjacency_file", ORACLE_SQL["adjacency_scan"])
def adjacency_file(spark, d):
    """As ``adjacency_scan``, by way of a text file."""
    lines = graphs.render_adjacency(graphs.adjacency_of(_graph(spark, d)[1]))
    a = graphs.read_adjacency(spark, _file(spark, "adjacency", lines))
    return a.select("id", "weight", F.size("nbrs").cast("long").alias("n_nbrs"), F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"))


@query("edge_list_file", ORACLE_SQL["edge_list_scan"])
def edge_list_file(spark, d):
    """As ``edge_list_scan``, by way of a text file with its two head lines."""
    e = _graph(spark, d)[1]
    head = spark.createDataFrame([("3",), ("4",)], "value string")
    return graphs.read_edge_list(spark, _file(spark, "edges", head.unionByName(e.select(F.concat_ws(" ", "src", "dst").alias("value")))))


@query("big_endian_ints", "SELECT o_orderkey AS key, o_orderkey AS first, o_custkey AS second FROM orders")
def big_endian_ints(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    raw = F.unhex(F.concat(*[F.lpad(F.hex(c), 8, "0") for c in ("o_orderkey", "o_custkey")]))
    return o.select(F.col("o_orderkey").alias("key"), graphs.big_endian_int(raw, 0).alias("first"), graphs.big_endian_int(raw, 1).alias("second"))


@query("edge_explode", f"WITH {GEO} SELECT src, dst FROM e")
def edge_explode(spark, d):
    a = graphs.adjacency_of(_graph(spark, d)[1])
    return graphs.edges_of(a.withColumn("nbrs", F.concat("nbrs", "nbrs")))


@query("vertex_limit", f"WITH {GEO} SELECT id FROM v ORDER BY id LIMIT 50")
def vertex_limit(spark, d):
    return graphs.limit_vertices(_graph(spark, d)[0], 50)


def _shuffled_file(spark: SparkSession, d: str) -> str:
    """The geo graph as a text file whose labels are in no order."""
    lines = graphs.adjacency_of(_graph(spark, d)[1])
    return _file(spark, "shuffled", graphs.render_adjacency(lines.orderBy(F.md5(F.col("id").cast("string").cast("binary")))))


FILE_ORDER = f"{GEO}, placed AS (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR))) - 1 AS ordinal FROM v)"


@query("file_vertex_limit", f"WITH {FILE_ORDER} SELECT id, ordinal FROM placed WHERE ordinal < 50")
def file_vertex_limit(spark, d):
    """The vertices of a file's first 50 lines, whatever their labels."""
    return graphs.limit_vertices(graphs.read_adjacency(spark, _shuffled_file(spark, d), ordinals=True), 50).select("id", "ordinal")


@query("file_block_partition", f"WITH {FILE_ORDER} SELECT id, CAST(ntile({PARTS}) OVER (ORDER BY ordinal) - 1 AS INTEGER) AS part FROM placed")
def file_block_partition(spark, d):
    """Contiguous blocks in the order of the file."""
    return layout.partition(graphs.read_adjacency(spark, _shuffled_file(spark, d), ordinals=True), PARTS, position="ordinal").select("id", "part")


_LINES = """
lines AS (SELECT c_custkey % 8 AS kind, CASE c_custkey % 8
    WHEN 0 THEN 'x' || c_custkey || ' 1.0 2' WHEN 1 THEN '' || c_custkey WHEN 2 THEN c_custkey || chr(9) || '1.0 2'
    WHEN 3 THEN c_custkey || ' heavy 2' WHEN 4 THEN c_custkey || ' 1.0 2 -3' ELSE c_custkey || ' 1.0 2  3' END AS value FROM customer)"""


def _odd_file(spark: SparkSession, d: str) -> str:
    """A text file of which most lines hold no vertex; some come twice."""
    lines = f"WITH {_LINES.replace('customer)', '{customer})')} SELECT value FROM lines UNION ALL SELECT value FROM lines WHERE kind = 5"
    return _file(spark, "lines", spark.sql(lines, customer=spark.read.parquet(f"{d}/customer.parquet")))


@query("rejected_lines", f"WITH {_LINES} SELECT value, ['label', 'no weight', 'tab', 'weight', 'neighbour', 'label again'][kind + 1] AS reason FROM lines WHERE kind < 6")
def rejected_lines(spark, d):
    """Lines of a file that hold no vertex, one in eight for each reason, by way of the file."""
    return graphs.sorted_out(graphs.read_lines(spark, _odd_file(spark, d)))[1].select("value", "reason")


@query("accepted_lines", f"WITH {_LINES} SELECT CAST(split_part(value, ' ', 1) AS BIGINT) AS id, 1.0::DOUBLE AS weight, '2 3' AS nbrs FROM lines WHERE kind > 4")
def accepted_lines(spark, d):
    """The vertices of the same file, of which each counts once."""
    good = graphs.sorted_out(graphs.read_lines(spark, _odd_file(spark, d)))[0]
    return good.select("id", "weight", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), " ").alias("nbrs"))


@query("binary_ints_file", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_custkey AS value FROM orders")
def binary_ints_file(spark, d):
    """Integers by way of binary files, read in ranges."""
    path = place(spark, "ints")
    binary.write_ints(spark.read.parquet(f"{d}/orders.parquet").orderBy("o_orderkey").select(F.col("o_custkey").alias("value")), path)
    return binary.read_ints(spark, path, split=1 << 20)


# Layout -------------------------------------------------------------------------------


@query("block_partition", f"WITH {GEO}, {PART} SELECT id, part FROM parts")
def block_partition(spark, d):
    return layout.block_partition(_graph(spark, d)[0], PARTS)


_DEGREE = f"""{GEO}, degrees AS (SELECT src AS id, count(*) AS n FROM e GROUP BY src),
parts AS (SELECT id, n, CAST(coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {PARTS} // (SELECT count(*) FROM e) AS INTEGER) AS part FROM degrees)"""


@query("degree_partition", f"WITH {_DEGREE} SELECT id, part FROM parts")
def degree_partition(spark, d):
    """Contiguous blocks with as many edges each as whole vertices allow."""
    v, e = _graph(spark, d)
    return layout.partition(v, PARTS, "degree", e)


@query("degree_partition_load", f"WITH {_DEGREE} SELECT part, count(*) AS vertices, CAST(sum(n) AS BIGINT) AS edges FROM parts GROUP BY part")
def degree_partition_load(spark, d):
    v, e = _graph(spark, d)
    owned = layout.edge_owner(e, layout.partition(v, PARTS, "degree", e))
    return owned.groupBy(F.col("src_part").alias("part")).agg(F.count_distinct("src").alias("vertices"), F.count("*").alias("edges"))


@query("hash_partition", f"WITH {GEO} SELECT id, CAST({prf.sql(chr(39) + 'h' + chr(39), '0', 'id')} % {PARTS} AS INTEGER) AS part FROM v")
def hash_partition(spark, d):
    return layout.partition(_graph(spark, d)[0], PARTS, "hash")


@query("thread_partition", f"WITH {GEO}, {PART} SELECT id, part, CAST(ntile({THREADS}) OVER (PARTITION BY part ORDER BY id) - 1 AS INTEGER) AS thread FROM parts")
def thread_partition(spark, d):
    return layout.thread_partition(_graph(spark, d)[0], PARTS, THREADS)


@query("partition_counts", f"WITH {GEO}, {PART} SELECT part, count(*) AS n FROM parts GROUP BY part")
def partition_counts(spark, d):
    return layout.partition_counts(layout.block_partition(_graph(spark, d)[0], PARTS))


@query(
    "partition_displacements",
    f"WITH {GEO}, {PART}, c AS (SELECT part, count(*) AS n FROM parts GROUP BY part) "
    "SELECT part, n, CAST(coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS displacement FROM c",
)
def partition_displacements(spark, d):
    return layout.partition_displacements(layout.block_partition(_graph(spark, d)[0], PARTS))


@query("edge_owner", f"WITH {GEO}, {PART}, {OWN} SELECT * FROM own")
def edge_owner(spark, d):
    return _owned(spark, d)


@query("cut_edges", f"WITH {GEO}, {PART}, {OWN} SELECT * FROM own WHERE src_part <> dst_part")
def cut_edges(spark, d):
    return layout.cut_edges(_owned(spark, d))


@query("routing_lists", f"WITH {GEO}, {PART}, {OWN} SELECT src_part, src, dst_part, count(*) AS n, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS labels FROM own GROUP BY ALL")
def routing_lists(spark, d):
    r = layout.routing_lists(_owned(spark, d))
    return r.withColumn("labels", F.array_join(F.transform("labels", lambda x: x.cast("string")), " "))


@query(
    "routing_size",
    f"WITH {GEO}, {PART}, {OWN}, g AS (SELECT src_part, src, dst_part, count(*) AS n FROM own GROUP BY ALL), "
    "s AS (SELECT src_part, CAST(sum(CASE WHEN n > 1 THEN n + 1 ELSE 1 END) + 2 * count(DISTINCT dst_part) AS BIGINT) AS list_size FROM g GROUP BY src_part) "
    "SELECT src_part, list_size, max(list_size) OVER () + 1 AS buffer_size FROM s",
)
def routing_size(spark, d):
    return layout.routing_size(_owned(spark, d))


@query(
    "buffer_slots",
    f"WITH {GEO}, {PART}, {OWN} SELECT src_part, dst_part, src, CAST(row_number() OVER (PARTITION BY src_part, dst_part ORDER BY src) - 1 AS INTEGER) AS slot "
    "FROM (SELECT DISTINCT src_part, dst_part, src FROM own)",
)
def buffer_slots(spark, d):
    return layout.buffer_slots(_owned(spark, d))


@query(
    "message_count_matrix",
    f"WITH {GEO}, {PART}, {OWN}, c AS (SELECT src_part, dst_part, count(DISTINCT src) AS n FROM own GROUP BY ALL), "
    f"grid AS (SELECT CAST(i // {PARTS} AS INTEGER) AS src_part, CAST(i % {PARTS} AS INTEGER) AS dst_part FROM (SELECT unnest(range({PARTS * PARTS})) AS i)) "
    "SELECT grid.src_part, grid.dst_part, coalesce(n, 0) AS msg_count FROM grid LEFT JOIN c ON c.src_part = grid.src_part AND c.dst_part = grid.dst_part",
)
def message_count_matrix(spark, d):
    return layout.message_counts(_owned(spark, d), PARTS)


@query("routing_chunks", ORACLE_SQL["routing_lists"])
def routing_chunks(spark, d):
    """The routing lists put together again from pieces of some 50 receivers."""
    c = layout.routing_chunks(_owned(spark, d), 50)
    r = c.groupBy("src_part", "src", "dst_part").agg(F.sum("n").alias("n"), F.sort_array(F.flatten(F.collect_list("labels"))).alias("labels"))
    return r.withColumn("labels", F.array_join(F.transform("labels", lambda x: x.cast("string")), " "))


@query(
    "message_matrix_file",
    "WITH m AS (" + ORACLE_SQL["message_count_matrix"] + ") SELECT string_agg(CAST(msg_count AS VARCHAR), ' ' ORDER BY dst_part) AS line FROM m GROUP BY src_part",
)
def message_matrix_file(spark, d):
    path = place(spark, "matrix")
    graphs.write_message_matrix(layout.message_counts(_owned(spark, d), PARTS), PARTS, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("gather_labels", f"WITH {GEO} SELECT row_number() OVER (ORDER BY id) - 1 AS position, id FROM v")
def gather_labels(spark, d):
    """The labels of all parts in part order, as (position, label) rows and not as one array."""
    return layout.ranked(_graph(spark, d)[0], "id", "position").select("position", "id")


@query("gather_ints", f"SELECT string_agg(CAST(i // {PARTS} AS VARCHAR), ' ' ORDER BY i) AS gathered FROM (SELECT unnest(range({PARTS * PARTS})) AS i)")
def gather_ints(spark, d):
    """Every rank sends its number to the first rank once for each rank."""
    sent = spark.range(PARTS).select(F.col("id").cast("int").alias("rank"), F.array_repeat("id", PARTS).alias("ints"))
    all_ = graphs.gathered(sent, "rank", "ints", PARTS)
    return all_.select(F.array_join(F.transform(F.flatten("ints"), lambda x: x.cast("string")), " ").alias("gathered"))


@query("rank_texts", "SELECT string_agg(n_name, '' ORDER BY n_nationkey) AS joined FROM nation")
def rank_texts(spark, d):
    return layout.joined_text(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name"), "n_nationkey", "n_name")


@query("timing_summary", "SELECT event_type AS phase, min(value) AS min_ms, max(value) AS max_ms, round(avg(value), 4) AS avg_ms FROM events GROUP BY event_type")
def timing_summary(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("phase"), F.col("value").alias("ms"))
    return layout.timing_summary(t)


# Draws --------------------------------------------------------------------------------


@query("vertex_iteration_cross", f"WITH {GEO} SELECT id, it FROM v, (SELECT unnest(range({1 << K})) AS it)")
def vertex_iteration_cross(spark, d):
    return _graph(spark, d)[0].select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << K) - 1).cast("long"))).alias("it"))


@query("eigenvalue_bits", f"WITH {GEO} SELECT id, it, CAST(1 - bit_count({_assign('id')} & it) % 2 AS INTEGER) AS x FROM v, (SELECT unnest(range({1 << K})) AS it)")
def eigenvalue_bits(spark, d):
    rows = _graph(spark, d)[0].select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << K) - 1).cast("long"))).alias("it"))
    return rows.select("id", "it", kpath.even(prf.assignment(SEED, K, F.col("id")), F.col("it")).alias("x"))


@query("edge_weights", f"WITH {GEO} SELECT level, src, dst, {_weight('level')} AS w FROM e, (SELECT CAST(unnest(range(2, {K + 1})) AS INTEGER) AS level)")
def edge_weights(spark, d):
    e = _graph(spark, d)[1]
    out = [e.select(F.lit(n).alias("level"), "src", "dst", prf.weight(SEED, GF.degree, n, F.col("src"), F.col("dst")).alias("w")) for n in range(2, K + 1)]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


@query("loop_count", "SELECT epsilon, CAST(round(ln(epsilon) / ln(0.8)) AS INTEGER) AS loops FROM (SELECT unnest([0.5::DOUBLE, 0.2, 0.1, 0.05, 0.01, 0.001]) AS epsilon)")
def loop_count(spark, d):
    return spark.createDataFrame([(e, kpath.loop_count(e)) for e in (0.5, 0.2, 0.1, 0.05, 0.01, 0.001)], "epsilon double, loops int")


@query("iteration_slices", "SELECT CAST(i AS INTEGER) AS instance, 64 * i // 3 AS low, 64 * (i + 1) // 3 AS high FROM (SELECT unnest(range(3)) AS i)")
def iteration_slices(spark, d):
    return spark.createDataFrame(kpath.iteration_slices(6, 3), "instance int, low long, high long")


# Fields and polynomials ---------------------------------------------------------------

_AB = "(SELECT CAST(i // {n} AS INTEGER) AS a, CAST(i % {n} AS INTEGER) AS b FROM (SELECT unnest(range({m})) AS i))"


@query("gf_add", "SELECT a, b, xor(a, b) AS total FROM " + _AB.format(n=GF.size, m=GF.size**2))
def gf_add(spark, d):
    return GF.table(spark).select("a", "b", F.col("a").bitwiseXOR(F.col("b")).alias("total"))


@query("gf_mul_table", f"SELECT a, b, CAST({_times('CAST(a AS BIGINT)', 'CAST(b AS BIGINT)')} AS INTEGER) AS prod FROM " + _AB.format(n=GF.size, m=GF.size**2))
def gf_mul_table(spark, d):
    return GF.table(spark)


@query("gf_byte_table", f"SELECT a, b, CAST({_times('CAST(a AS BIGINT)', 'CAST(b AS BIGINT)', 8, 285)} AS INTEGER) AS prod FROM " + _AB.format(n=256, m=65536))
def gf_byte_table(spark, d):
    return field(8, 285).table(spark)


_POLY = "(SELECT o_orderkey AS key, o_orderkey % 64 AS a, o_custkey % 64 AS b FROM orders)"


def _polys(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 64).alias("a"), (F.col("o_custkey") % 64).alias("b"))


@query("gf_multiply", f"SELECT key, CAST({_times('(a % 32)', '(b % 32)')} AS BIGINT) AS prod FROM {_POLY}")
def gf_multiply(spark, d):
    return _polys(spark, d).select("key", GF.col_multiply(F.col("a") % GF.size, F.col("b") % GF.size).alias("prod"))


@query("poly_add", f"SELECT key, xor(a, b) AS total FROM {_POLY}")
def poly_add(spark, d):
    return _polys(spark, d).select("key", P.col_add(F.col("a"), F.col("b")).alias("total"))


def _clmul(bits: int) -> str:
    out = "0"
    for i in range(bits):
        out = f"xor({out}, CASE WHEN (b >> {i}) & 1 = 1 THEN a << {i} ELSE 0 END)"
    return out


@query("poly_mul", f"SELECT key, CAST({_clmul(6)} AS BIGINT) AS prod FROM {_POLY}")
def poly_mul(spark, d):
    return _polys(spark, d).select("key", P.col_multiply(F.col("a"), F.col("b"), 6).alias("prod"))


@query(
    "poly_mod",
    f"SELECT key, CAST(list_reduce([CAST(prod AS BIGINT)] || [CAST(i AS BIGINT) FOR i IN range(10, 3, -1)], lambda p, i: CASE WHEN (p >> i) & 1 = 1 THEN xor(p, 19::BIGINT << (i - 4)) ELSE p END) AS BIGINT) AS rest "
    f"FROM (SELECT key, {_clmul(6)} AS prod FROM {_POLY})",
)
def poly_mod(spark, d):
    return _polys(spark, d).select("key", P.col_mod(P.col_multiply(F.col("a"), F.col("b"), 6), 19, 11).alias("rest"))


@query("poly_degree", f"SELECT key, CAST(CASE WHEN a = 0 THEN -1 ELSE floor(log2(a)) END AS INTEGER) AS degree FROM {_POLY}")
def poly_degree(spark, d):
    return _polys(spark, d).select("key", P.col_degree(F.col("a")).cast("int").alias("degree"))


@query("poly_shift_left", f"SELECT key, a << 3 AS shifted FROM {_POLY}")
def poly_shift_left(spark, d):
    return _polys(spark, d).select("key", P.col_shift_left(F.col("a"), 3).alias("shifted"))


@query(
    "poly_bits",
    "SELECT key, (a >> 3) & 1 = 1 AS has_3, CAST(bit_count(a - b) AS INTEGER) AS plain_bits, CAST(CASE WHEN a < b THEN 64 - bit_count(a - b) ELSE bit_count(a - b) END AS INTEGER) AS bits, "
    f"CAST(sign(a - b) AS INTEGER) AS compared, (key >> 9) & 1 = 1 AS byte_bit FROM {_POLY}",
)
def poly_bits(spark, d):
    raw = F.unhex(F.lpad(F.hex("key"), 16, "0"))
    diff = F.col("a") - F.col("b")
    return _polys(spark, d).select(
        "key", P.col_has_degree(F.col("a"), 3).alias("has_3"), F.bit_count(diff).alias("plain_bits"), P.col_bit_count(diff).alias("bits"),
        P.col_compare(F.col("a"), F.col("b")).alias("compared"), P.col_byte_bit(raw, 9).alias("byte_bit"),
    )


@query("poly_from_bytes", f"SELECT key, (key & 511) | 512 AS poly FROM {_POLY}")
def poly_from_bytes(spark, d):
    return _polys(spark, d).select("key", P.col_from_bytes(F.unhex(F.lpad(F.hex("key"), 16, "0")), 9).alias("poly"))


@query("poly_random", f"SELECT key, ({prf.sql(chr(39) + 'p' + chr(39), str(SEED), 'key')} % 512) | 512 AS poly FROM {_POLY}")
def poly_random(spark, d):
    return _polys(spark, d).select("key", P.col_random(SEED, F.col("key"), 9).alias("poly"))


@query(
    "poly_degrees",
    f"WITH p AS (SELECT key, [i FOR i IN range(5, -1, -1) IF (a >> i) & 1 = 1] AS da, [i FOR i IN range(5, -1, -1) IF (b >> i) & 1 = 1] AS db FROM {_POLY}) "
    "SELECT key, array_to_string(da, ' ') AS degrees, array_to_string([x FOR x IN da IF NOT list_contains(db, x)], ' ') AS only_a, "
    "array_to_string(list_sort([x FOR x IN da IF NOT list_contains(db, x)] || [x FOR x IN db IF NOT list_contains(da, x)]), ' ') AS one_of FROM p",
)
def poly_degrees(spark, d):
    """Degrees in descending order, the set difference, and the symmetric difference."""
    a, b = (P.col_degrees(F.col(c), 6) for c in "ab")
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), " ")
    both = F.concat(F.array_except(a, b), F.array_except(b, a))
    return _polys(spark, d).select("key", text(a).alias("degrees"), text(F.array_except(a, b)).alias("only_a"), text(F.sort_array(both)).alias("one_of"))


@query("int_halves", "SELECT o_orderkey AS key, o_orderkey >> 16 AS high, o_orderkey & 65535 AS low FROM orders")
def int_halves(spark, d):
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("key"), F.shiftright(k, 16).alias("high"), k.bitwiseAND(65535).alias("low"))


@query(
    "irreducible_polys",
    "WITH p AS (SELECT CAST(i AS BIGINT) AS a FROM (SELECT unnest(range(2, 128)) AS i)), q AS (SELECT a AS b FROM p), "
    f"made AS (SELECT DISTINCT {_clmul(7)} AS c FROM p, q) "
    "SELECT CAST(floor(log2(i)) AS INTEGER) AS degree, CAST(i AS BIGINT) AS poly FROM (SELECT unnest(range(4, 256)) AS i) WHERE i NOT IN (SELECT c FROM made)",
)
def irreducible_polys(spark, d):
    return spark.createDataFrame([(n, p) for n in range(2, 8) for p in P.irreducible(n)], "degree int, poly long")


@query(
    "primitive_polys",
    "WITH RECURSIVE step(d, poly, x, n) AS (SELECT CAST(floor(log2(i)) AS INTEGER), CAST(i AS BIGINT), CAST(2 AS BIGINT), 1 FROM (SELECT unnest(range(5, 256, 2)) AS i) "
    "UNION ALL SELECT d, poly, CASE WHEN ((x << 1) >> d) & 1 = 1 THEN xor(x << 1, poly) ELSE x << 1 END, n + 1 FROM step WHERE x <> 1 AND n < (1 << d)) "
    "SELECT d AS degree, poly FROM step WHERE x = 1 AND n = (1 << d) - 1",
)
def primitive_polys(spark, d):
    return spark.createDataFrame([(n, p) for n in range(2, 8) for p in P.primitive(n)], "degree int, poly long")


# Paths --------------------------------------------------------------------------------


@query("kpath_level1", f"WITH {GEO}, {LEVELS} SELECT id, it, val FROM l1")
def kpath_level1(spark, d):
    return kpath.level1(_graph(spark, d)[0], CFG)


@query("message_join", f"WITH {GEO}, {LEVELS} SELECT src, dst, it, val FROM e JOIN l1 ON l1.id = e.src")
def message_join(spark, d):
    v, e = _graph(spark, d)
    return kpath.messages(kpath.level1(v, CFG), e, CFG)


@query("kpath_level_n", f"WITH {GEO}, {LEVELS} SELECT id, it, val FROM l3")
def kpath_level_n(spark, d):
    v, e = _graph(spark, d)
    e = kpath.prepared(e, CFG)
    return kpath.next_level(kpath.next_level(kpath.level1(v, CFG), e, CFG, 2), e, CFG, 3)


@query("kpath_totals", TOTALS + "SELECT id, total FROM totals")
def kpath_totals(spark, d):
    return kpath.totals(*_graph(spark, d), CFG)


@query("kpath_slice", _totals(0, 21) + "SELECT id, total FROM totals")
def kpath_slice(spark, d):
    """The masks of one of several instances."""
    return kpath.totals(*_graph(spark, d), CFG, 0, 21)


@query("kpath_slices_merged", TOTALS + "SELECT id, total FROM totals")
def kpath_slices_merged(spark, d):
    v, e = _graph(spark, d)
    e = kpath.prepared(e, CFG)
    return kpath.merged([kpath.totals(v, e, CFG, low, high) for _, low, high in kpath.iteration_slices(K, 3)])


LOOPS = kpath.KPathConfig(K, epsilon=0.1, seed=SEED)


@query(
    "kpath_loops",
    " UNION ALL ".join(f"SELECT * FROM ({_totals(seed=c.seed, poly=c.field.poly)} SELECT CAST({n} AS INTEGER) AS loop, {K} AS k, count(*) > 0 AS found FROM totals)" for n, c in enumerate(kpath.seeds(LOOPS))),
)
def kpath_loops(spark, d):
    """The verdict of each of the ten loops that epsilon asks for, which draw their own fields
    and share one run."""
    return kpath.loop_verdicts(*_graph(spark, d), LOOPS)


@query(
    "kpath_loop_totals",
    " UNION ALL ".join(f"SELECT * FROM ({_totals(seed=c.seed, poly=c.field.poly)} SELECT CAST({n} AS INTEGER) AS loop, id, total FROM totals)" for n, c in enumerate(kpath.seeds(LOOPS))),
)
def kpath_loop_totals(spark, d):
    """The totals of all ten loops."""
    v, e = _graph(spark, d)
    return kpath.loop_totals(v, kpath.prepared(e, LOOPS), kpath.seeds(LOOPS)).withColumnRenamed("l", "loop")


@query("verdict_line", TOTALS + f"SELECT 'Graph ' || CASE WHEN count(*) > 0 THEN 'contains' ELSE 'does not contain' END || ' a {K}-path.' AS line FROM totals")
def verdict_line(spark, d):
    found = kpath_verdict(spark, d)
    line = F.when(F.col("found"), F.lit(kpath.report(True, K))).otherwise(F.lit(kpath.report(False, K)))
    return spark.read.text(_file(spark, "verdict", found.select(line))).select(F.col("value").alias("line"))


@query("kpath_verdict", TOTALS + f"SELECT {K} AS k, count(*) > 0 AS found FROM totals")
def kpath_verdict(spark, d):
    return kpath.verdict(kpath.totals(*_graph(spark, d), CFG), K)


@query(
    "exact_kpath_count",
    f"WITH {GEO} SELECT 4 AS k, count(*) AS paths FROM e a JOIN e b ON b.src = a.dst AND b.dst <> a.src JOIN e c ON c.src = b.dst AND c.dst NOT IN (a.src, a.dst, b.dst) WHERE a.src <> a.dst",
)
def exact_kpath_count(spark, d):
    v, e = _graph(spark, d)
    return kpath.path_count(e, v, 4).select(F.lit(4).alias("k"), "paths")
