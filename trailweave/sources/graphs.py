"""Graphs as two DataFrames: vertices (id, weight) and directed edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.operators import layout
from trailweave.sources import binary
from trailweave.sources.shared import written


def parse_adjacency(lines: DataFrame, value: str = "value", checked: bool = False) -> DataFrame:
    """Adjacency lines ``label weight nbr nbr ...`` -> id, weight, nbrs; extra columns stay.

    Tokens are divided by runs of blanks (tabs do not divide). The weight has float
    precision. Blank lines are skipped. A token that is no number is an error, unless the lines
    are ``checked``: then none is left, and a filter may run before the check without one.
    """

    def number(c: Column, kind: str) -> Column:
        return c.try_cast(kind) if checked else c.cast(kind)

    line = F.trim(F.col(value))
    t = F.split(line, " +")
    others = [c for c in lines.columns if c != value]
    return lines.filter(F.length(line) > 0).select(
        *others,
        number(t[0], "long").alias("id"),
        number(F.get(t, F.lit(1)) if checked else t[1], "float").cast("double").alias("weight"),
        F.transform(F.slice(t, 3, F.greatest(F.size(t) - 2, F.lit(0))), lambda x: number(x, "long")).alias("nbrs"),
    )


#: Splits of files whose first line numbers may be sent to every task.
SPLITS = 200_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files that are not blank, in the order of files and lines: value, file,
    line (0-based in its file, blank ones counted) and ordinal (0-based over all files, blank
    ones left out).

    Files are read in splits. A first pass counts the lines of each; the sums of the splits
    before (a row for each split) shift the numbers that lines have in their own.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_m"))
    solid = F.length(F.trim("value")) > 0
    splits = raw.groupBy("file", "_s").agg(F.min("_m").alias("_first"), F.count("*").alias("_lines"), F.count_if(solid).alias("_records"))
    before = (Window.unboundedPreceding, -1)

    def sum_before(col: str, window) -> Column:
        return F.coalesce(F.sum(col).over(window.rowsBetween(*before)), F.lit(0))

    task = F.shiftright("_first", 33)  # a task numbers the lines of its splits on
    splits = splits.select(
        "file", "_s", "_first",
        sum_before("_lines", Window.partitionBy("file").orderBy("_s")).alias("_line"),
        sum_before("_records", Window.orderBy("file", "_s")).alias("_ordinal"),
        (F.shiftleft(task, 33) + sum_before("_records", Window.partitionBy(task).orderBy("_first"))).alias("_base"),
    )
    splits = written(splits, "splits")
    if splits.count() <= SPLITS:
        splits = F.broadcast(splits)
    rows = raw.filter(solid).withColumn("_n", F.monotonically_increasing_id()).join(splits, ["file", "_s"])
    return rows.select("value", "file", (F.col("_m") - F.col("_first") + F.col("_line")).alias("line"), (F.col("_n") - F.col("_base") + F.col("_ordinal")).alias("ordinal"))


def read_adjacency(spark: SparkSession, path: str, ordinals: bool = False) -> DataFrame:
    """An adjacency text file, read in splits; with ``ordinals`` also file, line and ordinal."""
    return parse_adjacency(read_lines(spark, path) if ordinals else spark.read.text(path))


def sorted_out(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of ``read_lines`` as (good, bad): the adjacency of those that hold a vertex, with
    ordinals from 0 on as before, and file, line, value, reason of the others.

    Reasons: "tab" (only blanks divide), "label" (not a number from 0 on), "no weight",
    "weight" (not a number), "neighbour" (not a number from 0 on), "label again" (a line before
    has that label; the first one counts).
    """
    t = F.split(F.trim("value"), " +")
    label, weight = F.expr("try_cast(_t[0] AS BIGINT)"), F.expr("try_cast(get(_t, 1) AS FLOAT)")
    wrong = F.exists(F.expr("slice(_t, 3, greatest(size(_t) - 2, 0))"), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(-1)) < 0)
    rows = lines.withColumn("_t", t).withColumn(
        "reason",
        F.when(F.col("value").contains("\t"), "tab").when(F.coalesce(label, F.lit(-1)) < 0, "label").when(F.size("_t") < 2, "no weight").when(weight.isNull() | F.isnan(weight), "weight").when(wrong, "neighbour"),
    )
    rows = written(rows.withColumn("_id", F.when(F.col("reason").isNull(), label)).drop("_t"), "lines")
    again = rows.filter("_id IS NOT NULL").groupBy("_id").agg(F.min("ordinal").alias("_o"), F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    # A label on many lines is joined by broadcast, and lines that have none are not joined.
    labelled = layout.hub_join(rows.filter("_id IS NOT NULL"), "_id", again, how="left")
    labelled = labelled.withColumn("reason", F.when(F.col("ordinal") > F.col("_o"), F.lit("label again"))).drop("_o")
    rows = labelled.unionByName(rows.filter("_id IS NULL")).drop("_id")
    good = parse_adjacency(rows.filter("reason IS NULL").drop("reason"), checked=True)
    return good, rows.filter("reason IS NOT NULL").select("file", "line", "value", "reason")


def parse_edge_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """Edge-list lines ``src dst``. The lines before them hold one number each, of vertices
    and of edges; with blank lines they are left out, so splits of a file need no order."""
    t = F.split(F.trim(F.col(value)), " +")
    return lines.filter(F.size(t) == 2).select(t[0].cast("long").alias("src"), t[1].cast("long").alias("dst"))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """An edge-list text file, read in splits."""
    return parse_edge_list(spark.read.text(path))


def big_endian_int(raw: Column, index: Column | int) -> Column:
    """The index-th big-endian unsigned 32-bit integer of a binary column."""
    i = index if isinstance(index, Column) else F.lit(index)
    return F.conv(F.hex(F.substring(raw, i * 4 + 1, F.lit(4))), 16, 10).cast("long")


def read_binary_header(spark: SparkSession, path: str, vertices: int) -> DataFrame:
    """(i, value) of the 2 * vertices integers at the start of a binary graph file."""
    return binary.read_ints(spark, path, 2 * vertices)


def edges_of(adjacency: DataFrame) -> DataFrame:
    """Distinct directed edges; parallel ones fall together, self-loops stay."""
    return adjacency.select(F.col("id").alias("src"), F.explode("nbrs").alias("dst")).distinct()


def check(vertices: DataFrame, edges: DataFrame) -> None:
    """Raise ValueError for duplicate or negative ids and for edges to unknown vertices."""
    if not vertices.filter("id IS NULL OR id < 0").isEmpty():
        raise ValueError("vertex ids must be 0 or more")
    if not vertices.groupBy("id").count().filter("count > 1").isEmpty():
        raise ValueError("a vertex id comes twice")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()  # so no task gets all edges of a vertex
    if not ends.join(vertices, "id", "left_anti").isEmpty():
        raise ValueError("an edge ends at a vertex that does not exist")


def limit_vertices(adjacency: DataFrame, count: int, order: str = "id") -> DataFrame:
    """The first ``count`` vertices: by their place in the file, if they have an ``ordinal``, else
    by ``order``. Rows are chosen by position, so no task takes them all."""
    if "ordinal" in adjacency.columns:
        return adjacency.filter(F.col("ordinal") < count)
    return layout.ranked(adjacency, order, "_p").filter(F.col("_p") < count).drop("_p")


#: Vertex kinds of the geo graph; an id is 4 * key + kind, so kinds never meet.
REGION, NATION, CUSTOMER, SUPPLIER = range(4)


def geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region - nation - customer and supplier, both directions, distinct."""

    def pairs(name: str, a: str, a_kind: int, b: str, b_kind: int) -> DataFrame:
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return t.select((F.col(a).cast("long") * 4 + a_kind).alias("src"), (F.col(b).cast("long") * 4 + b_kind).alias("dst"))

    one = (
        pairs("nation", "n_regionkey", REGION, "n_nationkey", NATION)
        .unionByName(pairs("customer", "c_nationkey", NATION, "c_custkey", CUSTOMER))
        .unionByName(pairs("supplier", "s_nationkey", NATION, "s_suppkey", SUPPLIER))
    )
    both = one.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"))
    return both.select("e.src", "e.dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def vertices_of(edges: DataFrame) -> DataFrame:
    """Distinct ends of the edges, with a weight of 1."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("weight", F.lit(1.0))


def adjacency_of(edges: DataFrame) -> DataFrame:
    """id, weight, nbrs (ascending) from edges; the weight is (id mod 7) + 0.5. A row holds all
    neighbours of its vertex, as the adjacency format does; edges themselves know no such rows."""
    rows = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("nbrs"))
    return rows.select("id", (F.col("id") % 7 + 0.5).cast("float").cast("double").alias("weight"), "nbrs")


def render_adjacency(adjacency: DataFrame) -> DataFrame:
    """The lines that ``parse_adjacency`` reads."""
    return adjacency.select(F.concat_ws(" ", F.col("id").cast("string"), F.col("weight").cast("string"), F.array_join(F.transform("nbrs", lambda x: x.cast("string")), "  ")).alias("value"))


#: Numbers in a file of the message matrix, about.
CELLS = 4_000_000


def write_message_matrix(matrix: DataFrame, parts: int, path: str) -> None:
    """Square text of message counts: a line for each source part, blanks between. Pairs of
    parts without a row have no messages. Files follow in the order of their names.

    A line is put together from the numbers that are not zero and the runs of zeros between.
    """
    cells = matrix.filter("msg_count <> 0").groupBy("src_part", "dst_part").agg(F.sum("msg_count").alias("n"))
    rows = cells.groupBy("src_part").agg(F.sort_array(F.collect_list(F.struct("dst_part", "n"))).alias("c"))
    rows = matrix.sparkSession.range(parts).select(F.col("id").cast("int").alias("src_part")).join(rows, "src_part", "left").withColumn("c", F.coalesce("c", F.expr("CAST(array() AS ARRAY<STRUCT<dst_part: INT, n: BIGINT>>)")))
    filled = "array_join(transform(c, (x, i) -> repeat('0 ', x.dst_part - coalesce(get(c, i - 1).dst_part + 1, 0)) || x.n || ' '), '')"
    line = F.expr(f"rtrim({filled} || repeat('0 ', {parts} - coalesce(get(c, size(c) - 1).dst_part + 1, 0)))")
    files = max(1, parts * parts // CELLS)
    rows.repartitionByRange(files, "src_part").sortWithinPartitions("src_part").select(line.alias("value")).write.text(path)


def gathered(rows: DataFrame, rank: str, value: str, ranks: int) -> DataFrame:
    """One row with the values of all ranks as an array in rank order; a rank without a row
    gives null. The array holds ``ranks`` entries whatever the data."""
    at = F.map_from_entries(F.collect_list(F.struct(rank, value)))
    return rows.groupBy(rank).agg(F.max(value).alias(value)).agg(at.alias("_m")).select(F.transform(F.sequence(F.lit(0), F.lit(ranks - 1)), lambda r: F.try_element_at("_m", r)).alias(value))
