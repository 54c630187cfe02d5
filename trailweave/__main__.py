"""``python -m trailweave GRAPH --k K --out FOLDER``: read, check, detect, report, write.

The graph is an adjacency text file (or an edge list). FOLDER gets ``verdict`` (one line of
text) and, with ``--parts``, ``messages`` (the matrix of message counts). With
``--instance I --instances N`` only the I-th slice of the masks is worked on and FOLDER gets
its ``totals``; ``--merge FOLDER ...`` joins the totals of all slices and gives the verdict.
With ``--ledger FOLDER`` finished work is kept there, and a run that broke off goes on.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators import kpath, layout
from trailweave.sources import graphs
from trailweave.sources.shared import scratch


def options(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="trailweave", description="Does a graph have a simple path on k vertices?")
    p.add_argument("graph")
    p.add_argument("--k", type=int, required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--format", choices=("adjacency", "edges"), default="adjacency")
    p.add_argument("--epsilon", type=float, default=0.1)
    p.add_argument("--seed", type=int, default=11)
    p.add_argument("--max-loops", type=int)
    p.add_argument("--vertices", type=int, help="read the first so many vertices")
    p.add_argument("--parts", type=int, default=0)
    p.add_argument("--method", choices=("count", "degree", "hash"), default="count", help="how vertices are dealt to parts")
    p.add_argument("--strict", action="store_true", help="end if a line holds no vertex; else such lines are written to OUT/rejected")
    p.add_argument("--instance", type=int, default=0)
    p.add_argument("--instances", type=int, default=1)
    p.add_argument("--merge", nargs="+", default=[], help="folders of all slices")
    p.add_argument("--ledger", help="folder of finished work, from which a run that broke off goes on")
    got = p.parse_args(args)
    if not 0 <= got.instance < got.instances:
        p.error("--instance must be from 0 to below --instances")
    return got


def load(spark: SparkSession, o: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the graph. Vertices of an adjacency file have their place in it as
    ``ordinal``; lines that hold none are counted, and written or (``--strict``) an error."""
    if o.format == "edges":
        edges = graphs.read_edge_list(spark, o.graph).distinct()
        return graphs.vertices_of(edges), edges
    adjacency, rejected = graphs.sorted_out(graphs.read_lines(spark, o.graph))
    counts = {r["reason"]: r["count"] for r in rejected.groupBy("reason").count().collect()}
    if counts:
        said = ", ".join(f"{n} {reason}" for reason, n in sorted(counts.items()))
        if o.strict:
            raise ValueError(f"lines without a vertex: {said}")
        print(f"Lines without a vertex: {said}.")
        rejected.write.json(f"{o.out}/rejected")
    if o.vertices is not None:
        adjacency = graphs.limit_vertices(adjacency, o.vertices)
        edges = graphs.edges_of(adjacency)
        return adjacency.select("id", "weight", "ordinal"), edges.join(adjacency.select(F.col("id").alias("dst")), "dst", "left_semi")
    return adjacency.select("id", "weight", "ordinal"), graphs.edges_of(adjacency)


def run(spark: SparkSession, o: argparse.Namespace) -> str | None:
    """The verdict line, or None for one slice."""
    cfg = kpath.KPathConfig(o.k, o.epsilon, o.seed, max_loops=o.max_loops)
    vertices, edges = load(spark, o)
    graphs.check(vertices, edges)
    if o.parts:
        # Blocks follow the file, if no line was left out of it.
        dense = o.method == "count" and "ordinal" in vertices.columns and vertices.agg(F.max("ordinal")).first()[0] == vertices.count() - 1
        owned = layout.edge_owner(edges, layout.partition(vertices, o.parts, o.method, edges, "ordinal" if dense else None))
        graphs.write_message_matrix(layout.message_counts(owned, o.parts, dense=False), o.parts, f"{o.out}/messages")
    if o.merge:
        parts = [spark.read.parquet(f"{f}/totals") for f in o.merge]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        left = whole.groupBy("loop", "id").agg(F.bit_xor("total").alias("total"))
        found = bool(kpath.verdict(left, o.k).first()["found"])
    elif o.instances > 1:
        _, low, high = kpath.iteration_slices(o.k, o.instances)[o.instance]
        rows = kpath.loop_totals(vertices, kpath.prepared(edges, cfg), kpath.seeds(cfg), low, high, o.ledger)
        rows.select(F.col("l").alias("loop"), "id", "total").write.parquet(f"{o.out}/totals")
        return None
    else:
        found = kpath.detect(vertices, edges, cfg, o.ledger)
    line = kpath.report(found, o.k)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{o.out}/verdict")
    return line


def main() -> None:
    o = options()
    spark = SparkSession.builder.appName("trailweave").getOrCreate()
    with scratch(spark):
        line = run(spark, o)
    if line:
        print(line)
    spark.stop()


if __name__ == "__main__":
    main()
