import random
import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trailweave.operators import layout
from trailweave.sources import binary, graphs, shared


def test_ntile_without_a_single_task(spark):
    for n, parts in ((10, 3), (7, 9), (1000, 7)):
        v = spark.range(n).select((F.col("id") * 3).alias("id"))
        got = [r["part"] for r in layout.block_partition(v, parts).orderBy("id").collect()]
        small, more = divmod(n, parts)
        assert got == [p for p in range(parts) for _ in range(small + (p < more))]


def test_threads_inside_parts(spark):
    rows = layout.thread_partition(spark.range(23).toDF("id"), 4, 3).orderBy("id").collect()
    for part in range(4):
        own = [r["thread"] for r in rows if r["part"] == part]
        small, more = divmod(len(own), 3)
        assert own == [t for t in range(3) for _ in range(small + (t < more))]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 1.5 1  2\n1 2 0\n2 0.1\n\n")
    rows = {r["id"]: (r["weight"], r["nbrs"]) for r in graphs.read_adjacency(spark, str(tmp_path / "a.txt")).collect()}
    assert rows == {0: (1.5, [1, 2]), 1: (2.0, [0]), 2: (0.10000000149011612, [])}
    (tmp_path / "e.txt").write_text("3\n2\n0 1\n1 2\n")
    assert sorted(map(tuple, graphs.read_edge_list(spark, str(tmp_path / "e.txt")).collect())) == [(0, 1), (1, 2)]
    (tmp_path / "b.bin").write_bytes(b"".join(x.to_bytes(4, "big") for x in (1, 70000, 3, 4)) + b"rest")
    assert [r["value"] for r in graphs.read_binary_header(spark, str(tmp_path / "b.bin"), 2).orderBy("i").collect()] == [1, 70000, 3, 4]


def test_message_matrix_sink(spark, tmp_path):
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (2, 2)], "src long, dst long")
    parts = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "id long, part int")
    owned = layout.edge_owner(e, parts)
    m = layout.message_counts(owned, 2)
    assert sorted(map(tuple, m.collect())) == [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 1)]
    graphs.write_message_matrix(m, 2, str(tmp_path / "m"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()] == ["0 1", "1 1"]
    assert {(r["src_part"], r["list_size"], r["buffer_size"]) for r in layout.routing_size(owned).collect()} == {(0, 5, 7), (1, 6, 7)}
    assert layout.joined_text(spark.createDataFrame([(1, "b"), (0, "a")], "r int, t string"), "r", "t").first()[0] == "ab"


def test_ranks_within_keys(spark):
    rows = [(k, k * 7 + i * 3) for k in range(5) for i in range(k * 40 + 1)]
    got = layout.ranked_within(spark.createDataFrame(rows, "k int, v long"), ["k"], "v", "p").collect()
    assert sorted((r["k"], r["p"], r["v"]) for r in got) == [(k, i, k * 7 + i * 3) for k in range(5) for i in range(k * 40 + 1)]


def test_hub_join(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(3000)] + [(9999, -1), (None, -2)], "key long, i long")
    table = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("x"))
    assert [r["key"] for r in layout.hubs(rows, "key").collect()] == [0]
    for how, extra in (("inner", []), ("left", [(9999, -1, None), (None, -2, None)])):
        got = sorted(map(tuple, layout.hub_join(rows, "key", table, how=how).collect()), key=str)
        assert got == sorted([(0 if i % 3 else i, i, 0 if i % 3 else 2 * i) for i in range(3000)] + extra, key=str)


def test_gathered_and_shared(spark):
    rows = spark.createDataFrame([(2, "c"), (0, "a")], "rank int, v string")
    assert graphs.gathered(rows, "rank", "v", 3).first()["v"] == ["a", None, "c"]
    back = shared.written(rows, "test")
    assert sorted(back.collect()) == sorted(rows.collect()) and shared.shared_dir(spark)
    d = graphs.adjacency_of(spark.createDataFrame([(0, i) for i in range(40)], "src long, dst long"))
    assert d.first()["nbrs"] == list(range(40))


def test_scratch_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda s: str(tmp_path))
    own = f"{tmp_path}/trailweave/{spark.sparkContext.applicationId}"
    with shared.scratch(spark):
        rows = shared.written(spark.range(5).toDF("id"), "a")
        with shared.scratch(spark):
            inner = shared.bucketed(rows.withColumn("k", F.lit(1)), ["id"], 2, "b")
            assert inner.count() == 5 and len(shared.children(spark, own)) == 2
        assert len(shared.children(spark, own)) == 1 and rows.count() == 5
    assert shared.children(spark, own) == [] and not [t for t in spark.catalog.listTables() if t.name.startswith("trailweave_")]


def test_shutdown_deletes_tables(tmp_path):
    """Also after ``stop``, which ends what could delete them before the JVM does."""
    code = f"""
from pyspark.sql import SparkSession
from trailweave.sources import shared
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
shared.written(spark.range(3).toDF("id"), "x")
assert len(shared.children(spark, shared.folder(spark))) == 1
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent, capture_output=True, timeout=120)
    for _ in range(50):
        if not list((tmp_path / "trailweave").iterdir()):
            break
        time.sleep(0.2)
    assert not list((tmp_path / "trailweave").iterdir())


def test_lines_in_the_order_of_files(spark, tmp_path):
    rng, want = random.Random(4), []
    for name in ("b.txt", "a.txt", "c.txt"):
        lines = [rng.choice(["", "   ", f"{rng.randrange(10**6)} 1.0 " + "7 " * rng.randrange(40)]) for _ in range(700)]
        (tmp_path / name).write_text("\n".join(lines) + rng.choice(["", "\n"]))
        want += [(name, k, x) for k, x in enumerate(lines) if x.strip()]
    want.sort(key=lambda x: x[:2])
    for split in ("500", "3000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = graphs.read_lines(spark, str(tmp_path))
            assert split == "128m" or got.rdd.getNumPartitions() > 3
            rows = sorted((r["ordinal"], r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in got.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert rows == [(n, *x) for n, x in enumerate(want)]
    (tmp_path / "a.txt").write_text("9 1.0 2\n\n3 1.0\n7 1.0\n")
    first = graphs.limit_vertices(graphs.read_adjacency(spark, str(tmp_path / "a.txt"), ordinals=True), 2)
    assert sorted(r["id"] for r in first.collect()) == [3, 9]
    assert sorted(r["id"] for r in graphs.limit_vertices(first.drop("ordinal"), 1).collect()) == [3]


def test_lines_without_a_vertex(spark, tmp_path):
    (tmp_path / "g.txt").write_text("5 1.0 1\nx 1.0 2\n-1 1.0\n6\n7\t1.0\n8 heavy\n8 nan\n9 1.0 2 y\n\n10 1.0 -2\n5 2.0\n1 0.5\n5 3.0\n99999999999999999999 1.0\n")
    good, bad = graphs.sorted_out(graphs.read_lines(spark, str(tmp_path / "g.txt")))
    assert sorted((r["id"], r["weight"], r["nbrs"]) for r in good.collect()) == [(1, 0.5, []), (5, 1.0, [1])]
    assert sorted((r["line"], r["reason"]) for r in bad.collect()) == [
        (1, "label"), (2, "label"), (3, "no weight"), (4, "tab"), (5, "weight"), (6, "weight"), (7, "neighbour"), (9, "neighbour"), (10, "label again"), (12, "label again"), (13, "label"),
    ]
    assert all(r["file"].endswith("g.txt") and r["value"] for r in bad.collect())


def test_partition_methods(spark, monkeypatch):
    rng = random.Random(6)
    pairs = list({(min(rng.randrange(400), rng.randrange(400)), rng.randrange(500)) for _ in range(5000)})
    edges, vertices = spark.createDataFrame(pairs, "src long, dst long"), spark.range(500).toDF("id")
    degree = Counter(a for a, _ in pairs)
    for parts in (1, 7, 60):
        got = {r["id"]: r["part"] for r in layout.partition(vertices, parts, "degree", edges).collect()}
        assert sorted(got) == list(range(500)) and [got[i] for i in range(500)] == sorted(got.values()) and max(got.values()) < parts
        load = Counter()
        for i, p in got.items():
            load[p] += degree[i]
        assert all(abs(n - len(pairs) / parts) <= max(degree.values()) for n in load.values())
    assert {r["part"] for r in layout.partition(vertices, 7, "degree", edges.limit(0)).collect()} == {0}
    assert {r["part"] for r in layout.partition(vertices, 7, "hash").collect()} == set(range(7))
    with pytest.raises(ValueError):
        layout.partition(vertices, 7, "other")
    parts = layout.partition(vertices, 7, "count")
    small = sorted(layout.edge_owner(edges, parts).collect())
    monkeypatch.setattr(layout, "SMALL", 3)  # as for a table that is too large to send to every task
    assert sorted(layout.edge_owner(edges, parts).collect()) == small and len(small) == len(pairs)


def test_matrix_of_many_parts(spark, tmp_path, monkeypatch):
    parts, rng = 1500, random.Random(2)
    cells = {(rng.randrange(parts), rng.randrange(parts)): rng.randrange(1, 99) for _ in range(4000)} | {(0, 0): 5, (7, parts - 1): 6}
    monkeypatch.setattr(graphs, "CELLS", 500_000)
    graphs.write_message_matrix(spark.createDataFrame([(*k, n) for k, n in cells.items()], "src_part int, dst_part int, msg_count long"), parts, str(tmp_path / "m"))
    files = sorted((tmp_path / "m").glob("part-*"))
    lines = [x for f in files for x in f.read_text().splitlines()]
    assert len(files) > 2 and lines == [" ".join(str(cells.get((a, b), 0)) for b in range(parts)) for a in range(parts)]


def test_binary_files(spark, tmp_path):
    values = [random.Random(1).randrange(1 << 32) for _ in range(5000)] + [0, (1 << 32) - 1]
    binary.write_ints(spark.createDataFrame([(v,) for v in values], "value long").coalesce(3), str(tmp_path / "w"))
    assert not list((tmp_path / "w").glob("_*"))
    got = binary.read_ints(spark, str(tmp_path / "w"), split=1000)
    assert got.rdd.getNumPartitions() > 15
    assert [r["value"] for r in got.orderBy("i").collect()] == values and sorted(r["i"] for r in got.collect()) == list(range(len(values)))
    assert binary.read_ints(spark, str(tmp_path / "w"), 3).orderBy("i").collect() == got.orderBy("i").limit(3).collect()
    with open(tmp_path / "large", "wb") as f:  # 3 GB that take no room
        f.seek(3 * 10**9 - 4)
        f.write((77).to_bytes(4, "big"))
    reader = binary.IntsReader(str(tmp_path / "large"), None, binary.SPLIT)
    ranges = reader.partitions()
    assert len(ranges) > 20 and [r.value[1] for r in ranges[1:]] == [r.value[2] for r in ranges[:-1]]
    last = list(reader.read(ranges[-1]))[-1]
    assert last.column("i")[-1].as_py() == 750_000_000 - 1 and last.column("value")[-1].as_py() == 77
    assert binary.read_ints(spark, str(tmp_path / "large"), 750_000_000 - 5).filter("value <> 0").count() == 0
    (tmp_path / "torn").write_bytes(b"12345")
    assert graphs.read_binary_header(spark, str(tmp_path / "torn"), 0).count() == 0
    for count in (None, 2):
        with pytest.raises(ValueError):
            binary.IntsReader(str(tmp_path / "torn"), count, 8).partitions()
    (tmp_path / "none").mkdir()
    assert binary.read_ints(spark, str(tmp_path / "none")).count() == 0
