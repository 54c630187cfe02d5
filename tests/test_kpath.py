import random

import pytest
from pyspark.sql import functions as F

from trailweave import __main__ as command
from trailweave.functions.polynomials import is_primitive
from trailweave.operators import kpath
from trailweave.sources import graphs

#: The small public sample graph (label, weight, neighbours), with the blanks
#: and the line order that the parser must bear.
SMALL = ["0 4.0 1 2 3 6", "1 3.0 0 2 3", "3 2.0 0 1 4", "2 1.0 0 1 4 5", "4 1.0 2 3 5 6", "5 4.0 2 4 6", "6 3.0  0 4 5 "]


def graph(spark, edges, both=True, isolated=()):
    e = spark.createDataFrame([(a, b) for a, b in edges] + ([(b, a) for a, b in edges] if both else []), "src long, dst long").distinct()
    v = graphs.vertices_of(e).select("id").union(spark.createDataFrame([(i,) for i in isolated], "id long")).distinct()
    return v, e


@pytest.fixture(scope="module")
def small(spark):
    a = graphs.parse_adjacency(spark.createDataFrame([(x,) for x in SMALL], "value string"))
    return a.select("id", "weight"), graphs.edges_of(a)


def test_small_graph_counts(small):
    v, e = small
    graphs.check(v, e)
    assert e.count() == 24
    for k, n in ((1, 7), (2, 24), (3, 60), (4, 124), (5, 210)):
        assert kpath.exact_paths(e, v, k).count() == n


def test_path_count(spark):
    """As listed, on directed graphs with triangles, edges in one or both ways, loops and edges listed twice."""
    r = random.Random(5)
    for n, m in ((6, 14), (12, 60), (9, 70), (5, 0)):
        found = {(r.randrange(n), r.randrange(n)) for _ in range(m)}
        v, e = graph(spark, sorted(found), both=False, isolated=range(n)) if m else (spark.range(n), spark.createDataFrame([], "src long, dst long"))
        for k in range(1, 6):
            want = kpath.exact_paths(e, v, k).count()
            assert [tuple(x) for x in kpath.path_count(e, v, k).collect()] == [(want,)]
            assert k > 4 or kpath.path_count(e.unionByName(e.limit(3)), v, k).first()["paths"] == want


def test_path_count_lists_no_paths_over_a_hub(spark):
    """A hub with 300,000 leaves and a tail of two: 9e10 paths on three vertices go over the hub."""
    n = 300_000
    one = spark.range(n).selectExpr("-1L AS src", "id AS dst").unionByName(spark.createDataFrame([(-1, -2), (-2, -3)], "src long, dst long"))
    e = one.unionByName(one.selectExpr("dst AS src", "src AS dst"))
    v = graphs.vertices_of(e).select("id")
    assert kpath.path_count(e, v, 3).first()["paths"] == (n + 1) * n + 2
    assert kpath.path_count(e, v, 4).first()["paths"] == 2 * n


def test_plain_and_sliced_agree(small):
    v, e = small
    for k in (3, 5):
        cfg = kpath.KPathConfig(k, seed=3)
        assert sorted(kpath.plain_totals(v, e, cfg).collect()) == sorted(kpath.totals(v, e, cfg).collect())


def test_batches_of_masks_agree(small):
    v, e = small
    one, many, short = kpath.KPathConfig(8, seed=5), kpath.KPathConfig(8, seed=5, batch_rows=1), kpath.KPathConfig(8, seed=5, level_batch=2)
    want = sorted(kpath.totals(v, e, one).collect())
    assert sorted(kpath.totals(v, e, many).collect()) == want == sorted(kpath.totals(v, e, short).collect())


def test_slices_of_masks_join_to_the_whole(small):
    v, e = small
    for k, slices in ((3, 3), (7, 2)):
        cfg = kpath.KPathConfig(k, seed=4, batch_rows=1, level_batch=9)
        prepared, parts = kpath.prepared(e, cfg), []
        for _, low, high in kpath.iteration_slices(k, slices):
            parts.append(kpath.totals(v, prepared, cfg, low, high))
            assert sorted(parts[-1].collect()) == sorted(kpath.plain_totals(v, prepared, cfg, low, high).collect())
        assert sorted(kpath.merged(parts).collect()) == sorted(kpath.totals(v, prepared, cfg).collect())
        assert kpath.totals(v, prepared, cfg, 2, 2).collect() == []


def test_loops_share_a_run(small):
    v, e = small
    cfg = kpath.KPathConfig(5, seed=3, max_loops=3)
    cfgs, graph = kpath.seeds(cfg), kpath.prepared(e, cfg)
    assert len(cfgs) == 3 and all(is_primitive(c.poly) for c in cfgs)
    got = kpath.loop_totals(v, graph, cfgs).collect()
    assert sorted(map(tuple, got)) == sorted((n, r["id"], r["total"]) for n, c in enumerate(cfgs) for r in kpath.plain_totals(v, graph, c).collect())
    assert {(r["loop"], r["found"]) for r in kpath.loop_verdicts(v, graph, cfg).collect()} == {(n, any(g["l"] == n for g in got)) for n in range(3)}


def test_hubs_are_dealt_to_salts(spark, monkeypatch):
    monkeypatch.setattr(kpath, "HUB_EDGES", 3)
    v, e = graph(spark, [(0, i) for i in range(1, 12)] + [(i, i + 1) for i in range(1, 11)])
    cfg = kpath.KPathConfig(4, seed=2)
    g = kpath.prepared(e, cfg)
    assert g.hubs.collect() and g.edges.select("salt").distinct().count() > 1
    hubless = kpath.Graph(e, None, g.count, g.mark)
    assert sorted(kpath.totals(v, g, cfg).collect()) == sorted(kpath.plain_totals(v, g, cfg).collect()) == sorted(kpath.totals(v, hubless, cfg).collect())


def test_a_run_goes_on_from_its_ledger(small, tmp_path, monkeypatch):
    v, e = small
    cfg = kpath.KPathConfig(9, seed=7, batch_rows=1)
    graph_, path = kpath.prepared(e, cfg), str(tmp_path / "ledger")
    want = sorted(kpath.totals(v, graph_, kpath.KPathConfig(9, seed=7)).collect())
    counted, whole = [], kpath.sliced_totals

    def killed(vertices, graph, cfgs, low, high):
        if len(counted) == 5:
            raise KeyboardInterrupt
        counted.append((low, high))
        return whole(vertices, graph, cfgs, low, high)

    monkeypatch.setattr(kpath, "sliced_totals", killed)
    with pytest.raises(KeyboardInterrupt):
        kpath.totals(v, graph_, cfg, ledger=path)
    assert kpath.Ledger(v.sparkSession, path).left(0, 512) == [(320, 512)]
    (tmp_path / "ledger" / "320-384").mkdir()  # what a driver leaves that dies while it writes
    first = list(counted)
    counted.clear()
    monkeypatch.setattr(kpath, "sliced_totals", lambda *a: counted.append(a[3:]) or whole(*a))
    assert sorted(kpath.totals(v, graph_, cfg, ledger=path).collect()) == want
    assert len(first) == 5 and counted == [(320, 384), (384, 448), (448, 512)]
    with pytest.raises(ValueError):
        kpath.totals(v, graph_, kpath.KPathConfig(9, seed=8, batch_rows=1), ledger=path)


def test_ledger_folds_its_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kpath.Ledger, "FOLD", 3)
    book = kpath.Ledger(spark, str(tmp_path))
    rows = [[(0, 1, 5), (1, 2, 3)], [(0, 1, 5)], [(0, 1, 4)], [(1, 2, 3)], [(0, 9, 1)]]
    for n, some in enumerate(rows):
        book.add(64 * n, 64 * n + 64, spark.createDataFrame(some, "l int, id long, total long"))
    assert len(book.ranges()) < 3 and book.left(0, 400) == [(320, 400)] and book.left(-5, 10) == [(-5, 0)]
    assert sorted(map(tuple, book.totals().collect())) == [(0, 1, 4), (0, 9, 1)]
    assert len(list(tmp_path.iterdir())) == len(book.ranges())
    spark.createDataFrame([(0, 9, 7)], "l int, id long, total long").write.parquet(str(tmp_path / "64-128"))  # inside a folded range
    assert sorted(map(tuple, book.totals().collect())) == [(0, 1, 4), (0, 9, 1)]


def _nodes(plan):
    """(name, children) of a physical plan."""
    children = plan.children()
    return plan.nodeName(), plan.toString().split("\n")[0], [_nodes(children.apply(i)) for i in range(children.size())]


def _above_edges(node, exchanges=0):
    """The shuffles between each scan of the edges and the top of its level's join."""
    name, text, children = node
    if "Bucketed: true" in text:
        yield exchanges
    for c in children:
        yield from _above_edges(c, 0 if "Join" in name else exchanges + ("Exchange" in name and "Broadcast" not in name))


def test_edges_are_not_shuffled_and_plans_do_not_grow(spark, small):
    v, e = small
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cfg = kpath.KPathConfig(9, seed=3, batch_rows=10_000_000)
        g = kpath.prepared(e, cfg)
        salted = e.withColumn("salt", (F.col("dst") % 2).cast("int"))
        hubs = spark.createDataFrame([(0, 2), (4, 2)], "id long, slices int")
        for h in (kpath.Graph(kpath.bucketed(e, ["src"], 3, "test"), None, g.count, g.mark), kpath.Graph(kpath.bucketed(salted, ["src", "salt"], 3, "test"), hubs, g.count, g.mark)):
            plan = kpath._level(kpath._start(v, [cfg], 0, 512), h, [cfg], 2)._jdf.queryExecution().executedPlan()
            assert set(_above_edges(_nodes(plan))) == {0}, plan.toString()
        sizes = []
        for k in (9, 14):
            cfg = kpath.KPathConfig(k, seed=3, batch_rows=1 << 40)
            sizes.append(len(kpath.sliced_totals(v, g, [cfg], 0, 1 << k)._jdf.queryExecution().analyzed().toString()))
        assert sizes[1] < 1.7 * sizes[0]  # three levels in the last plan, not eight
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_command(spark, tmp_path):
    (tmp_path / "g.txt").write_text("\n".join(SMALL))
    base = [str(tmp_path / "g.txt"), "--k", "3", "--max-loops", "2", "--out"]
    line = command.run(spark, command.options([*base, str(tmp_path / "one"), "--parts", "2"]))
    assert line == "Graph contains a 3-path." == spark.read.text(str(tmp_path / "one/verdict")).first()[0]
    assert len(spark.read.text(str(tmp_path / "one/messages")).collect()) == 2
    for i in range(3):
        assert command.run(spark, command.options([*base, str(tmp_path / f"s{i}"), "--instance", str(i), "--instances", "3"])) is None
    merge = ["--merge", *[str(tmp_path / f"s{i}") for i in range(3)]]
    assert command.run(spark, command.options([*base, str(tmp_path / "all"), *merge])) == line
    (tmp_path / "bad.txt").write_text("0 1 5\n")
    (tmp_path / "odd.txt").write_text("\n".join([*SMALL, "x 1.0 2", "5 1.0", ""]))
    odd = [str(tmp_path / "odd.txt"), *base[1:], str(tmp_path / "odd"), "--parts", "3", "--method", "degree"]
    assert command.run(spark, command.options(odd)) == line
    assert sorted(r["reason"] for r in spark.read.json(str(tmp_path / "odd/rejected")).collect()) == ["label", "label again"]
    with pytest.raises(ValueError, match="1 label, 1 label again"):
        command.run(spark, command.options([*odd, "--strict"]))
    first = command.options([*base, str(tmp_path / "first"), "--vertices", "3"])
    assert [r["id"] for r in command.load(spark, first)[0].orderBy("ordinal").collect()] == [0, 1, 3]
    kept = command.options([*base, str(tmp_path / "kept"), "--ledger", str(tmp_path / "ledger")])
    assert command.run(spark, kept) == line and (tmp_path / "ledger/loops-0/0-8/_SUCCESS").exists()
    with pytest.raises(ValueError):
        command.run(spark, command.options([str(tmp_path / "bad.txt"), *base[1:], str(tmp_path / "bad")]))


def test_detects_and_never_errs(small):
    v, e = small
    assert kpath.detect(v, e, kpath.KPathConfig(3, epsilon=0.01))
    assert not kpath.detect(v, e, kpath.KPathConfig(8))


def test_no_false_positives_on_hard_graphs(spark):
    star = graph(spark, [(0, i) for i in range(1, 12)])
    loop = graph(spark, [(1, 0), (2, 0), (3, 0), (4, 0), (0, 0)], both=False)
    for seed in range(3):
        assert kpath.totals(*star, kpath.KPathConfig(8, seed=seed)).isEmpty()
        assert kpath.totals(*loop, kpath.KPathConfig(3, seed=seed)).isEmpty()


def test_trivial_bounds(spark):
    v, e = graph(spark, [(0, 0)], both=False, isolated=(5,))
    assert kpath.detect(v, e, kpath.KPathConfig(1))
    assert not kpath.detect(v, e, kpath.KPathConfig(2, max_loops=2))


def test_iteration_slices_are_exact():
    got = kpath.iteration_slices(6, 3)
    assert [x[1:] for x in got] == [(0, 21), (21, 42), (42, 64)]
    assert kpath.loop_count(0.1) == 10
    with pytest.raises(ValueError):
        kpath.KPathConfig(0)


def test_slice_mask_is_even_parity(spark):
    rows = spark.range(256).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("block"))
    for a, b, m in rows.select("a", "block", kpath.slice_mask(F.col("a"), F.col("block"), 8)).collect():
        assert m & (1 << 64) - 1 == sum(1 << t for t in range(64) if not bin(a & (b * 64 + t)).count("1") % 2)


def test_invalid_graphs(spark):
    v, e = graph(spark, [(0, 1)])
    for bad_v, bad_e in ((v.union(v), e), (v, e.union(spark.createDataFrame([(0, 9)], "src long, dst long"))), (v.union(spark.createDataFrame([(-1,)], "id long")), e)):
        with pytest.raises(ValueError):
            graphs.check(bad_v, bad_e)
