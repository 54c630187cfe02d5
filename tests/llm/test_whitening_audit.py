"""Whitening and the filter audit against plain versions."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.llm import filter_audit, whitening
from trailweave.llm.common import importable

# 12 -----------------------------------------------------------------------------------


def _vectors(n, d, seed=0):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ r.normal(size=(d, d)) * 0.3).astype(np.float32).tolist()


def _plain(vectors, count):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return deviation, (centred @ u / np.sqrt(e))[:, :count], e / e.sum()


@pytest.mark.parametrize(("d", "pairs"), [(5, 2080), (40, 300)])
def test_whitened_against_numpy(spark, monkeypatch, d, pairs):
    importable(spark)
    monkeypatch.setattr(whitening, "PAIRS", pairs)
    vectors = _vectors(150, d, d)
    vectors += [vectors[0]]  # a repeated row
    odd = [(None, None), (900, [None] * d), (901, [float("nan")] * d), (902, [float("-inf")] + [0.0] * (d - 1)), (903, []), (904, [0.5] * (d + 1)), (905, [0.5] * (d - 1))]
    rows = [(i % 150, v, i, "x") for i, v in enumerate(vectors)] + [(i, v, 0, "x") for i, v in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, x0 string").repartition(3)
    got = whitening.whitened(df).collect()
    deviation, white, explained = _plain(vectors, 32)
    k = min(d, 32)
    assert len(got) == 151 * k and {g["n"] for g in got} == {151} and {g["component"] for g in got} == set(range(1, k + 1))
    assert sorted((r["vec_id"], r["n"], r["deviation"]) for r in whitening.deviations(df).collect()) == sorted((i % 150, 151, x) for i, x in enumerate(deviation))
    signs = {}
    for g in got:
        i, c = g["vec_id"], g["component"] - 1
        want = white[i, c]
        assert g["deviation"] == deviation[i]
        assert abs(abs(g["whitened"]) - abs(want)) < 1e-7
        if abs(want) > 1e-6:
            assert signs.setdefault(c, g["whitened"] * want > 0) == (g["whitened"] * want > 0)
        assert abs(g["explained"] / explained[c] - 1) < 1e-9 and 0 <= g["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    flat = [(i, [1.0, 2.0, 0.25 * i]) for i in range(6)]
    got = whitening.whitened(spark.createDataFrame(flat, schema)).collect()
    assert len(got) == 6 and {g["component"] for g in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, []), (2, [])], [(i, [1.0, 2.0]) for i in range(4)]):
        assert len(whitening.deviations(spark.createDataFrame(rows, schema)).collect()) == sum(v is not None for _, v in rows)
        none = whitening.whitened(spark.createDataFrame(rows, schema))
        assert none.collect() == [] and none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


# 13 -----------------------------------------------------------------------------------


def _plain_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, toxic = ({i for i, *x in labels if x[c] == 1 and i is not None} for c in (0, 1))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and any((t or "") == text and j is not None and j < i for j, t, _ in docs) else set()
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                gone = sum(f in r[1] for r in rows if r[0] == part) - len(removed)
                left = [r for r in left if f not in r[1]]
                unique = sum(r[1] == {f} for r in rows if r[0] == part)
                out[part, "".join(order), step] = [len(left), len(removed), gone, unique, sum(r[2] for r in removed), sum(r[3] for r in removed)]
                shapley[f] += len(removed)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit_against_plain(spark):
    importable(spark)
    r = np.random.default_rng(5)
    words = ["".join(r.choice(list("abcdefghé"), 4)) for _ in range(400)]
    docs = []
    for i in range(60):
        w = [str(x) for x in r.choice(words if i % 3 else words[:60], 150 + 3 * i)]
        if i % 4 == 0:
            w = [x.upper() if k % 9 == 0 else x for k, x in enumerate(w)]
        if i % 5 == 0:
            w[7] += "#$%&*|"[i % 6]
        docs.append((i, "  ".join(w[:3]) + "\x0b" + " ".join(w[3:]), [None, "en", "fr", ""][i % 4]))
    docs += [(70 + i, docs[i % 7][1], "en") for i in range(40)]  # copies, some of them hot
    docs += [(200, None, "de"), (201, "", "de"), (201, "", "de"), (None, docs[1][1], "en"), (None, None, None), (15, docs[2][1], "fr"), (300, " ".join(words) * 30, "xx")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 90, 2)] + [(4, 0, 1), (4, None, None), (None, 1, 1)]
    d = spark.createDataFrame([(*x, "a", 7) for x in docs], "doc_id long, text string, lang string, part string, fails int").repartition(3)
    rows = filter_audit.facts(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = filter_audit.audit(rows).collect()
    want = _plain_audit(docs, labels)
    assert len(got) == len(want) == 600 * 5
    for g in got:
        assert [g[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] == want[g["part"], g["filter_order"], g["step"]]
    assert filter_audit.audit(filter_audit.facts(d.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect() == []


def test_audit_shares_states(spark):
    rows = spark.range(64).select(F.lit("p").alias("part"), (F.col("id") % 32).cast("int").alias("fails"), (F.col("id") % 2 == 0).alias("good"), F.lit(False).alias("toxic"))
    edges = filter_audit.walked(rows).collect()
    assert len(edges) == 80 and len({e["state"] for e in edges}) == 31  # every edge once, and each state but the last
    assert all(e["total"] == 64 >> bin(e["state"]).count("1") and e["removed"] * 2 == e["total"] for e in edges)


def test_long_texts_in_pieces():
    text = " ".join(f"w{i % 700}" for i in range(5000)) + " x" + "y" * 3000
    raw = text.encode()
    for size in (1, 7, 1000, 10**9):
        parts = list(filter_audit.pieces(raw, size))
        assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split()
