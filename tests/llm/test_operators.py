"""Each operator against a brute-force version, with the cases that its docstring states."""

import base64
import hashlib
import itertools
import re
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from trailweave.llm import bpe, fingerprints, language, packing, pii, pretoken, quality_rules, secret_scan, sharding, similarity, toxicity
from trailweave.llm import words as W
from trailweave.llm.queries import TOKENIZERS

tiktoken = pytest.importorskip("tiktoken")


# 1 ------------------------------------------------------------------------------------


def _toxic_corpus(n=240):
    r = np.random.default_rng(4)
    vocab = ["".join(r.choice(list("abcdefgh"), 4)) for _ in range(300)]
    out = []
    for i in range(n):
        w = [str(x) for x in r.choice(vocab, 60)]
        y = int(i % 5 == 0)
        if y:
            for k in r.choice(60, 3, replace=False):
                w[k] = str(r.choice(["vileword", "nastyword"]))
        out.append((" ".join(w), y))
    return out


def test_toxicity_learns_and_finds_spans(spark):
    rows = _toxic_corpus()
    chain = toxicity.fit(*zip(*rows[:160]))
    test = [(i, t) for i, (t, _) in enumerate(rows[160:])] + [(900, None), (901, ""), (902, "vileword"), (902, "vileword")]
    got = toxicity.score(spark.createDataFrame(test, "doc_id long, text string"), chain).collect()
    assert len(got) == len(test)
    right = sum(g["predicted"] == rows[160 + g["doc_id"]][1] for g in got if g["doc_id"] < 900)
    assert right >= 0.97 * (len(rows) - 160)
    for g in got:
        text = dict(test)[g["doc_id"]] or ""
        assert 0 <= g["score"] <= 1
        assert all("word" in text[s["start"] : s["end"]] for s in g["spans"])
    assert all(g["predicted"] == 0 for g in got if g["doc_id"] in (900, 901))


def test_marginals_against_enumeration():
    r = np.random.default_rng(1)
    chain = toxicity.Chain(trans=r.normal(size=(2, 2)), start=r.normal(size=2))
    e, starts = np.exp(r.normal(size=9)), np.array([0, 4, 5])
    got = toxicity.marginals(e, starts, chain)
    for a, b in zip(starts, [4, 5, 9]):
        total, one = 0.0, np.zeros(b - a)
        for tags in itertools.product((0, 1), repeat=b - a):
            x = np.exp(chain.start[tags[0]] + sum(chain.trans[p, q] for p, q in zip(tags, tags[1:]))) * np.prod([e[a + i] for i, t in enumerate(tags) if t])
            total += x
            one += x * np.array(tags)
        assert np.allclose(got[a:b], one / total)


def test_gradient_against_enumeration():
    """The gradient is the slope of the log likelihood, which is summed over all taggings."""
    r = np.random.default_rng(21)
    oov, n, m = 4, 5, 3
    X, Z = r.integers(0, oov + 1, (m, n)), r.integers(0, oov + 1, (m, n))
    S, Y = r.integers(0, 16, (m, n)), r.integers(0, 2, (m, n))
    lengths = np.array([5, 3, 1])
    on = (np.arange(n) < lengths[:, None]).astype(np.int64)
    Y, S = Y * on, S * on
    X, Z = np.where(on, X, oov), np.where(on, Z, oov)
    theta = r.normal(size=oov + 1 + 16 + 6) * 0.7

    def likelihood(theta):
        wv, sv, tr, st = np.split(theta, [oov + 1, oov + 17, oov + 21])
        wv, tr, total = np.append(wv[:-1], 0.0), tr.reshape(2, 2), 0.0
        for i in range(m):
            k = lengths[i]
            e = wv[X[i, :k]] + wv[Z[i, :k]] + sv[S[i, :k]]
            worth = lambda tags: st[tags[0]] + sum(tr[a, b] for a, b in zip(tags, tags[1:])) + sum(x for x, t in zip(e, tags) if t)  # noqa: B023, E731
            total += worth(Y[i, :k]) - np.log(sum(np.exp(worth(t)) for t in itertools.product((0, 1), repeat=int(k))))
        return total

    got = toxicity._gradient(theta, X, Z, S, Y, on, lengths, oov)
    for i in range(len(theta)):
        if i != oov:
            up, down = theta.copy(), theta.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            assert abs(got[i] - (likelihood(up) - likelihood(down)) / 2e-5) < 1e-5


def plain_score(words, chain):
    """A document's score and the marginals of its words, token by token."""
    weight = lambda w: sum(chain.word.get(c, 0.0) for c in toxicity.cues(w)) + chain.shape[toxicity.shape(w)]
    e, p, f1, f2 = np.clip([weight(w) for w in words], -30, 30), np.zeros(0), -12.0, -12.0
    if words:
        T, f, b = np.exp(chain.trans), [np.exp(chain.start) * [1, np.exp(e[0])]], [np.ones(2)]
        for x in e[1:]:
            f.append((f[-1] @ T) * [1, np.exp(x)])
            f[-1] /= f[-1].sum()
        for x in e[:0:-1]:
            b.append(T @ (b[-1] * [1, np.exp(x)]))
            b[-1] /= b[-1].sum()
        p = np.array([(u * v)[1] / (u * v).sum() for u, v in zip(f, b[::-1])])
        top = np.clip(p.max(), 1e-5, 1 - 1e-5)
        f1, f2 = np.log(top / (1 - top)), np.log(max(p.sum(), 6e-6))
    return 1 / (1 + np.exp(-np.clip(np.dot(chain.doc, [1, f1, f2]), -30, 30))), p


def test_document_scores_against_plain_recursion(spark):
    r = np.random.default_rng(22)
    words = [f"w{i}" for i in range(30)]
    chain = toxicity.Chain({w: float(x) for w, x in zip(words, r.normal(size=30))}, r.normal(size=16), r.normal(size=(2, 2)), r.normal(size=2), (-1.0, 0.4, 0.7))
    texts = [" ".join(r.choice(words, n)) for n in (1, 2, 63, 64, 65, 130, 700)]
    got = {x["doc_id"]: x for x in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chain).collect()}
    for i, t in enumerate(texts):
        score, p = plain_score(t.split(), chain)
        assert abs(got[i]["score"] - score) < 1e-9
        tagged = np.flatnonzero(p >= toxicity.SPAN)
        assert got[i]["n_spans"] == sum(k == 0 or tagged[k] != tagged[k - 1] + 1 for k in range(len(tagged)))


def test_spans_are_places_in_the_text_as_written(spark):
    chain = toxicity.Chain({"vileword": 20.0}, start=np.array([0.0, -5.0]), trans=np.array([[0.0, -5.0], [0.0, -5.0]]))
    texts = ["İstanbul vileword", "VILEWORD İİ x vileword", "naïve vileword – Ж İ Vileword", "\x85vileword", "ΣΑΣ vileword", "a vileword vileword b"]
    for t, g in zip(texts, sorted(toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chain).collect())):
        found = [t[s["start"] : s["end"]] for s in g["spans"]]
        assert [w.lower() for x in found for w in re.findall(r"(?i)vileword", x)] == ["vileword"] * len(re.findall("(?i)vileword", t)) and found
        assert all(x.lower().startswith("vileword") for x in found)


def test_training_sample_takes_whole_texts(spark):
    docs = spark.createDataFrame([(i, "w " * (50_000 if i % 7 == 0 else 10)) for i in range(40)] + [(1, "w " * 10), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (None, 1), (90, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels)
    assert len(rows) == len({r["doc_id"] for r in rows}) == 40 and max(len(r["text"]) for r in rows) == 100_000
    few = toxicity.training_rows(docs, labels, rows=30, chars=250_000)
    assert len(few) <= 30 and sum(len(r["text"]) for r in few) <= 250_000 and {r["doc_id"]: r["text"] for r in few}.items() <= {r["doc_id"]: r["text"] for r in rows}.items()


def test_training_uses_every_labelled_document(spark, monkeypatch):
    """All of more than 4000 give cues, windows and calibration; each window lies in one share."""
    rows = _toxic_corpus(4500)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(7, rows[7][0]), (None, "x"), (9000, "no label")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(3, 0), (None, 1)], "doc_id long, toxic int")
    seen, lexicon, blocks, calibrated = {}, toxicity.lexicon, toxicity._blocks, toxicity._calibrated

    def cut(windows, vocab, shares):
        got = blocks(windows, vocab, shares)
        seen["windows"] = windows.count(), sum(b.agg(F.sum("m")).first()[0] for b in got), len(got)
        return got

    monkeypatch.setattr(toxicity, "STEPS", 4)
    monkeypatch.setattr(toxicity, "SHARE", 2000)
    monkeypatch.setattr(toxicity, "lexicon", lambda rows: seen.update(rows=rows.count(), words=lexicon(rows)) or seen["words"])
    monkeypatch.setattr(toxicity, "_blocks", cut)
    monkeypatch.setattr(toxicity, "_calibrated", lambda known: seen.update(known=known.count()) or calibrated(known))
    toxicity.train(docs, labels)
    assert seen["rows"] == seen["known"] == 4500 and seen["words"] >= {"vileword", "nastyword"}
    assert seen["windows"][0] == seen["windows"][1] >= 2 * 4500 - 900 and seen["windows"][2] > 1
    assert lexicon(toxicity._labelled(docs.repartition(5), labels)) == seen["words"]


def test_gradient_steps_send_the_driver_a_bounded_amount(spark):
    """However many blocks there are, no more tasks than the cluster runs at once report to the driver."""
    r = np.random.default_rng(31)
    oov, n = 40, toxicity.WINDOW
    theta, rows, want = r.normal(size=oov + 1 + 22), [], np.zeros(oov + 1 + 22)
    for _ in range(30):
        x = np.stack([r.integers(0, top, (5, n)) for top in (oov + 1, oov + 1, 16, 2, 2)]).astype(np.int32)
        x[4] = 1
        rows.append((5, x.tobytes()))
        want += toxicity._gradient(theta, *x, x[4].sum(1), oov)
    context = spark.sparkContext
    context.setJobGroup("steps", "")
    g, m = toxicity._summed(spark.createDataFrame(rows, "m int, x binary").repartition(30).localCheckpoint(), theta, oov)
    status = context.statusTracker()
    jobs = [status.getJobInfo(j) for j in sorted(status.getJobIdsForGroup("steps"))]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert m == 150 and np.allclose(g, want)
    assert max(status.getStageInfo(k).numTasks for k in jobs[-1].stageIds) <= context.defaultParallelism


def test_calibration_compiles_nothing_for_a_step(spark):
    r = np.random.default_rng(32)
    f = r.normal(size=(300, 2))
    y = (f @ [1.0, -0.5] + r.normal(size=300) > 0.3).astype(int)
    known = spark.createDataFrame([(int(a), float(b), float(c)) for a, (b, c) in zip(y, f)], "y int, f1 double, f2 double").localCheckpoint()
    compiled = spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME()
    before = compiled.getCount()
    w = np.array(toxicity._calibrated(known))
    assert compiled.getCount() - before <= 2
    x = np.column_stack([np.ones(300), f])
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ w))) - 0.05 * w).max() < 1e-6  # no slope is left


def test_emissions_cost_little_more_than_their_cues():
    """A corpus has many words that are seen once; they are the larger part of a score's work."""
    r = np.random.default_rng(33)
    words = ["".join(w) for w in r.choice(list("abcdefgh1"), (60_000, 9))] + ["ab", "a" * 30, "é1"]
    chain = toxicity.Chain({w: float(x) for w, x in zip(words[::7], r.normal(size=9000) * 20)}, r.normal(size=16))
    spent = []
    for make in (toxicity.cues, toxicity.Emissions(chain).__getitem__):
        began = time.process_time()
        got = [make(w) for w in words]
        spent.append(time.process_time() - began)
    assert np.allclose(got, [np.exp(np.clip(sum(chain.word.get(c, 0.0) for c in toxicity.cues(w)) + chain.shape[toxicity.shape(w)], -30, 30)) for w in words], rtol=1e-12)
    assert spent[1] < 9 * spent[0]


def test_leaders_against_plain(spark, texts):
    """No smaller document of the same label shares a band."""
    rows = [(i, i % 3 % 2, t) for i, t in enumerate(texts)]
    sets = {i: set(enumerate(np.frombuffer(similarity.signature(s), dtype=np.uint64).tolist())) for i, _, t in rows if len(s := similarity.shingles([" ".join(W.words(t or ""))], W.WordHashes())[0])}
    label = {i: y for i, y, _ in rows}
    want = {i for i in sets if not any(j < i and label[j] == label[i] and sets[j] & sets[i] for j in sets)}
    got = toxicity.leaders(spark.createDataFrame(rows, "id long, y int, text string").repartition(3)).collect()
    assert {r["id"]: r["y"] for r in got} == {i: label[i] for i in want} and len(want) < len(sets)


def test_toxicity_without_labels(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    assert {r["predicted"] for r in toxicity.score(docs, chain).collect()} == {0}
    assert toxicity.score(empty, chain).count() == 0
    assert toxicity.keep_clean(docs, chain).count() == docs.count()


# 2 ------------------------------------------------------------------------------------


def _canon(t):
    x = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"\s+", " ", x).strip()


def test_fingerprints(spark, docs, texts, empty):
    got = {r["doc_id"]: r for r in fingerprints.edited(docs).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        third = len(t) // 3
        new = t[: len(t) - third] + nxt[:third]
        g = got[i]
        assert g["n_chars"] == len(t)
        assert g["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert g["near_edited"] == float(_canon(t) == _canon(new))
        assert g["near_next"] == float(_canon(t) == _canon(nxt))
        for j in got:
            assert (got[j]["fingerprint"] == g["fingerprint"]) == (_canon(texts[j]) == _canon(t))
    assert fingerprints.edited(empty).count() == 0
    clash = docs.withColumn("h1", F.lit(0)).withColumn("doc", F.lit(0)).withColumn("canon", F.lit("x"))
    assert {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(clash).collect()} == {i: g["fingerprint"] for i, g in got.items()}


def test_colliding_hashes_are_told_apart(spark, docs, texts, monkeypatch):
    rows = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 2, "a"), (3, 4, "c")], "h1 long, h2 long, canon string")
    full = fingerprints.crowded(rows.select("h1", "h2", F.sha2("canon", 256).alias("digest")))
    assert [tuple(r) for r in full.collect()] == [(1, 2)]
    got = fingerprints.collisions(rows, full).collect()
    assert sorted(r["ordinal"] for r in got) == [0, 1] and {r["h1"] for r in got} == {1}
    # With a hash of four values nearly all texts collide, originals and edited ones alike.
    monkeypatch.setattr(fingerprints, "wide_hash", lambda c: (F.xxhash64(c) % 2, F.xxhash64(F.lit("b"), c) % 2))
    order = sorted(range(len(texts)), reverse=True)
    following = {i: texts[order[(k + 1) % len(order)]] or "" for k, i in enumerate(order)}
    prints = defaultdict(set)
    for r in fingerprints.edited(docs).collect():
        t = texts[r["doc_id"]] or ""
        third = len(t) // 3
        prints[r["fingerprint"]].add(_canon(t))
        prints[r["edited_fingerprint"]].add(_canon(t[: len(t) - third] + following[r["doc_id"]][:third]))
    assert all(len(x) == 1 for x in prints.values()) and len(prints) == len(set().union(*prints.values()))
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()}
    assert all((plain[i] == plain[j]) == (_canon(texts[i]) == _canon(texts[j])) for i in plain for j in plain)


def test_next_rows_of_shared_ids(spark):
    r = np.random.default_rng(12)
    rows = [(int(i) if i else None, f"t{j}") for j, i in enumerate(r.choice([0, 0, 0, 7, 7, 7, *range(20, 60)], size=700))] + [(3, "same")] * 9
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"]).collect()
    assert Counter((x["doc_id"], x["text"]) for x in got) == Counter(rows) == Counter((x["next_doc_id"], x["next_text"]) for x in got)
    key = lambda i: -1 if i is None else i
    assert sum(key(x["next_doc_id"]) > key(x["doc_id"]) for x in got) == 1  # the last row's next is the first
    after = {(x["doc_id"], x["text"]): (x["next_doc_id"], x["next_text"]) for x in got if x["text"] != "same"}
    at, seen = max(after, key=lambda x: key(x[0])), set()
    while at in after and at not in seen:
        seen.add(at)
        at = after[at]
    assert len(seen) > 300


# 3 ------------------------------------------------------------------------------------


def _shingles(t):
    w = re.findall(r"\w+", (t or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_similarity_join(docs, texts, empty):
    sets = [_shingles(t) for t in texts]
    links, parent = Counter(), list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 10 * len(a & b) >= 8 * len(a | b):
            links[i] += 1
            links[j] += 1
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in similarity.join(docs).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: links[i] for i in range(len(texts))}
    assert {i: r["class_id"] for i, r in got.items()} == {i: find(i) for i in range(len(texts))}
    assert similarity.join(empty).count() == 0
    kept = sorted(r["doc_id"] for r in similarity.keep_one(docs).collect())
    assert kept == sorted({find(i) for i in range(len(texts))})


def test_blocks_and_copies(spark):
    r = np.random.default_rng(2)
    base = [f"w{x}" for x in r.integers(500, size=80)]
    rows = []
    for i in range(420):  # a group larger than a block, and copies of one text
        w = list(base)
        if i % 3:
            w[int(r.integers(80))] = f"z{i}"
        rows.append((i, " ".join(w)))
    rows += [(None, rows[0][1]), (5, rows[5][1])]
    sets = [_shingles(t) for _, t in rows]
    want = Counter()
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            want[i] += 1
            want[j] += 1
    got = similarity.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_links"] for r in got) == sorted(want[i] for i in range(len(rows)))
    kept = similarity.keep_one(spark.createDataFrame([(1, "a b c d e f", 0), (1, "a b c d e f", 0), (2, "x y", 0)], "doc_id long, text string, _mark int"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_groups_of_large_buckets(spark, monkeypatch):
    """Blocks of four classes: groups and counts as without blocks, whatever stays apart in a bucket."""
    monkeypatch.setattr(similarity, "BLOCK", 4)
    r = np.random.default_rng(41)
    rows = []
    for family in range(3):
        base = [f"f{family}w{x}" for x in r.integers(500, size=90)]
        for i in range(36):  # some reach the threshold through others only, some not at all
            w = list(base)
            for k in r.choice(90, int(r.integers(0, 4)), replace=False):
                w[k] = f"z{r.integers(10**6)}"
            rows.append((len(rows), " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets, links, parent = [_shingles(t) for _, t in rows], Counter(), list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(len(rows))}
    assert 3 < len(set(want.values())) < len(rows)
    assert {x["doc_id"]: x["class_id"] for x in similarity.groups(d).collect()} == want
    got = similarity.join(d).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == want and {x["doc_id"]: x["n_links"] for x in got} == {i: links[i] for i in want}


def test_blocks_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_SHINGLES", 60)
    monkeypatch.setattr(similarity, "COLUMNS", 64)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:100] + [f"x{i}"] + base[100:])) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x["class_id"], x["n_links"]) for x in similarity.join(d).collect()} == {(0, 11)}
    assert {x["class_id"] for x in similarity.groups(d).collect()} == {0}


def test_pruning_table_is_the_posterior():
    least = similarity.least_matches(0.8, 1e-6)
    grid = np.linspace(0, 1, 20001)[1:-1]
    for n, m in zip(range(16, 129, 16), least):
        for x, keeps in ((m, True), (m - 1, False)):
            logs = x * np.log(grid) + (n - x) * np.log(1 - grid)
            d = np.exp(logs - logs.max())
            assert (d[grid >= 0.8].sum() / d.sum() >= 1e-6) == keeps


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)]
    e = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in chain], "a binary, b binary")
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["label"], "big") for r in similarity.components(e).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_groups_plans_stay_small(spark, docs, monkeypatch):
    """What the driver plans: few joins in any table, and components once unless links are added."""
    joins, labelled, written, components = {}, [], similarity.written, similarity.components

    def planned(df, label):
        joins[label] = max(joins.get(label, 0), df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return written(df, label)

    monkeypatch.setattr(similarity, "written", planned)
    monkeypatch.setattr(similarity, "components", lambda edges: labelled.append(1) or components(edges))
    out = similarity.groups(docs)
    joins["out"] = out._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert max(joins.values()) <= 10 and len(labelled) == 1, (joins, labelled)
    assert out.count() == docs.count()


def test_words_are_the_pattern():
    for t in ("Héllo, wörld_1 ²x½ ÀÉ", "naïve – Ж中 x", "", "A b\x85c"):
        assert W.words(t) == re.findall(r"\w+", t.lower())


# 4 ------------------------------------------------------------------------------------


def test_language_mixture(spark, empty):
    r = np.random.default_rng(3)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["schu", "reng", "tz"], "cc": ["ção", "lh", "nha"]}
    make = lambda k, n: " ".join("".join(r.choice(parts[k], 2)) for _ in range(n))
    train = [(i, make(k, 60), k) for i, k in enumerate(["aa", "bb", "cc"] * 20)]
    model = language.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    test = [(0, make("aa", 50)), (1, make("cc", 80)), (2, make("aa", 60) + " " + make("bb", 30)), (3, None), (4, "12 -- 3"), (4, "12 -- 3")]
    got = {x["doc_id"]: x for x in language.predict(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["aa", "cc", "aa", "und", "und"]
    assert [got[i]["n_langs"] for i in range(5)] == [1, 1, 2, 0, 0]
    assert abs(got[2]["langs"][0]["share"] - 2 / 3) < 0.05
    assert language.predict(empty, model).count() == 0
    none = language.train(empty)
    assert {x["lang_pred"] for x in language.predict(spark.createDataFrame(test, "doc_id long, text string"), none).collect()} == {"und"}


def test_mixtures_against_plain_em():
    """The language set and shares as a loop over sets of all sizes finds them."""
    r = np.random.default_rng(23)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["schu", "reng", "tz"], "cc": ["ção", "lh", "nha"], "dd": ["ka", "tz", "wo"]}
    make = lambda k, n: " ".join("".join(r.choice(parts[k], 2)) for _ in range(n))
    model = language.fit([make(k, 80) for k in parts for _ in range(12)], [k for k in parts for _ in range(12)])
    texts = [make("aa", 40), make("bb", 30) + " " + make("cc", 20), make("dd", 25) + " " + make("aa", 5), make("aa", 15) + " " + make("bb", 15) + " " + make("cc", 15), "ka", "x", "", "12"]
    texts += [texts[0]] * 2
    got, kept = language.mixtures(texts, model)
    for text, share, size in zip(texts, got, kept):
        words = ["".join(w) for w in re.findall(r"[^\W\d_]+", text)]
        if not words:
            assert size == 0 and not share.any()
            continue
        logs = np.array([model.logp[language.trigrams([w])[0]].sum(0) for w in words], dtype=float)
        like = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -language.SHARPEST))

        def em(allowed):
            pi = allowed / allowed.sum()
            for _ in range(language.ROUNDS):
                post = like * pi
                pi = (post / post.sum(1, keepdims=True)).mean(0)
            return pi, np.log((like * pi).sum(1)).sum()

        order = np.argsort(-em(np.ones(4))[0], kind="stable")
        sets = []
        for k in range(1, 5):
            allowed = np.zeros(4)
            allowed[order[:k]] = 1
            pi, value = em(allowed)
            sets.append((value - language.PENALTY * np.log(len(words) + 1) * (k - 1), -k, pi))
        best = max(sets, key=lambda x: x[:2])
        assert size == -best[1] and np.allclose(share, best[2], atol=1e-4)


def test_every_language_is_modelled_and_long_and_repeated_rows(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{i:03}": letters[i % 26] + letters[i // 26] + "q" for i in range(260)}
    rows = [(i * 3 + j, " ".join([w] * 20), lang) for i, (lang, w) in enumerate(own.items()) for j in range(3)]
    model = language.train(spark.createDataFrame([*rows, rows[0], (9999, None, "l000"), (None, "abc", None)], "doc_id long, text string, lang string"))
    assert model.langs == sorted(own) and model.logp.shape == (1 << language.slot_bits(260), 260)
    test = [(i, t) for i, t, _ in rows[::40]] + [(0, "aaq " * 200_000), (0, "aaq " * 200_000)]
    got = language.predict(spark.createDataFrame(test, "doc_id long, text string"), model).collect()
    assert len(got) == len(test) and sum(g["lang_pred"] == dict((i, lang) for i, _, lang in rows)[g["doc_id"]] for g in got) >= len(test) - 1
    tie = language.predict(spark.createDataFrame([(1, "zzzz")], "doc_id long, text string"), language.fit(["same words"] * 2, ["b", "a"])).first()
    assert tie["lang_pred"] == "a"


# 5 ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_codec():
    with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pretoken.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_exact(docs, texts, empty, reference_codec):
    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, path).collect()}
    dig = {r["doc_id"]: r for r in bpe.digests(docs, path).collect()}
    raw = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    for i, t in enumerate(texts):
        want = reference_codec.encode_ordinary(t or "")
        assert ids[i] == want and raw[i] == (t or "").encode() and dig[i]["n_tokens"] == len(want)
        assert dig[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert bpe.digests(empty, path).count() == 0


def test_bpe_on_odd_texts(reference_codec):
    c = bpe.codec(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    r = np.random.default_rng(5)
    odd = ["".join(r.choice(list("ab 1'\n\t .é²ª_ßЖ中😀\x1c\x85½ſ"), 40)) for _ in range(60)] + ["the" * 700, "a" * 256, "a" * 257, "'s'll <|endoftext|>"]
    for letters in ("eth", "ab", "a-", "etaoinshr", "日本語のは", "ภาษไทย"):  # long words without a blank
        odd += ["".join(r.choice(list(letters), int(r.integers(65, 500)))) for _ in range(12)]
    assert c.encode_ids(odd) == [reference_codec.encode_ordinary(t) for t in odd]
    lens, spelled, decoded = c.digests(odd + [""])
    assert lens.tolist() == [len(reference_codec.encode_ordinary(t)) for t in odd] + [0]
    assert decoded == [hashlib.sha256(t.encode()).hexdigest() for t in odd + [""]]
    with pytest.raises(ValueError):
        c.decode([[999999]])


def test_bpe_on_many_and_very_long_words(reference_codec):
    c = bpe.codec(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    r = np.random.default_rng(15)
    han = " ".join("".join(map(chr, r.integers(0x4E00, 0x9FA5, 80))) for _ in range(3000))
    thai = "".join(map(chr, r.integers(0xE01, 0xE3A, 30000)))
    for text in (han, thai, "".join(r.choice(list("etaoinshrdlucm"), 8000))):
        assert c.encode_ids([text])[0] == reference_codec.encode_ordinary(text)
    for text in ("the" * 100_000, "-" * 400_000, "é" * 1_000_000):
        ids = c.encode_ids([text])[0]
        assert c.decode([ids])[0].decode() == text and len(set(ids)) < 40


def test_bpe_long_texts_in_windows(monkeypatch):
    """Windows and pieces give what the library gives for the whole text."""
    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for k, v in (("WINDOW", 50), ("CHUNK", 50), ("DECODED", 37)):
        monkeypatch.setattr(bpe, k, v)
    r, c = np.random.default_rng(7), bpe.codec(path)
    letters = list("abcdefg   \n\t.,'12é—日本語。️🙂") + ["'s", "'ll", " 's", "  "]
    texts = ["".join(r.choice(letters, 3000)) for _ in range(6)] + ["日本語" * 300 + "。" + "本" * 200, "ab" * 700, " " * 500, "don't " * 200]
    for t in texts:
        ids = library.encode_ordinary(t)
        assert "".join(c.windows(t)) == t and c.encode_ids([t]) == [ids]
        n, spelled, decoded = c.digests([t])
        assert (n[0], spelled[0], decoded[0]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert len(list(c.windows(texts[0]))) > 20
    assert c.encode_ids(texts) == [library.encode_ordinary(t) for t in texts] and c.decode(c.encode_ids(texts)) == [t.encode() for t in texts]


# 6 ------------------------------------------------------------------------------------


def test_quality_measurements(spark, docs, texts, empty):
    more = texts + ["a b c d e\na b c d e\n\n \na b c d e x", "x " * 9, "# $ < a", "\x0b\x0c", "aaaaaaa b c d e f g h i j k l"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(more)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.ledger(d).collect()}
    for i, t in enumerate(more):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + o for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for o in range(5)}
        g = got[i]
        assert (g["n_words"], g["word_chars"], g["n_dup_lines"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert g["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert (g["failures"] & 1 > 0) == (len(w) < 10)
    assert quality_rules.ledger(empty).count() == 0
    assert quality_rules.apply_policy(quality_rules.ledger(docs)).filter("kept").select(docs.columns).count() > 0
    clash = docs.withColumn("n_words", F.lit(-1)).withColumn("failures", F.lit("x")).withColumn("doc", F.lit(0))
    assert quality_rules.ledger(clash).filter("n_words < 0").isEmpty()
    kept = quality_rules.keep(clash)
    assert kept.columns == clash.columns and {r["n_words"] for r in kept.collect()} == {-1}


def test_stored_ledger(spark, docs, tmp_path):
    twice = docs.unionByName(docs)
    entries = quality_rules.stored(twice, str(tmp_path / "ledger"))
    assert "text" not in entries.columns and entries.count() == twice.count()
    for rules in (("few_words",), tuple(n for n, _ in quality_rules.RULES)):
        p = quality_rules.Policy("t", rules)
        kept = sorted((r["doc_id"] for r in quality_rules.keep(twice, p).collect()))
        assert kept == sorted(r["doc_id"] for r in quality_rules.apply_policy(entries, p).filter("kept").collect())
        got = {r["rule"]: r["failed"] for r in quality_rules.ablations(entries, p).collect()}
        assert got == {r["rule"]: r["failed"] for r in quality_rules.ablations(quality_rules.ledger(twice), p).collect()}


def test_ablations(spark):
    rows = spark.createDataFrame([(0,), (1,), (3,), (2,), (4,)], "failures long")
    p = quality_rules.Policy("t", ("few_words", "repeated_windows"))
    got = {r["rule"]: r.asDict() for r in quality_rules.ablations(rows, p).collect()}
    assert got["few_words"] == {"rule": "few_words", "failed": 2, "only_this": 1, "rejected": 3, "rejected_without": 2}
    assert got["repeated_windows"]["failed"] == 2


# 7 ------------------------------------------------------------------------------------


def test_surrogates(spark, empty):
    a = "Write to Ann.B.92@mail6.example.com or ANN.B.92@MAIL6.EXAMPLE.COM, call +1 (017) 555-7713 or +1-017-555-7713."
    b = "Card 4111111111111111 or 4111 1111 1111 1111, not 9807915762804490. IP 97.51.17.173. Mrs. Brown met Herr Braun and г-жа Иванова."
    rows = [(1, a), (2, b), (2, b), (3, None), (4, ""), (None, "at 97.51.17.173"), (6, "plain 12 text")] + [(100 + i, f"Mr. N{chr(97 + i % 26)}{chr(97 + i // 26)} was at 10.0.{i}.1") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.anonymise(d).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    ta, tb = by[1]["text"], by[2]["text"]
    mails = re.findall(r"\S+@\S+[a-zA-Z]", ta)
    assert mails[0].upper() == mails[1] and "92@" not in ta and mails[0].endswith(".com")
    phones = re.findall(r"\+[\d() -]+\d", ta)
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) and phones[0].startswith("+1 (") and "555-7713" not in ta
    cards = re.findall(r"\d{16}|\d{4}(?: \d{4}){3}", tb)
    luhn = lambda s: sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10
    assert cards[0] == cards[1].replace(" ", "") != "4111111111111111" and luhn(cards[0]) == 0 and luhn(cards[2]) != 0
    assert re.search(r"Mrs\. [A-Z]\w+ met Herr [A-Z]\w+ and г-жа [А-Я]\w+", tb) and "Brown" not in tb and "Иванова" not in tb
    assert by[None]["text"][3:] in tb and "97.51" not in tb
    assert (by[3]["text"], by[4]["text"], by[6]["text"]) == (None, "", "plain 12 text")
    names = [re.match(r"Mr\. (\S+) was at (\S+)", by[100 + i]["text"]).groups() for i in range(80)]
    assert len({n for n, _ in names}) == 80 and len({ip for _, ip in names}) == 80
    assert pii.anonymise(empty).count() == 0
    assert pii.anonymise(d, "other key").filter("doc_id = 1").first()["text"] != ta


def test_every_entity_passes_the_hint(spark):
    rows = [(1, "the resolver at 8.8.8.8 answers"), (2, "1.1.1.1"), (3, "in 2020 it was 8.8.8.8"), (4, "version 1.2.3 of 5")]
    got = {r["doc_id"]: r for r in pii.anonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_entities"] for i in (1, 2, 3, 4)] == [1, 1, 1, 0] and got[4]["text"] == rows[3][1]
    assert "8.8.8.8" not in got[1]["text"] and got[1]["text"].split()[3] == got[3]["text"].split()[-1] != got[2]["text"]


#: Of each type: entities as they are found in a text.
ENTITIES = {
    "email": ["a@b.co", "Änne_1%x+y@mail.sub-x.example.org"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR0012345678"],
    "ip": ["8.8.8.8", "10.200.3.4"],
    "card": ["4111 1111 1111 1111", "378282246310005"],
    "ssn": ["078-05-1120"],
    "phone": ["+49 30 1234 5678", "(212) 555-0100", "212.555.0101"],
    "person": ["Mrs. Brown", "г-н Иван Петров", "κυρία Ελένη", "Dr O'Neil-Smith"],
}


def test_found_types_against_brute_force(spark):
    """Every pattern through ``found``; places, types and what is left against Python's own search."""
    own = [regex.compile(p) for p in pii.PATTERNS.values()]
    flat = [(k, e) for k, v in ENTITIES.items() for e in v]
    texts = [e for _, e in flat] + [f"x {a} and {b}, so" for (_, a), (_, b) in itertools.product(flat, flat)] + ["no 1 entity", "v1.2.3", "@", "1.2.3.4.5", "long " * 40_000 + "a@b.co"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in pii.anonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    surrogates = defaultdict(set)
    for i, t in rows:
        at, types, gaps, begin = 0, [], [], 0
        while at < len(t):  # the first pattern, in order, that matches here
            m = next(((k, m) for k, p in zip(pii.PATTERNS, own) if (m := p.match(t, at))), None)
            if m:
                types.append((m[0], m[1][0]))
                gaps.append(t[begin:at])
                begin = m[1].end()
            at = m[1].end() if m else at + 1
        gaps.append(t[begin:])
        assert got[i]["types"] == [k for k, _ in types], t[:80]
        parts = re.fullmatch("(.*)".join(map(re.escape, gaps)), got[i]["text"], re.S).groups()
        for (k, e), s in zip(types, parts):
            assert s != e
            surrogates[k, e].add(s)
    assert all(len(s) == 1 for s in surrogates.values())  # one entity, one surrogate
    assert {k for k in surrogates} >= set(flat) and len(set().union(*surrogates.values())) == len(surrogates)
    rest = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    for e in ENTITIES["iban"]:
        (s,) = surrogates["iban", e]
        assert s[:2] == e[:2] and [c == " " for c in s] == [c == " " for c in e] and (rest(s.replace(" ", "")) == 1) == (rest(e.replace(" ", "")) == 1)


def test_attempts_end(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"m{i % 10}@{'abcdefghijklmnopqrstuvwxyz'[i // 10]}.co") for i in range(260)], "doc_id long, text string")
    got = [r["text"] for r in pii.anonymise(rows).collect()]
    assert len(set(got)) == 260 and not set(got) & {r["text"] for r in rows.collect()}
    monkeypatch.setattr(pii, "ATTEMPTS", 2)
    monkeypatch.setattr(pii, "surrogate", lambda key: (F.lit("4"), F.lit("")))
    with pytest.raises(ValueError):
        pii.anonymise(spark.createDataFrame([(1, "078-05-1120"), (2, "078-05-1121")], "doc_id long, text string"))


def test_names_outgrow_the_pools(spark):
    value, digest = pii.surrogate("key")
    tries = spark.range(60).select(F.lit("person").alias("type"), F.lit("m|νίκου").alias("canon"), F.col("id").cast("int").alias("attempt"))
    words = {r["attempt"]: r["s"].count("-") + 1 for r in tries.withColumn("_h", digest).withColumn("s", value).collect()}
    assert words == {i: 1 + i // 3 for i in range(60)}
    greek = "αβγδεζηθικλμνξοπρστυ"
    rows = [(i, f"κύριος Ω{greek[i % 20]}{greek[i // 20]}") for i in range(400)]  # the pools hold 6 + 36 + 216
    got = [r["text"] for r in pii.anonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(set(got)) == 400 and not set(got) & {t for _, t in rows}
    assert all(re.fullmatch(r"κύριος \w+(-\w+)*", t) for t in got)


# 8 ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def forest():
    return secret_scan.fit(*secret_scan.labelled_findings(2000))


def test_forest_on_held_out_findings(forest):
    X, y = secret_scan.labelled_findings(1000, seed=77)
    assert np.mean((forest.score(np.array(X)) >= 0.5) == np.array(y)) > 0.97


def test_evidence():
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    jwt = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=") + ".eyJzdWIiOiIxIn0." + "x" * 20
    cases = [
        ('token = "%s"', key, 1), ("commit: %s", key, 0), ("see %s", key, None), ("%s", "AKIA" + "Q3" * 8, 1), ("a %s", "AKIA" + "Q3" * 7, None), ("%s", jwt, 1), ("%s", "eyJhbGci.b.c", 0),
        ("%s", "4111111111111111", 0), ("%s", "4111111111111112", None), ("a.b@%s", "mail.example-host.com", 0), ("https://x.org/%s", "a1" * 10, 0), ("%s", "123e4567-e89b-42d3-a456-426614174000", 0),
        ('password = "%s"', "your_password_here_1", 0), ("%s", "----------------1", 0),
    ]
    for form, value, label in cases:
        text = "some words " + form % value + " more"
        a = text.index(value)
        assert secret_scan.evidence(text, a, a + len(value)) == label, (form, value)


def test_learned_forest_on_held_out_documents(spark):
    """Learned from some documents, measured on findings of others, against a plain walk down the trees."""
    r = np.random.default_rng(31)
    hexa = lambda n: "".join(r.choice(list("0123456789abcdef"), n))
    word = lambda: "".join(r.choice(["ba", "lo", "mi", "ter"], 3))
    rows = []
    for i in range(600):
        text = " ".join(word() for _ in range(12)) + " "
        text += [f'token = "{hexa(40)}"', f"commit {hexa(40)}", f"to x.{i}@mail{i}.example.com", f"{word()}_{word()}_{word()}_{word()}7", f'api_key: "{hexa(32)}"'][i % 5]
        rows.append((i, text + " " + word()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    forest = secret_scan.learn(docs.filter("doc_id < 400"))
    assert word() in forest.words and len(forest.words) <= secret_scan.DICTIONARY + 200
    got = secret_scan.scan(docs.filter("doc_id >= 400"), forest).collect()
    want = {i: int(i % 5 in (0, 4)) for i in range(400, 600)}
    assert sum(g["n_secrets"] == want[g["doc_id"]] for g in got) >= 198

    def walk(tree, x):
        feature, cut, left, right, share = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] if x[feature[at]] <= cut[at] else right[at]
        return share[at]

    for g in got[:40]:
        text = rows[g["doc_id"]][1]
        for f in g["findings"]:
            a, b = f["start"], f["end"]
            x = secret_scan.features(text[a:b], text[max(0, a - 40) : a], text[b : b + 40], forest.words)
            assert abs(f["score"] - np.mean([walk(t, x) for t in forest.trees])) < 1e-12
    long = ("word " * 200_000) + f'token = "{hexa(40)}"'
    twice = secret_scan.scan(spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string"), forest).collect()
    assert [x["n_secrets"] for x in twice] == [1, 1] and twice[0] == twice[1]
    assert secret_scan.scan(docs.limit(0), secret_scan.learn(docs.limit(0))).count() == 0


def test_learns_from_all_documents(spark, monkeypatch):
    """Every word counts for the dictionary and every finding for the forest, however many documents
    there are, in whatever order they lie."""
    n, found = 60_000, 7000
    text = F.concat(F.lit("ba lo mi "), F.when(F.col("id") % 12_000 == 7, "quizzical ").when(F.col("id") % 15_000 == 7, "zephyrous ").otherwise(""), F.when(F.col("id") < found, F.concat(F.lit('token = "'), F.sha1(F.col("id").cast("string")), F.lit('" '))).otherwise(""), F.when(F.col("id") < 9, F.concat(F.lit("commit "), F.sha1(F.lit("x")), F.lit(" to"))).otherwise(""))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    seen, grow = [], secret_scan.grown
    monkeypatch.setattr(secret_scan, "grown", lambda rows, words: seen.append(rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()) or grow(rows, words))
    forest = secret_scan.learn(docs)
    assert "quizzical" in forest.words and "zephyrous" not in forest.words  # in 5 documents and in 4
    made = secret_scan.FINDINGS // 2
    found = sum(secret_scan.evidence(f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"', 9, 49) == 1 for i in range(found))
    assert found > 6990
    assert {r["label"]: (r["n"], r["w"]) for r in seen[0]} == {0.0: (made + 1, made + 1), 1.0: (made + found, made + found / 4)}
    other = secret_scan.learn(docs.orderBy(F.desc("doc_id")).repartition(3))
    assert other.words == forest.words and all(np.array_equal(a, b) for s, t in zip(forest.trees, other.trees) for a, b in zip(s, t))


def test_dictionary_is_the_most_frequent_words(spark, monkeypatch):
    """By count, equal counts by name, whole documents whatever their number."""
    r = np.random.default_rng(5)
    words = ["w" + "".join(r.choice(list("abcdef"), 4)) for _ in range(300)]
    texts = [" ".join(words[int(300 * r.random() ** 2)] for _ in range(20)) for _ in range(400)] + [None, "", "x" * 13, "wé wab7"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = Counter(w for t in texts for w in set((t or "").split()) if re.fullmatch("[a-z]{3,12}", w))
    for most, held in ((50, 30), (7, 10**6), (10**6, 1)):
        monkeypatch.setattr(secret_scan, "DICTIONARY", most)
        monkeypatch.setattr(secret_scan, "HELD", held)
        want = sorted((w for w, n in counts.items() if n >= 5), key=lambda w: (-counts[w], w))[:most]
        assert secret_scan.dictionary(docs.repartition(5)) == secret_scan._WORDS | set(want)


def test_long_texts_are_cut_between_words():
    text = "one two_three  four " * 50
    for size in (1, 5, 64, 5000):
        pieces = list(secret_scan._pieces(text, size))
        assert "".join(pieces) == text and [w for p in pieces for w in W.words(p)] == W.words(text)
    assert list(secret_scan._pieces("")) == []


def test_scan_and_redact(spark, docs, empty, forest):
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    rows = [(1, f'some words token = "{key}" and more'), (2, f"sha1 {key} of the commit"), (3, None), (4, ""), (5, "password: hunter2x!9"), (6, "/usr/local/lib/python3/file_name.py")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = {r["doc_id"]: r for r in secret_scan.scan(d, forest).collect()}
    assert [got[i]["n_secrets"] for i in range(1, 7)] == [1, 0, 0, 0, 1, 0]
    f = [x for x in got[1]["findings"] if x["secret"]][0]
    assert rows[0][1][f["start"] : f["end"]] == key
    clean = {r["doc_id"]: r for r in secret_scan.redact(d, forest).collect()}
    assert clean[1]["text"] == 'some words token = "[SECRET]" and more' and clean[1]["n_chars"] == len(clean[1]["text"])
    assert clean[2]["text"] == rows[1][1] and clean[3]["text"] is None
    assert secret_scan.redact(docs, forest).schema == docs.schema and secret_scan.scan(empty, forest).count() == 0


# 9 ------------------------------------------------------------------------------------


def test_numbered_pre_tokens_are_the_pattern():
    r, split = np.random.default_rng(9), pretoken.Splitter()
    for letters in ("ab'strevlmd  \n1.é²", "abst'redmlv  \n\t1.!é²ª_ßЖ中😀\x1c\x85½ſ ٣"):
        for _ in range(80):
            texts = ["".join(r.choice(list(letters), int(r.integers(0, 60)))) for _ in range(int(r.integers(0, 9)))]
            words, index, counts = split.numbered(texts)
            got = iter(words[i] for i in index)
            assert [[next(got) for _ in range(n)] for n in counts] == [split(t) for t in texts] and next(got, None) is None


def test_packing_keeps_every_id_once(docs, texts, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rows = defaultdict(list)
    packed = packing.pack(docs.coalesce(1), f"{TOKENIZERS}/byte_bpe_50k.json", keep_ids=True).collect()
    for r in packed:
        rows[r["doc_id"]].append(r)
    for i, text in enumerate(texts):
        want, at = t.encode(text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(rows[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids"] == want[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    seqs = defaultdict(list)
    for r in packed:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert sum(r["length"] for r in packed) > 0.9 * 2048 * (len(seqs) - 1)
    assert packing.pack(empty, f"{TOKENIZERS}/byte_bpe_50k.json").count() == 0


def test_cuts_are_optimal():
    r = np.random.default_rng(6)
    for _ in range(50):
        at = np.concatenate([[0], np.cumsum(r.integers(1, 6, size=12))])
        cost = np.concatenate([[0], r.integers(0, 5, size=12)])
        got = packing.cuts(at, cost, 8, True)
        price = lambda marks: sum(8 - (b - a) + cost[list(at).index(b)] for a, b in zip(marks, marks[1:]))
        best = min(price([0, *c, at[-1]]) for n in range(12) for c in itertools.combinations(at[1:-1].tolist(), n) if all(b - a <= 8 for a, b in zip([0, *c], [*c, at[-1]])))
        assert got[0] == 0 and got[-1] == at[-1] and price(got) == best


# 10 -----------------------------------------------------------------------------------


def test_shards(spark, empty):
    rows = [(i, f"text {i}") for i in range(300)] + [(1000 + i, f"copy {i // 5}") for i in range(200)] + [(2000 + i, "hot") for i in range(250)] + [(3000, None), (3001, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("home", F.lit(0)).withColumn("grp", F.lit("x"))
    got = sharding.assign(d, F.col("text"), F.struct("doc_id", "text")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["text"]) == sorted(x for x in rows if x[1])
    sizes = Counter(r["shard"] for r in got)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    spread = defaultdict(set)
    for r in got:
        spread[r["text"]].add(r["shard"])
    assert sum(len(spread[f"copy {i}"]) == 1 for i in range(40)) >= 30
    assert len(spread["hot"]) < 40
    assert sharding.assign(empty, F.col("text"), F.col("doc_id")).count() == 0


@pytest.mark.parametrize("copies,alone", [(5, 0), (3, 600)])
def test_few_groups_are_cut_in_full_shards(spark, copies, alone):
    n = 3000 - alone
    rows = [(i, f"copy {i // copies}") for i in range(n)] + [(n + i, f"text {i}") for i in range(alone)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(d, F.col("text"), F.col("doc_id")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == rows
    assert set(Counter(r["shard"] for r in got).values()) == {75}
    spread = defaultdict(set)
    for r in got:
        spread[r["text"]].add(r["shard"])
    assert all(len(x) == 1 for x in spread.values())  # 75 is a multiple of both sizes


def test_layout_of_sizes():
    r = np.random.default_rng(8)
    for _ in range(100):
        sizes = {int(s): int(r.integers(1, 9)) for s in r.integers(2, 60, size=6)}
        room = r.multinomial(sum(s * c for s, c in sizes.items()) + int(r.integers(0, 20)), np.ones(8) / 8).tolist()
        whole, cut = sharding.pack(sizes, room)
        rows = {(s, k): list(range(s)) for s, a, b, _ in whole for k in range(a, b + 1)}
        used = Counter()
        for s, a, b, shard in whole:
            used[shard] += s * (b - a + 1)
        parts = defaultdict(list)
        for s, k, a, b, shard in cut:
            parts[s, k] += range(a, b + 1)
            used[shard] += b - a + 1
        assert not set(rows) & set(parts) and len(parts) <= 8
        assert sum(b - a + 1 for _, a, b, _ in whole) == len(rows)
        assert {**rows, **parts} == {(s, k): list(range(s)) for s, c in sizes.items() for k in range(c)}
        assert all(used[i] <= room[i] for i in range(8))


def _least_cut(sizes, quota):
    """The fewest linked pairs in different shards, over all layouts with these quotas."""
    best = {tuple(quota): 0}
    for n in sizes:
        after = {}
        for room, cost in best.items():
            for part in itertools.product(*[range(min(n, r) + 1) for r in room]):
                if sum(part) == n:
                    left = tuple(r - p for r, p in zip(room, part))
                    c = cost + (n * (n - 1) - sum(p * (p - 1) for p in part)) // 2
                    after[left] = min(after.get(left, c), c)
        best = after
    return min(best.values())


@pytest.mark.parametrize("sizes,alone", [([4, 4, 3, 2], 5), ([9, 2, 2], 2), ([5, 5, 5], 0), ([7, 3, 2, 2], 1)])
def test_cut_is_the_least_on_small_graphs(spark, sizes, alone):
    rows = [(g * 100 + i, f"group {g}") for g, n in enumerate(sizes) for i in range(n)] + [(9000 + i, f"own {i}") for i in range(alone)]
    placed = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), F.col("text"), F.col("doc_id"), 3)
    got = sharding.cut(placed, F.col("text")).first()
    n = len(rows)
    quota = [n // 3 + (s < n % 3) for s in range(3)]
    assert sorted(Counter(r["shard"] for r in placed.collect()).values()) == sorted(quota)
    assert (got["groups"], got["edges"]) == (len(sizes), sum(x * (x - 1) // 2 for x in sizes))
    assert got["cut_edges"] == _least_cut(sizes, quota)


def test_shards_of_repeated_rows(spark):
    rows = [(1, "same")] * 50 + [(None, "same")] * 10 + [(2, None)] * 20 + [(i, f"t{i}") for i in range(40)]
    placed = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), F.col("text"), F.struct("doc_id", "text"), 4).collect()
    assert Counter((r["doc_id"], r["text"]) for r in placed) == Counter(rows)
    assert set(Counter(r["shard"] for r in placed).values()) == {30}
    assert all(sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(30)) for s in range(4))
