"""The pipeline's stages, each against a plain version on its own input."""

import itertools
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.test_operators import _shingles, plain_score
from trailweave.llm import secret_scan, toxicity
from trailweave.llm import words as W
from trailweave.llm.queries import TOKENIZERS

DATA = os.environ.get("TRAILWEAVE_DATA", "/root/testdata/sf0.001")


def _rejected(text):
    """Does a rule of the standard policy fail?"""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(w), sum(map(len, w))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[k : k + 5]) for k in range(n - 4))
    repeated = len({k + o for k in range(n - 4) if windows[tuple(w[k : k + 5])] > 1 for o in range(5)})
    symbols, again = sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    return n < 10 or 100 * repeated > 20 * n or 10 * symbols > 3 * n or 10 * again > 3 * len(lines) or chars < 2 * n or chars > 25 * n


def _groups(texts):
    """The least id of each document's group of near duplicates."""
    parent = {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    sets = {i: _shingles(t) for i, t in texts.items()}
    for i, j in itertools.combinations(sorted(texts), 2):
        if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_secrets_stage_learns_from_all_documents(spark, monkeypatch):
    """A word of exactly 5 of 60,000 documents is in the dictionary of the stage's forest."""
    text = F.when(F.col("id") % 12_000 == 7, "ba lo quizzical").otherwise("ba lo mi")
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    seen = []
    monkeypatch.setattr(secret_scan, "redact", lambda docs, forest: seen.append(forest) or docs)
    C.secrets(spark, docs, DATA)
    assert "quizzical" in seen[0].words


def test_toxicity_stage_learns_from_all_labels(spark, tmp_path):
    """A cue of documents that lie behind the first 4000 labelled ones, in the order of the hashes of
    their ids, is learnt."""
    r = np.random.default_rng(8)
    vocab = ["".join(r.choice(list("abcdefgh"), 4)) for _ in range(300)]
    ids = spark.range(7500).select(F.col("id").alias("doc_id"))
    learnt = [x["doc_id"] for x in ids.filter(F.pmod(C.crc_of_id(), F.lit(5)) != 0).orderBy(F.xxhash64("doc_id")).collect()]
    late, bad = set(learnt[4200::60]), set(range(0, 7500, 10))
    cue = {**dict.fromkeys(bad, "vileword"), **dict.fromkeys(late, "quizzical")}
    texts = [" ".join([*r.choice(vocab, 15), cue.get(i, "plain"), *r.choice(vocab, 5)]) for i in range(7500)]
    spark.createDataFrame([(i, int(i in cue)) for i in range(7500)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {x["doc_id"] for x in C.toxic(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path)).collect()}
    assert len(learnt) > 5900 and len(late) > 25 and not left & set(cue) and len(left) > 0.99 * (7500 - len(cue))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 20 == 0, F.concat("text", F.lit(' token = "'), F.sha1("text"), F.lit('"'))).otherwise(F.col("text")))
    columns, tables, seen = docs.columns, [docs], [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        tables.append(docs)
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()} if k < 4 else docs.collect())
        assert k == 4 or docs.columns == columns
    base, quality, toxic, single, masked, pieces = seen
    assert quality == {i: t for i, t in base.items() if not _rejected(t or "")}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    chain = toxicity.train(tables[1].select("doc_id", "text"), labels.select("doc_id", "toxic"))
    assert toxic == {i: t for i, t in quality.items() if plain_score(W.words(t), chain)[0] < 0.5} and len(toxic) < len(quality)
    groups = _groups(toxic)
    assert single == {i: t for i, t in toxic.items() if groups[i] == i}
    forest = secret_scan.learn(tables[3].select("doc_id", "text"))
    for i, t in single.items():
        want, at = "", 0
        for a, b, score in secret_scan.findings(t, forest):
            if score >= secret_scan.LIMIT:
                want, at = want + t[at:a] + "[SECRET]", b
        assert masked[i] == want + t[at:] and not re.search(r'token = "[0-9a-f]{40}"', masked[i])
    assert set(masked) == set(single) and any("[SECRET]" in t for t in masked.values())
    tokenizer = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    got, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        got[p["doc_id"]].append((p["start"], p["ids"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert {i: [x for _, ids in sorted(v) for x in ids] for i, v in got.items()} == {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in masked.items()}
    for s in sequences.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_stages_on_nulls_and_empty_tables(spark, docs, texts, empty, tmp_path):
    docs.select("doc_id").selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic").limit(3).write.parquet(str(tmp_path / "labels.parquet"))
    odd = docs.unionByName(docs.filter("doc_id < 3")).unionByName(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("hit", "k", "id", "mark", "doc", "gone", "n_words", "kept", "score", "shard"):
        odd = odd.withColumn(name, F.lit("x"))
    for name, table in (("some", docs), ("odd", odd), ("none", empty)):
        d = table
        for k, (_, stage) in enumerate(C.STAGES):
            place = str(tmp_path / name / str(k))
            stage(spark, d, str(tmp_path)).write.parquet(place)
            after = spark.read.parquet(place)
            assert k == 4 or (after.columns == d.columns and after.exceptAll(d).filter("text NOT LIKE '%[SECRET]%'").isEmpty())
            d = after
        assert (d.count() == 0) == (name == "none")
        if name == "odd":
            left = [r["doc_id"] for r in spark.read.parquet(str(tmp_path / name / "2")).collect()]
            assert None in left and len(left) == len(set(left)) and {0, 1, 2, 5} & set(left)
