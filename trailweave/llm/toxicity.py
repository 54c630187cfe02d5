"""Toxic spans by a linear-chain conditional random field.

Tags are clean (0) and toxic (1). Document labels become token labels by a greedy
cover: the cues (words or their stems) that best separate the toxic documents not yet explained from
the clean ones are taken, again and again, until none separates well. The chain
is trained on windows around those tokens and on windows of clean documents. Forward-
backward marginals give offending offsets; their maximum and sum give the document's
score through a small logistic calibration.

``train`` learns from every labelled document: cues are counted, windows cut, gradients summed and the
calibration fitted on the executors; the driver gets the cues, the vocabulary and the parameters.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import similarity
from trailweave.llm import words as W
from trailweave.llm.common import most_frequent, partitions, swept
from trailweave.llm.sieve import maybe, sieve
from trailweave.sources.shared import bucketed, place, scratch, written

#: Rows and characters of ``training_rows`` at most; ``train`` has no such bounds.
TRAIN_ROWS, TRAIN_CHARS = 4000, 30_000_000
WINDOW, STEPS, L2, SEED = 24, 50, 0.02, 17
#: Shares of the windows that steps take in turn, so each window is used STEPS / SHARES times or, where
#: there are fewer than SHARE windows a share, more often; windows whose gradient is taken at once.
SHARES, SHARE, BLOCK = 10, 4000, 4096
#: Most frequent cues in the chain's vocabulary beside the lexicon; cues that a task counts at once.
VOCABULARY, HELD = 50_000, 200_000
STEM = 5
#: Families with a cue for it to be taken beside the cover.
WITNESSES = 6
SPAN = 0.5


@dataclass
class Chain:
    """Parameters; a table's missing words count by their shape alone."""

    word: dict[str, float] = field(default_factory=dict)
    shape: np.ndarray = field(default_factory=lambda: np.zeros(16))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    doc: tuple[float, float, float] = (-20.0, 0.0, 0.0)


def shape(word: str) -> int:
    """Length class, and whether the word is letters only."""
    return min(len(word), 8) - 1 + 8 * (not word.isalpha())


class Emissions(dict):
    """word -> score of the toxic tag, filled on demand and bounded."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.weight, self.shapes = chain.word.get, chain.shape.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) > 150_000:
            self.clear()
        n, e = len(word), self.weight(word, 0.0)
        if n > STEM:
            e += self.weight(word[:STEM] + "*", 0.0)
        e += self.shapes[(n if n < 8 else 8) - 1 + 8 * (not word.isalpha())]
        e = self[word] = math.exp(-30.0 if e < -30.0 else min(e, 30.0))  # NumPy on single numbers takes many times as long
        return e


def _scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, width: int = 64) -> np.ndarray:
    """x[t] = (a + b x[t-1]) / (c + d x[t-1]) for all t, exactly, in blocks.

    Each step is a 2x2 matrix; blocks multiply theirs side by side, one pass links the
    blocks, and a second pass fills them in. b = d = 0 forgets what was before.
    """
    n = len(a)
    rows = -(-n // width)
    pad = rows * width - n
    A, B, C, D = (np.concatenate([x, np.full(pad, v)]).reshape(rows, width).T.copy() for x, v in ((a, 0.0), (b, 1.0), (c, 1.0), (d, 0.0)))
    p, q, r, s = np.zeros(rows), np.ones(rows), np.ones(rows), np.zeros(rows)  # x_out = (p + q x) / (r + s x)
    for k in range(width):
        p, q, r, s = A[k] * r + B[k] * p, A[k] * s + B[k] * q, C[k] * r + D[k] * p, C[k] * s + D[k] * q
        z = 1.0 / (p + q + r + s)
        p, q, r, s = p * z, q * z, r * z, s * z
    x, into = 1.0, np.empty(rows)
    for i, (pi, qi, ri, si) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        into[i] = x
        x = (pi + qi * x) / (ri + si * x)
    out = np.empty((width, rows))
    x = into
    for k in range(width):
        x = (A[k] + B[k] * x) / (C[k] + D[k] * x)
        out[k] = x
    return out.T.reshape(-1)[:n]


def marginals(emit: np.ndarray, starts: np.ndarray, chain: Chain) -> np.ndarray:
    """P(toxic) of every token; ``emit`` holds exp(score), ``starts`` the first token of each text."""
    n = len(emit)
    if n == 0:
        return np.zeros(0)
    t, s0 = np.exp(chain.trans), np.exp(chain.start)
    first = np.zeros(n, dtype=bool)
    first[starts] = True
    fwd = _scan(np.where(first, s0[1], t[0, 1]) * emit, np.where(first, 0.0, t[1, 1]) * emit, np.where(first, s0[0], t[0, 0]), np.where(first, 0.0, t[1, 0]))
    last = np.append(first[1:], True)
    nxt = np.append(emit[1:], 1.0)
    bwd = _scan(*(x[::-1] for x in (np.where(last, 1.0, t[1, 0]), np.where(last, 0.0, t[1, 1] * nxt), np.where(last, 1.0, t[0, 0]), np.where(last, 0.0, t[0, 1] * nxt))))[::-1]
    odds = fwd * bwd
    return odds / (1.0 + odds)


def cues(word: str) -> tuple[str, ...]:
    """What a toxic word may be known by: itself, and its stem if it is longer."""
    return (word, word[:STEM] + "*") if len(word) > STEM else (word,)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, y, text) of every document with a label, each id once, in buckets of the id. A sieve
    keeps other texts out of the shuffle, the only one that texts go through."""
    named = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
    known = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    known = maybe(known.withColumn("k", F.xxhash64("id")), sieve(named.select(F.xxhash64("id").alias("k"))), "hit").filter("hit")
    rows = known.select("id", "text").join(named, "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return bucketed(rows, ["id"], partitions(docs.sparkSession), "toxic-rows")


def leaders(rows: DataFrame) -> DataFrame:
    """(id, y) of documents that share no MinHash band of word shingles with one of the same label
    and a smaller id. Copies would make all their words look telling."""

    def run(batches):
        memo = W.WordHashes()
        for ids, ys, texts in W.chunks(batches, "id", "y", "text"):
            of, keys = [], []
            for k, s in enumerate(similarity.shingles([" ".join(W.words(t)) for t in texts], memo)):
                if len(s):
                    bands = np.frombuffer(similarity.signature(s), dtype=np.uint64)
                    keys.append(bands + np.arange(len(bands), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    of.append(np.full(len(bands), k))
            if of:
                k = np.concatenate(of)
                yield pa.RecordBatch.from_pydict({"id": np.array(ids)[k], "y": np.array(ys, dtype=np.int32)[k], "key": np.concatenate(keys).view(np.int64), "n": np.array([len(x) for x in of], dtype=np.int32).repeat([len(x) for x in of])})

    bands = rows.mapInArrow(W.released(run), "id long, y int, key long, n int")
    first = bands.groupBy("y", "key").agg(F.min(F.struct("id", "n")).alias("f"))
    return first.groupBy("f.id", "y", "f.n").agg(F.count("*").alias("led")).filter("led = n").select("id", "y")


def _counted(rows: DataFrame, cues_of, *columns: str) -> DataFrame:
    """(c, y, n): rows by cue and label; ``cues_of`` gives the cues and label of a row."""

    def batch(seen):
        keys = list(seen)
        return pa.RecordBatch.from_pydict({"c": pa.array([c for c, _ in keys], pa.string()), "y": pa.array([y for _, y in keys], pa.int32()), "n": pa.array(seen.values(), pa.int64())})

    def run(batches):
        seen = (Counter(), Counter())
        flat = lambda: {(c, y): n for y in (0, 1) for c, n in seen[y].items()}
        for lists in W.chunks(batches, *columns):
            for row in zip(*lists):
                found, y = cues_of(*row)
                seen[y].update(found)
                if len(seen[0]) + len(seen[1]) >= HELD:
                    yield batch(flat())
                    seen[0].clear(), seen[1].clear()
        yield batch(flat())

    return rows.mapInArrow(W.released(run), "c string, y int, n long").groupBy("c", "y").agg(F.sum("n").alias("n"))


def _cues_of_text(y: int, text: str):
    return {c for w in set(W.words(text)) for c in cues(w)}, y


def _separates(count, n, good, n_good):
    """How well a cue in ``count`` of n toxic and ``good`` of n_good clean documents separates them:
    its log odds ratio in standard errors."""
    odds = F.log((count + 0.5) / (n - count + 0.5)) - F.log((good + 0.5) / (n_good - good + 0.5))
    return odds / F.sqrt(1 / (count + 0.5) + 1 / (n - count + 0.5) + 1 / (good + 0.5) + 1 / (n_good - good + 0.5))


def lexicon(rows: DataFrame) -> set[str]:
    """Cues that explain toxic labels: a greedy cover of the toxic documents, and all other
    cues that are as one-sided, both of cues that separate all documents well. Of near copies one
    counts for each label.

    In each round a document that is not yet explained names the cue of its own that separates best;
    cues that separate well by the documents that name them are taken."""
    spark = rows.sparkSession
    first = bucketed(leaders(rows), ["id"], partitions(spark), "toxic-leaders")
    sizes = {r["y"]: r["n"] for r in first.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    ratio = n_bad / max(1, n_good)
    kept = rows.join(first.select("id"), "id", "left_semi")
    by_label = _counted(kept, _cues_of_text, "y", "text").groupBy("c").agg(*[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(n) for y, n in ((1, "total"), (0, "good"))])
    usual = (F.col("total") > 1) & (F.col("total") >= 4 * ratio * F.col("good")) & (F.col("good") <= 0.05 * n_good + 1)
    apart = _separates(F.col("total"), n_bad, F.col("good"), n_good) >= 2.5
    names = written(by_label.filter(usual & apart), "toxic-cues")
    share = F.col("total") / F.greatest(F.lit(1.0), F.col("total") + ratio * F.col("good"))
    taken = {r["c"] for r in names.filter((F.col("total") >= WITNESSES) & (share >= 0.95)).select("c").collect()}

    def run(batches):
        for ids, texts in W.chunks(batches, "id", "text"):
            found = [sorted(_cues_of_text(1, t)[0]) for t in texts]
            yield pa.RecordBatch.from_pydict({"id": np.array(ids, dtype=np.int64).repeat([len(f) for f in found]), "c": pa.array([c for f in found for c in f], pa.string())})

    held = kept.filter("y = 1").select("id", "text").mapInArrow(W.released(run), "id long, c string").withColumn("k", F.xxhash64("c"))
    left, n = maybe(held, sieve(names.select(F.xxhash64("c").alias("k"))), "hit").filter("hit").select("id", "c").join(names.select("c", "good"), "c"), n_bad
    while True:
        left = written(left, "toxic-left")
        z = left.groupBy("c").agg(F.count("*").alias("k"), F.first("good").alias("good")).filter("k > 1").select("c", "good", _separates(F.col("k"), n, F.col("good"), n_good).alias("z")).filter("z >= 2.5")
        named = left.select("id", "c").join(z, "c").groupBy("id").agg(F.max(F.struct("z", "c", "good")).alias("best"))
        votes = named.groupBy("best.c", "best.good").agg(F.count("*").alias("k")).filter((F.col("k") > 1) & (_separates(F.col("k"), n, F.col("good"), n_good) >= 2.5))
        votes = written(votes.select("c"), "toxic-votes")
        new = {r["c"] for r in votes.collect()}
        if not new:
            return taken
        taken |= new
        done = written(left.join(votes, "c", "left_semi").select("id").distinct(), "toxic-done")
        n -= done.count()
        left = left.join(done, "id", "left_anti")


def _windows(rows: DataFrame, bad: set[str]) -> DataFrame:
    """(share, w, tags): windows of WINDOW words, joined by blanks, and their tags as digits. Up to six
    around cues of a toxic document; two anywhere in one without cues and in a clean one, and up to
    three around what looks like a cue in clean text, which counts as clean."""

    def run(batches):
        memo: dict[str, bool] = {}
        for ids, ys, texts in W.chunks(batches, "id", "y", "text"):
            shares, words, marks = [], [], []
            for k, y, t in zip(ids, ys, texts):
                d = W.words(t)
                if not d:
                    continue
                if len(memo) > HELD:
                    memo.clear()
                for w in set(d):
                    if w not in memo:
                        memo[w] = not bad.isdisjoint(cues(w))
                hits = [i for i, w in enumerate(d) if memo[w]]
                rng = np.random.default_rng([SEED, k & (2**64 - 1)])
                places = hits[:6] if y and hits else [int(rng.integers(len(d)))] * 2 + hits[:3]
                for at in places:
                    lo = max(0, at - int(rng.integers(WINDOW)))
                    part = d[lo : lo + WINDOW]
                    shares.append(k % SHARES)
                    words.append(" ".join(part))
                    marks.append("".join("1" if y and memo[w] else "0" for w in part))
            yield pa.RecordBatch.from_pydict({"share": pa.array(shares, pa.int32()), "w": pa.array(words, pa.string()), "tags": pa.array(marks, pa.string())})

    return rows.mapInArrow(W.released(run), "share int, w string, tags string")


def _arrays(windows: list[tuple[str, str]], vocab: dict[str, int]) -> tuple[np.ndarray, ...]:
    """X, Z, S, Y, on of ``_gradient``."""
    X, Z, S, Y, on = (np.zeros((len(windows), WINDOW), dtype=np.int32) for _ in range(5))
    oov = len(vocab)
    X[:], Z[:] = oov, oov
    for i, (w, tags) in enumerate(windows):
        s = w.split(" ")
        k = len(s)
        S[i, :k], Y[i, :k], on[i, :k] = [shape(x) for x in s], [int(x) for x in tags], 1
        X[i, :k], Z[i, :k] = [vocab.get(x, oov) for x in s], [vocab.get(cues(x)[-1], oov) if len(x) > STEM else oov for x in s]
    return X, Z, S, Y, on


def _blocks(windows: DataFrame, vocab: dict[str, int], shares: int) -> list[DataFrame]:
    """The windows of each share as arrays, BLOCK at most in a row."""

    def run(batches):
        held: dict[int, list] = {}

        def block(k):
            got = held.pop(k)
            return pa.RecordBatch.from_pydict({"share": pa.array([k], pa.int32()), "m": pa.array([len(got)], pa.int32()), "x": pa.array([np.stack(_arrays(got, vocab)).tobytes()], pa.binary())})

        for ks, ws, tags in W.chunks(batches, "share", "w", "tags"):
            for k, w, t in zip(ks, ws, tags):
                own = held.setdefault(k % shares, [])
                own.append((w, t))
                if len(own) == BLOCK:
                    yield block(k % shares)
        for k in list(held):
            yield block(k)

    spark = windows.sparkSession
    path = place(spark, "toxic-blocks")
    windows.mapInArrow(W.released(run), "share int, m int, x binary").write.partitionBy("share").parquet(path)
    all_ = spark.read.schema("m int, x binary, share int").parquet(path)
    return [all_.filter(F.col("share") == k).select("m", "x") for k in range(shares)]


def _summed(blocks: DataFrame, theta: np.ndarray, oov: int) -> tuple[np.ndarray, int]:
    """The gradient of all blocks, and how many windows they hold. As many tasks as the cluster runs at
    once, each for several blocks, send the driver what is not 0: however many blocks there are, it
    gets no more. The parameters go out as a broadcast, which ends with the step."""

    context = blocks.sparkSession.sparkContext
    sent = context.broadcast(theta)

    def run(batches):
        g, m = np.zeros_like(sent.value), 0
        for b in batches:
            for n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                X, Z, S, Y, on = np.frombuffer(x, dtype=np.int32).reshape(5, n, WINDOW)
                g += _gradient(sent.value, X, Z, S, Y, on, on.sum(1), oov)
                m += n
        at = np.flatnonzero(g)
        yield pa.RecordBatch.from_pydict({"m": pa.array([m], pa.int64()), "at": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "g": pa.array([g[at].tobytes()], pa.binary())})

    g, m = np.zeros_like(theta), 0
    for r in blocks.coalesce(context.defaultParallelism).mapInArrow(run, "m long, at binary, g binary").collect():
        g[np.frombuffer(r["at"], dtype=np.int32)] += np.frombuffer(r["g"])
        m += r["m"]
    sent.destroy()
    return g, m


def _calibrated(known: DataFrame) -> tuple[float, float, float]:
    """Logistic regression of y on (1, f1, f2) by Newton steps with a weak prior. A step's sums are
    taken in Python: numbers in a Spark expression would be compiled anew at each step."""
    w = np.zeros(3)

    def run(batches):
        g, h = np.zeros(3), np.zeros((3, 3))
        for b in batches:
            y, f1, f2 = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns)
            x = np.stack([np.ones(len(y)), f1, f2])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g += x @ (y - p)
            h += (x * (p * (1 - p))) @ x.T
        yield pa.RecordBatch.from_pydict({"s": pa.array([np.append(g, h).tolist()], pa.list_(pa.float64()))})

    some = known.select("y", "f1", "f2")
    for _ in range(40):
        got = np.sum([r["s"] for r in some.mapInArrow(run, "s array<double>").collect()] or [[0.0] * 12], axis=0)
        step = np.linalg.solve(got[3:].reshape(3, 3) + 0.05 * np.eye(3), got[:3] - 0.05 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain and the calibration, of every labelled document with a text, copies of
    a row once. No toxic labels give a chain that scores near 0."""
    with scratch(docs.sparkSession):
        rows = _labelled(docs, labels)
        if rows.filter("y = 1").isEmpty():
            return Chain()
        bad = lexicon(rows)
        swept(docs.sparkSession)
        windows = written(_windows(rows, bad), "toxic-windows")
        m = windows.count()
        if not m:
            return Chain()
        counts = _counted(windows, lambda w: ([c for x in w.split(" ") for c in cues(x)], 0), "w").select("c", "n")
        vocab = {c: i for i, c in enumerate(sorted(most_frequent(written(counts.filter("n > 1"), "toxic-vocabulary"), "c", VOCABULARY) | bad))}
        oov = len(vocab)
        shares = max(1, min(SHARES, m // SHARE))
        blocks = _blocks(windows, vocab, shares)
        theta = np.zeros(oov + 1 + 16 + 4 + 2)
        m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            g, n = _summed(blocks[step % shares], theta, oov)
            g = g / max(1, n) - L2 / np.sqrt(m) * theta * 0.1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            theta = theta + 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            if step % SHARES == 0:
                swept(docs.sparkSession)
        wv, sv, tr, st = np.split(theta, [oov + 1, oov + 17, oov + 21])
        chain = Chain({w: float(wv[i]) for w, i in vocab.items()}, sv, tr.reshape(2, 2), st)

        def run(batches):
            memo = Emissions(chain)
            for ys, texts in W.chunks(batches, "y", "text"):
                _, f1, f2 = doc_features([W.words(t) for t in texts], memo, chain)
                yield pa.RecordBatch.from_pydict({"y": pa.array(ys, pa.int32()), "f1": f1, "f2": f2})

        chain.doc = _calibrated(written(rows.select("y", "text").mapInArrow(W.released(run), "y int, f1 double, f2 double"), "toxic-known"))
        swept(docs.sparkSession)
        return chain


def fit(texts: list[str], toxic: list[int]) -> Chain:
    """``train`` on a few texts and their labels."""
    spark = SparkSession.active()
    rows = list(enumerate(texts))
    return train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int"))


def _gradient(theta, X, Z, S, Y, on, lengths, oov):
    """Of the log likelihood: observed minus expected feature counts."""
    wv, sv, tr, st = np.split(theta, [oov + 1, oov + 17, oov + 21])
    T, s0 = np.exp(tr.reshape(2, 2)), np.exp(st)
    wv = np.append(wv[:-1], 0.0)
    E = np.exp(np.clip(wv[X] + wv[Z] + sv[S], -30, 30))
    m, n = X.shape
    al, be = np.zeros((n, m, 2)), np.ones((n, m, 2))
    for t in range(n):
        e = np.stack([np.ones(m), E[:, t]], 1)
        x = np.tile(s0, (m, 1)) * e if t == 0 else (al[t - 1] @ T) * e
        al[t] = x / x.sum(1, keepdims=True)
    for t in range(n - 2, -1, -1):
        x = (be[t + 1] * np.stack([np.ones(m), E[:, t + 1]], 1)) @ T.T
        x /= x.sum(1, keepdims=True)
        be[t] = np.where((lengths <= t + 1)[:, None], 1.0, x)
    post = al * be
    post /= post.sum(2, keepdims=True)
    diff = (Y - post[:, :, 1].T) * on
    g = np.zeros_like(theta)
    g[: oov + 1] = np.bincount(X.ravel(), diff.ravel(), oov + 1) + np.bincount(Z.ravel(), diff.ravel(), oov + 1)
    g[oov] = 0.0
    g[oov + 1 : oov + 17] = np.bincount(S.ravel(), diff.ravel(), 16)
    gt = np.zeros((2, 2))
    for t in range(1, n):
        pair = al[t - 1][:, :, None] * T[None] * (be[t] * np.stack([np.ones(m), E[:, t]], 1))[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        seen = np.zeros((m, 2, 2))
        seen[np.arange(m), Y[:, t - 1], Y[:, t]] = 1
        gt += ((seen - pair) * on[:, t][:, None, None]).sum(0)
    g[oov + 17 : oov + 21] = gt.ravel()
    g[oov + 21 :] = np.bincount(Y[:, 0], minlength=2) - post[0].sum(0)
    return g


def doc_features(docs: list[list[str]], memo: Emissions, chain: Chain):
    """Marginals of all words, and per document: log odds of the largest marginal, log of
    the expected number of toxic words. Documents without words get -12 for both."""
    lens = np.array([len(d) for d in docs], dtype=np.int64)
    first, full = W.starts_of(lens), lens > 0
    emit = np.fromiter(map(memo.__getitem__, itertools.chain.from_iterable(docs)), dtype=np.float64, count=int(lens.sum()))
    p = marginals(emit, first[full], chain)
    f1, f2 = np.full(len(docs), -12.0), np.full(len(docs), -12.0)
    if len(p):
        top = np.clip(np.maximum.reduceat(p, first[full]), 1e-5, 1 - 1e-5)
        f1[full] = np.log(top / (1 - top))
        f2[full] = np.log(np.maximum(np.add.reduceat(p, first[full]), 6e-6))
    return p, f1, f2


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> list:
    """A bounded sample of labelled documents to look at on the driver; ``train`` takes all: whole texts by ascending hash of the id, as
    many as ``rows`` and, together, ``chars`` characters allow. Ids and lengths come first,
    alone; texts are read for the chosen ones only. Copies of a row count once."""
    named = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = named.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(rows)
    known = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sizes = known.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("mark"), F.max(F.length("text")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    taken, left = [], chars
    for r in sizes:
        if r["n"] <= left:
            taken.append((r["doc_id"], r["mark"]))
            left -= r["n"]
    wanted = docs.sparkSession.createDataFrame(taken, known.select("doc_id", F.xxhash64("text").alias("mark")).schema)
    texts = known.join(F.broadcast(wanted.withColumnRenamed("doc_id", "_id")), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("mark")))
    got = {r["doc_id"]: r for r in texts.select("doc_id", "text", "toxic").toLocalIterator()}
    return [got[d] for d, _ in taken if d in got]


SCHEMA = "doc_id long, score double, predicted int, n_spans int, spans array<struct<start:int,end:int,probability:double>>"


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Score every whole text of (doc_id, text): doc_id, score, predicted, n_spans, spans.

    Spans are code-point offsets of runs of words with a marginal of SPAN or more. Null
    and empty texts get the score of a text without words and no spans; repeated rows
    are scored each; an empty table gives no rows.
    """

    def run(batches):
        memo = Emissions(chain)
        b0, b1, b2 = chain.doc
        for ids, texts in W.chunks(batches, "doc_id", "text"):
            toks = [W.words(t) for t in texts]
            lens = [len(t) for t in toks]
            p, f1, f2 = doc_features(toks, memo, chain)
            y = 1 / (1 + np.exp(-np.clip(b0 + b1 * f1 + b2 * f2, -30, 30)))
            spans = [_spans(t, p[a : a + n]) if n and m >= 0 else [] for t, a, n, m in zip(texts, W.starts_of(lens), lens, f1)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(ids, pa.int64()), "score": y, "predicted": pa.array((y >= 0.5).astype(np.int32)), "n_spans": pa.array([len(s) for s in spans], pa.int32()), "spans": pa.array(spans, _SPANS)}
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(W.released(run), SCHEMA)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Neighbouring toxic words as one span, by the words' places in the text as written."""
    lower, place = text, None
    if not _latin(text):  # a letter may be longer in lower case
        lower = text.lower()
        if len(lower) != len(text):
            place = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
    out: list[dict] = []
    before = -2
    for i, m in enumerate(W._WORD.finditer(lower)):
        if i < len(p) and p[i] >= SPAN:
            start, end = m.span() if place is None else (int(place[m.start()]), int(place[m.end() - 1]) + 1)
            if before == i - 1:
                out[-1]["end"], out[-1]["probability"] = end, max(out[-1]["probability"], float(p[i]))
            else:
                out.append({"start": start, "end": end, "probability": float(p[i])})
            before = i
    return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def keep_clean(docs: DataFrame, chain: Chain, limit: float = 0.5) -> DataFrame:
    """Rows whose text scores below ``limit``, with all columns; no shuffle."""

    def run(batches):
        memo = Emissions(chain)
        b0, b1, b2 = chain.doc
        for b in batches:
            keep = [np.zeros(0, dtype=bool)]
            for (part,) in W.chunks([b], "text"):
                _, f1, f2 = doc_features([W.words(t) for t in part], memo, chain)
                keep.append(1 / (1 + np.exp(-np.clip(b0 + b1 * f1 + b2 * f2, -30, 30))) < limit)
            yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(W.released(run), docs.schema)
