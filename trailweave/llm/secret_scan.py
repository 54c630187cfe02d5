"""Secret scanning: candidates by pattern, false positives removed by a random forest.

The forest looks at a candidate's length, its changes between character classes, how much
of it dictionary words cover, whether it sits in a path, and the words around it. ``learn``
trains it on labelled findings of two kinds: candidates of the documents whose label rules
settle (``evidence``: an issuer's exact format, a decoded token header, a check digit, an
e-mail address, the length of a named digest), all of all documents, and, for forms that a
corpus may lack, made-up ones (``labelled_findings``). The features show the forest much of what the rules look at - an
issued beginning, the words before a value - so it learns to carry these rules over to
candidates that they leave open, and agreement with them is no independent test of it. The
dictionary is the fixed words and the most frequent words of all documents. Words are counted,
findings gathered and trees grown on the executors; the driver gets the dictionary and the trees.
"""

from __future__ import annotations

import base64
import json
import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm import words as W
from trailweave.llm.common import most_frequent
from trailweave.sources.shared import place, scratch, written

TREES, DEPTH, FINDINGS, SEED, LIMIT = 40, 9, 6000, 11, 0.5
#: Weight of the documents' findings together at most, half for each label; most frequent words
#: in the dictionary; words that a task counts at once.
FOUND, DICTIONARY, HELD = 6000, 20_000, 200_000
_RUN = re.compile(r"(?<![A-Za-z0-9+/_~.-])[A-Za-z0-9+/_~-][A-Za-z0-9+/_~.-]{15,}={0,2}")
_NAMED = re.compile(r"(?i)(?:passw(?:or)?d|passwd|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth)\w{0,20}[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?([^\s\"',;<>()]{6,})")
_MARK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?")
_TELLS = re.compile(r"(?i)passw|passwd|pwd|secret|token|credential|key|auth|bearer|login")
_HARMLESS = re.compile(r"(?i)sha|md5|digest|checksum|hash|commit|uuid|guid|etag|revision|file|path|url|href|src|version|build|id\b")
_DUMMY = re.compile(r"(?i)example|placeholder|changeme|your|dummy|sample|test|xxx|<|\$\{|\*\*\*|\.\.\.")
#: Beginnings that issuers give to their keys.
_ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ", "npm_", "SG.")
#: Words that names and paths are made of.
_WORDS = frozenset(
    "the and for with this that from have are was not you all can data file name user test main core base util utils index page "
    "image images static assets public private local home src lib bin etc var usr tmp http https www com org net html json xml "
    "config default version build release update create delete select insert value values string number array object class model "
    "view controller service manager handler request response client server token secret password key auth login access admin "
    "account email address phone order item product customer report table column field record system network security group "
    "python java script node module package docs read write load save open close start stop time date day month year long short "
    "example sample dummy placeholder change your here license general apache foundation work under".split()
)


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _covered(s: str, words: frozenset[str] = _WORDS) -> float:
    """Share of letters and digits that dictionary words of three letters or more cover."""
    parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", s).lower())
    known = 0
    for p in parts:
        i = 0
        while i < len(p):
            for n in range(min(12, len(p) - i), 2, -1):
                if p[i : i + n] in words:
                    known += n
                    i += n
                    break
            else:
                i += 1
    return known / max(1, sum(c.isalnum() for c in s))


NAMES = ("length", "changes", "digits", "upper", "hex", "entropy", "vowel_run", "covered", "path", "issued", "assigned", "quoted", "tell", "harmless", "dummy", "letters_only")
#: Where trees may split each feature (0.5: yes or no), so that no threshold depends on
#: which findings are looked at.
_SHARES = tuple(i / 20 for i in range(1, 20))
CUTS = {n: (0.5,) for n in NAMES} | {n: _SHARES for n in ("changes", "digits", "upper", "vowel_run", "covered")}
CUTS |= {"length": tuple(i + 0.5 for i in (*range(6, 26), 27, 31, 32, 35, 36, 39, 40, 43, 44, 47, 48, 55, 63, 64, 79, 87, 88, 127, 199)), "entropy": tuple(i / 4 for i in range(1, 27))}
STEPS = [(f, cut) for f, n in enumerate(NAMES) for cut in CUTS[n]]


def features(value: str, before: str, after: str, words: frozenset[str] = _WORDS) -> list[float]:
    """Of a candidate and up to 40 characters on either side."""
    n, kinds = len(value), [_class(c) for c in value]
    counts = Counter(value)
    letters = sum(k < 2 for k in kinds)
    word_before = " ".join(re.findall(r"[\w-]+", before)[-3:])
    return [
        float(min(n, 200)),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        kinds.count(2) / n,
        kinds.count(1) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        sum(c in "aeiouäöüéèáíóú" for c in value.lower()) / max(1, letters),
        _covered(value, words),
        float(value.count("/") >= 2 or value.startswith(("/", "./")) or bool(re.search(r"\.[a-z]{2,4}$", value)) or before.endswith(("/", "\\"))),
        float(value.startswith(_ISSUED)),
        float(bool(re.search(r"(?::=|=>|[:=])\s*[\"']?$", before))),
        float(before.endswith(('"', "'")) and after[:1] in ('"', "'")),
        float(bool(_TELLS.search(word_before))),
        float(bool(_HARMLESS.search(word_before))),
        float(bool(_DUMMY.search(value))),
        float(letters == n),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = SEED, words: frozenset[str] = _WORDS) -> tuple[list[list[float]], list[int]]:
    """n made-up findings with labels (1: secret), half of each, drawn by a seeded generator."""
    r = random.Random(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "th", "le", "on", "ti", "ou", "che", "ver", "ment", "ción", "ung", "re")) for _ in range(r.randint(1, 4)))
    known = sorted(_WORDS)
    X, y = [], []
    for i in range(n):
        secret = i % 2
        pre, post = " ".join(word() for _ in range(4)) + " ", " " + word()
        quote = r.choice(('"', "'", ""))
        if secret:
            value = r.choice(
                (
                    lambda: some("0123456789abcdef", r.choice((32, 40, 48, 64))),
                    lambda: some(lower + upper + digit, r.randint(16, 64)),
                    lambda: some(lower + upper + digit + "+/", r.choice((40, 44, 64, 88))),
                    lambda: r.choice(_ISSUED) + some(lower + upper + digit, r.randint(16, 40)),
                    lambda: word().capitalize() + some(digit, 3) + some("!#%_-+", 2) + some(lower + upper + digit, r.randint(1, 6)),
                )
            )()
            name = r.choice(("token", "secret", "password", "api_key", "API_KEY", "access_key", "auth_token", "client_secret", "passwd", "Bearer"))
            if value.startswith(_ISSUED) and r.random() < 0.4:
                before, after = pre + quote, quote + post
            else:
                before, after = pre + name + r.choice((" = ", "=", ": ", ":", " := ")) + quote, quote + post
        else:
            kind = r.randrange(8)
            value = (
                lambda: some("0123456789abcdef", r.choice((32, 40, 64))),
                lambda: "-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
                lambda: "/" * r.randint(0, 1) + "/".join(r.choice(known) for _ in range(r.randint(3, 6))) + r.choice(("", ".py", ".html", ".json")),
                lambda: "".join(word() for _ in range(5)),
                lambda: "_".join(r.choice(known) for _ in range(r.randint(3, 5))) + r.choice(("", some(digit, 2))),
                lambda: some(digit, r.randint(16, 20)),
                lambda: r.choice(("your_api_key_here", "xxxxxxxxxxxxxxxx", "changeme_please", "example-token-value", "placeholder_secret")) + some(digit, r.randint(0, 2)),
                lambda: r.choice(("-", "=", "_", "~")) * r.randint(16, 60),
            )[kind]()
            if kind < 2:
                before = pre + r.choice(("sha1 ", "md5: ", "checksum ", "commit ", "uuid=", "digest = ", "etag: ", "revision ")) + quote
            elif kind in (3, 4) and r.random() < 0.3 or kind == 6:
                before = pre + r.choice(("token = ", "password: ", "key=")) + quote
            else:
                before = pre + quote
            after = quote + post
        X.append(features(value, before[-40:], after[:40], words))
        y.append(secret)
    return X, y


#: The exact formats of issuers' keys.
_EXACT = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|glpat-[\w-]{20}|xox[bp]-\d{8,}-[\w-]{16,}|sk_live_[A-Za-z0-9]{24,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{22}\.[\w-]{43}")
_DIGEST = re.compile(r"(?i)(?:md5|sha-?1|sha-?256|sha|commit|revision|checksum|digest|etag)\W{1,4}$")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}")


def evidence(text: str, a: int, b: int) -> int | None:
    """1 or 0 where a rule settles what text[a:b] is, else None."""
    value, before = text[a:b], text[max(0, a - 80) : a]
    if value.startswith("-----BEGIN ") or _EXACT.fullmatch(value):
        return 1
    parts = value.split(".")
    if len(parts) == 3 and value.startswith("eyJ"):
        try:
            return int("alg" in json.loads(base64.urlsafe_b64decode(parts[0] + "=" * (-len(parts[0]) % 4))))
        except ValueError:
            return 0
    if re.search(r"[\w.%+-]@$", before) or re.match(r"[\w.%+-]*@[\w-]+\.", text[a : b + 80]):
        return 0  # an e-mail address
    if re.search(r"://\S*$", before) or _UUID.fullmatch(value) or len(set(value)) < 3:
        return 0
    if value.isdigit():
        double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(value))]
        return 0 if sum(d - 9 * (d > 9) for d in double) % 10 == 0 else None
    named = _NAMED.search(text, max(0, a - 60), min(len(text), b + 2))
    if named and named.span(1) == (a, b) and before[-1:] in "\"'" and text[b : b + 1] == before[-1:]:
        # A name that says so, in quotes; whether the value is drawn at random shows in its pairs of characters.
        pairs = len({value[i : i + 2] for i in range(len(value) - 1)})
        return 1 if len(value) >= 20 and pairs >= 0.75 * min(len(value) - 1, 256) and not _DUMMY.search(value) else 0 if _DUMMY.search(value) else None
    if _DIGEST.search(before) and re.fullmatch(r"(?i)[0-9a-f]+", value) and len(value) in (32, 40, 64):
        return 0
    return None


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, left and right child, share of secrets;
    and the dictionary of the features."""

    trees: list[tuple[np.ndarray, ...]]
    words: frozenset[str] = _WORDS

    def score(self, X: np.ndarray) -> np.ndarray:
        total = np.zeros(len(X))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(X), dtype=np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                k = at[rows]
                at[rows] = np.where(X[rows, feature[k]] <= cut[k], left[k], right[k])
            total += share[at]
        return total / max(1, len(self.trees))


def fit(X: list[list[float]], y: list[int], trees: int = TREES, depth: int = DEPTH, seed: int = SEED, words: frozenset[str] = _WORDS) -> Forest:
    """Of few findings, on the driver, at any thresholds (``grown``: of many, by Spark): bootstrap
    samples, a random third of the features at each node, Gini splits."""
    X, y = np.array(X, dtype=float), np.array(y, dtype=float)
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        nodes: list[list] = []

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, 0, 0, y[rows].mean()])
            if level == depth or len(rows) < 8 or nodes[me][4] in (0.0, 1.0):
                return me
            best = (1e-9, None, None)
            base = len(rows) * nodes[me][4] * (1 - nodes[me][4])
            for f in rng.choice(X.shape[1], max(1, X.shape[1] // 3), replace=False):
                order = np.argsort(X[rows, f], kind="stable")
                x, c = X[rows[order], f], np.cumsum(y[rows[order]])
                k = np.flatnonzero(x[1:] > x[:-1]) + 1
                if not len(k):
                    continue
                a, b = c[k - 1] / k, (c[-1] - c[k - 1]) / (len(rows) - k)
                gain = base - k * a * (1 - a) - (len(rows) - k) * b * (1 - b)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], f, (x[k[i] - 1] + x[k[i]]) / 2)
            if best[1] is None:
                return me
            low = X[rows, best[1]] <= best[2]
            nodes[me][0], nodes[me][1] = int(best[1]), float(best[2])
            nodes[me][2] = grow(rows[low], level + 1)
            nodes[me][3] = grow(rows[~low], level + 1)
            return me

        grow(rng.integers(len(X), size=len(X)), 0)
        out.append(tuple(np.array(c) for c in zip(*nodes)))
    return Forest(out, words)


def document_findings(docs: DataFrame) -> DataFrame:
    """(doc_id, value, before, after, label) of the candidates that ``evidence`` settles."""

    def run(batches):
        for ids, texts in W.chunks(batches, "doc_id", "text"):
            rows = [(d, t[a:b], t[max(0, a - 40) : a], t[b : b + 40], y) for d, t in zip(ids, texts) for a, b in candidates(t) if (y := evidence(t, a, b)) is not None]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(cols[0], pa.int64()), **{n: pa.array(c, pa.string()) for n, c in zip(("value", "before", "after"), cols[1:4])}, "label": pa.array(cols[4], pa.int32())})

    return docs.mapInArrow(W.released(run), "doc_id long, value string, before string, after string, label int")


_REST = re.compile(r"\w*")


def _pieces(text: str, size: int = W.CHUNK_CHARS):
    """A text in pieces of about ``size`` characters that end where a word does."""
    at = 0
    while at < len(text):
        end = _REST.match(text, min(len(text), at + size)).end()
        yield text[at:end]
        at = end


def dictionary(docs: DataFrame) -> frozenset[str]:
    """The fixed words and, of the words of 3 to 12 letters that are in 5 documents or more, the
    DICTIONARY most frequent."""

    def batch(seen):
        kept = [w for w in seen if 3 <= len(w) <= 12 and w.isascii() and w.isalpha()]
        return pa.RecordBatch.from_pydict({"w": pa.array(kept, pa.string()), "n": pa.array([seen[w] for w in kept], pa.int64())})

    def run(batches):
        seen: Counter = Counter()
        for (texts,) in W.chunks(batches, "text"):
            for t in texts:
                own: set[str] = set()
                for piece in _pieces(t):
                    own.update(W.words(piece))
                seen.update(own)
                if len(seen) >= HELD:
                    yield batch(seen)
                    seen.clear()
        yield batch(seen)

    with scratch(docs.sparkSession):
        counts = docs.select("text").mapInArrow(W.released(run), "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
        counts = written(counts.filter("n >= 5"), "secret-words")
        return _WORDS | most_frequent(counts, "w", DICTIONARY)


_FOUND = "x array<double>, label double, weight double"


def _weight(n: int) -> float:
    """Of each of n findings with a label: a power of two, so that sums are exact in any order."""
    return 2.0 ** -max(0, math.ceil(math.log2(2 * n / FOUND)))


def learn(docs: DataFrame) -> Forest:
    """A forest for the documents: made-up findings, and all of theirs. Copies of a value count
    once for a label; however many there are, a label's findings weigh FOUND / 2 together at most,
    so that neither label nor the made-up forms are outweighed. Documents without findings
    leave the made-up ones."""
    spark = docs.sparkSession
    with scratch(spark):
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        words = dictionary(docs)
        own = document_findings(docs).groupBy("label", "value").agg(F.min(F.struct("before", "after")).alias("x")).select("label", "value", "x.*")
        own = written(own, "secret-findings")
        weights = {r["label"]: _weight(r["n"]) for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}

        def run(batches):
            for b in batches:
                labels, *rest = (b.column(k).to_pylist() for k in range(4))
                X = [features(*row, words) for row in zip(*rest)]
                yield pa.RecordBatch.from_pydict({"x": pa.array(X, pa.list_(pa.float64())), "label": pa.array(labels, pa.float64()), "weight": pa.array([weights[y] for y in labels], pa.float64())})

        X, y = labelled_findings(words=words)
        rows = spark.createDataFrame([(x, float(label), 1.0) for x, label in zip(X, y)], _FOUND)
        rows = written(rows.unionByName(own.select("label", "value", "before", "after").mapInArrow(W.released(run), _FOUND)), "secret-features")
        return grown(rows, words)


def grown(rows: DataFrame, words: frozenset[str] = _WORDS, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """A forest from rows (x, label, weight), grown on all of them by Spark: a third of the steps
    at each node, every tree on every row. Each step of STEPS is a feature of two values, which
    Spark splits as it is; of numbers it would take thresholds from a sample."""
    spark = rows.sparkSession
    steps = F.array(*[(F.get("x", F.lit(f)) > cut).cast("double") for f, cut in STEPS])
    meta = {"ml_attr": {"attrs": {"binary": [{"idx": i, "name": f"s{i}"} for i in range(len(STEPS))]}, "num_attrs": len(STEPS)}}
    rows = rows.select("label", "weight", array_to_vector(steps).alias("features", metadata=meta))
    # The mean of the labels in a leaf is its share of secrets.
    model = RandomForestRegressor(weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, bootstrap=False, featureSubsetStrategy="onethird", minInstancesPerNode=4).fit(rows)
    path = place(spark, "secret-forest")
    model.write().save(path)
    found: list[list[list]] = [[] for _ in range(trees)]
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect():
        left, right, split = r["leftChild"], r["rightChild"], r["split"]
        f, cut = STEPS[split["featureIndex"]] if left >= 0 else (-1, 0.0)
        if left >= 0 and list(split["leftCategoriesOrThreshold"]) != [0.0]:
            left, right = right, left
        found[r["treeID"]].append([f, cut, max(0, left), max(0, right), r["prediction"]])
    return Forest([tuple(np.array(c) for c in zip(*nodes)) for nodes in found], words)


def candidates(text: str) -> list[tuple[int, int]]:
    """Code-point ranges that may be secrets: long runs with a digit, of mixed
    case or with an issued beginning, values
    assigned to telling names, private key blocks. Overlaps keep the first and longest."""
    found = [m.span() for m in _RUN.finditer(text) if any(c.isdigit() for c in m[0]) or m[0].startswith(_ISSUED) or sum(a.islower() and b.isupper() for a, b in zip(m[0], m[0][1:])) > 1]
    if "=" in text or ":" in text:
        found += [m.span(1) for m in _NAMED.finditer(text)]
    if "-----BEGIN " in text:
        found += [m.span() for m in _MARK.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        b -= len(text[a:b]) - len(text[a:b].rstrip(".=,;:") or text[a:b]) if not text[b - 1] == "=" else 0
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def findings(text: str, forest: Forest) -> list[tuple[int, int, float]]:
    spans = candidates(text)
    if not spans:
        return []
    X = np.array([features(text[a:b], text[max(0, a - 40) : a], text[b : b + 40], forest.words) for a, b in spans])
    score = forest.score(X)
    return [(a, b, 1.0 if text.startswith("-----BEGIN ", a) else float(s)) for (a, b), s in zip(spans, score)]


SCHEMA = "doc_id long, n_candidates int, n_secrets int, findings array<struct<start:int,end:int,score:double,secret:boolean>>"
_FINDINGS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("secret", pa.bool_())]))


def scan(docs: DataFrame, forest: Forest, limit: float = LIMIT) -> DataFrame:
    """One row per document with its candidates, each scored; secrets score ``limit`` or more.

    Null and empty texts have none; repeated rows are scanned each; an empty table gives no rows.
    """

    def run(batches):
        for ids, texts in W.chunks(batches, "doc_id", "text"):
            got = [findings(t, forest) for t in texts]
            rows = [[{"start": a, "end": b, "score": s, "secret": s >= limit} for a, b, s in g] for g in got]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(ids, pa.int64()), "n_candidates": pa.array([len(g) for g in got], pa.int32()), "n_secrets": pa.array([sum(x["secret"] for x in g) for g in rows], pa.int32()), "findings": pa.array(rows, _FINDINGS)}
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(W.released(run), SCHEMA)


def redact(docs: DataFrame, forest: Forest, limit: float = LIMIT, mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with every secret in ``text`` replaced by ``mask`` and
    ``n_chars``, where there is such a column, set to the new length. Null texts stay null."""

    def run(batches):
        for b in batches:
            names = b.schema.names
            texts = b.column(names.index("text")).to_pylist()  # all of a batch: common.BATCH_BYTES bounds it
            clean = [t and _masked(t, [f for f in findings(t, forest) if f[2] >= limit], mask) for t in texts]
            cols = list(b.columns)
            cols[names.index("text")] = pa.array(clean, b.schema.field("text").type)
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([n if t is None or t == old else len(t) for t, old, n in zip(clean, texts, cols[k].to_pylist())], cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(W.released(run), docs.schema)


def _masked(text: str, found: list[tuple[int, int, float]], mask: str) -> str:
    for a, b, _ in reversed(found):
        text = text[:a] + mask + text[b:]
    return text
