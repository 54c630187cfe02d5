"""Language proportions of a text by expectation-maximisation over a mixture.

Each language is a distribution over hashed letter trigrams (word ends included),
learned from labelled texts. A word's likelihood under a language is the product of its
trigrams'. EM finds the proportions under which the document's words are likeliest; a
language stays in the set only if it raises the log likelihood by more than a
penalty (Bayesian information criterion).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailweave.llm import words as W

#: Labelled documents read for each language at most, and for all of them together about.
ROWS_PER_LANG, ROWS = 1500, 20_000
#: Entries of the trigram table: beyond 128 languages it has fewer slots, but all languages.
TABLE = 1 << 24
BITS, ROUNDS, PENALTY, SHARPEST = 17, 12, 4.0, 12.0
NONE = "und"


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # trigram slot x language, float32


@lru_cache(1)
def _letters() -> np.ndarray:
    """code point -> itself in lower case, or 32 for what is no letter."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def slot_bits(langs: int) -> int:
    """Bits of a trigram's slot, so that slots times languages stay within TABLE."""
    return max(10, min(BITS, (TABLE // max(1, langs)).bit_length() - 1))


def trigrams(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: the slot of the trigram around each letter, the first
    letter of each word, and the number of words of each text."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    # One blank after each text keeps words of neighbours apart.
    raw = "".join(t + " " for t in texts).encode("utf-32-le", "surrogatepass")
    code = _letters()[np.frombuffer(raw, dtype=np.uint32)]
    letter = code != 32
    pad = np.concatenate([[32], code, [32]]).astype(np.uint64)
    h = (pad[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (pad[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (pad[2:] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    slot = (h >> np.uint64(64 - bits)).astype(np.int32)
    first = letter & ~np.concatenate([[False], letter[:-1]])
    ends = np.cumsum(sizes)
    per = np.diff(np.concatenate([[0], np.cumsum(first)[ends - 1]])) if len(texts) else np.zeros(0, dtype=np.int64)
    at = np.cumsum(letter) - 1
    return slot[letter], at[first], per


def fit(texts: list[str], langs: list[str]) -> Model:
    """Trigram distributions with add-one smoothing; languages in alphabetical order."""
    names = sorted(set(langs))
    bits = slot_bits(len(names))
    own: dict[str, list[str]] = {}
    for t, lang in zip(texts, langs):
        own.setdefault(lang, []).append(t)
    logp = np.zeros((1 << bits, len(names)), dtype=np.float32)
    for k, name in enumerate(names):
        counts = np.zeros(1 << bits)
        for i in range(0, len(own[name]), 256):
            counts += np.bincount(trigrams(own[name][i : i + 256], bits)[0], minlength=1 << bits)
        logp[:, k] = np.log((counts + 0.05) / (counts.sum() + 0.05 * (1 << bits)))
    return Model(names, logp)


def train(docs: DataFrame, rows: int = ROWS_PER_LANG) -> Model:
    """Fit on a bounded sample: of each language about ``rows`` documents, or ROWS divided by
    the number of languages if that is less, chosen by a hash of the id. Every language is
    modelled. Rows with a null text or language are not used."""
    usable = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return Model([], np.zeros((1 << BITS, 0), dtype=np.float32))
    rows = max(1, min(rows, ROWS // len(sizes)))
    # About twice the rows are drawn, and of these the ones of least hash taken.
    share = {r["lang"]: min(1.0, 2 * rows / r["n"] + 30 / r["n"]) for r in sizes}
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)) < F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("lang")] * (1 << 30)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text", F.lit(3)))
    got = usable.filter(drawn).select("lang", "text", F.row_number().over(order).alias("_n")).filter(F.col("_n") <= rows).collect()
    model = fit([r["text"] for r in got], [r["lang"] for r in got])
    del got
    W.trim()
    return model


def _em(like: np.ndarray, doc: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS):
    """Proportions and log likelihood of each document. like: word x language."""
    n = np.diff(np.append(first, len(like))).astype(np.float64)
    pi = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        r = like * pi.astype(np.float32)[doc]
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, first, axis=0) / n[:, None]
    ll = np.add.reduceat(np.log((like * pi.astype(np.float32)[doc]).sum(1)), first)
    return pi, ll


def mixtures(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Language proportions of each text after selection (zero rows: no letters), and
    the number of languages kept."""
    K = len(model.langs)
    out, kept = np.zeros((len(texts), K)), np.zeros(len(texts), dtype=np.int64)
    slots, first, per = trigrams(texts, slot_bits(K))
    if not K or not len(first):
        return out, kept
    logs = np.add.reduceat(model.logp[slots], first, axis=0)
    # No word speaks for or against a language by more than e**SHARPEST.
    like = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -SHARPEST))
    full = np.flatnonzero(per)
    n = per[full]
    doc, start = np.repeat(np.arange(len(full)), n), W.starts_of(n)
    pi, ll = _em(like, doc, start, np.ones((len(full), K)))
    order = np.argsort(-pi, axis=1, kind="stable")
    best = np.zeros_like(pi)
    best[np.arange(len(full)), order[:, 0]] = 1
    single = np.add.reduceat(np.log(like[np.arange(len(like)), order[doc, 0]]), start)
    price = PENALTY * np.log(n + 1)
    score, size = single.copy(), np.ones(len(full), dtype=np.int64)
    # The full mixture is the likeliest of all: if it is not worth one more language, no set is.
    open_ = np.flatnonzero(ll - single > price)
    for m in range(2, K + 1):
        if not len(open_):
            break
        sel = np.isin(doc, open_)
        allowed = np.zeros((len(open_), K))
        np.put_along_axis(allowed, order[open_, :m], 1, axis=1)
        p2, l2 = _em(like[sel], np.repeat(np.arange(len(open_)), n[open_]), W.starts_of(n[open_]), allowed)
        value = l2 - price[open_] * (m - 1)
        won = value > score[open_]
        best[open_[won]], score[open_[won]], size[open_[won]] = p2[won], value[won], m
        open_ = open_[ll[open_] - price[open_] * m > score[open_]]  # even all that is left to gain is too little
    out[full], kept[full] = best, size
    return out, kept


SCHEMA = "doc_id long, lang_pred string, score double, n_langs int, langs array<struct<lang:string,share:double>>"
_LANGS = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, n_langs and the languages with their shares, largest first.

    Text that is null, empty or without letters gets ``und`` with score 0, as does every
    text when no language was learned. Ties go to the first language in alphabetical
    order. Repeated rows are predicted each; an empty table gives no rows.
    """

    def run(batches):
        for ids, texts in W.chunks(batches, "doc_id", "text"):
            pi, kept = mixtures(texts, model)
            top = pi.argmax(1) if len(model.langs) else np.zeros(len(texts), dtype=int)
            rows = [[] if not k else [{"lang": model.langs[j], "share": float(p[j])} for j in np.argsort(-p, kind="stable")[:k]] for p, k in zip(pi, kept)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "lang_pred": [model.langs[t] if k else NONE for t, k in zip(top, kept)],
                    "score": pi.max(1, initial=0.0).astype(float),
                    "n_langs": pa.array(kept.astype(np.int32)),
                    "langs": pa.array(rows, _LANGS),
                }
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(W.released(run), SCHEMA)
