"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

Each task finds the different pre-tokens of its texts and encodes every one once. In DuckDB
a word is a set of (position, token) rows; the recursive query joins neighbouring rows to
the merge table and contracts each word's leftmost pair of least rank, until no word has a
pair left. Ordered aggregation decodes the ids of whole texts.

No token holds three bytes in a row that no vocabulary entry holds, so words are cut there
first; the parts cannot influence each other. What is still long contracts in several places
at once: the leftmost least pair among all within a token's reach to both sides is
contracted next whatever happens farther away.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm import words as W
from trailweave.llm.pretoken import Splitter

#: Rows of a recursion's state over all its rounds, about.
STATE_ROWS = 3_000_000
#: Parts with more bytes than this contract in several places at once.
WIDE = 64
MEMO, CHUNK = 400_000, 3_000_000
#: Characters of a window of a long text, and ids that are decoded at once.
WINDOW, DECODED = 3_000_000, 500_000
#: A letter before another character: what holds the letter ends there, whatever follows.
_END = regex.compile(r"\p{L}(?=\P{L})")

#: A row of ``state`` is a token with the token after it. Ranks and positions share one
#: number, so its minimum is the leftmost pair of least rank: rank, pos, pos of the next.
_ENCODE = """
WITH RECURSIVE state(w, pos, id, npos, nid, step) AS (
    SELECT w, pos, id, npos, nid, 0 FROM start
    UNION ALL
    SELECT s.w, s.pos,
           CASE WHEN s.pos = b.pos THEN b.rank ELSE s.id END,
           CASE WHEN s.pos = b.pos THEN n.npos ELSE s.npos END,
           CASE WHEN s.pos = b.pos THEN n.nid WHEN s.npos = b.pos THEN b.rank ELSE s.nid END,
           s.step + 1
    FROM state s
    JOIN (SELECT w, CAST(k // 1048576 AS INTEGER) AS rank, CAST(k // 1024 % 1024 AS INTEGER) AS pos, CAST(k % 1024 AS INTEGER) AS npos
          FROM (SELECT s.w, min(m.rank * 1048576 + s.pos * 1024 + s.npos) AS k
                FROM state s JOIN merges m ON m.l = s.id AND m.r = s.nid GROUP BY s.w)) b ON b.w = s.w
    LEFT JOIN state n ON n.w = s.w AND n.pos = CASE WHEN s.pos = b.pos THEN s.npos END
    WHERE s.pos <> b.npos
)
SELECT s.w, s.id FROM (SELECT w, max(step) AS step FROM state GROUP BY w) l JOIN state s ON s.w = l.w AND s.step = l.step ORDER BY s.w, s.pos
"""
#: The same for long parts: {reach} is the longest token's bytes, {rounds} the rounds.
#: Pairs of one rank contract at once, every other one of a run, unless one of them is
#: ``loud``: its token would be in a pair of a lesser rank, which comes before the next.
_ENCODE_WIDE = """
WITH RECURSIVE state(w, pos, id, step) AS (
    SELECT w, pos, id, 0 FROM start
    UNION ALL
    SELECT w, pos, CASE WHEN hit THEN rank ELSE id END, step + 1
    FROM (SELECT *, coalesce(lag(hit) OVER o, false) AS eaten, bool_or(hit) OVER (PARTITION BY w) AS goes_on
          FROM (SELECT *, safe AND (n - max(CASE WHEN fresh THEN n END) OVER o) % 2 = 0
                             AND coalesce(max(CASE WHEN NOT safe THEN n END) OVER o, 0) < max(CASE WHEN fresh THEN n END) OVER o AS hit
                FROM (SELECT *, row_number() OVER o AS n, rank IS DISTINCT FROM lag(rank) OVER o AS fresh,
                             coalesce(rank = min(rank) OVER (o RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)
                                      AND rank < coalesce(min(CASE WHEN loud THEN rank END) OVER (o RANGE BETWEEN {reach} PRECEDING AND 1 PRECEDING), 2147483647), false) AS safe
                      FROM (SELECT s.w, s.pos, s.id, s.step, CAST(m.rank AS INTEGER) AS rank, coalesce(m.loud OR a.rank < m.rank OR b.rank < m.rank, false) AS loud
                            FROM (SELECT *, lead(id) OVER o AS nid, lead(id, 2) OVER o AS nnid, lag(id) OVER o AS pid FROM state WHERE step < {rounds} WINDOW o AS (PARTITION BY w ORDER BY pos)) s
                            LEFT JOIN merges m ON m.l = s.id AND m.r = s.nid LEFT JOIN merges a ON a.l = s.pid AND a.r = m.rank LEFT JOIN merges b ON b.l = m.rank AND b.r = s.nnid)
                      WINDOW o AS (PARTITION BY w ORDER BY pos))
                WINDOW o AS (PARTITION BY w ORDER BY pos))
          WINDOW o AS (PARTITION BY w ORDER BY pos))
    WHERE goes_on AND NOT eaten
)
SELECT s.w, s.pos, s.id, s.step FROM (SELECT w, max(step) AS step FROM state GROUP BY w) l JOIN state s ON s.w = l.w AND s.step = l.step ORDER BY s.w, s.pos
"""
_DECODE = "SELECT t.w, string_agg(v.text, '' ORDER BY t.pos) AS text FROM tokens t JOIN vocab v ON v.id = t.id GROUP BY t.w ORDER BY t.w"


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def gathered(pool: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The entries of ``pool`` (entry i has size[i] items) that ``index`` names, one after the other."""
    begin, n = np.cumsum(size) - size, size[index]
    ends = np.cumsum(n)
    return pool[np.repeat(begin[index] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    """Encodes and decodes by the ranks of one vocabulary file."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.ranks = read_ranks(path)
        self.split = Splitter(pattern)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        l, r, k = (pa.array(x, pa.int32()) for x in zip(*rows)) if rows else (pa.array([], pa.int32()),) * 3
        twins = {a: c for a, b, c in rows if a == b}
        self._table("merges", pa.table({"l": l, "r": r, "rank": pa.array(k, pa.int32()).cast(pa.int64()), "loud": [twins.get(x[2], x[2]) < x[2] for x in rows]}))
        # Bytes are characters below 256 in DuckDB, where no blob can be aggregated.
        self._table("vocab", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "text": [t.decode("latin-1") for t in self.ranks]}))
        self.known = np.zeros(max(self.ranks.values()) + 1, dtype=bool)
        self.known[list(self.ranks.values())] = True
        self.pairs, self.triples = np.zeros(1 << 16, dtype=bool), np.zeros(1 << 24, dtype=bool)
        self.reach = np.ones(256, dtype=np.int64)  # the longest token with a byte
        for t in self.ranks:
            b = np.frombuffer(t, dtype=np.uint8).astype(np.int64)
            self.reach[b] = np.maximum(self.reach[b], len(t))
            if len(t) == 2:
                self.pairs[b[0] << 8 | b[1]] = True
            self.triples[b[:-2] << 16 | b[1:-1] << 8 | b[2:]] = True
        fours = [t[i : i + 4] for t in self.ranks for i in range(len(t) - 3)]
        self.fours = np.unique(np.frombuffer(b"".join(fours), dtype=">u4").astype(np.int64))
        self.threes = np.array(sorted(int.from_bytes(t, "big") for t in self.ranks if len(t) == 3), dtype=np.int64)
        digits = [f"{i} ".encode() if self.known[i] else b"" for i in range(len(self.known))]
        self.digit_size, self.digits = np.array([len(d) for d in digits]), np.frombuffer(b"".join(digits), dtype=np.uint8)
        self.memo: dict[str, bytes] = {}
        self.last: list[str] = []

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _cut(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the parts of words begin: at ``starts``, and where no token can reach across."""
        b = flat.astype(np.int32)
        cut = np.ones(len(b), dtype=bool)
        if len(b) > 1:
            cut[1:] = ~self.pairs[b[:-1] << 8 | b[1:]]
        if len(b) > 2:
            three = self.triples[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
            cut[1:-1] &= ~three
            cut[2:] &= ~three
        cut[starts] = True
        at = np.flatnonzero(cut)
        if len(b) < 4 or np.diff(np.append(at, len(b))).max() <= WIDE:
            return at
        # Long parts are cut by what four bytes show, too.
        more = np.append(True, ~self.pairs[b[:-1] << 8 | b[1:]])
        three = np.isin(b[:-2] << 16 | b[1:-1] << 8 | b[2:], self.threes)
        four = np.isin(b[:-3].astype(np.int64) << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:], self.fours)
        for k, found in ((3, three), (4, four)):
            for shift in range(1, k):
                more[shift : len(b) - k + shift + 1] &= ~found
        return np.flatnonzero(cut | more)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """For every word its ids, as 32-bit integers."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lens = np.array([len(b) for b in raw], dtype=np.int64)
        data = b"".join(raw)
        if not data:
            return [b""] * len(words)
        starts = np.cumsum(lens) - lens
        at = self._cut(np.frombuffer(data, dtype=np.uint8), starts[lens > 0])
        ends = np.append(at, len(data)).astype(np.int64)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        ids, size = self._contracted(parts.dictionary.to_pylist())
        index = parts.indices.to_numpy()
        flat = gathered(ids, size, index).tobytes()
        before = np.append(0, np.cumsum(size[index])) * 4
        a, b = before[np.searchsorted(at, starts)], before[np.searchsorted(at, starts + lens)]
        return [flat[x:y] for x, y in zip(a.tolist(), b.tolist())]

    def _contracted(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, one after the other, and the number of each part's ids."""
        out: list[np.ndarray | None] = [None] * len(parts)
        lens = np.array([len(p) for p in parts], dtype=np.int64)
        for i in np.flatnonzero(lens == 1):
            out[i] = self.byte_id[[parts[i][0]]]
        short = np.flatnonzero((lens > 1) & (lens <= WIDE))
        short = short[np.argsort(lens[short], kind="stable")]
        for some in np.split(short, np.flatnonzero(np.diff(np.cumsum(lens[short] ** 2 // 2 + 1) // STATE_ROWS)) + 1):
            for i, ids in zip(some, self._recursion([parts[i] for i in some])):
                out[i] = ids
        for i in np.flatnonzero(lens > WIDE):
            out[i] = self._wide(parts[i])
        size = np.array([len(x) for x in out], dtype=np.int64)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32), size

    def _recursion(self, parts: list[bytes]) -> list[np.ndarray]:
        if not parts:
            return []
        lens = np.array([len(p) for p in parts])
        ids = self.byte_id[np.frombuffer(b"".join(parts), dtype=np.uint8)]
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(lens) - lens, lens)
        last, none = pos == np.repeat(lens - 1, lens), np.int32(-1)
        w = np.repeat(np.arange(len(parts)), lens).astype(np.int32)
        self._table("start", pa.table({"w": w, "pos": pos.astype(np.int32), "id": ids, "npos": np.where(last, none, pos + 1).astype(np.int32), "nid": np.where(last, none, np.append(ids[1:], none)).astype(np.int32)}))
        got = self.db.execute(_ENCODE).fetchnumpy()
        return np.split(np.asarray(got["id"], dtype=np.int32), np.flatnonzero(np.diff(got["w"])) + 1)

    def _wide(self, part: bytes) -> np.ndarray:
        """A long part; the recursion starts again from where its bounded rounds ended."""
        b = np.frombuffer(part, dtype=np.uint8)
        ids, pos, reach = self.byte_id[b], np.arange(len(b), dtype=np.int32), int(self.reach[b].max())
        while True:
            rounds = max(1, STATE_ROWS // len(ids))
            self._table("start", pa.table({"w": np.zeros(len(ids), dtype=np.int32), "pos": pos, "id": ids}))
            got = self.db.execute(_ENCODE_WIDE.format(reach=reach, rounds=rounds)).fetchnumpy()
            ids, pos = (np.asarray(got[c], dtype=np.int32) for c in ("id", "pos"))
            if got["step"][0] < rounds:
                return ids

    def decode(self, id_lists: list) -> list[bytes]:
        """Bytes of each list of ids; an id outside the vocabulary is an error."""
        lens = np.array([len(x) for x in id_lists], dtype=np.int64)
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in id_lists]) if len(id_lists) else np.zeros(0, dtype=np.int64)
        return self._decoded(flat, lens)

    def _decoded(self, flat: np.ndarray, lens: np.ndarray) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in lens]
        for k, piece in self._decoded_pieces(flat, lens):
            out[k].append(piece)
        return [b"".join(x) for x in out]

    def _decoded_pieces(self, flat: np.ndarray, lens: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(number of the list, bytes) in order; DECODED ids are aggregated at once, so a long
        list comes in several pieces."""
        if len(flat) and not (0 <= flat.min() and flat.max() < len(self.known) and self.known[flat].all()):
            raise ValueError("ids outside the vocabulary")
        w = np.repeat(np.arange(len(lens)), lens).astype(np.int32)
        for at in range(0, len(flat), DECODED):
            some = slice(at, at + DECODED)
            self._table("tokens", pa.table({"w": w[some], "pos": np.arange(len(flat[some])), "id": flat[some].astype(np.int32)}))
            for k, text in self.db.execute(_DECODE).fetchall():
                yield k, text.encode("latin-1")

    def windows(self, text: str) -> Iterator[str]:
        """A text in windows that end where a pre-token does. A run of letters is never cut, and
        a pattern other than the vocabulary's own gives one window."""
        at = 0
        while at < len(text):
            end = self.split.known and len(text) - at > WINDOW and _END.search(text, at + WINDOW - 1)
            yield text[at : end.end() if end else len(text)]
            at = end.end() if end else len(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each text's ids."""
        if sum(map(len, texts)) <= max(WINDOW, CHUNK):
            return self._encoded(texts)
        parts = [(k, w) for k, t in enumerate(texts) for w in self.windows(t)]
        got = [self._encoded([w]) for _, w in parts]
        lens = np.zeros(len(texts), dtype=np.int64)
        np.add.at(lens, [k for k, _ in parts], [n[0] for _, n in got])
        return np.concatenate([x for x, _ in got]), lens

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, index, counts = self.split.numbered(texts)
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO:  # keep what this and the last texts use
            self.memo = {w: self.memo[w] for w in {*self.last, *words} if w in self.memo}
        self.last = words
        # As in the library, a pre-token that is a token is that token.
        own = {w: r for w in new if (r := self.ranks.get(w.encode())) is not None}
        self.memo.update((w, np.int32(r).tobytes()) for w, r in own.items())
        new = [w for w in new if w not in own]
        self.memo.update(zip(new, self.encode_words(new)))
        known = [self.memo[w] for w in words]
        size = np.array([len(b) // 4 for b in known], dtype=np.int64)
        flat = gathered(np.frombuffer(b"".join(known), dtype=np.int32), size, index)
        done = np.append(0, np.cumsum(size[index]))[np.append(0, np.cumsum(counts))]
        return flat, np.diff(done)

    def encode_ids(self, texts: list[str]) -> list[list[int]]:
        flat, lens = self.encode(texts)
        return [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])] if len(lens) else []

    def digests(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[str]]:
        """Number of ids, sha-256 of the ids as text, sha-256 of the decoded ids, of each text."""
        if len(texts) == 1 and len(texts[0]) > WINDOW:
            return self._long_digests(texts[0])
        flat, lens = self.encode(texts)
        spelled = gathered(self.digits, self.digit_size, flat).tobytes()
        ends = np.append(0, np.cumsum(self.digit_size[flat]))[np.cumsum(lens)].tolist()
        shas = [hashlib.sha256(spelled[a : max(a, b - 1)]).hexdigest() for a, b in zip([0, *ends], ends)]
        return lens, shas, [hashlib.sha256(b).hexdigest() for b in self._decoded(flat, lens)]

    def _long_digests(self, text: str) -> tuple[np.ndarray, list[str], list[str]]:
        """``digests`` of one long text, of which a window is held at once."""
        n, spelled, decoded, held = 0, hashlib.sha256(), hashlib.sha256(), b""
        for window in self.windows(text):
            flat, lens = self._encoded([window])
            n += len(flat)
            digits = held + gathered(self.digits, self.digit_size, flat).tobytes()
            spelled.update(digits[:-1])
            held = digits[-1:]
            for _, piece in self._decoded_pieces(flat, lens):
                decoded.update(piece)
        return np.array([n]), [spelled.hexdigest()], [decoded.hexdigest()]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str = PATTERN) -> Codec:
    """The process's codec for a vocabulary; workers keep it between tasks."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; null texts give empty arrays,
    repeated rows are encoded each, an empty table gives no rows."""

    def run(batches):
        c = codec(path, pattern)
        for ids, texts in W.chunks(batches, "doc_id", "text", size=CHUNK):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(c.encode_ids(texts), pa.list_(pa.int32()))})

    return _texts(docs).mapInArrow(W.released(run), "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and bytes of every (doc_id, ids); null ids give empty bytes. The bytes
    need not be UTF-8: an id may be part of a character."""

    def run(batches):
        c = codec(path)
        for b in batches:
            lists = [x or [] for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "bytes": pa.array(c.decode(lists), pa.binary())})

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(W.released(run), "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, without shipping
    the ids. The bytes are decoded from the text's ids."""

    def run(batches):
        c = codec(path, pattern)
        for ids, texts in W.chunks(batches, "doc_id", "text", size=CHUNK):
            lens, spelled, decoded = c.digests(texts)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(lens, pa.int64()), "ids_sha256": spelled, "decoded_sha256": decoded})

    return _texts(docs).mapInArrow(W.released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
