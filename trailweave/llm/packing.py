"""Order-preserving packing of token streams into fixed windows by dynamic programming.

The documents of a partition, in its order, are one stream of ids, each document closed
by an end id. A window is a stretch of at most ``width`` ids between two cuts. Cuts
are allowed after documents (free), after sentences (a small penalty) and, where no
sentence ends for long, at every GRID ids (a larger one). The cost of a window is its
padding plus the penalty of its cut:

    f(j) = min over i with p(j) - p(i) <= width of f(i) + width - (p(j) - p(i)) + c(j)

so only f(i) + p(i) matters, and a monotone queue over the sliding range finds its
minimum in constant time for each cut.
"""

from __future__ import annotations

import os
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm import words as W
from trailweave.llm.pretoken import Splitter

WIDTH, END_ID = 2048, 1
SENTENCE, HARD, GRID, GAP = 4, 64, 32, 256
#: Ids over which the programme looks at once; what follows the last cut is carried on.
STREAM = 1_000_000
#: Characters worked on together.
CHUNK = 3_000_000
#: Pre-tokens remembered by a worker, about 200 bytes each.
MEMO = 1_000_000


class Tokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by a tokenizers file.

    Different pre-tokens are encoded once and remembered; a text's ids are gathered from
    theirs. As the vocabulary's notes tell, the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as File

        self.file = File.from_file(path)
        self.file.encode_special_tokens = True
        self.split, self.memo, self.last, self.limit = Splitter(), {}, [], MEMO
        ends = [t for t, _ in sorted(self.file.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array([t[-1] in ".!?Ċ" for t in ends], dtype=bool)  # Ċ: a line feed

    def ids(self, texts: list[str]) -> list[bytes]:
        words, index, counts = self.split.numbered(texts)
        if not len(index):
            return [b""] * len(texts)
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > self.limit:
            self.memo = {w: self.memo[w] for w in {*self.last, *words} if w in self.memo}
        self.last = words
        self._learn(new)
        known = [self.memo[w] for w in words]
        size = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        pool, begin = np.frombuffer(b"".join(known), dtype="<u4"), np.cumsum(size) - size
        n = size[index]
        ends = np.cumsum(n)
        flat = pool[np.repeat(begin[index] - ends + n, n) + np.arange(ends[-1])].tobytes()
        last = np.append(0, ends)[np.cumsum(counts)] * 4
        return [flat[a:b] for a, b in zip(np.append(0, last).tolist(), last.tolist())]

    def _learn(self, new: list[str]) -> None:
        """Encode words. Those that are a blank and letters go as one text, which the
        tokenizer cuts where they were joined."""
        plain = [w for w in new if w[0] == " " and w[1:].isalpha()]
        for k in range(0, len(plain), 4000):
            part = plain[k : k + 4000]
            e = self.file.encode("".join(part), add_special_tokens=False)
            ids, at = np.array(e.ids, dtype="<u4").tobytes(), np.flatnonzero(np.diff(np.array(e.word_ids))) + 1
            at = [0, *(at * 4).tolist(), len(ids)]
            if len(at) == len(part) + 1:  # else it knows other letters; each goes alone
                self.memo.update((w, ids[a:b]) for w, a, b in zip(part, at, at[1:]))
        rest = [w for w in new if w not in self.memo]
        for k in range(0, len(rest), 20_000):
            part = rest[k : k + 20_000]
            for w, e in zip(part, self.file.encode_batch_fast(part, add_special_tokens=False)):
                self.memo[w] = np.array(e.ids, dtype="<u4").tobytes()


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def boundaries(lengths: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut is allowed, from 0 to the stream's end, and their penalties."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    cost = np.full(total + 1, -1, dtype=np.int32)
    cost[sentence_ends] = SENTENCE
    cost[ends] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    wide = np.flatnonzero(np.diff(at) > GAP)
    if len(wide):
        more = np.concatenate([np.arange(at[i] + GRID, at[i + 1], GRID) for i in wide])
        cost[more] = HARD
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def cuts(at: np.ndarray, cost: np.ndarray, width: int, final: bool) -> list[int]:
    """The best cuts of a stream, first 0; the last is the stream's end if ``final``,
    else the cheapest place to go on from within the last window."""
    p, c = at.tolist(), cost.tolist()
    n = len(p)
    f, back = [0] * n, [0] * n
    v = [0] * n  # f + p
    queue: deque[int] = deque([0])
    for j in range(1, n):
        here = p[j]
        low = here - width
        while p[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        f[j] = x = v[i] + width - here + c[j]
        v[j] = x = x + here
        while queue and v[queue[-1]] >= x:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not final:
        tail = [k for k in range(n) if p[k] > p[-1] - width]
        j = min(tail, key=lambda k: (v[k], -k)) if p[-1] > width else 0
    out = [j]
    while j:
        j = back[j]
        out.append(j)
    return [p[k] for k in reversed(out)]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = END_ID, keep_ids: bool = False, memo: int = MEMO, forget: bool = False) -> DataFrame:
    """Pack all documents, each exactly once: one row per piece.

    No shuffle: each input partition is one stream in its own order, with its own
    sequences (``sequence_id``: partition number times 2**32 plus a running number).
    Null and empty texts are the end id alone; documents longer than a window are cut
    into several pieces; repeated rows are packed each; an empty table gives no rows.
    ``keep_ids`` adds the pieces' ids (array of int). ``memo`` bounds the pre-tokens that a
    worker remembers; more of them cost memory and spare CPU time. ``forget`` drops them when
    a task ends, for executors that have other stages to run.
    """

    def run(batches):
        tok = tokenizer(path)
        tok.limit = memo
        end = np.array([end_id], dtype="<u4").tobytes()
        base, done = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int, bytes, int, int]] = []  # doc_id, ids left, ids before them, ids in all
        size = 0

        def flush(final: bool):
            nonlocal held, size, done
            lengths = np.array([len(b) // 4 for _, b, _, _ in held], dtype=np.int64)
            flat = np.frombuffer(b"".join(b for _, b, _, _ in held), dtype="<u4")
            known = flat < len(tok.ends)
            at, cost = boundaries(lengths, np.flatnonzero(tok.ends[np.where(known, flat, 0)] & known) + 1)
            marks = cuts(at, cost, width, final)
            rows, k, begin = [], 0, 0  # k: document; begin: its place in the stream
            for a, b in zip(marks, marks[1:]):
                x = a
                while x < b:
                    doc, ids, before, whole = held[k]
                    stop = min(b, begin + len(ids) // 4)
                    piece = ids[(x - begin) * 4 : (stop - begin) * 4]
                    rows.append((doc, before + x - begin, stop - x, zlib.crc32(piece), whole, base + done, x - a, piece))
                    x = stop
                    if stop == begin + len(ids) // 4:
                        begin, k = stop, k + 1
                done += 1
            rest = held[k:]
            if rest and marks[-1] > begin:
                doc, ids, before, whole = rest[0]
                rest[0] = (doc, ids[(marks[-1] - begin) * 4 :], before + marks[-1] - begin, whole)
            held, size = rest, sum(len(b) // 4 for _, b, _, _ in rest)
            if rows:
                cols = list(zip(*rows))
                out = {n: pa.array(x, pa.int64()) for n, x in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), cols)}
                if keep_ids:
                    out["ids"] = pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in cols[7]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

        for ids, texts in W.chunks(batches, "doc_id", "text", size=CHUNK):
            for d, b in zip(ids, tok.ids(texts)):
                b += end
                held.append((d, b, 0, len(b) // 4))
                size += len(b) // 4
                if size >= STREAM:
                    yield from flush(False)
        if held:
            yield from flush(True)
        if forget:
            tok.memo, tok.last = {}, []

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(W.released(run), SCHEMA + ", ids array<int>" * keep_ids)
