"""SentencePiece (BPE models) encoding with byte offsets, and decoding.

Normalisation takes, at every place of a text, the longest prefix that the model's compiled
character map holds, and records for each normalised byte the byte of the text that it came
from; so each piece is projected back onto a span of the original bytes.

No piece holds two neighbouring characters that no vocabulary entry holds side by side. So
normalised texts are cut there, equal parts are encoded once, and the parts' ids are joined.
Long texts are worked on in windows that end before a blank where no piece and no entry of
the map can reach across.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm import words as W
from trailweave.llm.bpe import gathered

#: Fixed values of the file format: kinds of pieces, model kind, the sign for a blank.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
BLANK = "▁"
#: Bytes that no UTF-8 text holds: they stand before and behind each text of a batch.
_FRONT, _BACK = 0xFF, 0xFE
#: Bytes of a window of a long text; remembered parts; characters up to which parts are joined
#: all at once, and of the parts that are.
WINDOW, MEMO, SHORT, TOGETHER = 2_000_000, 400_000, 64, 2_000_000
#: Characters of texts encoded together.
CHUNK = 3_000_000


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            out |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return out

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, raw[at : at + size]
            at += size


class CharacterMap:
    """The compiled character map: a double-array trie of UTF-8 keys and their replacements."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.trie = np.frombuffer(compiled, dtype="<u4", count=size // 4, offset=4).astype(np.int64)
        self.strings = np.frombuffer(compiled, dtype=np.uint8, offset=4 + size)
        self.ends = np.flatnonzero(self.strings == 0)

    def _below(self, unit: np.ndarray) -> np.ndarray:
        """Distance from a node to its children."""
        return unit >> 10 << ((unit & 512) >> 6)

    def longest(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place ``at`` the length of the longest key that begins there (0: none) and the
        place of its replacement in ``strings``. All places go down the trie together."""
        length, value = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        alive, node, depth = np.arange(len(at)), np.full(len(at), self._below(self.trie[:1])[0]), 0
        while len(alive):
            inside = at[alive] + depth < len(raw)
            alive, node = alive[inside], node[inside]
            c = raw[at[alive] + depth].astype(np.int64)
            node = node ^ c
            unit = self.trie[np.minimum(node, len(self.trie) - 1)]
            goes_on = (node < len(self.trie)) & (unit & (1 << 31 | 255) == c)
            alive, unit = alive[goes_on], unit[goes_on]
            node, leaf = node[goes_on] ^ self._below(unit), unit >> 8 & 1 == 1
            depth += 1
            length[alive[leaf]], value[alive[leaf]] = depth, self.trie[node[leaf]] & 0x7FFFFFFF
        return length, value

    def sizes(self, value: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.ends, value)] - value


class Normalised:
    """text: all normalised texts, one after the other; source: for each byte the byte of its own
    text; bounds: where each text begins, and the end; whole: the source's end of each text."""

    def __init__(self, text: np.ndarray, source: np.ndarray, bounds: np.ndarray, whole: np.ndarray):
        self.text, self.source, self.bounds, self.whole = text, source, bounds, whole


class Model:
    """A model file: pieces, character map and the rules of white space."""

    def __init__(self, raw: bytes):
        pieces, trainer, norm = [], {}, {}
        for k, v in fields(raw):
            if k == 1:
                p = dict(fields(v))
                pieces.append((p[1].decode(), float(np.frombuffer(p[2], "<f4")[0]) if 2 in p else 0.0, p.get(3, NORMAL)))
            elif k in (2, 3):
                (trainer if k == 2 else norm).update(fields(v))
        if trainer.get(3, 1) != BPE:
            raise ValueError("only BPE models are read")
        self.pieces, self.fallback = pieces, bool(trainer.get(35, 0))
        self.suffix, self.unknown_text = bool(trainer.get(24, 0)), trainer.get(44, " ⁇ ".encode()).decode()
        self.map = CharacterMap(norm[2]) if norm.get(2) else None
        self.prefix, self.squeeze, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        own = {t: i for i, (t, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        self.id, self.unused = own, {t for t, i in own.items() if pieces[i][2] == UNUSED}
        rank = {s: r for r, s in enumerate(sorted({pieces[i][1] for i in own.values()}, reverse=True))}
        self.rank = {t: rank[pieces[i][1]] for t, i in own.items()}
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        self.byte = {int(t[3:5], 16): i for i, (t, _, kind) in enumerate(pieces) if kind == BYTE}
        fixed = sorted((t for t, i in own.items() if pieces[i][2] == USER_DEFINED), key=len, reverse=True)
        self.fixed = re.compile("|".join(map(re.escape, fixed))) if fixed else None
        self.fixed_raw = re.compile(b"(?=(" + b"|".join(re.escape(t.encode()) for t in fixed) + b"))") if fixed else None
        self.pairs, self.triples = np.zeros(1 << 16, dtype=bool), np.zeros(1 << 24, dtype=bool)
        for t in own:
            b = np.frombuffer(t.encode(), dtype=np.uint8).astype(np.int64)
            self.pairs[b[:-1] << 8 | b[1:]] = True
            self.triples[b[:-2] << 16 | b[1:-1] << 8 | b[2:]] = True
        self.inner_blank = any(re.search(f"[^{BLANK}]{BLANK}", t) for t in own)
        said = [self._said(i) for i in range(len(pieces))]
        self.said_size, self.said = np.array([len(x) for x in said]), np.frombuffer(b"".join(said), dtype=np.uint8)
        self.kind = np.array([k for _, _, k in pieces])
        spelled = [b"%d," % i for i in range(len(pieces))]
        self.digit_size, self.digits = np.array([len(x) for x in spelled]), np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.memo: dict[bytes, int] = {}
        self.pool, self.counts = (np.zeros(0, dtype=np.int32),) * 2, np.zeros(0, dtype=np.int64)
        self.last: list[bytes] = []
        # Symbols are pieces and the single characters of pieces; the others are -1.
        symbols = dict(own)
        for c in sorted({c for t in own for c in t} - set(own)):
            symbols[c] = len(pieces) + len(symbols) - len(own)
        self.symbol = np.full(0x110000, -1, dtype=np.int64)
        single = [t for t in symbols if len(t) == 1]
        self.symbol[[ord(t) for t in single]] = [symbols[t] for t in single]
        self.base = len(pieces) + len(symbols)
        joins = sorted((symbols[t[:i]] * self.base + symbols[t[i:]], self.rank[t], j) for t, j in own.items() for i in range(1, len(t)) if t[:i] in symbols and t[i:] in symbols)
        self.join, self.join_rank, self.joined = (np.array(x, dtype=np.int64) for x in (zip(*joins) if joins else ((-1,), (0,), (0,))))

    def _said(self, i: int) -> bytes:
        """What a piece stands for in decoded text."""
        text, _, kind = self.pieces[i]
        if kind == CONTROL:
            return b""
        if kind == BYTE:
            return bytes([int(text[3:5], 16)])
        return (self.unknown_text if kind == UNKNOWN else text.replace(BLANK, " ")).encode()

    # Normalisation ----------------------------------------------------------------------

    def normalise(self, texts: list[bytes], first: bool = True, last: bool = True) -> Normalised:
        """The normalised texts and the sources of their bytes. ``first``, ``last``: do the texts
        begin and end here, or are they windows of a longer one?"""
        data = b"".join(b"\xff" + t + b"\xfe" for t in texts)
        raw, lens = np.frombuffer(data, dtype=np.uint8), np.array([len(t) for t in texts], dtype=np.int64)
        front = np.cumsum(lens + 2) - lens - 2
        if self.map is None and self.fixed_raw is None and not self.squeeze:
            out, source, unit = raw, np.arange(len(raw)), None
        else:
            out, source, unit = self._replaced(data, raw)
        bars = np.flatnonzero(out >= _BACK)  # front and back of each text, in turn
        blank, width = out == 32, len(BLANK.encode()) if self.escape else 1
        kept = np.ones(len(out), dtype=np.int64)
        kept[blank] = width
        kept[bars] = 0
        whole = lens.copy()
        if self.squeeze:
            self._squeezed(out, unit, blank, bars, kept, source - np.repeat(front + 1, np.diff(np.append(bars[::2], len(out)))), whole, first, last)
        full = np.add.reduceat(kept, bars[::2]) > 0 if len(texts) else np.zeros(0, dtype=bool)  # texts with anything left
        if self.prefix and (last if self.suffix else first):
            kept[bars[1::2] if self.suffix else bars[::2]] = np.where(full, width, 0)
        ends = np.cumsum(kept)
        text, sources = np.repeat(out, kept), source - np.repeat(front + 1, np.diff(np.append(bars[::2], len(out))))
        # A blank that is put before a text comes from its first byte that stays.
        some = np.flatnonzero((kept > 0) & (out < _BACK))
        if len(some):
            after = some[np.minimum(np.searchsorted(some, bars[::2]), len(some) - 1)]
            sources[bars[::2]] = np.where(full, sources[after], 0)
        sources[bars[1::2]] = whole
        sources = np.repeat(sources, kept)
        at = (ends - kept)[(blank | (out >= _BACK)) & (kept > 0)]
        if self.escape:
            for i, c in enumerate(BLANK.encode()):
                text[at + i] = c
        else:
            text[at] = 32
        bounds = np.append((ends - kept)[bars[::2]], len(text))
        return Normalised(text, sources, bounds, whole)

    def _replaced(self, data: bytes, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after replacement, the place where each one's unit began, and its unit's number."""
        at = np.flatnonzero(raw & 0xC0 != 0x80)
        own = np.diff(np.append(at, len(raw)))
        length, value = self.map.longest(raw, at) if self.map else (np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64))
        if self.fixed_raw:  # these come first and stay as they are
            found = [(m.start(), len(m[1])) for m in self.fixed_raw.finditer(data)]
            k = np.searchsorted(at, [a for a, _ in found])
            length[k], value[k] = [n for _, n in found], -1
        inside, until = np.zeros(len(at), dtype=bool), -1
        for k in np.flatnonzero(length > own).tolist():  # keys of several characters, from left to right
            if at[k] >= until:
                until = at[k] + length[k]
                inside[k + 1 : np.searchsorted(at, until)] = True
        at, own, length, value = (x[~inside] for x in (at, own, length, value))
        new = (length > 0) & (value >= 0)
        size = np.where(length > 0, length, own)
        if self.map is None:
            pool, begin = raw, at
        else:
            pool, begin = np.append(raw, self.map.strings), np.where(new, value + len(raw), at)
            size[new] = self.map.sizes(value[new])
        unit, ends = np.repeat(np.arange(len(at)), size), np.cumsum(size)
        return pool[np.repeat(begin - ends + size, size) + np.arange(len(unit))], at[unit], unit

    def _squeezed(self, out, unit, blank, bars, kept, source, whole, first, last) -> None:
        """Set ``kept`` to 0 for blanks at the start, behind a blank, and at the end of each text."""
        begins = np.append(True, unit[1:] != unit[:-1])
        solid = np.cumsum(~blank)
        own = np.flatnonzero(begins)[np.cumsum(begins) - 1]  # first byte of a byte's unit
        leading = blank & (solid == solid[own])
        before = np.where(own > 0, blank[own - 1] | ((out[own - 1] == _FRONT) & first), False)
        kept[leading & before] = 0
        if last:
            for k, (a, b) in enumerate(zip(bars[::2].tolist(), bars[1::2].tolist())):
                text, size = out[a + 1 : b].tobytes(), -1
                while size != len(text):  # the sign for a blank counts as one here
                    size = len(text)
                    text = text.rstrip(b" ").removesuffix(BLANK.encode() if self.escape else b"")
                end = a + 1 + size
                gone = np.flatnonzero(kept[end:b])
                if len(gone):
                    whole[k] = source[end + gone[0]]
                kept[end:b] = 0

    # Encoding ---------------------------------------------------------------------------

    def _cut(self, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where parts begin: at ``starts``, and between characters that no piece holds together.
        A piece that holds both holds the pair of bytes and all other bytes of both characters."""
        lead, wide = b & 0xC0 != 0x80, b.astype(np.int32)
        held = np.zeros(len(b), dtype=bool)
        held[1:] = self.pairs[wide[:-1] << 8 | wide[1:]]
        if len(b) > 2:
            three = self.triples[wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]]
            held[1:-1] &= three | (b[1:-1] < 128)
            held[2:] &= three | (b[1:-1] < 128)
        cut = lead & ~held
        cut[starts] = True
        return np.flatnonzero(cut)

    def _merged(self, text: str) -> list[str]:
        """The pieces of a part: the pair of the best score is joined, leftmost first."""
        if self.fixed:
            symbols, frozen, at = [], set(), 0
            for m in self.fixed.finditer(text):
                symbols += text[at : m.start()]
                frozen.add(len(symbols))
                symbols.append(m[0])
                at = m.end()
            symbols += text[at:]
        else:
            symbols, frozen = list(text), ()
        n, rank, split = len(symbols), self.rank, {}
        after, before = np.arange(1, n + 1).tolist(), np.arange(-1, n - 1).tolist()
        heap: list[tuple[int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i in frozen or j in frozen:
                return
            both = symbols[i] + symbols[j]
            r = rank.get(both)
            if r is not None:
                heapq.heappush(heap, (r, i, len(both)))
                if both in self.unused:
                    split[both] = symbols[i], symbols[j]

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two has changed since
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        out, stack = [], [s for s in reversed(symbols) if s]
        while stack:  # an unused piece falls apart into what it was joined from
            s = stack.pop()
            if s in self.unused and s in split:
                stack += split[s][::-1]
            else:
                out.append(s)
        return out

    def _part(self, raw: bytes) -> tuple[bytes, bytes]:
        """Ids and normalised bytes of a part's pieces, as 32-bit integers. The bytes of a
        character that is spelled out in byte pieces all belong to the last of them."""
        ids, sizes = [], []
        for piece in self._merged(raw.decode()):
            own = piece.encode()
            if piece in self.id or not self.fallback:
                ids.append(self.id.get(piece, self.unknown))
                sizes.append(len(own))
            else:
                ids += [self.byte[c] for c in own]
                sizes += [0] * (len(own) - 1) + [len(own)]
        return np.array(ids, dtype=np.int32).tobytes(), np.array(sizes, dtype=np.int32).tobytes()

    def _parts(self, raws: list[bytes]) -> list[tuple[bytes, bytes]]:
        """``_part`` of many short parts, by the same rule: in each round every part joins the
        leftmost of its pairs of the best score, until none has a pair left."""
        texts = [x.decode() for x in raws]
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        ids, at, n = self.symbol[chars], np.arange(len(chars)), len(chars)
        part, done, worst = np.repeat(np.arange(len(raws)), lens), [], 1 << 40

        def found(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and outcome of the pairs of the i-th symbols and the ones behind."""
            j = np.minimum(i + 1, len(ids) - 1)
            code = np.where((ids[i] >= 0) & (ids[j] >= 0) & (part[i] == part[j]) & (i < j), ids[i] * self.base + ids[j], -2)
            k = np.minimum(np.searchsorted(self.join, code), len(self.join) - 1)
            return np.where(self.join[k] == code, self.join_rank[k], worst), self.joined[k]

        rank, outcome = found(np.arange(n))
        while len(ids):
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            best = np.minimum.reduceat(rank * n + np.arange(len(ids)), starts)
            going = best < worst * n
            hit = best[going] % n
            ids[hit] = outcome[hit]
            stay = np.repeat(going, np.diff(np.append(starts, len(ids))))
            done.append((at[~stay], ids[~stay]))
            stay[hit + 1] = False
            ids, at, part, rank, outcome = (x[stay] for x in (ids, at, part, rank, outcome))
            new = np.cumsum(stay)[hit] - 1  # where the joined symbols are now
            changed = np.append(new, new[(new > 0)] - 1)
            if len(changed):
                rank[changed], outcome[changed] = found(changed)
        at, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at)
        at, ids = at[order], ids[order]
        wide = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)  # bytes of each character
        before = np.append(0, np.cumsum(wide))
        size = before[np.append(at[1:], n)] - before[at]
        odd = (ids < 0) | (ids >= len(self.pieces))  # single characters that are no pieces
        count = np.where(odd & self.fallback, size, 1)
        ends = np.cumsum(count)
        out, sizes = np.repeat(np.where(odd, self.unknown, ids), count).astype(np.int32), np.zeros(ends[-1], dtype=np.int32)
        sizes[ends - 1] = size
        if self.fallback and odd.any():
            flat = np.frombuffer(b"".join(raws), dtype=np.uint8)
            place = np.repeat(before[at] - ends + count, count) + np.arange(len(out))
            spelled = np.repeat(odd, count)
            table = np.array([self.byte[c] for c in range(256)], dtype=np.int32)
            out[spelled] = table[flat[place[spelled]]]
        cuts = (4 * np.append(0, ends)[np.searchsorted(at, np.append(0, np.cumsum(lens)))]).tolist()
        x, y = out.tobytes(), sizes.tobytes()
        return [(x[a:b], y[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _learn(self, new: list[bytes]) -> None:
        """Remember what ``new`` parts become: a number in the memo, ids and sizes in the pools."""
        short = [x for x in new if len(x) <= SHORT] if not self.fixed and not self.unused else []
        sizes, got = np.cumsum([len(x) for x in short]) // TOGETHER, {}
        for some in np.split(np.arange(len(short)), np.flatnonzero(np.diff(sizes)) + 1):
            if len(some):
                some = short[some[0] : some[-1] + 1]
                got.update(zip(some, self._parts(some)))
        got.update((x, self._part(x)) for x in new if x not in got)
        self._remember(got)

    def _remember(self, got: dict[bytes, tuple[bytes, bytes]]) -> None:
        self.memo.update(zip(got, range(len(self.memo), len(self.memo) + len(got))))
        known = np.frombuffer(b"".join([a for a, _ in got.values()]), dtype=np.int32), np.frombuffer(b"".join([b for _, b in got.values()]), dtype=np.int32)
        self.pool = tuple(np.append(a, b) for a, b in zip(self.pool, known))
        self.counts = np.append(self.counts, np.array([len(a) // 4 for a, _ in got.values()], dtype=np.int64))

    def _forget(self, kept: set[bytes]) -> None:
        """Remember nothing but ``kept`` parts."""
        names = [x for x in self.memo if x in kept]
        index = np.array([self.memo[x] for x in names], dtype=np.int64)
        self.pool = tuple(gathered(x, self.counts, index) for x in self.pool)
        self.counts, self.memo = self.counts[index], dict(zip(names, range(len(names))))

    def _pieces(self, norm: Normalised) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and sizes of all pieces, and the number of pieces of each text."""
        none = np.zeros(0, dtype=np.int32)
        if not len(norm.text):
            return none, none, np.zeros(len(norm.whole), dtype=np.int64)
        begins = norm.bounds[:-1][np.diff(norm.bounds) > 0]
        at = self._cut(norm.text, begins)
        ends = np.append(at, len(norm.text)).astype(np.int64)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(norm.text.tobytes())]).dictionary_encode()
        names = parts.dictionary.to_pylist()
        new = [x for x in names if x not in self.memo]
        if len(self.memo) + len(new) > MEMO:  # keep what these texts and the last ones use
            self._forget({*self.last, *names})
        self.last = names
        if new:
            self._learn(new)
        index = np.array([self.memo[x] for x in names], dtype=np.int64)[parts.indices.to_numpy()]
        ids, sizes = (gathered(x, self.counts, index) for x in self.pool)
        count = self.counts
        done = np.append(0, np.cumsum(count[index]))
        per_text = np.diff(done[np.searchsorted(at, norm.bounds)])
        if not self.fallback and len(ids) > 1:  # unknown characters in a row are one piece
            text = np.repeat(np.arange(len(per_text)), per_text)
            own = np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown) | (text[1:] != text[:-1]))
            at = np.flatnonzero(own)
            ids, sizes, per_text = ids[at], np.add.reduceat(sizes, at), np.bincount(text[at], minlength=len(per_text))
        return ids, sizes, per_text

    def encode(self, texts: list[bytes], first: bool = True, last: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begin and end of each piece in the bytes of its text, pieces of each text."""
        norm = self.normalise(texts, first, last)
        ids, sizes, count = self._pieces(norm)
        text = np.repeat(np.arange(len(texts)), count)
        ends = np.cumsum(sizes, dtype=np.int64)
        source = np.append(norm.source, 0)
        begin = source[np.minimum(ends - sizes, len(norm.source))]
        end = np.where(ends == norm.bounds[text + 1], norm.whole[text], source[ends]) if len(ids) else ends
        # Byte pieces of one character begin where it does, and only the last has its bytes.
        if len(ids):
            begin = np.where(ends - sizes == norm.bounds[text + 1], norm.whole[text], begin)
            empty = sizes == 0
            end = np.where(empty, begin, end)
        return ids, begin, end, count

    def windows(self, raw: bytes) -> Iterator[bytes]:
        """A text in windows; each but the first begins with a blank behind another character
        that no key of the map and no piece joins to it."""
        at = 0
        while at < len(raw):
            end = len(raw)
            if not self.inner_blank and self.escape and len(raw) - at > WINDOW:
                end = next((m.start() + 1 for m in re.compile(rb"[!-~](?= )").finditer(raw, at + WINDOW) if self._parts_at(raw, m.start() + 1)), end)
            yield raw[at:end]
            at = end

    def _parts_at(self, raw: bytes, at: int) -> bool:
        """No key of the map that begins before ``at`` ends behind it, and the character before
        stays what it is."""
        if self.fixed_raw and any(m.start() + len(m[1]) > at for m in self.fixed_raw.finditer(raw, max(0, at - 1000), at)):
            return False
        if self.map is None:
            return True
        near = np.frombuffer(raw[max(0, at - 1000) : at + 1000], dtype=np.uint8)
        place = min(at, 1000)
        length, _ = self.map.longest(near, np.arange(place))
        return not length[place - 1] and bool((np.arange(place) + length <= place).all())

    # Decoding ---------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, counts: np.ndarray, first: bool = True) -> list[bytes]:
        """The text of each list of ids, as UTF-8. Bytes that are none become U+FFFD each."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.pieces)):
            raise ValueError("ids outside the vocabulary")
        flat = gathered(self.said, self.said_size, ids).tobytes()
        ends = np.append(0, np.cumsum(self.said_size[ids]))[np.append(0, np.cumsum(counts))].tolist()
        at = np.append(0, np.cumsum(counts)).tolist()
        out = []
        for a, b, x, y in zip(at, at[1:], ends, ends[1:]):
            text = flat[x:y]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = self._mended(ids[a:b])
            out.append(text[self._put_before(ids[a:b]) :] if first else text)
        return out

    def _put_before(self, ids: np.ndarray) -> int:
        """Blanks at the start of a text that the normalisation had put there."""
        drop = 0
        if self.prefix or self.squeeze:
            for i in ids:
                if self.kind[i] in (NORMAL, USER_DEFINED, UNUSED) and self.pieces[i][0].startswith(BLANK):
                    drop += 1
                    if self.squeeze and self.pieces[i][0] == BLANK:
                        continue
                    return drop
                if self.kind[i] != CONTROL:
                    return drop
        return drop

    def _mended(self, ids: np.ndarray) -> bytes:
        """Decoded text where runs of byte pieces are no UTF-8."""
        out, kinds = [], self.kind[ids] == BYTE
        edges = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(ids))):
            text = b"".join(self._said(i) for i in ids[a:b])
            if kinds[a]:
                at, own = 0, []
                while at < len(text):
                    size = next((n for n in (1, 2, 3, 4) if _one(text[at : at + n])), 0)
                    own.append(text[at : at + size] if size else "�".encode())
                    at += size or 1
                text = b"".join(own)
            out.append(text)
        return b"".join(out)

    def digests(self, raw: bytes) -> tuple[int, str, str, int]:
        """Number of ids, SHA-256 of the ids as text and of the decoded text, and the bytes that
        the pieces' spans cover, of one long text, window by window."""
        n, covered, spelled, said, held = 0, 0, hashlib.sha256(), hashlib.sha256(), b""
        at = 0
        for window in self.windows(raw):
            ids, begin, end, count = self.encode([window], at == 0, at + len(window) == len(raw))
            n, covered = n + len(ids), covered + int((end - begin).sum())
            digits = held + gathered(self.digits, self.digit_size, ids).tobytes()
            spelled.update(digits[:-1])
            held = digits[-1:]
            said.update(self.decode(ids, count, at == 0)[0])
            at += len(window)
        return n, spelled.hexdigest(), said.hexdigest(), covered


def _one(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    """The process's model of a file; workers keep it between tasks."""
    if path not in _MODELS:
        with open(path, "rb") as f:
            _MODELS[path] = Model(f.read())
    return _MODELS[path]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, begins, ends of every whole text: the pieces, and for each the bytes of the
    text (UTF-8) it stands for, from begin to below end. Null and empty texts give empty lists,
    repeated rows are encoded each, an empty table gives no rows."""

    def run(batches):
        m = model(path)
        for ids, texts in W.chunks(batches, "doc_id", "text", size=CHUNK):
            pieces, begin, end, count = m.encode([t.encode() for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(pieces, count), _lists(begin, count), _lists(end, count)], ["doc_id", "ids", "begins", "ends"])

    return _texts(docs).mapInArrow(W.released(run), "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every (doc_id, ids); null ids give an empty text, ids outside the
    vocabulary are an error."""

    def run(batches):
        m = model(path)
        for b in batches:
            lists = [x or [] for x in b.column("ids").to_pylist()]
            flat = np.array([i for x in lists for i in x], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array([t.decode() for t in m.decode(flat, np.array([len(x) for x in lists], dtype=np.int64))], pa.string())})

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(W.released(run), "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes of every whole text, without
    shipping the ids; covered_bytes are the bytes in the pieces' spans. Cases as in ``encode``."""

    def run(batches):
        m = model(path)
        for ids, texts in W.chunks(batches, "doc_id", "text", size=CHUNK):
            raws = [t.encode() for t in texts]
            if len(raws) == 1 and len(raws[0]) > WINDOW:
                rows = [m.digests(raws[0])]
            else:
                pieces, begin, end, count = m.encode(raws)
                at = np.append(0, np.cumsum(count))
                spelled, places = gathered(m.digits, m.digit_size, pieces).tobytes(), np.append(0, np.cumsum(m.digit_size[pieces]))[at].tolist()
                covered, said = np.append(0, np.cumsum(end - begin))[at], m.decode(pieces, count)
                rows = [(n, hashlib.sha256(spelled[a : max(a, b - 1)]).hexdigest(), hashlib.sha256(t).hexdigest(), c) for n, a, b, t, c in zip(count.tolist(), places, places[1:], said, np.diff(covered).tolist())]
            n, x, y, c = zip(*rows)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": x, "decoded_sha256": y, "covered_bytes": pa.array(c, pa.int64())})

    return _texts(docs).mapInArrow(W.released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
