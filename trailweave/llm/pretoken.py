"""Pre-tokens of a byte-level BPE vocabulary: the matches of its pattern, exactly.

The pattern's matches cover a text without gaps, and where one ends follows from the classes
of neighbouring characters. ``Splitter.numbered`` finds all ends of a batch of texts at once
and numbers equal pre-tokens, so a word that comes often is one Python object. Any other
pattern is matched as it stands.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_TAILS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(1)
def _classes() -> np.ndarray:
    """code point -> class, as the pattern's own module sees it."""
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for low in range(0, 0x110000, 0x1000):
        if not 0xD800 <= low < 0xE000:  # no characters
            text = "".join(map(chr, range(low, low + 0x1000)))
            for c, p in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
                for m in regex.finditer(p, text):
                    out[low + m.start() : low + m.end()] = c
    return out


def starts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a match of PATTERN begins. ``code`` holds the code points of texts without a
    gap between them, ``first`` the first place of each text that is not empty."""
    kind = _classes()[code]
    new = np.zeros(len(code) + 1, dtype=bool)  # a text begins here; one more for the end
    new[first], new[-1] = True, True
    space, blank = kind == _SPACE, code == 32
    before, after = np.append(False, space[:-1]), np.append(space[1:], False)
    same = np.append(False, kind[1:] == kind[:-1])
    # A blank before a run belongs to it; the last of several spaces stands alone or goes on.
    out = np.where(space, ~before | ~after & ~new[1:], np.where(before, ~np.append(False, blank[:-1]), ~same)) | new[:-1]
    quotes = np.flatnonzero((code == 39) & out)
    for tail in _TAILS:
        at = quotes[quotes + len(tail) < len(code)]
        for i, c in enumerate(tail, 1):
            at = at[(code[at + i] == ord(c)) & ~new[at + i]]
        out[at + 1] = False
        rest = at + len(tail) + 1
        out[rest[rest < len(code)]] = True
    return out


class Splitter:
    """Splits texts by a pattern."""

    def __init__(self, pattern: str = PATTERN):
        self.exact = regex.compile(pattern).findall
        self.known = pattern == PATTERN

    def __call__(self, text: str) -> list[str]:
        return self.exact(text)

    def numbered(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different pre-tokens of all texts, the number of each pre-token in order, and
        the count of pre-tokens of each text."""
        if not self.known:
            split = [self.exact(t) for t in texts]
            number: dict[str, int] = {}
            index = np.array([number.setdefault(w, len(number)) for s in split for w in s], dtype=np.int64)
            return list(number), index, np.array([len(s) for s in split], dtype=np.int64)
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        whole = "".join(texts)
        if not whole:
            return [], np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        try:
            raw, wide = whole.encode("latin-1"), 1
        except UnicodeEncodeError:
            raw, wide = whole.encode("utf-32-le"), 4
        begin = np.cumsum(lens) - lens
        on = starts(np.frombuffer(raw, dtype=np.uint8 if wide == 1 else np.uint32), begin[lens > 0])
        at = np.flatnonzero(on)
        offsets = np.append(at, len(whole)) * wide
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        name = "latin-1" if wide == 1 else "utf-32-le"
        counts = np.diff(np.append(np.searchsorted(at, begin), len(at)))
        return [w.decode(name) for w in words.dictionary.to_pylist()], words.indices.to_numpy(), counts
