r"""Lower-case words (runs of ``\w``) of whole texts, their hashes, and batching.

Latin-1 texts are folded by one byte table; other texts take the regular expression.
Both give the same words.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_WORD = re.compile(r"\w+")
_FOLD = bytes(ord(chr(c).lower()) if re.match(r"\w", chr(c)) and ord(chr(c).lower()) < 256 else 32 for c in range(256))
#: Texts worked on together, in characters.
CHUNK_CHARS = 1_500_000
ROWS_AT_ONCE = 128


def words(text: str) -> list[str]:
    try:
        return text.encode("latin-1").translate(_FOLD).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text.lower())


class WordHashes(dict):
    """word -> 64-bit hash; forgotten and started again when it has grown too large."""

    LIMIT = 150_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def chunks(batches: Iterator, *columns: str, size: int = CHUNK_CHARS) -> Iterator[list[list]]:
    """Columns of Arrow batches as Python lists, cut so that the texts (the last
    column, null as empty) of a chunk have ``size`` characters or are one text. Rows become
    Python objects a few at a time, so a worker never holds a batch twice."""
    for batch in batches:
        picked = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        out: list[list] = [[] for _ in columns]
        held = 0
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            lists = [x.slice(k, ROWS_AT_ONCE).to_pylist() for x in picked]
            for row in zip(*lists):
                text = row[-1] or ""
                if held and held + len(text) > size:
                    yield out
                    out, held = [[] for _ in columns], 0
                for x, v in zip(out, row):
                    x.append(v)
                out[-1][-1] = text
                held += len(text)
        if out[-1]:
            yield out


def trim() -> None:
    """Give memory that is no longer used back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run):
    """A worker's function for Arrow batches that gives memory back when its task ends: workers
    live on, and a later stage's task shares the executor with them."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return go


def starts_of(lengths: list[int]) -> np.ndarray:
    out = np.zeros(len(lengths), dtype=np.int64)
    if len(lengths):
        np.cumsum(lengths[:-1], out=out[1:])
    return out
