"""Words, lines and n-grams of Arrow text columns as 64-bit hashes, in whole-array steps.

A word's hash is a polynomial over its bytes, read off running sums, so that a
slice of texts costs a handful of array operations and no loop over words.
Hashes are 64 bits wide: two different words of a corpus with a billion
distinct words collide with a chance of a few per cent, once in the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[name] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; a longer text is a range of its own."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, int(offsets[start]) + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, stop
        start = stop


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with NULL as the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


@dataclass
class Texts:
    """Bytes of several texts, their words, and the running sums that give any span's hash."""

    data: np.ndarray  # bytes as they are
    offsets: np.ndarray  # of texts in data, one more than texts
    starts: np.ndarray  # of words in data
    ends: np.ndarray
    doc: np.ndarray  # text of each word
    sums: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * _power("inverse", _INVERSE, len(self.data) + 1)[starts]
        return mixed(h)

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def words_per_text(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each text of a value per byte."""
        running = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return running[self.offsets[1:]] - running[self.offsets[:-1]]


def split(column: pa.Array, lower: bool = True, spaces: np.ndarray = _SPACES) -> Texts:
    """Words of each text: longest runs of bytes outside ``spaces`` (space and control white space).

    ``lower`` folds A-Z in the hashes.  Empty texts have no words.
    """
    raw = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[raw[0] : raw[-1]] if body is not None else np.zeros(0, np.uint8)
    offsets = raw - raw[0]
    n = len(data)
    values = _BYTE_VALUE[_LOWER[data] if lower else data]
    values = values * _power("base", _BASE, n + 1)[:n]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    inside = ~spaces[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    return Texts(data, offsets, starts, ends, doc, sums)


_GRAM = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words within one text, and the index of its first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = len(hashes) - n + 1
    total = np.zeros(k, np.uint64)
    for i in range(n):
        total += hashes[i : i + k] * _GRAM[i]
    at = np.flatnonzero(doc[:k] == doc[n - 1 :])
    return mixed(total[at]), at
