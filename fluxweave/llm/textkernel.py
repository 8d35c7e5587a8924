"""Vectorised word and n-gram hashing of Arrow string columns.

Texts are taken as UTF-8 bytes.  All separators of the contracts are ASCII, so a byte table decides where words
begin and end, and a batch is hashed with a handful of numpy passes instead of one Python call a word.  Memory is
bounded by the chunk size (or by the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything ASCII but digits and letters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False
NOT_ALNUM[128:] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of the rows [row0, row1) of a batch; word i is data[starts[i]:ends[i]], row r has words off[r]..off[r+1]."""

    row0: int
    row1: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    off: np.ndarray

    def __post_init__(self) -> None:
        self._pos = None

    def _positions(self) -> np.ndarray:
        if self._pos is None:
            spans = np.diff(np.append(self.starts, len(self.data)))
            lead = self.starts[0] if len(self.starts) else len(self.data)
            pos = np.zeros(len(self.data), np.int64)
            pos[lead:] = np.arange(lead, len(self.data)) - np.repeat(self.starts, spans)
            self._pos = pos
        return self._pos

    def hash(self, prefix: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``prefix`` bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        pos, lens = self._positions(), self.ends - self.starts
        most = int(lens.max())
        table = np.zeros(max(most, int(pos.max()) + 1), np.uint64)
        table[: min(most, prefix or most)] = powers(_BASE, min(most, prefix or most))
        value = _TABLE[self.data] * table[pos]
        value[self.sep] = 0
        return mix(np.add.reduceat(value, self.starts) + np.minimum(lens, prefix or most).astype(np.uint64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for every i; the caller drops those that cross rows."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, q = np.zeros(len(h) - n + 1, np.uint64), powers(_STEP, n)
    for k in range(n):
        out += h[k : k + len(out)] * q[k]
    return mix(out + np.uint64(n))


def words(column: pa.Array, separators: np.ndarray, chunk_bytes: int = 1 << 19) -> Iterator[Words]:
    """Lower-cased (A-Z) words of a string column, in chunks of whole rows; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk_bytes, "right")) - 1)
        last = min(last, len(column))
        at = offsets[row : last + 1] - offsets[row]
        data = LOWER[raw[offsets[row] : offsets[last]]]
        sep = separators[data]
        begin = np.ones(len(data) + 1, bool)
        begin[1:-1] = sep[:-1]
        begin[at] = True  # no word crosses rows
        starts = np.flatnonzero(begin[:-1] & ~sep)
        stop = np.ones(len(data) + 1, bool)
        stop[1:-1] = sep[1:]
        stop[at] = True
        ends = np.flatnonzero(stop[1:] & ~sep) + 1
        out = Words(row, last, data, starts, ends, np.searchsorted(starts, at))
        out.sep = sep
        yield out
        row = last


def row_of(off: np.ndarray) -> np.ndarray:
    """For each word its row within the chunk."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
