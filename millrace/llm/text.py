"""Vectorised access to the words of Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Words and word sequences are named by
64-bit polynomial hashes taken from prefix sums, so that a batch costs a few numpy passes over its bytes.
Null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer document is a chunk of its own.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.empty(max(n, CHUNK + 1), np.uint64)
        have[0] = 1
        have[1:] = np.uint64(base)
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Hash of each values[lo:hi] (uint64), independent of where it stands."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return mix((sums[hi] - sums[lo]) * powers(pow(base, -1, 1 << 64), len(values) + 1)[lo])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


@dataclass
class Chunk:
    """Rows lo..hi of a batch: their bytes, and where each row's bytes start (one more entry than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def words(self, lower: bool = False) -> "Words":
        data, n = (_LOWER[self.data] if lower else self.data), len(self.data)
        solid = ~_SPACE[data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = ~solid[:-1]
        starts = np.flatnonzero(solid & (before | first[:n]))
        after = np.empty(n, bool)
        after[n - 1 :] = True
        after[:-1] = ~solid[1:]
        ends = np.flatnonzero(solid & (after | first[1:])) + 1
        return Words(self, starts, ends, spans_hash(_BYTE[data], starts, ends, _BASE) if n else np.empty(0, np.uint64), np.searchsorted(starts, self.offsets))


@dataclass
class Words:
    chunk: Chunk
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    #: Where each row's words start (one more entry than rows).
    rows: np.ndarray

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; those that would leave a chunk are missing."""
        if len(self.hashes) < n:
            return np.empty(0, np.uint64)
        lo = np.arange(len(self.hashes) - n + 1)
        return spans_hash(self.hashes, lo, lo + n, _WORD_BASE)

    def between(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of the words lo..hi."""
        return spans_hash(self.hashes, lo, hi, _WORD_BASE)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """The column's bytes, whole rows at a time."""
    offsets, data = buffers(column)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def sliding_argmin(keys: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest of keys[i:i+w] for each i (compared by their high 32 bits).

    However many keys there are, as many bits count, so equal stretches have their least key in the same place.
    """
    n = len(keys)
    if n < w:
        return np.empty(0, np.int64)
    bits = np.uint64(32)  # places; no Arrow batch has as many bytes
    marked = ((keys >> bits) << bits) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max)
    padded[:n] = marked
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def places(keys: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """np.lexsort((keys, group)) of 64-bit keys, within groups (small whole numbers; all one group if not given).

    Group, leading bits of the key and place are sorted as one number; keys that differ only in their other bits are put in order after that.
    """
    n = len(keys)
    low, high = max(1, n.bit_length()), int(group.max()).bit_length() if group is not None and n else 0
    if low + high > 44:
        return np.lexsort((keys,) if group is None else (keys, group))
    marked = ((keys >> np.uint64(low + high)) << np.uint64(low)) | np.arange(n, dtype=np.uint64)
    if high:
        marked |= group.astype(np.uint64) << np.uint64(64 - high)
    marked.sort()
    order = (marked & ((np.uint64(1) << np.uint64(low)) - np.uint64(1))).astype(np.int64)
    marked >>= np.uint64(low)
    ranked, alike = keys[order], marked[1:] == marked[:-1]
    differ = alike & (ranked[1:] != ranked[:-1])
    if differ.any():
        run = np.concatenate([[0], np.cumsum(~alike)])
        open_ = np.zeros(run[-1] + 1, bool)
        open_[run[1:][differ]] = True
        at = np.flatnonzero(open_[run])
        order[at] = order[at][np.lexsort((ranked[at], run[at]))]
    return order


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n positions some lo..hi covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, lo, 1)
    np.add.at(steps, hi, -1)
    return np.cumsum(steps[:n]) > 0
