"""Vectorised word and word-n-gram hashing over Arrow text columns.

A text column's UTF-8 buffer is hashed as one array: a word's hash is a polynomial over its bytes (cumulative sums,
mod 2^64), so the cost for a word doesn't depend on Python. Blank bytes are 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is neither a letter nor a digit; bytes of multi-byte characters count as letters.
SYMBOL = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SLICE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shift and multiply rounds."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit multipliers made from a rule."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(salt)) | np.uint64(1)


_BYTE = seeds(256, 7)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for 64-bit integers much faster than numpy.unique, which hashes them."""
    x = np.sort(x)
    if len(x) < 2:
        return x
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


@dataclass
class Words:
    """The words of some documents in a row: hash, document number in the batch, first and past-the-last byte."""

    data: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    lo: int
    hi: int
    ends: np.ndarray  # byte offsets of documents lo..hi, len hi-lo+1

    def bounds(self) -> np.ndarray:
        """Word offsets of documents lo..hi."""
        return np.searchsorted(self.doc, np.arange(self.lo, self.hi + 1))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, nulls as empty, and its n+1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about limit bytes; a longer document is a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def hashed(column: pa.Array, lower: bool = False, separator: np.ndarray = BLANK) -> Iterator[Words]:
    """Words of a text column, a slice of documents at a time."""
    raw, offsets = utf8(column)
    for lo, hi in slices(offsets):
        data = raw[offsets[lo] : offsets[hi]]
        ends = offsets[lo : hi + 1] - offsets[lo]
        if lower:
            data = LOWER[data]
        yield split(data, ends, lo, hi, separator)


def split(data: np.ndarray, ends: np.ndarray, lo: int, hi: int, separator: np.ndarray = BLANK) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, np.zeros(0, np.uint64), lo, hi, ends)
    word = ~separator[data]
    starts, stops = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    cut = ends[(ends > 0) & (ends < n)]
    starts[cut] |= word[cut]
    stops[cut - 1] |= word[cut - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    up, down = _power(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        h = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    doc = np.searchsorted(ends, first, "right") - 1 + lo
    return Words(data, first, last, doc, h, lo, hi, ends)


def ngrams(words: Words, n: int, salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one document, and the numbers of their first words."""
    m = len(words.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    by = seeds(n, salt)
    with np.errstate(over="ignore"):
        h = words.hash[:m] * by[0]
        for k in range(1, n):
            h += words.hash[k : k + m] * by[k]
    at = np.flatnonzero(words.doc[:m] == words.doc[n - 1 :])
    return mix(h[at]), at
