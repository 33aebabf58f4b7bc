"""Words of whole Arrow string columns, split and hashed with numpy.

Every word class used here is a set of bytes: UTF-8 bytes from 0x80 up are
either all inside or all outside of it.  A column's text buffer can therefore
be split without decoding a single string.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_BLOCK = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD1342543DE82EF95
_SHINGLE = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_VALUE = _byte_values()
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def byte_class(inside) -> np.ndarray:
    return np.fromiter((inside(b) for b in range(256)), dtype=bool, count=256)


#: [^\x20\x09-\x0D]+
NOT_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text whose A-Z is lower-cased
ALNUM = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _ODD, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, pow(_ODD, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
    return up, down


_UP, _DOWN = _powers(2 * _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def row_slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Consecutive row ranges of about limit bytes; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def split(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and each row's first word, of rows whose bytes lie in data[off[0]:off[-1]]."""
    lo, hi = int(off[0]), int(off[-1])
    kept = inside[data[lo:hi]]
    edge = off[:-1] - lo
    edge = edge[edge < hi - lo]
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    first[edge] |= kept[edge]
    last = kept.copy()
    last[:-1] &= ~kept[1:]
    before = edge[edge > 0] - 1
    last[before] |= kept[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts + lo, ends + lo, np.searchsorted(starts, off - lo)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased; equal words hash equally in every process."""
    global _UP, _DOWN
    out = np.empty(len(starts), np.uint64)
    table, i = _VALUE[FOLD], 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + _BLOCK, "left")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            if hi - lo > len(_UP):
                _UP, _DOWN = _powers(hi - lo)
            part = table[data[lo:hi]] * _UP[: hi - lo]
            at = starts[i:j] - lo
            # every other sum covers the bytes between two words and is dropped
            bounds = np.stack([at, ends[i:j] - lo], axis=1).ravel()
            sums = np.add.reduceat(np.append(part, np.uint64(0)), bounds)[::2]
            out[i:j] = sums * _DOWN[at] + (ends[i:j] - starts[i:j]).astype(np.uint64) * _MULT
            i = j
    return mix(out)


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some rows, and each row's first word (one entry more than rows)."""
    starts, ends, first = split(data, off, inside)
    return hash_words(data, starts, ends), first


def ngrams(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (k up to 5), whatever row they belong to."""
    if len(w) < k:
        return np.zeros(0, np.uint64)
    n = len(w) - k + 1
    with np.errstate(over="ignore"):
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out += w[j : j + n] * _SHINGLE[j]
            out = mix(out) if j == k - 1 else out ^ (out >> np.uint64(29))
    return out


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = 5):
    """Sorted distinct k-word shingles of each row; fewer words make one shingle, none make none."""
    w, first = words(data, off, NOT_SPACE)
    grams = ngrams(w, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield ngrams(w[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
