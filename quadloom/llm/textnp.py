"""Vectorised text primitives over UTF-8 byte buffers.

An Arrow string column already is one byte buffer plus offsets, so every
helper here works on whole slices of documents at once: no Python object is
made per word, and a slice of about a megabyte keeps its temporaries in cache.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Multiplier of the polynomial hash modulo 2**64, odd so that it has an inverse.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_powers = np.ones(1, dtype=np.uint64)
_inverse_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, cached for the life of the worker."""
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("_powers", BASE), ("_inverse_powers", BASE_INV)):
                table = np.full(size, base, dtype=np.uint64)
                table[0] = 1
                globals()[name] = np.multiply.accumulate(table)
    return _powers[:n], _inverse_powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (in place; returns its argument)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (length + 1, from 0) of a string column; a null is an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        return buffers(column.cast(pa.string()))
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    _, raw_offsets, raw = column.buffers()
    if n == 0 or raw_offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(raw_offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer text is a range of its own, never cut."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        out.append((at, to))
        at = to
    return out


#: ASCII upper case to lower case; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters and digits of ASCII and every byte of a multi-byte character count as word bytes.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin-1 letters (C3 80..9E to C3 A0..BE), at unchanged length."""
    out = LOWER[data]
    if len(out) > 1:
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
        out[capital + 1] += 32
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a run never crosses a document's border."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < n)]
    first[border] = inside[border]
    last[border - 1] = inside[border - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum over the slice."""
    n = len(data)
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    h = prefix[ends] - prefix[starts]
    h *= down[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def counts_to_offsets(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def per_document(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets, by document, into a sorted array of byte positions."""
    return np.searchsorted(positions, offsets, side="left").astype(np.int64)


def ragged_sum(values: np.ndarray, offsets: np.ndarray, dtype=np.float64) -> np.ndarray:
    """Sum of each range; an empty range gives 0."""
    total = np.zeros(len(values) + 1, dtype)
    np.cumsum(values, out=total[1:], dtype=dtype)
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged_reduce(ufunc, values: np.ndarray, offsets: np.ndarray, empty):
    """``ufunc`` over each range; ``empty`` where a range has no element."""
    out = np.full(len(offsets) - 1, empty, dtype=values.dtype)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(filled):
        out[filled] = ufunc.reduceat(values, offsets[filled])
    return out


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges start .. start + length."""
    to = counts_to_offsets(lengths)
    return np.repeat(starts - to[:-1], lengths) + np.arange(to[-1])
