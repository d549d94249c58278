"""Words of whole texts as numpy arrays: one pass over the bytes of an Arrow string column.

A word is a maximal run of bytes other than space and the controls 9 to 13, which are never part of a longer UTF-8
sequence, so words of bytes and words of characters are the same.  A word is known by a 64-bit hash of its bytes:
a polynomial with random byte values, by prefix sums, then a mixing step.  All sums wrap at 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BYTE_LOWER = _BYTE[_LOWER]
#: Bytes or words whose sums are taken at once: tables of powers have this length, whatever the length of a text.
_RUN = 1 << 16


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(_RUN + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _BACK = _powers(_BASE), _powers(_INVERSE)


@dataclass
class Words:
    """Words of n rows. first: n + 1 places in the other arrays; start, end: bytes of data; hash: 64 bits a word."""

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """All words of all rows. lower: A-Z count as a-z in the hash.

    Needs four bytes for each byte of text and 24 for each word; sums of bytes are held for a run only.
    """
    data, offsets = texts_of(column)
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins = inside[1:-1] & ~inside[:-2]
    begins[edges] = inside[1:-1][edges]
    start = np.flatnonzero(begins)
    del begins
    ends = inside[1:-1] & ~inside[2:]
    ends[edges - 1] = inside[1:-1][edges - 1]
    end = np.flatnonzero(ends) + 1
    del ends, inside
    h = _word_sums(data, start, end, _BYTE_LOWER if lower else _BYTE)
    return Words(data, np.searchsorted(start, offsets), start, end, mix(h ^ (end - start).astype(np.uint64)))


def _word_sums(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The polynomial of each word's bytes, by prefix sums over runs of bytes; a word longer than a run by its parts."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        a = int(start[i])
        j = int(np.searchsorted(end, a + _RUN, "right"))
        if j <= i:
            total, scale, step = 0, 1, int(_POWER[_RUN])
            for at in range(a, int(end[i]), _RUN):
                part = values[data[at : min(at + _RUN, int(end[i]))]]
                total += scale * int((part * _POWER[: len(part)]).sum(dtype=np.uint64))
                scale = scale * step & 0xFFFFFFFFFFFFFFFF
            out[i] = total & 0xFFFFFFFFFFFFFFFF
            i += 1
            continue
        own = values[data[a : int(end[j - 1])]]
        own *= _POWER[: len(own)]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own, out=sums[1:])
        first = start[i:j] - a
        out[i:j] = (sums[end[i:j] - a] - sums[first]) * _BACK[first]
        i = j
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Each value once, in order: a sort, which for many different integers is far faster than hashing them."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each place (len(words) - n + 1 places), across rows."""
    out = np.empty(max(len(words) - n + 1, 0), np.uint64)
    step = _RUN - n
    for a in range(0, len(out), step):
        b = min(a + step, len(out))
        sums = np.zeros(b - a + n, np.uint64)
        np.cumsum(words[a : b + n - 1] * _POWER[: b - a + n - 1], out=sums[1:])
        out[a:b] = mix((sums[n:] - sums[:-n]) * _BACK[: b - a])
    return out


def places(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every run of n words within one row."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    began = np.cumsum(count) - count
    return row, np.arange(len(row)) - np.repeat(began, count) + first[:-1][row]
