"""Elias-Fano coding of a non-decreasing series: about 2 + log2(range / n) bits a value, and select by position.

The lower bits of each value are stored as they are.  The upper parts are a bitmap with a one for each value, at place
upper + i.  The directory over that bitmap has no 64-bit table: ones before each block of 512 bits are 16-bit numbers within
superblocks of 2^15 bits, one number a superblock counts those before it, and every 512th one names its block, so select
looks at the few blocks between two samples and then reads one: about 0.05 bits of directory a bit.  The directory is made once and
stored behind the series; opening one makes no pass over it.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 512
#: Blocks in a superblock, and ones from one sample to the next.
SUPER, SAMPLE = 64, 512
_HEAD = struct.Struct("<QQBQQ")


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, above: np.ndarray, within: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.blocks = high.reshape(-1, BLOCK // 8)
        self.above, self.within, self.samples = above, within, samples

    @staticmethod
    def _directory(n: int, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ones before each superblock, ones before each block within its superblock, blocks of the sampled ones), a superblock at a time."""
        blocks = high.reshape(-1, BLOCK // 8)
        above, within, samples, total = np.zeros(-(-len(blocks) // SUPER), "<u8"), np.zeros(len(blocks), "<u2"), np.zeros(-(-n // SAMPLE), "<u4"), 0
        for k in range(len(above)):
            own = slice(k * SUPER, (k + 1) * SUPER)
            upto = np.cumsum(np.bitwise_count(blocks[own]).sum(axis=1, dtype=np.int64))
            above[k], within[own] = total, upto - np.diff(upto, prepend=0)
            first, end = -(-total // SAMPLE), -(-(total + int(upto[-1])) // SAMPLE)
            samples[first:end] = k * SUPER + np.searchsorted(upto, np.arange(first, end) * SAMPLE - total, "right")
            total += int(upto[-1])
        return above, within, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        low_bits = max(0, (most // max(n, 1)).bit_length() - 1)
        low = np.zeros(-(-n * low_bits // 8) * 8, np.uint8)
        for b in range(low_bits):
            low[b : n * low_bits : low_bits] = (values >> np.uint64(b)).astype(np.uint8) & 1
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(places[-1]) + 1 if n else 1) // BLOCK) * BLOCK, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little")
        return cls(n, low_bits, np.packbits(low, bitorder="little"), high, *cls._directory(n, high))

    def rank(self, block: np.ndarray) -> np.ndarray:
        """Ones before each of these blocks."""
        return self.above[block // SUPER].astype(np.int64) + self.within[block]

    def _block(self, i: np.ndarray) -> np.ndarray:
        """The block with the i-th one: between two samples, by halves."""
        low = self.samples[i // SAMPLE].astype(np.int64)
        after = i // SAMPLE + 1
        high = np.where(after < len(self.samples), self.samples[np.minimum(after, len(self.samples) - 1)].astype(np.int64), len(self.blocks) - 1)
        while (low < high).any():
            middle = (low + high + 1) // 2
            up = self.rank(middle) <= i
            low, high = np.where(up, middle, low), np.where(up, high, middle - 1)
        return low

    def select(self, at: np.ndarray) -> np.ndarray:
        """The values at these positions."""
        at = np.asarray(at, np.int64)
        out = np.empty(len(at), np.uint64)
        for begin in range(0, len(at), 4096):
            i = at[begin : begin + 4096]
            block = self._block(i)
            ones = np.cumsum(np.unpackbits(self.blocks[block], axis=1, bitorder="little"), axis=1, dtype=np.int16)
            place = block * BLOCK + (ones > (i - self.rank(block))[:, None]).argmax(axis=1)
            value = (place - i).astype(np.uint64) << np.uint64(self.low_bits)
            for b in range(self.low_bits):
                p = i * self.low_bits + b
                value |= ((self.low[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
            out[begin : begin + 4096] = value
        return out

    def tobytes(self) -> bytes:
        return _HEAD.pack(self.n, 0, self.low_bits, len(self.low), len(self.high)) + b"".join(x.tobytes() for x in (self.low, self.high, self.above, self.within, self.samples))

    @classmethod
    def frombytes(cls, data: bytes) -> tuple[EliasFano, int]:
        """The series, and how many bytes it took."""
        n, _, low_bits, low, high = _HEAD.unpack_from(data)
        at, parts, blocks = _HEAD.size, [], high * 8 // BLOCK
        for kind, count in (("u1", low), ("u1", high), ("<u8", -(-blocks // SUPER)), ("<u2", blocks), ("<u4", -(-n // SAMPLE))):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, low_bits, *parts), at
