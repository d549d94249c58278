"""Ids of whole texts by a tokenizer file, one library call for each new piece instead of each text.

Byte-level BPE splits a text by a fixed pattern before it merges, and no match of that pattern crosses from a run of
other characters into white space but for one leading space.  Texts are therefore cut into pieces of that form (each a
row of whole matches), and the library encodes each distinct piece once; a text's ids are its pieces' ids.  A text that
holds one of the tokenizer's added tokens (an end-of-text mark, say) is cut at that before anything else, as the library
does it, so such a text goes to the library as a whole.

Pieces are cut, hashed and looked up as arrays, a batch of texts at a time.  A worker remembers the ids of pieces, known by
128 bits of hash, up to a number of bytes; those not asked for the longest go first, and long ones are not remembered.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .words import _BYTE, _word_sums, mix, texts_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Unicode's white space.
_WHITE = "\t-\r \x85\xa0" + "".join(chr(c) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
PIECE = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_WHITE_SET = frozenset(re.findall(f"[{_WHITE}]", "".join(map(chr, range(0x3001)))))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: First bytes of white space beyond ASCII, in UTF-8.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_OTHER_BYTE = mix(_BYTE + np.uint64(0x5851F42D4C957F2D))


@dataclass
class Cut:
    """Pieces of n rows. start, end: bytes of data; first: n + 1 places among the pieces."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def row(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode()

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        size = (self.end - self.start).astype(np.uint64)
        return tuple(mix(_word_sums(self.data, self.start, self.end, values) ^ size) for values in (_BYTE, _OTHER_BYTE))


def _wide_rows(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Rows with white space beyond ASCII."""
    at = np.flatnonzero(_LEAD[data])
    if not len(at):
        return []
    after = np.append(data, np.zeros(2, np.uint8))
    a, b, c = data[at], after[at + 1], after[at + 2]
    found = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    found |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | np.isin(c, (0xA8, 0xA9, 0xAF)))) | ((b == 0x81) & (c == 0x9F)))
    found |= ((a == 0xE1) & (b == 0x9A) | (a == 0xE3) & (b == 0x80)) & (c == 0x80)
    return np.unique(np.searchsorted(offsets, at[found], "right") - 1).tolist()


def cut(column: pa.Array) -> Cut:
    """As PIECE cuts each text."""
    data, offsets = texts_of(column)
    n = len(data)
    white = np.zeros(n + 2, bool)
    white[1:-1] = _SPACE[data]
    own, before, after = white[1:-1], white[:-2], white[2:]
    starts = own & ~after  # the last of a run of white space, where something follows
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    starts[ends] = False
    starts |= own & ~before
    lone = ~own & before  # not after a space, which the piece takes along
    lone[1:] &= data[:-1] != 32
    starts |= lone
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    for i in _wide_rows(data, offsets):
        a, b = int(offsets[i]), int(offsets[i + 1])
        sizes = [len(x.encode()) for x in PIECE.findall(data[a:b].tobytes().decode())]
        starts[a:b] = False
        starts[a + np.cumsum([0, *sizes[:-1]])] = True
    start = np.flatnonzero(starts)
    return Cut(data, offsets, start, np.append(start[1:], n)[: len(start)], np.searchsorted(start, offsets))


def spread(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values flat[first : first + size] of each place, one after another."""
    upto = np.cumsum(size)
    return flat[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(first - (upto - size), size)]


class Known:
    """Values (rows of 32-bit numbers) of pieces, in arrays in order of the first hash, up to about `most` bytes."""

    #: What a piece takes besides its values.
    ENTRY = 32

    def __init__(self, most: int = 48 << 20, longest: int = 64):
        self.most, self.longest, self.clock = most, longest, 0
        self._set(*(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int32, np.int32)), np.zeros(0, np.uint32))

    def _set(self, h, other, first, size, used, flat) -> None:
        self.h, self.other, self.first, self.size, self.used, self.flat = h, other, first, size, used, flat

    def values(self, pieces_: Cut, work: Callable[[list[str]], list]) -> tuple[np.ndarray, np.ndarray]:
        """(values of all pieces one after another, how many each has); work(texts of pieces): the values of new ones."""
        h, other = pieces_.hashes()
        h, example, inverse = np.unique(h, return_index=True, return_inverse=True)
        other = other[example]
        self.clock += 1
        at = np.minimum(np.searchsorted(self.h, h), max(len(self.h) - 1, 0))
        hit = (self.h[at] == h) & (self.other[at] == other) if len(self.h) else np.zeros(len(h), bool)
        new = np.flatnonzero(~hit)
        self.used[at[hit]] = self.clock
        found = [np.asarray(x, np.uint32) for x in work([pieces_.bytes(example[i]).decode() for i in new.tolist()])] if len(new) else []
        size, first = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        size[hit], first[hit] = self.size[at[hit]], self.first[at[hit]]
        size[new] = [len(x) for x in found]
        first[new] = len(self.flat) + np.cumsum(size[new]) - size[new]
        flat = np.concatenate((self.flat, *found)) if found else self.flat
        out = spread(flat, first[inverse], size[inverse]), size[inverse]
        short = new[(pieces_.end - pieces_.start)[example[new]] <= self.longest]
        there = np.searchsorted(self.h, h[short])
        free = np.ones(len(short), bool)  # a piece that shares the first hash with another one is not remembered
        if len(self.h):
            free = self.h[np.minimum(there, len(self.h) - 1)] != h[short]
        short, there = short[free], there[free]
        if len(short):
            columns = (self.h, h), (self.other, other), (self.first, first), (self.size, size), (self.used, np.full(len(h), self.clock))
            self._set(*(np.insert(x, there, y[short]) for x, y in columns), flat)
        if self.ENTRY * len(self.h) + self.flat.nbytes > self.most:
            self._forget()
        return out

    def _forget(self) -> None:
        """Half of the pieces stay, those that were asked for last."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: len(self.used) // 2])
        flat = spread(self.flat, self.first[keep], self.size[keep].astype(np.int64))
        size = self.size[keep]
        self._set(self.h[keep], self.other[keep], np.cumsum(size, dtype=np.int64) - size, size, self.used[keep], flat)


class Pieces:
    """Ids of texts by one tokenizer; `known` remembers pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known()
        #: Texts of the tokens that the library looks for before it splits, and a pattern of them (None without any).
        self.added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        (self.line_feed,) = self.ids("\n")

    def ids(self, text: str) -> np.ndarray:
        """By the library, of a text as it is."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def each(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of pieces or pre-tokens; many in one call: a line feed between them is always an id of its own."""
        out = [None if x[-1] not in _WHITE_SET else self.ids(x) for x in texts]
        words = [i for i, x in enumerate(out) if x is None]
        for begin in range(0, len(words), 20_000):
            own = words[begin : begin + 20_000]
            ids = self.ids("\n".join([texts[i] for i in own]))
            ends = np.append(np.flatnonzero(ids == self.line_feed), len(ids))
            for i, a, b in zip(own, np.append(0, ends[:-1] + 1).tolist(), ends.tolist()):
                out[i] = ids[a:b]
        return out

    def special_rows(self, pieces_: Cut) -> list[int]:
        """Rows that hold an added token."""
        if self.special is None:
            return []
        data = pieces_.data.tobytes()
        if not any(x.encode() in data for x in self.added):
            return []
        return [i for i in range(len(pieces_.offsets) - 1) if self.special.search(pieces_.row(i))]

    def encode(self, column: pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        pieces_ = cut(column)
        flat, size = self.known.values(pieces_, self.each)
        edges = np.concatenate(([0], np.cumsum(size)))[pieces_.first].tolist()
        flat = flat.astype("<u4", copy=False)
        out = [flat[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        for i in self.special_rows(pieces_):
            out[i] = self.ids(pieces_.row(i)).tobytes()
        return out


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """A worker's own, kept between tasks."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def encode_column(column: pa.Array, path: str) -> list[bytes]:
    return pieces(path).encode(column)
