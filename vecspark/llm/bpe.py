"""Byte-level BPE encoding and decoding by the ranks of a vocabulary file.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton over all tokens finds the longest token at
each place of a piece.  An encoding is built from left to right of longest matches; a token may follow another one only
if the two are compatible, which is that merging their joined bytes by rank gives just these two.  (Every prefix of an
encoding by merges is one, so compatibility of neighbours is enough.)  Where no token fits, the last one is taken back
and a shorter one is tried; places where that failed are marked, so each place and token is tried once: linear time.
Compatibility is memoised by pair.

A piece that is a token itself is that token.  Texts are split by the pattern into matches, and each is encoded for
itself; a worker keeps the ids of pieces that it has seen, up to a number of bytes.  Decoding needs the bytes of tokens
only, in one array; the automaton is made where texts are encoded.

Defined cases: a null text is an empty one and has no ids; decoding null or no ids gives empty bytes; an id that the
vocabulary doesn't have is an error.  Repeated rows and null ids of documents are rows like any other.
"""

from __future__ import annotations

import base64

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, chunks, documents, id_and_text
from .tokens import Known, cut, tokenizer_path


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Decoder:
    """The bytes of all tokens of a vocabulary, in one array."""

    def __init__(self, ranks: dict[bytes, int]):
        token = [b""] * (max(ranks.values(), default=-1) + 1)
        for x, i in ranks.items():
            token[i] = x
        self.sizes = np.array([len(t) for t in token], np.int64)
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.first = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: gathers them from the joined bytes of all tokens."""
        out = []
        for begin in range(0, len(ids), 1 << 16):
            own = ids[begin : begin + (1 << 16)].astype(np.int64)
            size = self.sizes[own]
            before = np.cumsum(size) - size
            out.append(self.bytes[np.arange(size.sum()) + np.repeat(self.first[own] - before, size)].tobytes())
        return b"".join(out)


class Bpe:
    """Encoder of one vocabulary; remembers pieces, up to the bytes of Known, and `pairs` pairs of tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: int = 60_000):
        self.pattern, self.most_pairs = regex.compile(pattern), pairs
        self.rank = {token.decode("latin-1"): i for token, i in ranks.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for token in self.rank:
            self.automaton.add_word(token)
        self.automaton.make_automaton()
        self.shorter: dict[str, str] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known = Known()

    def merged(self, text: str) -> list[str]:
        """The merges themselves: the pair of lowest rank first, of equal ones the leftmost."""
        parts, rank = list(text), self.rank.get
        while len(parts) > 1:
            least, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (least is None or r < least):
                    least, at = r, i
            if least is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether b can follow a; a is "" at the start."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def next_shorter(self, token: str) -> str:
        """The longest token that is a proper prefix; "" if there is none."""
        got = self.shorter.get(token)
        if got is None:
            got = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), "")
            self.shorter[token] = got
        return got

    def piece(self, text: str) -> list[int]:
        """Ids of one match of the pattern, given as Latin-1."""
        whole = self.rank.get(text)
        if whole is not None:
            return [whole]
        n, at, out, failed = len(text), 0, [], set()
        most = [0] * n
        for end, size in self.automaton.iter(text):
            begin = end + 1 - size
            if size > most[begin]:
                most[begin] = size
        trial = text[: most[0]]
        while at < n:
            last = out[-1] if out else ""
            while trial and (at + len(trial) in failed or not self.compatible(last, trial)):
                trial = self.next_shorter(trial)
            if trial:
                out.append(trial)
                at += len(trial)
                trial = text[at : at + most[at]] if at < n else ""
            elif out:
                failed.add(at)
                trial = self.next_shorter(out.pop())
                at -= len(last)
            else:
                raise ValueError("the vocabulary can't express these bytes")
        return [self.rank[t] for t in out]

    def each(self, pieces_: list[str]) -> list[list[int]]:
        """The ids of each piece: of its matches, one after another."""
        return [[i for m in self.pattern.findall(x) for i in self.piece(m.encode().decode("latin-1"))] for x in pieces_]

    def encode(self, column: pa.Array) -> pa.ListArray:
        """The ids of each text of a column."""
        pieces_ = cut(column)
        flat, size = self.known.values(pieces_, self.each)
        first = np.concatenate(([0], np.cumsum(size)))[pieces_.first]
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat.view(np.int32)))


_made: dict[tuple[str, str], Bpe] = {}
_decoders: dict[str, Decoder] = {}


def bpe(path: str, pattern: str) -> Bpe:
    """A worker's own, kept between tasks."""
    if (path, pattern) not in _made:
        _made[path, pattern] = Bpe(read_ranks(path), pattern)
    return _made[path, pattern]


def decoder(path: str) -> Decoder:
    """A worker's own, kept between tasks."""
    if path not in _decoders:
        _decoders[path] = Decoder(read_ranks(path))
    return _decoders[path]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text): doc_id, ids."""

    def run(batches: Batches) -> Batches:
        own = bpe(path, pattern)
        for batch in chunks(batches):
            yield pa.record_batch([batch.column("doc_id"), own.encode(batch.column("text"))], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def _decoded(lists: pa.ListArray, own: Decoder) -> list[bytes]:
    values = lists.values.to_numpy(zero_copy_only=False)
    first, null = lists.offsets.to_numpy(), lists.is_null().to_numpy(zero_copy_only=False)
    return [b"" if null[i] else own.decode(values[first[i] : first[i + 1]]) for i in range(len(lists))]


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows (doc_id, ids): the same and decoded (bytes)."""

    def run(batches: Batches) -> Batches:
        own = decoder(path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                yield pa.record_batch([part.column("doc_id"), part.column("ids"), pa.array(_decoded(part.column("ids"), own), pa.binary())], names=["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """decode(encode(docs)) in one map, so a task needs one worker: doc_id, ids, decoded."""

    def run(batches: Batches) -> Batches:
        own, back = bpe(path, pattern), decoder(path)
        for batch in chunks(batches):
            ids = own.encode(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), ids, pa.array(_decoded(ids, back), pa.binary())], names=["doc_id", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of documents and the bytes that they decode to, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One map over the table, nothing is shuffled or broadcast.  A null or empty text has no ids (0 tokens, digests of
    nothing); a null doc_id and repeated rows are rows like any other; an empty table gives no rows.
    """
    import public_tokenizers

    both = round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
