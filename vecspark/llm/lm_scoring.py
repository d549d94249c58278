"""LM scoring: a trigram model whose n-gram counts live in a log-frequency Bloom filter.

Training counts words, word pairs and word triples of all training texts.  Tasks count their own texts first and ship packed
partial counts by bucket of the key, so a very frequent word costs one entry a task.  Each bucket sums them exactly: word
counts stay as they are (the base score needs them), and the counts of pairs and triples, quantised on a grid that is
exact up to 5 and then grows by a factor of `base`, go into that bucket's slice of one Bloom filter.  A key of level q is
inserted q times, as (key, 1) .. (key, q); a reader probes (key, 1), (key, 2) .. until one is missing.  A slice has the bits that its
own insertions need to fill the share `fill` of it, so the filter grows with the corpus, false positives don't, and n-grams of
every count are in it.

A model (filter and word counts) of up to `bits` bits is broadcast.  A larger one stays in its buckets: texts go to blocks, the
distinct words and n-grams of a block to their buckets, and their counts and levels back to the block.  A frequent key is asked for
once a block, and a task holds one bucket or one block at a time.  Both ways give the same scores.

Probabilities back off by interpolation, with N tokens and V distinct ones in training, and low() the least count of a level:

    P(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P(w|v)   = (low(c(v w)) + pair P(w)) / (c(v) + pair)
    P(w|u v) = (low(c(u v w)) + triple P(w|v)) / (up(c(u v)) + triple),  up() the largest count of a level; P(w|v) for the first token

Counts are rounded down where they are parts and up where they are totals, so the probabilities of all words add up to 1 at the
most, but for false positives.  Those are cut back by what must hold: an n-gram is not more frequent than any n-gram in it.

N-grams are known by 36 bits within their bucket: two share a key with a probability that is small beside that of a false positive
(0.0001 with eight million in a bucket).  Words, whose counts are exact, are known by 52.

Defined cases: a null text is empty; an empty text has one token, the end.  A null doc_id counts as the text "" for the
fold (remainder 0: held out), and each row is scored alone, repeated or not.  Without training rows N = V = 0, the base is
log10(0.1 / 0.1) = 0 for each token, and so is the score.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, chunks, documents, packed, partitions, stored, unpacked
from .words import distinct, mix, words_of

#: Tokens for the end and the beginning of a text, spread over the hashes' range.
END, BEGIN = mix(np.array([0x0E4D, 0xBE61], np.uint64))
#: Bytes of text of a block, and keys that a task gathers before it ships them.
_BLOCK, _MOST = 8 << 20, 1 << 21
_PAIR, _TRIPLE = np.uint64(0xA24BAED4963EE407), np.uint64(0xD6E8FEB86659FD93)
#: Bits by which n-grams of one bucket, and words of one bucket, are told apart.
_KEY_BITS, _WORD_BITS = 36, 52
_COUNTED = "bucket int, grams boolean, keys binary, counts binary"
_BUCKET = "bucket int, words binary, counts binary, bits binary, tokens long, distinct long, size long, ones long"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


@dataclass(frozen=True)
class Settings:
    bits: int = 1 << 28
    fill: float = 0.33
    probes: int = 4
    base: float = 1.25
    pair: float = 64.0
    triple: float = 4.0


@lru_cache
def grid(base: float) -> np.ndarray:
    """The least count of each level from 1 on."""
    out = [1]
    while out[-1] < 1 << 62:
        out.append(max(out[-1] + 1, int(out[-1] * base)))
    if len(out) > 255:
        raise ValueError("levels have to fit a byte: the base is too small")
    return np.array(out, np.int64)


def levels(count: np.ndarray, base: float) -> np.ndarray:
    """The level of each count; 0 of 0."""
    return np.searchsorted(grid(base), count, "right")


def least_count(level: np.ndarray, base: float) -> np.ndarray:
    return np.concatenate(([0], grid(base)))[level]


def most_count(level: np.ndarray, base: float) -> np.ndarray:
    return (np.concatenate((grid(base), [1 << 62])) - 1)[level]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """0 .. buckets - 1 by the key's upper 32 bits."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def spare_bits(buckets: int, bits: int = _KEY_BITS) -> int:
    """Lower bits of keys that are not needed to tell those of a bucket apart."""
    return max(0, 64 - bits - (buckets - 1).bit_length())


def cut_keys(keys: np.ndarray, buckets: int, bits: int = _KEY_BITS) -> np.ndarray:
    drop = np.uint64(spare_bits(buckets, bits))
    return keys >> drop << drop


def packed_keys(keys: np.ndarray, drop: int = 0) -> bytes:
    """Keys in order, without their lower bits, as differences."""
    return packed(np.diff(keys >> np.uint64(drop), prepend=np.uint64(0)))


def unpacked_keys(data: bytes, drop: int = 0) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64) << np.uint64(drop)


@dataclass
class Tokens:
    """Tokens of n rows: words in lower case (A-Z only), then an end for each row; the token before; keys of pairs and triples."""

    row: np.ndarray
    token: np.ndarray
    before: np.ndarray
    pair: np.ndarray
    triple: np.ndarray
    #: Whether a token is the first of its row, which has no triple.
    first: np.ndarray


def tokens_of(column: pa.Array, buckets: int) -> Tokens:
    words = words_of(column, lower=True)
    rows = len(words.first) - 1
    ends = words.first[1:] + np.arange(rows)
    token = np.empty(len(words.hash) + rows, np.uint64)
    is_word = np.ones(len(token), bool)
    is_word[ends] = False
    token[is_word], token[ends] = cut_keys(words.hash, buckets, _WORD_BITS), cut_keys(END, buckets, _WORD_BITS)
    first = np.zeros(len(token), bool)
    first[words.first[:-1] + np.arange(rows)] = True
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first] = cut_keys(BEGIN, buckets, _WORD_BITS)
    pair = mix(before * _PAIR ^ token)
    triple = np.empty_like(pair)
    triple[1:] = mix(pair[:-1] * _TRIPLE ^ token[1:])
    triple[:1] = 0
    return Tokens(np.repeat(np.arange(rows), np.diff(words.first) + 1), token, before, cut_keys(pair, buckets), cut_keys(triple, buckets), first)


def tokens_of_all(batch: pa.RecordBatch, buckets: int) -> Tokens:
    """tokens_of() of all texts of a block, worked out in pieces that stay near the processor."""
    parts, rows = [], 0
    for piece in chunks([batch]):
        t = tokens_of(piece.column("text"), buckets)
        t.row += rows
        rows += piece.num_rows
        parts.append(t)
    if len(parts) == 1:
        return parts[0]
    return Tokens(*(np.concatenate([getattr(t, f.name) for t in parts]) for f in fields(Tokens))) if parts else tokens_of(batch.column("text"), buckets)


def _by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """buckets + 1 places in keys, which are in order."""
    return np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))


def _count(buckets: int):
    """A task's partial counts, packed by bucket; `_MOST` keys of a kind are counted at once."""
    drops, begin = (spare_bits(buckets, _WORD_BITS), spare_bits(buckets)), cut_keys(BEGIN, buckets, _WORD_BITS)

    def counted(grams: bool, kept: list[np.ndarray]) -> pa.RecordBatch:
        key, count = np.unique(np.concatenate(kept), return_counts=True)
        edges = _by_bucket(key, buckets)
        some = np.flatnonzero(np.diff(edges))
        own = [slice(edges[b], edges[b + 1]) for b in some]
        return pa.record_batch([
            pa.array(some, pa.int32()), pa.array([grams] * len(some)),
            pa.array([packed_keys(key[x], drops[grams]) for x in own], pa.binary()), pa.array([packed(count[x]) for x in own], pa.binary()),
        ], names=["bucket", "grams", "keys", "counts"])

    def run(batches: Batches) -> Batches:
        kept: dict[bool, list[np.ndarray]] = {False: [], True: []}
        for batch in chunks(batches):
            t = tokens_of(batch.column("text"), buckets)
            kept[False] += [t.token, np.full(batch.num_rows, begin)]
            kept[True] += [t.pair, t.triple[~t.first]]
            for grams, keys in kept.items():
                if sum(map(len, keys)) > _MOST:
                    yield counted(grams, keys)
                    keys.clear()
        for grams, keys in kept.items():
            if keys:
                yield counted(grams, keys)

    return run


def _places(keys: np.ndarray, level: int, probe: int, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of (key, level) in its bucket's slice."""
    odd = np.uint64((level * 0x9E3779B97F4A7C15 + probe * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)
    return first + ((mix(keys + odd) >> np.uint64(32)) * size >> np.uint64(32))


def room(insertions: int, settings: Settings) -> int:
    """Bits, a multiple of 8, of which so many insertions set the share settings.fill."""
    return max(64, int(np.ceil(insertions * settings.probes / -np.log1p(-settings.fill) / 8)) * 8)


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]):
    """(keys, counts), each key once and in order, of (keys in order, counts); a sixteenth of the keys' range at a time."""
    if not parts:
        return
    low, high = min(int(k[0]) for k, _ in parts), max(int(k[-1]) for k, _ in parts)
    edges = np.array([low + (high - low) * i // 16 for i in range(16)], np.uint64)
    cuts = [[*np.searchsorted(k, edges), len(k)] for k, _ in parts]
    for i in range(16):
        key, count = (np.concatenate([x[which][c[i] : c[i + 1]] for x, c in zip(parts, cuts)]) for which in (0, 1))
        if len(key):
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            yield key[begins], np.add.reduceat(count, begins)


def _reduce(settings: Settings, buckets: int):
    """A bucket's row: its words with their exact counts, and its slice of the filter."""
    drops, begin = (spare_bits(buckets, _WORD_BITS), spare_bits(buckets)), cut_keys(BEGIN, buckets, _WORD_BITS)

    def run(table: pa.Table) -> pa.Table:
        sums = {}
        for grams in (False, True):
            own = table.filter(pc.equal(table.column("grams"), grams))
            parts = [(unpacked_keys(k.as_py(), drops[grams]), unpacked(c.as_py()).astype(np.int64 if not grams else np.uint32)) for k, c in zip(own.column("keys"), own.column("counts"))]
            found = [(k, levels(c, settings.base).astype(np.uint8) if grams else c) for k, c in _sums(parts)]
            sums[grams] = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (list(zip(*found)) or [(), ()])]
            del parts, found
        key, level = sums[True]
        size = np.uint64(room(int(level.sum()), settings))
        bits, most = np.zeros(int(size) // 8, np.uint8), int(level.max(initial=0))
        for at in range(0, len(key), 1 << 18):
            k, lv = key[at : at + (1 << 18)], level[at : at + (1 << 18)]
            for j in range(1, most + 1):
                if j > 1:
                    k, lv = k[lv >= j], lv[lv >= j]
                if not len(k):
                    break
                for i in range(settings.probes):
                    p = _places(k, j, i, np.uint64(0), size)
                    np.bitwise_or.at(bits, (p >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))
        word, count = sums[False]
        real = word != begin
        return pa.table({
            "bucket": table.column("bucket").slice(0, 1), "words": pa.array([packed_keys(word, drops[0])], pa.binary()), "counts": pa.array([packed(count)], pa.binary()), "bits": pa.array([bits.tobytes()], pa.binary()),
            "tokens": pa.array([int(count[real].sum())], pa.int64()), "distinct": pa.array([int(real.sum())], pa.int64()), "size": pa.array([int(size)], pa.int64()), "ones": pa.array([int(np.bitwise_count(bits).sum())], pa.int64()),
        })

    return run


class Held:
    """Word counts and a filter (of one bucket, or all of them) in memory. edges: the places of the buckets' slices, in bits."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, bits: np.ndarray, edges: np.ndarray, settings: Settings):
        self.words, self.counts, self.bits, self.edges, self.settings = words, counts, bits, edges, settings

    def count(self, words: np.ndarray) -> np.ndarray:
        """The exact count of each word."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram: probes until one is missing."""
        out, most = np.zeros(len(keys), np.uint8), len(grid(self.settings.base))
        for begin in range(0, len(keys), 1 << 17):
            k = keys[begin : begin + (1 << 17)]
            at = bucket_of(k, len(self.edges) - 1) if len(self.edges) > 2 else np.zeros(len(k), np.int64)
            first, size = self.edges[at], self.edges[at + 1] - self.edges[at]
            alive, j = np.arange(len(k)), 1
            while len(alive) and j <= most:
                for i in range(self.settings.probes):
                    p = _places(k[alive], j, i, first[alive], size[alive])
                    alive = alive[(self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
                out[begin + alive] = j
                j += 1
        return out


@dataclass
class Model:
    """table: a row a bucket (words, counts, bits); held: all of it, None where that is more than settings.bits; fill: the share of bits that are set."""

    settings: Settings
    buckets: int
    tokens: int
    distinct: int
    size: int
    fill: float
    table: DataFrame
    held: Held | None


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Counts all words, pairs and triples of docs (text), and builds the filter."""
    spark, buckets = docs.sparkSession, partitions(docs.sparkSession)
    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count(buckets), _COUNTED)
    table = stored(counted.groupBy("bucket").applyInArrow(_reduce(settings, buckets), _BUCKET))
    rows = {r.bucket: r for r in table.select("bucket", "tokens", "distinct", "size", "ones").collect()}  # a few numbers a bucket
    sizes = np.array([rows[b].size if b in rows else room(0, settings) for b in range(buckets)], np.int64)
    tokens, distinct, ones = (sum(r[c] for r in rows.values()) for c in ("tokens", "distinct", "ones"))
    held = None
    if sizes.sum() + 128 * (distinct + 1) <= settings.bits:
        edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.uint64)
        bits, words, counts = np.zeros(int(edges[-1]) // 8, np.uint8), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for r in table.select("bucket", "words", "counts", "bits").orderBy("bucket").toLocalIterator():
            at = int(edges[r.bucket]) // 8
            bits[at : at + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
            words.append(unpacked_keys(bytes(r.words), spare_bits(buckets, _WORD_BITS)))
            counts.append(unpacked(bytes(r.counts)).astype(np.int64))
        held = Held(np.concatenate(words), np.concatenate(counts), bits, edges, settings)
    return Model(settings, buckets, tokens, distinct, int(sizes.sum()), ones / float(sizes.sum()), table.select("bucket", "words", "counts", "bits"), held)


@dataclass(frozen=True)
class _Small:
    """What every task needs of a model."""

    settings: Settings
    buckets: int
    tokens: int
    distinct: int

    def lines(self, batch: pa.RecordBatch, count, level) -> pa.RecordBatch:
        """A row for each text. count(words), level(keys): of all that _wanted() names for these texts, in its order."""
        t, s = tokens_of_all(batch, self.buckets), self.settings
        total = self.tokens + 0.1 * (self.distinct + 1)
        kind, at = np.unique(np.append(t.token, cut_keys(BEGIN, self.buckets, _WORD_BITS)), return_inverse=True)
        own = count(kind)[at]
        own, begins = own[:-1], own[-1]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[t.first] = begins
        base = np.log10((own + 0.1) / total)
        key, at = np.unique(np.concatenate((t.pair, t.triple[~t.first])), return_inverse=True)
        found = level(key)[at]
        pair = np.minimum(found[: len(t.pair)], levels(np.minimum(own, before), s.base)).astype(np.uint8)
        triple, pair_before = np.zeros_like(pair), np.zeros_like(pair)
        pair_before[1:] = pair[:-1]
        pair_before[t.first] = 0
        triple[~t.first] = found[len(t.pair) :]
        triple = np.minimum(triple, np.minimum(pair, pair_before))
        p = (own + 0.1) / total
        p = (np.minimum(least_count(pair, s.base), before) + s.pair * p) / (before + s.pair)
        p = (least_count(triple, s.base) + s.triple * p) / (most_count(pair_before, s.base) + s.triple)
        rows = batch.num_rows
        sums = lambda x: np.bincount(t.row, weights=x, minlength=rows)
        return pa.record_batch([
            batch.column("doc_id"), batch.column("held_out"), pa.array(np.bincount(t.row, minlength=rows)), pa.array(sums(own > 0).astype(np.int64)),
            pa.array(sums(base)), pa.array(sums(np.log10(np.minimum(p, 1.0)))),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _score(small, held):
    """Lines of texts by a broadcast model."""

    def run(batches: Batches) -> Batches:
        for batch in chunks(batches):
            yield small.lines(batch, held.value.count, held.value.level)

    return run


def _blocks(batches: Batches) -> Batches:
    """Texts of about _BLOCK bytes in one row, compressed; blocks are numbered."""
    n = TaskContext.get().partitionId() << 36
    for batch in chunks(batches, most=_BLOCK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "data"])
        n += 1


def _block(data: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(data.as_buffer()).read_next_batch()


def _wanted(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The words and the n-grams that the texts of a block look up, each once and in order, so those of a bucket lie together."""
    t = tokens_of_all(batch, buckets)
    return distinct(np.append(t.token, cut_keys(BEGIN, buckets, _WORD_BITS))), distinct(np.concatenate((t.pair, t.triple[~t.first])))


def _ask(buckets: int):
    drops = spare_bits(buckets, _WORD_BITS), spare_bits(buckets)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                words, grams = _wanted(_block(data), buckets)
                w, g = _by_bucket(words, buckets), _by_bucket(grams, buckets)
                asked = np.flatnonzero(np.diff(w) + np.diff(g))
                yield pa.record_batch([
                    pa.array([block] * len(asked), pa.int64()), pa.array(asked, pa.int32()),
                    pa.array([packed_keys(words[w[b] : w[b + 1]], drops[0]) for b in asked], pa.binary()), pa.array([packed_keys(grams[g[b] : g[b + 1]], drops[1]) for b in asked], pa.binary()),
                ], names=["block", "bucket", "words", "grams"])

    return run


def _answer(settings: Settings, buckets: int, most: int = 200_000):
    """Rows in order of bucket, the bucket's own first: the counts and levels of each row's words and n-grams. About `most` are looked up at once."""
    drops, none = (spare_bits(buckets, _WORD_BITS), spare_bits(buckets)), np.zeros(0, np.uint64)

    def looked_up(bucket: int, held: Held, rows: list) -> pa.RecordBatch:
        out = []
        for ask, unpack in ((lambda x: held.count(x).astype(np.uint64), 1), (held.level, 2)):
            keys = [unpacked_keys(r[unpack], drops[unpack - 1]) for r in rows]
            got = ask(np.concatenate([none, *keys]))
            out.append(np.split(got, np.cumsum([len(k) for k in keys])[:-1]))
        counts, level = out
        return pa.record_batch([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()),
            pa.array([packed(x) for x in counts], pa.binary()), pa.array([zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in level], pa.binary()),
        ], names=["block", "bucket", "counts", "levels"])

    def run(batches: Batches) -> Batches:
        at, held, rows, size = None, None, [], 0
        for batch in batches:
            for block, bucket, words, grams, counts, bits in zip(*(batch.column(c) for c in ("block", "bucket", "words", "grams", "counts", "bits"))):
                bucket = bucket.as_py()
                if rows and (bucket != at or size >= most):
                    yield looked_up(at, held, rows)
                    rows, size = [], 0
                if bucket != at:
                    at, held = bucket, Held(none, none.astype(np.int64), np.zeros(8, np.uint8), np.array([0, 64], np.uint64), settings)
                if block.is_valid:
                    rows.append((block.as_py(), words.as_py(), grams.as_py()))
                    size += len(rows[-1][2]) // 3
                else:
                    own = np.frombuffer(bits.as_py(), np.uint8)
                    held = Held(unpacked_keys(words.as_py(), drops[0]), unpacked(counts.as_py()).astype(np.int64), own, np.array([0, 8 * len(own)], np.uint64), settings)
        if rows:
            yield looked_up(at, held, rows)

    return run


def _settle(small):
    """A block's texts, and counts and levels of what they look up, bucket by bucket: the lines of the texts."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.filter(pc.is_valid(table.column("levels"))).sort_by("bucket")
        counts = np.concatenate([np.zeros(0, np.uint64), *(unpacked(x.as_py()) for x in parts.column("counts"))]).astype(np.int64)
        level = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x.as_py()) if x.as_py() else b"" for x in parts.column("levels")), np.uint8)
        batch = _block(table.filter(pc.is_valid(table.column("data"))).column("data")[0])
        # What was asked for is what lines() asks for, in the same order.
        out = small.lines(batch, lambda _: counts, lambda _: level)
        return pa.Table.from_batches([out])

    return run


def _score_by_buckets(docs: DataFrame, model: Model, small: _Small) -> DataFrame:
    # Stored: a text's block has to be the same for what it asks and for itself.
    blocks = stored(docs.mapInArrow(_blocks, "block long, data binary"))
    asked = blocks.mapInArrow(_ask(model.buckets), "block long, bucket int, words binary, grams binary")
    dealt = asked.unionByName(model.table, allowMissingColumns=True).repartition(model.buckets, "bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first())
    # Stored, so the shuffle of the keys is done with before the texts move.
    answered = stored(dealt.mapInArrow(_answer(model.settings, model.buckets), "block long, bucket int, counts binary, levels binary"))
    return blocks.unionByName(answered, allowMissingColumns=True).groupBy("block").applyInArrow(_settle(small), _SCORED)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, held_out): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text"))
    small = _Small(model.settings, model.buckets, model.tokens, model.distinct)
    if model.held is None:
        rows = _score_by_buckets(docs, model, small)
    else:
        rows = docs.mapInArrow(_score(small, docs.sparkSession.sparkContext.broadcast(model.held)), _SCORED)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(folds: int, fold: int):
    """Whether crc32(doc_id as text) mod folds is fold."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of nine tenths of them: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Shuffled: packed partial counts of n-grams; for a model of over 32 MB also each block's distinct n-grams, what is known of them, and
    the texts.  Broadcast: the model, up to 32 MB.  A null or empty text has one token, the end; a null doc_id is held out; repeated
    rows are scored each for itself; an empty table gives no rows.
    """
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(10, 0))
    return score(docs, train(docs.where(~F.col("held_out"))))
