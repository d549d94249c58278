"""Packing: first-fit decreasing in randomised groups of documents.

Each document is its ids and an end id.  It is cut into pieces of the capacity and a rest.  A full piece is a sequence
of its own; rests are packed by first-fit decreasing, which finds the first bin with room by going down a tournament
tree whose inner nodes hold the largest room below them.  Groups of documents (dealt at random, row by row, whatever a row
holds: `group_rows` rows on average) are packed independently, so no task sees more than a group and nothing is global but
the group count.

The shuffle carries a few numbers a piece, unless `carry` asks for the ids themselves.

Defined cases: a null text is empty; an empty text is the end id alone.  Rows that repeat a doc_id are packed each for
itself.  A null doc_id stays null.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, chunks, documents
from .tokens import encode_column, tokenizer_path

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long, ids binary"


class RoomTree:
    """A tournament tree over bins in the order in which they were opened; each inner node holds the most room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """(bin, offset): takes `size` from the first bin that has the room. There is always one: as many bins as items."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        left = room[at] = room[at] - size
        bin_, most = at - self.leaves, left
        while at > 1:
            most = max(room[at], room[at ^ 1])
            at //= 2
            if room[at] == most:
                break
            room[at] = most
        return bin_, left


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size: longest first, of equal ones the earlier first."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = RoomTree(len(sizes), capacity)
    for i in np.argsort(-sizes, kind="stable"):
        bins[i], left = tree.put(int(sizes[i]))
        offsets[i] = capacity - left - sizes[i]
    return bins, offsets


def cut(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, carry: bool = False) -> DataFrame:
    """The pieces of all documents. docs: doc_id, text, grp (the group to be packed in)."""

    def run(batches: Batches) -> Batches:
        end = np.array([end_id], "<u4").tobytes()
        for batch in chunks(batches):
            rows = [], [], [], [], [], [], []
            for doc, group, ids in zip(batch.column("doc_id").to_pylist(), batch.column("grp").to_pylist(), encode_column(batch.column("text"), path)):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    for to, x in zip(rows, (doc, start, len(own) // 4, zlib.crc32(own), total, group, own if carry else None)):
                        to.append(x)
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(rows, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp", "ids"])

    return docs.select("doc_id", "text", "grp").mapInArrow(run, _PIECES)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, group_rows: int = 4096, seed: int = 11, carry: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; ids too (little-endian 32-bit) if carry."""
    groups = max(1, -(-docs.count() // group_rows))
    text = F.coalesce("text", F.lit(""))
    # By the row's place in its partition, which a repeated task finds again: rows that are equal are dealt apart, too.
    group = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), group.alias("grp"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
        size = table.column("length").to_numpy()
        full = size == capacity
        bins, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        bins[full] = np.arange(full.sum())
        bins[~full], offset[~full] = first_fit_decreasing(size[~full], capacity)
        bins[~full] += full.sum()
        columns = [table.column(c) for c in names[:5]] + [pa.array((table.column("grp")[0].as_py() << 32) + bins), pa.array(offset), table.column("ids")]
        return pa.table(columns, names=names)

    out = cut(docs, path, capacity, end_id, carry).groupBy("grp").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out if carry else out.drop("ids")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece.

    A map encodes, and a shuffle of a few numbers a piece takes it to its group; nothing is broadcast.  A null or empty text is
    the end id alone, repeated rows and null ids are packed each for itself, an empty table gives no rows.
    """
    return pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
