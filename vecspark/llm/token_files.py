"""Token-ID / binary output: one concatenated id array a shard, with Elias-Fano coded document boundaries.

A map encodes the texts; ids, not texts, are then range-partitioned and sorted by doc_id (and by the row's place in the
input, so that many rows with one doc_id or none are dealt over several ranges).  Each partition is a shard file:

    ids, little-endian, 2 bytes each where the vocabulary allows it, else 4
    Elias-Fano series: starts of documents in the id array, and its end
    Elias-Fano series: doc_id - smallest doc_id, of the documents that have one
    u8 bytes per id, u64 documents, u64 documents without an id, i64 smallest doc_id, u64 ids, u64 length of the two series, u8 version, "EFID"

Ids go out as they come, so a task holds a batch of them and two numbers a document.  A task writes under a name of its own and
returns it; only files in the returned list (a stored table with a row a shard) belong to the output, so a repeated task leaves
no mark.  Files are written by Arrow's file systems, into the shared folder or any URI that those know.

Defined cases: a null text is empty; an empty text has the end id alone.  Rows without a doc_id come first, rows that
repeat one stay next to each other.  An empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, chunks, documents, dropped, id_and_text, partitions, shared_folder, stored
from .elias_fano import EliasFano
from .tokens import encode_column, tokenizer_path

_TAIL = struct.Struct("<BQQqQQB4s")
_FILES = "shard int, path string, documents long, tokens long"


def tail_bytes(doc_ids: np.ndarray, nulls: int, lengths: np.ndarray, width: int) -> bytes:
    """What follows the ids of a file. doc_ids: in order, of the documents behind the first `nulls`."""
    least = int(doc_ids[0]) if len(doc_ids) else 0
    series = EliasFano.of(np.concatenate(([0], np.cumsum(lengths)))).tobytes() + EliasFano.of((doc_ids - least).view(np.uint64)).tobytes()
    return series + _TAIL.pack(width, len(lengths), nulls, least, int(lengths.sum()), len(series), 1, b"EFID")


class Shard:
    """A file opened for reading: boundaries at once, doc_ids and ids of documents when they are asked for."""

    def __init__(self, file):
        end = file.size()
        file.seek(end - _TAIL.size)
        width, self.documents, self.nulls, self.least, self.tokens, size, version, magic = _TAIL.unpack(file.read(_TAIL.size))
        if magic != b"EFID" or version != 1:
            raise ValueError("not a file of token ids")
        file.seek(end - _TAIL.size - size)
        series = file.read(size)
        self.starts, used = EliasFano.frombytes(series)
        self.keys, _ = EliasFano.frombytes(series[used:])
        self.file, self.kind = file, f"<u{width}"

    def doc_ids(self, begin: int, end: int) -> pa.Array:
        """Of the documents from begin to end."""
        at = np.arange(begin, end) - self.nulls
        known = self.keys.select(np.maximum(at, 0)).view(np.int64) + self.least if self.keys.n else np.zeros(len(at), np.int64)
        return pa.array(known, pa.int64(), mask=at < 0)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end of the shard's array."""
        width = int(self.kind[-1])
        self.file.seek(start * width)
        return np.frombuffer(self.file.read((end - start) * width), self.kind)


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids (binary, as in a file, then compressed: a third less to store and a fifth less to shuffle), of docs (doc_id, text)."""
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
    end = np.array([end_id], f"<u{width}").tobytes()

    def run(batches: Batches) -> Batches:
        small = zstandard.ZstdCompressor(level=6)
        for batch in chunks(batches):
            ids = [small.compress(np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() + end) for x in encode_column(batch.column("text"), path)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids binary").withColumn("width", F.lit(width))


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = 2) -> DataFrame:
    """Writes docs (doc_id, text) below folder; the files: shard, path, documents, tokens."""
    spark, store = docs.sparkSession, fs.FileSystem.from_uri(folder)
    store[0].create_dir(store[1], recursive=True)

    def run(batches: Batches) -> Batches:
        out, doc_ids, lengths, nulls, width, large = None, [], [], 0, 0, zstandard.ZstdDecompressor()
        for batch in chunks(batches, "ids"):
            if out is None:
                name, width = f"{folder}/{uuid.uuid4().hex}.ids", batch.column("width")[0].as_py()
                there, at = fs.FileSystem.from_uri(name)
                out = there.open_output_stream(at)
            column = batch.column("doc_id")
            nulls += column.null_count
            doc_ids.append(column.drop_null().to_numpy())
            own = []
            for x in batch.column("ids"):
                data = large.decompress(x.as_buffer())
                own.append(len(data) // width)
                out.write(data)
            lengths.append(np.array(own, np.int64))
        if out is not None:
            own = np.concatenate(lengths)
            out.write(tail_bytes(np.concatenate(doc_ids), nulls, own, width))
            out.close()
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([len(own)], pa.int64()), pa.array([own.sum()], pa.int64())], names=["shard", "path", "documents", "tokens"])

    # Stored, as the ranges are found by a look at the rows: texts are encoded once.
    rows_at = shared_folder(spark)
    rows = stored(encoded(docs, path, end_id), rows_at, "none").withColumn("place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(partitions(spark), "doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    files = stored(dealt.mapInArrow(run, _FILES))
    dropped(spark, rows_at)
    return files


def read_ids(files: DataFrame, carry: bool = True) -> DataFrame:
    """doc_id, start (over all shards), n_tokens, ids_crc32, ids of every document of the files (ids null unless carry)."""
    spark, before, rows = files.sparkSession, 0, []
    for r in files.orderBy("shard").toLocalIterator():  # a row a shard
        rows.append((r.path, before))
        before += r.tokens

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as file:
                    shard = Shard(file)
                    for begin in range(0, shard.documents, 500):
                        end = min(begin + 500, shard.documents)
                        starts = shard.starts.select(np.arange(begin, end + 1)).astype(np.int64)
                        ids = shard.ids(int(starts[0]), int(starts[-1])).astype("<u4")
                        own = [ids[a:b] for a, b in zip(starts[:-1] - starts[0], starts[1:] - starts[0])]
                        lists = pa.ListArray.from_arrays(pa.array(starts - starts[0], pa.int32()), pa.array(ids.astype(np.int32))) if carry else pa.nulls(end - begin, pa.list_(pa.int32()))
                        yield pa.record_batch([
                            shard.doc_ids(begin, end), pa.array(base + starts[:-1]), pa.array(np.diff(starts)), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()), lists,
                        ], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    listed = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    out = listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
    return out if carry else out.drop("ids")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents, written in order of doc_id and read back: doc_id, start, n_tokens, ids_crc32.

    A map encodes, ids are stored and shuffled once by range; the driver sees a row a file.  A null or empty text has the end
    id alone; rows without a doc_id come first, repeated rows one after another; an empty table gives no rows.
    """
    return read_ids(write_ids(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), shared_folder(spark)), carry=False)
