"""Media columns: content-addressed payloads in tar shards.

A payload is stored once a shard as an 8-bit greyscale PNG of 64 columns, named by the digest of what is stored.  Each task
writes one tar file and returns, for each of its rows, the digest and the shard, offset and length of the stored bytes.  A digest
that several places hold is read from the first of them, so a payload that a third of all rows share is described, read and featured
once.

Metadata columns come from range reads of the first 33 bytes of each stored file (signature and header), without the payload.
Features come from a second job, which reads whole files and decodes them.

A task writes under a name of its own; only files that the stored index names belong to the output, so a repeated task
leaves no mark.  Files are written and read by Arrow's file systems, in the shared folder or any URI that those know.

Defined cases: a null text is empty, an empty payload is one row of 64 zeros; equal texts have equal digests; repeated
rows and null ids are rows like any other.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, chunks, documents, id_and_text, partitions, shared_folder, stored

WIDTH = 64
_PNG = b"\x89PNG\r\n\x1a\n"
HEADER = 33
#: Digests of texts that a task remembers at once, some 300 bytes each.
SEEN = 1 << 16
_STORED = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    """data and zeros up to a positive multiple of 64 bytes."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """Rows of 64 samples of 8 bits, no filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(lines.tobytes(), level)) + _part(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first 33 bytes."""
    if data[:8] != _PNG or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png made."""
    width, height, _ = header(data)
    at, packed = 8, b""
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        if data[at + 4 : at + 8] == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += 12 + size
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def write(docs: DataFrame, folder: str, compression: int = 6) -> DataFrame:
    """Stores the texts of docs; a row for each: doc_id, n_bytes, digest, shard, offset, length.

    A task stores a text again only if it had SEEN others since: index() takes one place of each digest.
    """
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)

    def run(batches: Batches) -> Batches:
        name, out, seen, end = f"{folder}/{uuid.uuid4().hex}.tar", None, {}, 0
        for batch in chunks(batches):
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = text.encode()
                key = hashlib.sha256(data).digest()
                if key not in seen:
                    stored_form = to_png(pad(data), compression)
                    digest = hashlib.sha256(stored_form).hexdigest()
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(stored_form)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    if out is None:
                        there, path = fs.FileSystem.from_uri(name)
                        out = there.open_output_stream(path)
                    out.write(head + stored_form + bytes(-len(stored_form) % tarfile.BLOCKSIZE))
                    if len(seen) == SEEN:
                        seen.clear()
                    seen[key] = digest, name, end + len(head), len(stored_form)
                    end += len(head) + -(-len(stored_form) // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE
                for to, x in zip(rows, (doc, len(data), *seen[key])):
                    to.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(x, k) for x, k in zip(rows, kinds)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(2 * tarfile.BLOCKSIZE))
            out.close()

    return stored(id_and_text(docs).mapInArrow(run, _STORED))


def index(rows: DataFrame) -> DataFrame:
    """digest, shard, offset, length: where each digest is read from; the first shard by name of those that hold it."""
    where = F.min(F.struct("shard", "offset", "length")).alias("x")
    return rows.where(F.col("shard").isNotNull()).groupBy("digest").agg(where).select("digest", "x.*")


def _by_shard(places: DataFrame) -> DataFrame:
    """Places dealt out in ranges of (shard, offset), so a task reads forward and a large shard is read by several."""
    return places.repartitionByRange(partitions(places.sparkSession), "shard", "offset").sortWithinPartitions("shard", "offset")


def _reader():
    at, file = None, None

    def read(shard: str, offset: int, length: int) -> bytes:
        nonlocal at, file
        if shard != at:
            store, path = fs.FileSystem.from_uri(shard)
            at, file = shard, store.open_input_file(path)
        file.seek(offset)
        return file.read(length)

    return read


def metadata(places: DataFrame) -> DataFrame:
    """places and width, height, bits: header-only range reads."""

    def run(batches: Batches) -> Batches:
        read = _reader()
        for batch in batches:
            got = [header(read(r["shard"], r["offset"], HEADER)) for r in batch.to_pylist()]
            columns = [pa.array([g[i] for g in got], pa.int32()) for i in range(3)]
            yield pa.record_batch([*batch.columns, *columns], names=[*batch.schema.names, "width", "height", "bits"])

    return _by_shard(places.select("digest", "shard", "offset", "length")).mapInArrow(run, "digest string, shard string, offset long, length long, width int, height int, bits int")


def features(places: DataFrame) -> DataFrame:
    """Of each stored file with metadata, read whole: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A row a place, whatever the number of rows that share it; no places give no rows.
    """

    def run(batches: Batches) -> Batches:
        read = _reader()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                data = read(r["shard"], r["offset"], r["length"])
                payload = from_png(data)
                counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                share = counts[counts > 0] / len(payload)
                mean = float((counts * np.arange(256)).sum() / len(payload))
                about = f"{r['width']}x{r['height']}x{r['bits']} mean={mean:.3f} entropy={abs(float((share * np.log2(share)).sum())):.3f}"
                rows.append((r["digest"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), about))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            if not rows:
                continue
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return places.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def payloads(places: DataFrame) -> DataFrame:
    """digest, payload (the padded bytes) of each stored file."""

    def run(batches: Batches) -> Batches:
        read = _reader()
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.record_batch([batch.column("digest"), pa.array([from_png(read(r["shard"], r["offset"], r["length"])) for r in rows], pa.binary())], names=["digest", "payload"])

    return _by_shard(places.select("digest", "shard", "offset", "length")).mapInArrow(run, "digest string, payload binary")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as stored greyscale images, read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Shuffled: digests and places of stored bytes, never the bytes.  Nothing is broadcast.  A null or empty text is a payload of 64 zeros;
    equal texts have equal values; null ids and repeated rows are rows like any other; an empty table gives no rows.
    """
    rows = write(documents(spark, sf_dir), shared_folder(spark))
    return rows.select("doc_id", "n_bytes", "digest").join(features(metadata(index(rows))), "digest").drop("digest")
