"""Binary forms of codes and quantizers: a column of bytes each way. Layouts are fixed values of the formats."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.spec import ProductSpec, QuantizerSpec, packed_size
from vecspark.operators.encode import _add

#: Fixed values. Wire, big-endian: magic, version, type (1 plain, 2 product), dim, bits, 0, norm, lengths of cells and signs, 0.
WIRE = struct.Struct(">2sBBHBxfII2x")
WIRE_MAGIC, WIRE_VERSION, PLAIN, PRODUCT = b"TQ", 1, 1, 2
#: Fixed values. Portable, little-endian: magic, version, type, rotation kind, 0, dim, bits, seed, lengths of four float32 arrays.
PORTABLE = struct.Struct("<4s4BIIq4I")
PORTABLE_MAGIC, PORTABLE_VERSION = b"TQPB", 1
#: Fixed values. Compact, little-endian: dim, bits, seed; then a byte for the rotation kind, which older ones (dense) lack.
COMPACT = struct.Struct("<QQq")
KINDS = {"dense": 1, "hadamard": 2}
NAMES = {number: name for name, number in KINDS.items()}
#: Fixed values. Page, little-endian: magic, version, lengths of the two quantizers, entries, room for entries.
PAGE = struct.Struct("<4s5I")
PAGE_MAGIC, PAGE_VERSION = b"TQKV", 1


def wire(cells: bytes, norm: float, dim: int, bits: int, signs: bytes = b"") -> bytes:
    return WIRE.pack(WIRE_MAGIC, WIRE_VERSION, PRODUCT if signs else PLAIN, dim, bits, norm, len(cells), len(signs)) + cells + signs


def from_wire(data: bytes) -> dict:
    if len(data) < WIRE.size:
        raise ValueError("wire data is too short")
    magic, version, kind, dim, bits, norm, n_cells, n_signs = WIRE.unpack_from(data)
    if (magic, version) != (WIRE_MAGIC, WIRE_VERSION) or kind not in (PLAIN, PRODUCT):
        raise ValueError("not wire data")
    wanted = (packed_size(dim, bits - (kind == PRODUCT)), packed_size(dim, 1) if kind == PRODUCT else 0)
    if (n_cells, n_signs) != wanted or len(data) != WIRE.size + n_cells + n_signs:
        raise ValueError("wire data has another length")
    return {"dim": dim, "bits": bits, "norm": norm, "packed": data[WIRE.size : WIRE.size + n_cells], "signs": data[WIRE.size + n_cells :]}


def portable(spec: QuantizerSpec | ProductSpec) -> bytes:
    """All that a code's meaning depends on: matrix, centroids, boundaries, and the projection of a product code."""
    product = isinstance(spec, ProductSpec)
    base = spec.base if product else spec
    arrays = [np.asarray(x, "<f4").reshape(-1) for x in (base.dense, base.centroids, base.boundaries, spec.projection if product else np.zeros(0))]
    head = PORTABLE.pack(PORTABLE_MAGIC, PORTABLE_VERSION, PRODUCT if product else PLAIN, KINDS[base.rotation], 0, spec.dim, spec.bits, spec.seed, *map(len, arrays))
    return head + b"".join(a.tobytes() for a in arrays)


def from_portable(data: bytes) -> QuantizerSpec | ProductSpec:
    if len(data) < PORTABLE.size:
        raise ValueError("portable data is too short")
    magic, version, kind, rotation, _, dim, bits, seed, *sizes = PORTABLE.unpack_from(data)
    if (magic, version) != (PORTABLE_MAGIC, PORTABLE_VERSION) or kind not in (PLAIN, PRODUCT) or rotation not in NAMES:
        raise ValueError("not portable data")
    product = kind == PRODUCT
    cells = 1 << bits - product
    if sizes != [dim * dim, cells, cells - 1, dim * dim * product] or len(data) != PORTABLE.size + 4 * sum(sizes):
        raise ValueError("portable data has another length")
    at, arrays = PORTABLE.size, []
    for n in sizes:
        arrays.append(np.frombuffer(data, "<f4", n, at).astype(float))
        at += 4 * n
    if not all(np.isfinite(a).all() for a in arrays):
        raise ValueError("portable data holds a number that is not finite")
    base = QuantizerSpec(dim, bits - product, seed, NAMES[rotation], arrays[0].reshape(dim, dim), (tuple(arrays[1]), tuple(arrays[2])))
    return ProductSpec(dim, bits, seed, NAMES[rotation], (base, arrays[3].reshape(dim, dim))) if product else base


def compact(spec: QuantizerSpec | ProductSpec) -> bytes:
    return COMPACT.pack(spec.dim, spec.bits, spec.seed) + bytes([KINDS[spec.rotation]])


def from_compact(data: bytes, product: bool = False) -> QuantizerSpec | ProductSpec:
    """Bytes behind are ignored; without a kind byte the rotation is dense."""
    if len(data) < COMPACT.size:
        raise ValueError("compact data is too short")
    dim, bits, seed = COMPACT.unpack_from(data)
    kind = data[COMPACT.size] if len(data) > COMPACT.size else KINDS["dense"]
    if kind not in NAMES:
        raise ValueError("unknown rotation kind")
    return (ProductSpec if product else QuantizerSpec)(dim, bits, seed, NAMES[kind])


def wire_column(coded: DataFrame, spec: QuantizerSpec, out: str = "wire") -> DataFrame:
    """coded (packed, norm) with wire bytes."""
    dim, bits = spec.dim, spec.bits
    return _add(coded, f"{out} binary", "packed", spec.code_bytes, lambda b: [pa.array([wire(x, n, dim, bits) for x, n in zip(b.column("packed").to_pylist(), b.column("norm").to_pylist())], pa.binary())])


def wire_product_column(coded: DataFrame, spec: ProductSpec, out: str = "wire") -> DataFrame:
    """coded (mse, signs, res_norm of quantize_product()) with wire bytes."""
    dim, bits = spec.dim, spec.bits

    def make(batch):
        parts = zip(*(batch.column(n).to_pylist() for n in ("mse", "signs", "res_norm")))
        return [pa.array([wire(cells, norm, dim, bits, signs) for cells, signs, norm in parts], pa.binary())]

    return _add(coded, f"{out} binary", "mse", spec.base.code_bytes, make)


def wire_fields(df: DataFrame, column: str = "wire") -> DataFrame:
    """df with what its wire bytes say: wire_dim, wire_bits, wire_norm, wire_packed, wire_signs."""
    kinds = {"dim": pa.int32(), "bits": pa.int32(), "norm": pa.float32(), "packed": pa.binary(), "signs": pa.binary()}

    def make(batch):
        rows = [from_wire(x) for x in batch.column(column).to_pylist()]
        return [pa.array([r[k] for r in rows], t) for k, t in kinds.items()]

    return _add(df, "wire_dim int, wire_bits int, wire_norm float, wire_packed binary, wire_signs binary", column, None, make)


def _page_head(key: int, value: int, entries: int) -> bytes:
    return PAGE.pack(PAGE_MAGIC, PAGE_VERSION, key, value, entries, entries)


def _read_page_head(data: bytes) -> tuple[int, int, int, int]:
    """(bytes read, bytes of the key and the value quantizer, entries)."""
    magic, version, key, value, entries, _ = PAGE.unpack_from(data)
    if (magic, version) != (PAGE_MAGIC, PAGE_VERSION):
        raise ValueError("not a page")
    return PAGE.size, key, value, entries


def page_bytes(entries: DataFrame, by: list[str], keys: ProductSpec, values: QuantizerSpec) -> DataFrame:
    """by, page: each page's entries (slot, mse, signs, res_norm, packed, norm) in one blob; a page is of bounded size, as its slots are."""
    key_spec, value_spec = compact(keys), compact(values)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        head = _page_head(len(key_spec), len(value_spec), table.num_rows)
        joined = lambda name: b"".join(table.column(name).to_pylist())
        floats = lambda name: table.column(name).to_numpy().astype("<f4").tobytes()
        blob = head + key_spec + value_spec + joined("mse") + joined("signs") + floats("res_norm") + joined("packed") + floats("norm")
        return pa.table([*[table.column(b).slice(0, 1) for b in by], pa.array([blob], pa.binary())], names=[*by, "page"])

    fields = {f.name: f.dataType.simpleString() for f in entries.schema.fields}
    return entries.groupBy(*by).applyInArrow(run, ", ".join([*(f"`{b}` {fields[b]}" for b in by), "page binary"]))


def page_entries(pages: DataFrame, by: list[str]) -> DataFrame:
    """The entries of page_bytes() again."""
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("page")[i].as_py()
                at, n_key, n_value, n = _read_page_head(data)
                keys, values = from_compact(data[at : at + n_key], True), from_compact(data[at + n_key : at + n_key + n_value])
                at += n_key + n_value
                columns = []
                for width in (packed_size(keys.dim, keys.bits - 1), packed_size(keys.dim, 1), 4, values.code_bytes, 4):
                    columns.append([data[at + j * width : at + (j + 1) * width] for j in range(n)])
                    at += n * width
                if at != len(data):
                    raise ValueError("a page has another length")
                floats = lambda x: pa.array(np.frombuffer(b"".join(x), "<f4"))
                out = [pa.array(np.arange(n, dtype=np.int32)), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), floats(columns[2]), pa.array(columns[3], pa.binary()), floats(columns[4])]
                own = [pa.concat_arrays([batch.column(b).slice(i, 1)] * n) if n else batch.column(b).slice(0, 0) for b in by]
                yield pa.record_batch([*own, *out], names=[*by, "slot", "mse", "signs", "res_norm", "packed", "norm"])

    return pages.select(*by, "page").mapInArrow(run, ", ".join([*(f"`{b}` {fields[b]}" for b in by), "slot int, mse binary, signs binary, res_norm float, packed binary, norm float"]))


def read_portable(spark: SparkSession, path: str) -> DataFrame:
    """path, dim, bits, seed, rotation, centroids, boundaries of files in the portable form."""

    def run(batches):
        for batch in batches:
            specs = [from_portable(x) for x in batch.column("content").to_pylist()]
            bases = [s.base if isinstance(s, ProductSpec) else s for s in specs]
            yield pa.record_batch([batch.column("path"), pa.array([s.dim for s in specs], pa.int32()), pa.array([s.bits for s in specs], pa.int32()), pa.array([s.seed for s in specs], pa.int64()), pa.array([s.rotation for s in specs]), pa.array([b.centroids.tolist() for b in bases]), pa.array([b.boundaries.tolist() for b in bases])], names=["path", "dim", "bits", "seed", "rotation", "centroids", "boundaries"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, dim int, bits int, seed long, rotation string, centroids array<double>, boundaries array<double>").orderBy(F.col("path"))
