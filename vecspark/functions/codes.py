"""Codes of batches of vectors, as numpy: the helpers that the Arrow functions call on a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .spec import ProductSpec, QuantizerSpec

TINY = 1e-12
#: Rows that are worked on at once.
ROWS = 256
#: Queries times bits up to which look-ups by byte are faster than a matrix product (measured at 64 and 384 dimensions).
LOOKUPS = 8


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without nulls, all of length dim."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if column.null_count or len(flat) != len(column) * dim:
        raise ValueError(f"not all vectors have {dim} components")
    return flat.reshape(-1, dim)


def lists_of(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, dim = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * dim, pa.int32()), pa.array(x.reshape(-1)).cast(kind, safe=False))


def bytes_of(x: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    rows, width = x.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, np.uint8))])


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    """A binary column without nulls, all of `width` bytes, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    if column.null_count or (np.diff(offsets) != width).any():
        raise ValueError(f"not all codes have {width} bytes")
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Rows of small integers to rows of bytes: the lowest bit first, in bytes from the lowest bit on."""
    values = values.astype(np.uint8, copy=False)
    rows, count = values.shape
    if bits == 8:
        return values
    if bits == 1:
        return np.packbits(values, axis=1, bitorder="little")
    per = 8 // bits
    if 8 % bits == 0:
        if count % per:
            values = np.pad(values, ((0, 0), (0, -count % per)))
        out = values[:, ::per].copy()
        for i in range(1, per):
            out |= values[:, i::per] << np.uint8(bits * i)
        return out
    apart = (values[:, :, None] >> np.arange(bits, dtype=np.uint8)) & np.uint8(1)
    return np.packbits(apart.reshape(rows, -1), axis=1, bitorder="little")


def unpack(packed: np.ndarray, count: int, bits: int) -> np.ndarray:
    """As bytes: the cells that pack() took."""
    if bits == 8:
        return packed
    if 8 % bits == 0:
        per, mask = 8 // bits, np.uint8((1 << bits) - 1)
        out = np.empty((len(packed), packed.shape[1] * per), np.uint8)
        for i in range(per):
            np.bitwise_and(packed >> np.uint8(bits * i), mask, out=out[:, i::per])
        return out[:, :count]
    apart = np.unpackbits(packed, axis=1, bitorder="little")[:, : count * bits].reshape(len(packed), count, bits)
    out = apart[:, :, 0].copy()
    for i in range(1, bits):
        out |= apart[:, :, i] << np.uint8(i)
    return out


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, norms as float32 values); a vector shorter than TINY stays as it is."""
    norm = np.float32(np.sqrt((x * x).sum(axis=1))).astype(float)
    return x / np.where(norm > TINY, norm, 1.0)[:, None], norm


def indices(x: np.ndarray, spec: QuantizerSpec) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each rotated coordinate, norms). A value on a boundary is in the upper cell."""
    edges, cells, norm = spec.boundaries, np.zeros(x.shape, np.uint8), np.zeros(len(x))
    for begin in range(0, len(x), ROWS):  # what a step makes stays near the processor
        own = slice(begin, begin + ROWS)
        u, norm[own] = unit(x[own])
        y = spec.rotate(u)
        if len(edges) > 15:
            cells[own] = np.searchsorted(edges, y, "right")
        else:
            for b in edges:
                cells[own] += y >= b
    return cells, norm


def reconstruct(cells: np.ndarray, spec: QuantizerSpec) -> np.ndarray:
    """Unit-norm reconstructions; an index out of range is an error."""
    if cells.size and (cells.min() < 0 or cells.max() >= len(spec.centroids)):
        raise ValueError(f"an index is not from 0 to {len(spec.centroids) - 1}")
    return spec.unrotate(spec.centroids[cells])


def encode_product(x: np.ndarray, spec: ProductSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, signs of the projected residual, norm of the residual). The norm of x is not kept."""
    cells, _ = indices(x, spec.base)
    left = unit(x)[0] - reconstruct(cells, spec.base)
    return cells, (left @ spec.projection.T >= 0).view(np.uint8), np.float32(np.sqrt((left * left).sum(axis=1))).astype(float)


def _plus_minus(signs: np.ndarray) -> np.ndarray:
    return np.array([-1.0, 1.0])[signs]


def decode_product(cells: np.ndarray, signs: np.ndarray, left: np.ndarray, spec: ProductSpec) -> np.ndarray:
    return reconstruct(cells, spec.base) + spec.scale * left[:, None] * (_plus_minus(signs) @ spec.projection)


def product_scores(cells, signs, left, queries: np.ndarray, spec: ProductSpec) -> np.ndarray:
    """rows x queries: estimates of <x / |x|, y>."""
    base = spec.base.centroids[cells] @ spec.base.rotate(queries).T
    return base + spec.scale * left[:, None] * (_plus_minus(signs) @ (queries @ spec.projection.T).T)


def scores(cells, norms, queries: np.ndarray, spec: QuantizerSpec) -> np.ndarray:
    """rows x queries: estimates of <x, y>."""
    return norms[:, None] * (spec.centroids[cells] @ spec.rotate(queries).T)


def byte_sums(queries: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray | None:
    """queries x bytes x 256: what each value of each byte of a packed code adds to each query's product. values: of the cells.

    None where cells don't fill bytes (3, 5, 6 and 7 bits).
    """
    if 8 % bits:
        return None
    per = 8 // bits
    table = values[unpack(np.arange(256, dtype=np.uint8)[:, None], per, bits)]
    padded = np.pad(queries, ((0, 0), (0, -queries.shape[1] % per)))
    return np.einsum("vp,qbp->qbv", table, padded.reshape(len(queries), padded.shape[1] // per, per))


def looked_up(packed: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """rows x queries: products of packed codes with queries, by sums of a byte each; cells are never unpacked."""
    rows, width = packed.shape
    out, base, step = np.empty((rows, len(sums))), np.arange(width) * 256, max(1, (1 << 19) // width)
    for begin in range(0, rows, step):
        at = packed[begin : begin + step] + base
        for q, table in enumerate(sums):
            out[begin : begin + step, q] = table.ravel().take(at).sum(axis=1)
    return out


def by_lookup(queries: int, bits: int) -> bool:
    """Whether look-ups beat unpacking and a matrix product: for few queries, whose share of the unpacking is large."""
    return 8 % bits == 0 and queries * bits <= LOOKUPS


def packed_products(packed: np.ndarray, queries: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """rows x queries: products of the values of packed cells with queries, either way."""
    if by_lookup(len(queries), bits):
        return looked_up(packed, byte_sums(queries, values, bits))
    return values[unpack(packed, queries.shape[1], bits)] @ queries.T


def packed_scores(packed: np.ndarray, norms: np.ndarray, queries: np.ndarray, spec: QuantizerSpec) -> np.ndarray:
    """scores() of packed codes."""
    return norms[:, None] * packed_products(packed, spec.rotate(queries), spec.centroids, spec.bits)


def packed_product_scores(mse: np.ndarray, signs: np.ndarray, left: np.ndarray, queries: np.ndarray, spec: ProductSpec) -> np.ndarray:
    """product_scores() of packed codes."""
    base = packed_products(mse, spec.base.rotate(queries), spec.base.centroids, spec.base.bits)
    return base + spec.scale * left[:, None] * packed_products(signs, queries @ spec.projection.T, np.array([-1.0, 1.0]), 1)


def uniform(x: np.ndarray, bits: int) -> np.ndarray:
    """Each vector's components, relative to its norm, to the nearest of 2^bits even steps from -1 to 1; halves go up."""
    norm = np.float32(np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(float)
    top = (1 << bits) - 1
    share = np.clip(x / np.where(norm > 0, norm, 1.0), -1, 1)
    return np.where(norm > 0, (np.floor((share + 1) / 2 * top + 0.5) / top * 2 - 1) * norm, 0.0)
