"""Codes of vector columns: maps over Arrow batches, no shuffle. Rows keep all their columns.

A column that is added replaces one of the same name.  Rows whose input is null, has another length or a null component get nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from vecspark.functions import codes
from vecspark.functions.spec import ProductSpec, QuantizerSpec


def _add(df: DataFrame, more: str, column: str, width: int | None, make: Callable[[pa.RecordBatch], list], keep: list[str] | None = None) -> DataFrame:
    """df with columns (DDL) that make() gets from the rows of a batch whose `column` has `width` elements or bytes (any, if None).

    keep: the columns of df that come back from Python, if not all: what is only read needn't travel twice.
    """
    added = StructType.fromDDL(more)
    keep = [f for f in df.schema.fields if f.name.lower() not in {x.name.lower() for x in added.fields} and (keep is None or f.name in keep)]
    names = [f.name for f in keep] + added.fieldNames()

    def fits(values: pa.Array) -> np.ndarray:
        if width is None:
            return values.is_valid().to_numpy(zero_copy_only=False)
        size = pc.binary_length(values) if pa.types.is_binary(values.type) else pc.list_value_length(values)
        ok = pc.fill_null(pc.equal(size, width), False).to_numpy(zero_copy_only=False)
        if not pa.types.is_binary(values.type) and values.values.null_count:
            hole = np.concatenate(([0], np.cumsum(pc.is_null(values.flatten()).to_numpy(zero_copy_only=False))))
            upto = np.concatenate(([0], np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False))))
            ok &= hole[upto[1:]] == hole[upto[:-1]]
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ok = fits(batch.column(column))
            if ok.all():
                made = make(batch)
            else:
                place = pa.array(np.cumsum(ok) - 1, mask=~ok)
                made = [x.take(place) for x in make(batch.filter(pa.array(ok)))]
            yield pa.record_batch([*(batch.column(f.name) for f in keep), *made], names=names)

    return df.mapInArrow(run, StructType([*keep, *added.fields]))


def rotate(df: DataFrame, spec: QuantizerSpec, vector: str = "v", out: str = "rotated", inverse: bool = False) -> DataFrame:
    spec = spec.solved()

    def make(batch):
        x = codes.matrix_of(batch.column(vector), spec.dim)
        return [codes.lists_of(spec.unrotate(x) if inverse else spec.rotate(x), pa.float64())]

    return _add(df, f"{out} array<double>", vector, spec.dim, make)


def quantize(df: DataFrame, spec: QuantizerSpec, vector: str = "v", keep: list[str] | None = None) -> DataFrame:
    """Adds packed (bytes) and norm (float). keep: the columns that stay, all if None."""
    spec = spec.solved()

    def make(batch):
        cells, norms = codes.indices(codes.matrix_of(batch.column(vector), spec.dim), spec)
        return [codes.bytes_of(codes.pack(cells, spec.bits)), pa.array(norms.astype(np.float32))]

    return _add(df, "packed binary, norm float", vector, spec.dim, make, keep)


def indices(df: DataFrame, spec: QuantizerSpec, vector: str = "v") -> DataFrame:
    """Adds cells (integers, not packed) and norm."""
    spec = spec.solved()

    def make(batch):
        cells, norms = codes.indices(codes.matrix_of(batch.column(vector), spec.dim), spec)
        return [codes.lists_of(cells, pa.int32()), pa.array(norms.astype(np.float32))]

    return _add(df, "cells array<int>, norm float", vector, spec.dim, make)


def unpack(df: DataFrame, dim: int, bits: int, packed: str = "packed", out: str = "cells") -> DataFrame:
    width = (dim * bits + 7) // 8
    return _add(df, f"{out} array<int>", packed, width, lambda b: [codes.lists_of(codes.unpack(codes.rows_of(b.column(packed), width), dim, bits), pa.int32())])


def dequantize(df: DataFrame, spec: QuantizerSpec, packed: str = "packed", out: str = "recon") -> DataFrame:
    """Adds the unit-norm reconstruction; times the norm it is the vector's."""
    spec = spec.solved()

    def make(batch):
        cells = codes.unpack(codes.rows_of(batch.column(packed), spec.code_bytes), spec.dim, spec.bits)
        return [codes.lists_of(codes.reconstruct(cells, spec), pa.float64())]

    return _add(df, f"{out} array<double>", packed, spec.code_bytes, make)


def dequantize_indices(df: DataFrame, spec: QuantizerSpec, cells: str = "cells", out: str = "recon") -> DataFrame:
    """As dequantize(), from integers; one out of range is an error."""
    spec = spec.solved()
    return _add(df, f"{out} array<double>", cells, spec.dim, lambda b: [codes.lists_of(codes.reconstruct(codes.matrix_of(b.column(cells), spec.dim).astype(np.int64), spec), pa.float64())])


def quantize_product(df: DataFrame, spec: ProductSpec, vector: str = "v", keep: list[str] | None = None) -> DataFrame:
    """Adds mse, signs (bytes) and res_norm (float). keep: the columns that stay, all if None."""
    spec = spec.solved()

    def make(batch):
        cells, signs, left = codes.encode_product(codes.matrix_of(batch.column(vector), spec.dim), spec)
        return [codes.bytes_of(codes.pack(cells, spec.bits - 1)), codes.bytes_of(codes.pack(signs, 1)), pa.array(left.astype(np.float32))]

    return _add(df, "mse binary, signs binary, res_norm float", vector, spec.dim, make, keep)


def product_parts(batch: pa.RecordBatch, spec: ProductSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, signs, residual norms) of a batch that quantize_product() made."""
    cells = codes.unpack(codes.rows_of(batch.column("mse"), spec.base.code_bytes), spec.dim, spec.bits - 1)
    signs = codes.unpack(codes.rows_of(batch.column("signs"), (spec.dim + 7) // 8), spec.dim, 1)
    return cells, signs, batch.column("res_norm").to_numpy(zero_copy_only=False).astype(float)


def dequantize_product(df: DataFrame, spec: ProductSpec, out: str = "recon") -> DataFrame:
    spec = spec.solved()
    return _add(df, f"{out} array<double>", "mse", spec.base.code_bytes, lambda b: [codes.lists_of(codes.decode_product(*product_parts(b, spec), spec), pa.float64())])


def own_scores(cells: np.ndarray, signs: np.ndarray, left: np.ndarray, q: np.ndarray, spec: ProductSpec) -> np.ndarray:
    """The estimated product of each code with the query of the same row."""
    sketch = (codes._plus_minus(signs) * (q @ spec.projection.T)).sum(axis=1)
    return (spec.base.centroids[cells] * spec.base.rotate(q)).sum(axis=1) + spec.scale * left * sketch


def score_product(df: DataFrame, spec: ProductSpec, query: str, out: str = "score") -> DataFrame:
    """Adds the estimated product of each row's code with the query vector in the same row."""
    spec = spec.solved()

    def make(batch):
        return [pa.array(own_scores(*product_parts(batch, spec), codes.matrix_of(batch.column(query), spec.dim), spec))]

    return _add(df, f"{out} double", query, spec.dim, make)


def matmul(df: DataFrame, weight: np.ndarray, vector: str = "v", out: str = "product") -> DataFrame:
    """Rows times a matrix that every task holds (at most MATMUL_BYTES); transposed products take weight.T."""
    if weight.nbytes > MATMUL_BYTES:
        raise ValueError(f"a matrix of {weight.nbytes} bytes isn't broadcast; use matmul_relational()")
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(weight, float))
    return _add(df, f"{out} array<double>", vector, len(weight), lambda b: [codes.lists_of(codes.matrix_of(b.column(vector), len(shared.value)) @ shared.value, pa.float64())])


MATMUL_BYTES = 64 << 20


def matmul_relational(a: DataFrame, b: DataFrame) -> DataFrame:
    """a (i, k, x) times b (k, j, y): i, j, value; a join on k and sums, for matrices of any size."""
    from pyspark.sql import functions as F

    return a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("value"))
