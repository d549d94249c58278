"""Whitening of embeddings by a digit-slice GEMM: exact covariances, and components of any scale.

Vectors become integers, x = floor(scale * c).  What the components are fitted to is each distinct x once: n vectors with
sums S.  Everything that could cancel is an integer, never rounded:

1. a task sums the x of its rows; the sums of tasks are added as big integers to n and S;
2. y = n x - S is a vector's difference from the mean, times n.  It is split into digits of 20 bits (balanced, so at most 2**19 in
   size), a digit a matrix; the products of two digit matrices over up to 8,192 rows are below 2**53, where float64 BLAS is exact.
   Products are put together again as big integers, task by task, and merged by row of the matrix: G = sum of y y^T;
3. the driver has one d x d matrix of integers (V = G / n^3) and decomposes it: float64 first, then Jacobi rotations in
   fixed-point integers of `bits` bits, whose matrix products are digit slices too.  So eigenvalues that are 1e-40 of the largest still have all their digits;
4. each vector is projected, y v / (n sqrt(e)); over the fit list the covariance of the results is compared with the identity.

Vectors of different lengths are whitened apart.  The decomposition takes 2 to 3 s on the driver at 64 dimensions,
and grows with d^3.

Defined cases: vectors that are null or hold null or non-finite components take no part; empty ones have no components.  Repeated rows
and rows without a vec_id each get their own results.  Values beyond 64 bits after scaling take the largest long.  A component
without variance (fewer distinct vectors than components) has explained 0 (null where nothing varies at all) and a null whitened
value, and is left out of identity_error, which is null where no component is left.  A deviation of more than 38 digits is null.  An empty
table gives no rows.
"""

from __future__ import annotations

import decimal
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, stored, whole_rows, with_row

#: Bits of a digit, and rows whose products are summed in float64: 2 * 19 + 13 bits.
DIGIT, ROWS = 20, 1 << 13
_SUMS = "dim int, i int, numbers array<string>"


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    components: int = 4
    bits: int = 240


def integers(vectors: DataFrame, s: Settings) -> DataFrame:
    """row (all columns of vectors), x (longs), dim of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    usable = F.col("embedding").isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(s.scale * c).cast("long"))
    return whole_rows(vectors.where(usable), x.alias("x"), F.size(v).alias("dim"))


def matrices(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows of the batch, their x) for each length of vectors."""
    dims = batch.column("dim").to_numpy()
    return [(int(d), at := np.flatnonzero(dims == d), batch.column("x").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(d))) for d in np.unique(dims)]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, as longs where all of it surely fits, else as Python's integers."""
    size = max(map(abs, (int(x.max(initial=0)), int(x.min(initial=0))))) * n + max(map(abs, sums.tolist()), default=0)
    if size < 1 << 61:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def digits(y: np.ndarray) -> list[np.ndarray]:
    """float64 matrices of balanced digits: y = the sum of digit k * 2**(20 k)."""
    out, half = [], 1 << (DIGIT - 1)
    while y.size and (y != 0).any():
        low = ((y + half) & ((1 << DIGIT) - 1)) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> DIGIT
    return out


def product(a: list[np.ndarray], b: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """a^T b of matrices of digits, exactly, as Python's integers. At most ROWS rows are summed at once."""
    parts = [np.zeros(shape, np.int64) for _ in range(len(a) + len(b))]
    out = np.zeros(shape, object)
    for begin in range(0, len(a[0]) if a and b else 0, ROWS):
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                parts[i + j] += (p[begin : begin + ROWS].T @ q[begin : begin + ROWS]).astype(np.int64)
        for k, part in enumerate(parts):
            out += part.astype(object) << (DIGIT * k)
            part[:] = 0
    return out


def summed(partial: DataFrame) -> dict[tuple[int, int], list[int]]:
    """(dim, i) -> numbers, the sums over all tasks: added up in a stream by key, so a key may have any number of rows."""

    def run(batches: Batches) -> Batches:
        key, total = None, []
        row = lambda: pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([list(map(str, total))], pa.list_(pa.string()))], names=["dim", "i", "numbers"])
        for batch in batches:
            for r in batch.to_pylist():
                own = list(map(int, r["numbers"]))
                if (r["dim"], r["i"]) == key:
                    total = [a + b for a, b in zip(total, own)]
                else:
                    if key is not None:
                        yield row()
                    key, total = (r["dim"], r["i"]), own
        if key is not None:
            yield row()

    merged = partial.repartition("dim", "i").sortWithinPartitions("dim", "i").mapInArrow(run, _SUMS)
    return {(r.dim, r.i): list(map(int, r.numbers)) for r in merged.collect()}  # a row for each row of a d x d matrix


def sums_of(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """dim -> (n, S)."""

    def run(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, at, x in matrices(batch):
                # Halves of longs, so that sums of a batch stay longs.
                own = ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0)
                total[dim] = total.get(dim, 0) + np.append(np.array([len(at)], object), own)
        for dim, numbers in total.items():
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([0], pa.int32()), pa.array([list(map(str, numbers))], pa.list_(pa.string()))], names=["dim", "i", "numbers"])

    return {dim: (numbers[0], np.array(numbers[1:], object)) for (dim, _), numbers in summed(fit.mapInArrow(run, _SUMS)).items()}


def gram(fit: DataFrame, shared) -> dict[int, np.ndarray]:
    """dim -> the sum of y y^T. shared: a broadcast dim -> (n, S)."""

    def run(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in matrices(batch):
                for begin in range(0, len(x), ROWS):
                    own = digits(centred(x[begin : begin + ROWS], *shared.value[dim]))
                    total[dim] = total.get(dim, 0) + product(own, own, (dim, dim))
        for dim, g in total.items():
            rows = [list(map(str, r)) for r in g]
            yield pa.record_batch([pa.array([dim] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["dim", "i", "numbers"])

    found = summed(fit.mapInArrow(run, _SUMS))
    return {dim: np.array([found[dim, i] for i in range(dim)], object).reshape(dim, dim) for dim in {d for d, _ in found}}


def fixed_product(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """a^T b of fixed-point matrices."""
    return product(digits(a), digits(b), (a.shape[1], b.shape[1])) >> bits


def eigen(g: np.ndarray, bits: int) -> tuple[list[int], np.ndarray]:
    """(eigenvalues as shares of the trace, in units of 2**-bits, falling; unit eigenvectors as columns in float64) of a symmetric integer matrix.

    None of it, where the trace is 0.  Each vector's largest entry is positive.
    """
    d, trace, one = len(g), int(sum(g.diagonal())), 1 << bits
    if not trace:
        return [0] * d, np.zeros((d, d))
    a = (g << bits) // trace
    about = np.linalg.eigh((a / one).astype(np.float64))[1]
    q = (about * 2.0**60).round().astype(np.int64).astype(object) << (bits - 60)
    eye = np.array([[one if i == j else 0 for j in range(d)] for i in range(d)], object)
    for _ in range(5):  # orthogonal to all bits: each step squares the error
        q = fixed_product(q.T, 3 * eye - fixed_product(q, q, bits), bits) >> 1
    b = fixed_product(q, fixed_product(a, q, bits), bits)
    while _sweep(b, q, bits):
        pass
    values = b.diagonal()
    by = sorted(range(d), key=lambda i: (-values[i], i))
    vectors = (q[:, by] / one).astype(np.float64)
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return [int(values[i]) for i in by], vectors


def _sweep(b: np.ndarray, q: np.ndarray, bits: int) -> bool:
    """Rotates each pair of rows of b (and of columns of q) whose product matters; whether there was one."""
    rotated, least = False, 1 << (bits // 4)
    for i in range(len(b)):
        for j in range(i + 1, len(b)):
            off = int(b[i, j])
            # Small beside both its diagonal entries, or beside rounding: nothing to gain.
            if abs(off) <= least or (off * off) << (bits // 2) <= abs(int(b[i, i]) * int(b[j, j])):
                continue
            gap, twice = int(b[j, j] - b[i, i]), 2 * off
            root = isqrt(gap * gap + twice * twice)
            t = (twice << bits) // (gap + root if gap >= 0 else gap - root)
            c = isqrt((1 << 4 * bits) // ((1 << 2 * bits) + t * t))
            s = t * c >> bits
            for m in (b, b.T, q.T):
                x, y = m[i].copy(), m[j].copy()
                m[i], m[j] = (c * x - s * y) >> bits, (s * x + c * y) >> bits
            b[i, j] = b[j, i] = 0
            rotated = True
    return rotated


@dataclass
class Components:
    """Of vectors of one length: n and S of the fit list, unit vectors (columns), roots of the eigenvalues, shares of the trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    roots: np.ndarray
    explained: np.ndarray
    error: float | None = None

    @classmethod
    def of(cls, n: int, sums: np.ndarray, g: np.ndarray, s: Settings) -> Components:
        k, trace = min(s.components, len(sums)), int(sum(g.diagonal()))
        values, vectors = eigen(g, s.bits)
        values = [v if v > 1 << (s.bits // 4) else 0 for v in values[:k]]
        roots = [(v * trace / ((1 << s.bits) * n**3)) ** 0.5 for v in values]
        return cls(n, sums, np.ascontiguousarray(vectors[:, :k]), np.array(roots), np.array([v / (1 << s.bits) if trace else np.nan for v in values]))

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """A column a component; not a number where it has no variance."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.roots > 0, (y.astype(np.float64) / self.n) @ self.vectors / self.roots, np.nan)


def fitted(vectors: DataFrame, s: Settings = Settings()) -> dict[int, Components]:
    """The components of each length of vectors; passes over the distinct vectors, which are stored, for sums, products and the check."""
    spark = vectors.sparkSession
    fit = stored(integers(vectors, s).select("dim", "x").where("dim > 0").distinct())
    sums = sums_of(fit)
    grams = gram(fit, spark.sparkContext.broadcast(sums))  # d numbers a length of vectors
    out = {dim: Components.of(*sums[dim], grams[dim], s) for dim in sums}
    shared = spark.sparkContext.broadcast(out)

    def run(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in matrices(batch):
                c = shared.value[dim]
                w = np.column_stack((np.ones(len(x)), c.whitened(centred(x, c.n, c.sums))))
                total[dim] = total.get(dim, 0) + w.T @ w
        for dim, m in total.items():
            i, j = np.indices(m.shape).reshape(2, -1)
            yield pa.record_batch([pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m.ravel())], names=["dim", "i", "j", "value"])

    moments = fit.mapInArrow(run, "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("value"))
    for r in moments.collect():  # (components + 1)^2 rows a length of vectors
        if r.i == r.j == 0:
            continue
        c = out[r.dim]
        if r.i > 0 and r.j > 0 and c.roots[r.i - 1] > 0 and c.roots[r.j - 1] > 0:
            c.error = max(c.error or 0.0, abs(r.value / c.n - (r.i == r.j)))
    return out


def whiten(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """row (all columns of vectors), component (from 1), n, deviation (decimal), whitened, explained, identity_error."""
    shared = vectors.sparkSession.sparkContext.broadcast(fitted(vectors, s))
    kind = pa.decimal128(38, 0)

    def deviations(y: np.ndarray) -> pa.Array:
        if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 63:
            return pa.array((y * y).sum(axis=1)).cast(kind)
        own = (y.astype(object) ** 2).sum(axis=1).tolist()
        return pa.array([decimal.Decimal(v) if v < 10**38 else None for v in own], kind)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for dim, at, x in matrices(batch):
                c = shared.value[dim]
                for begin in range(0, len(x), ROWS):
                    own, y = at[begin : begin + ROWS], centred(x[begin : begin + ROWS], c.n, c.sums)
                    k, rows = len(c.roots), len(own)
                    each = pa.array(np.repeat(np.arange(rows), k))
                    w = c.whitened(y).ravel()
                    share = np.tile(c.explained, rows)
                    yield pa.record_batch([
                        batch.column("row").take(pa.array(own)).take(each), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, c.n)), deviations(y).take(each),
                        pa.array(w, mask=np.isnan(w)), pa.array(share, mask=np.isnan(share)), pa.array([c.error] * (rows * k), pa.float64()),
                    ], names=["row", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    source = integers(vectors, s).where("dim > 0")
    return source.mapInArrow(run, with_row(vectors, "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings, four components: vec_id, component, n, deviation, whitened, explained, identity_error.

    Shuffled: the integer vectors once, to find the distinct ones; d rows of integers a task.  Broadcast: n, S and four components.  Rows with an unusable
    vector are left out; a null vec_id and repeated rows stay; a deviation beyond a long is null; an empty table gives no rows.
    """
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return out.select("row.vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", "explained", "identity_error")
