"""Top-k search: the queries against all rows.

Queries of up to `ASKED_BYTES` bytes are broadcast, and the rows stay where they are: a task scores its batches against all queries
and keeps each query's k best rows, which is all that leaves it.  More queries than that are gathered into blocks, as are the rows;
each pair of a row block and a query block is a tile, joined by equality on both numbers.  In either case a batch or a tile is one
matrix product, and the global k best are found by a window, whose group limit prunes before the shuffle.  Order: larger scores
first, then smaller ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions import codes
from vecspark.functions.spec import ProductSpec, QuantizerSpec, packed_size

from . import encode

ROWS, QUERIES = 8192, 1024
#: Bytes of query vectors that are broadcast.
ASKED_BYTES = 16 << 20
#: Scores that a task holds at once.
SCORES = 1 << 21
DECIMALS = 6


def _blocks(df: DataFrame, number: str, rows: int, columns: list[str]) -> tuple[DataFrame, int]:
    """df gathered into lists of about `rows` rows, by a hash of the row: number, and a list for each column."""
    count = max(1, -(-df.count() // rows))
    dealt = df.withColumn(number, F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.lit(count)).cast("int"))
    return dealt.groupBy(number).agg(F.collect_list(F.struct(*columns)).alias("rows")), count


def _column(cell: pa.StructArray, name: str) -> pa.Array:
    return cell.field(name)


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each query, in order."""
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], ids[keep], score[keep]


def _found(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query; s: queries x rows. Of equal scores at the k-th place all are looked at."""
    if s.shape[1] > k:
        i, j = np.nonzero(s >= np.partition(s, -k, axis=1)[:, -k][:, None])
    else:
        i, j = (x.ravel() for x in np.indices(s.shape))
    return _best(i, ids[j], s[i, j], k)


def topk(rows: DataFrame, queries: DataFrame, k: int, dim: int, score: Callable[[pa.StructArray, np.ndarray], np.ndarray], decimals: int | None = DECIMALS) -> DataFrame:
    """query_id, rank, id, score. rows: id and what score() reads; queries: query_id, q (a vector).

    score(rows, queries) gives rows x queries. Scores are rounded to `decimals` before they are ranked, unless None.
    """
    names = ["query_id", "id", "score"]

    def scored(own: pa.StructArray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = score(own, q).T
        s = np.round(s, decimals) + 0.0 if decimals is not None else s
        return _found(s, _column(own, "id").to_numpy(zero_copy_only=False), k)

    asked = queries.select("query_id", "q")
    if asked.count() * dim * 8 <= ASKED_BYTES:
        table = asked.toArrow().combine_chunks()
        shared = rows.sparkSession.sparkContext.broadcast((table.column("query_id").to_numpy(), codes.matrix_of(table.column("q"), dim)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked_ids, q = shared.value
            at, ids, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            step = max(1, min(ROWS // 4, SCORES // max(len(q), 1)))
            for batch in batches:
                for begin in range(0, batch.num_rows if len(q) else 0, step):
                    new = scored(batch.slice(begin, step).to_struct_array(), q)
                    at, ids, s = (np.concatenate(x) for x in zip((at, ids, s), new))
                    if len(at) > 8 * k * len(q):
                        at, ids, s = _best(at, ids, s, k)
            at, ids, s = _best(at, ids, s, k)
            yield pa.record_batch([pa.array(asked_ids[at], pa.int64()), pa.array(ids, pa.int64()), pa.array(s)], names=names)

        found = rows.mapInArrow(run, "query_id long, id long, score double")
    else:
        left, n_queries = _blocks(asked, "qb", QUERIES, ["query_id", "q"])
        right, n_rows = _blocks(rows, "rb", ROWS, rows.columns)
        left = left.withColumnRenamed("rows", "queries").withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
        right = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    own, block = batch.column("rows").slice(i, 1).flatten(), batch.column("queries").slice(i, 1).flatten()
                    at, ids, s = scored(own, codes.matrix_of(_column(block, "q"), dim))
                    yield pa.record_batch([pa.array(_column(block, "query_id").to_numpy(zero_copy_only=False)[at]), pa.array(ids), pa.array(s)], names=names)

        found = left.join(right, ["qb", "rb"]).select("queries", "rows").mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """vectors: id, v."""
    return topk(vectors.select("id", "v"), queries, k, dim, lambda rows, q: codes.matrix_of(_column(rows, "v"), dim) @ q.T)


def code_topk(coded: DataFrame, queries: DataFrame, k: int, spec: QuantizerSpec) -> DataFrame:
    """coded: id, packed, norm of quantize()."""
    spec = spec.solved()

    def score(rows, q):
        return codes.packed_scores(codes.rows_of(_column(rows, "packed"), spec.code_bytes), _column(rows, "norm").to_numpy(zero_copy_only=False).astype(float), q, spec)

    return topk(coded.select("id", "packed", "norm"), queries, k, spec.dim, score)


def product_topk(coded: DataFrame, queries: DataFrame, k: int, spec: ProductSpec) -> DataFrame:
    """coded: id, mse, signs, res_norm of quantize_product(). Scores estimate products with the unit vector."""
    spec = spec.solved()

    def score(rows, q):
        mse, signs = codes.rows_of(_column(rows, "mse"), spec.base.code_bytes), codes.rows_of(_column(rows, "signs"), packed_size(spec.dim, 1))
        return codes.packed_product_scores(mse, signs, _column(rows, "res_norm").to_numpy(zero_copy_only=False).astype(float), q, spec)

    return topk(coded.select("id", "mse", "signs", "res_norm"), queries, k, spec.dim, score)


class QuantizedIndex:
    """A table of codes: fit() once (written where `path` says, or lazily), search() many times, append() more rows."""

    def __init__(self, spec: QuantizerSpec | ProductSpec, codes_: DataFrame, path: str | None = None):
        self.spec, self.codes, self.path = spec, codes_, path

    @classmethod
    def fit(cls, vectors: DataFrame, spec: QuantizerSpec | ProductSpec, path: str | None = None) -> QuantizedIndex:
        made = cls._coded(vectors, spec)
        if path:
            made.write.mode("errorifexists").parquet(path)
            made = vectors.sparkSession.read.parquet(path)
        return cls(spec, made, path)

    @staticmethod
    def _coded(vectors: DataFrame, spec) -> DataFrame:
        make = encode.quantize_product if isinstance(spec, ProductSpec) else encode.quantize
        return make(vectors.select("id", "v"), spec, keep=["id"])

    def append(self, vectors: DataFrame) -> QuantizedIndex:
        more = self._coded(vectors, self.spec)
        if self.path:
            more.write.mode("append").parquet(self.path)
            return QuantizedIndex(self.spec, vectors.sparkSession.read.parquet(self.path), self.path)
        return QuantizedIndex(self.spec, self.codes.unionByName(more))

    def search(self, queries: DataFrame, k: int, strict: bool = False) -> DataFrame:
        """strict: an error if k is more than there are rows; else k is cut to their number."""
        if strict and self.codes.limit(k).count() < k:
            raise ValueError(f"k is {k}, but there are fewer rows")
        find = product_topk if isinstance(self.spec, ProductSpec) else code_topk
        return find(self.codes, queries, k, self.spec)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of exact neighbours among those found."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
