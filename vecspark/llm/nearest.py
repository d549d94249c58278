"""Nearest neighbours by a block matrix join with int8 tiles and error bounds.

Vectors are quantised once and packed into blocks (a row a block), which are stored: int8 codes, and for each vector its step, its norm and
the norms of what its codes hold and miss.  Every query block meets every candidate block once.  Candidate blocks stay where they are:
query blocks go to them in rounds, as many at a time as have `asked_bytes` bytes, which is checked before they are broadcast.  A round is
one pass over the stored candidate blocks; a task streams its own, and keeps of each query the k largest lower bounds that it has seen so far.

1. In a tile all products are taken between int8 codes (x ~ s * code, one step s a vector).  Within the tile codes become float32: products
   of up to 1,040 components are then exact integers, and the product is one matrix multiplication;
2. |<x, y> - s t <code x, code y>| <= |x - s code x| |y| + |s code x| |y - t code y|, so each product has a lower and an upper
   bound; a candidate whose upper bound is below the k-th of the task's lower bounds for the query can't be among its k nearest;
3. what is left of all tasks is cut once more by the k-th largest lower bound of them all;
4. what is left then, some k + 5 a query, is joined with the original vectors and recomputed in double precision; sorted by query,
   it streams through a heap that keeps the k nearest.

The result is exact: bounds only leave out what can't be in it.  A task holds the query blocks of a round, a candidate block, and k bounds a query.

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do rows
without a vec_id; vectors of different lengths are no candidates of each other.  A candidate with the query's own
vec_id is the query's own row.  Of rows that repeat a query's vec_id each is a query of its own: its entries have
the same query_id, and `query_row` (a hash of the vector) tells them apart.  Repeated rows are distinct candidates.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Batches, shared_folder, stored

_BLOCK = "dim int, block int, uids binary, ids binary, codes binary, numbers binary"
_BOUNDS = "query long, candidate long, low double, high double"
_RANKED = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()
_SCORES = "query long, query_id long, query_row long, vec_id long, score double"
#: Products of codes up to 127 of this many components stay below 2**24, where float32 holds integers exactly.
EXACT = 1040


@dataclass(frozen=True)
class Settings:
    k: int = 20
    query_block: int = 2048
    candidate_block: int = 8192
    tile_rows: int = 256
    asked_bytes: int = 16 << 20


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles), dim, mark of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & ok)
    return rows.withColumns({"dim": F.size("vector"), "mark": F.xxhash64("vec_id", "vector")})


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(int8 codes; step, norm, norm of what the codes hold, norm of what they miss) of each row."""
    step = np.abs(x).max(axis=1) / 127
    step[step == 0] = 1.0
    code = np.rint(x / step[:, None])
    held = code * step[:, None]
    norm = lambda y: np.linalg.norm(y, axis=1)
    return code.astype(np.int8), np.column_stack((step, norm(x), norm(held), norm(x - held)))


def _code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for begin in range(0, a.shape[1], EXACT):
        out += a[:, begin : begin + EXACT] @ b[:, begin : begin + EXACT].T
    return out


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


@dataclass
class Block:
    uids: np.ndarray
    ids: np.ndarray
    codes: np.ndarray
    numbers: np.ndarray


def tile(q: Block, c: Block, best: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate's place, lower and upper bound): of each query in this tile what can be among its k nearest.

    best: of each query the k largest lower bounds that were seen before; those of this tile are put into it.
    """
    k = best.shape[1]
    codes, (step_c, norm_c, _, miss_c) = c.codes.astype(np.float32), c.numbers.T
    found: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, len(q.ids), rows):
        own = slice(begin, begin + rows)
        step_q, _, held_q, miss_q = q.numbers[own].T
        about = _code_products(q.codes[own].astype(np.float32), codes) * step_q[:, None] * step_c
        error = (miss_q[:, None] * norm_c + held_q[:, None] * miss_c) * (1 + 1e-9) + 1e-12 * np.abs(about)
        itself = q.ids[own, None] == c.ids
        low = np.where(itself, -np.inf, about - error)
        top = np.partition(low, -k, axis=1)[:, -k:] if low.shape[1] > k else low
        best[own] = np.partition(np.concatenate((best[own], top), axis=1), -k, axis=1)[:, -k:]
        i, j = np.nonzero((about + error >= best[own].min(axis=1)[:, None]) & ~itself)
        found.append((i + begin, j, low[i, j], (about + error)[i, j]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 4


def blocks(rows: DataFrame, most: int, counts: dict[int, int]) -> DataFrame:
    """Rows (uid, vec_id, dim, vector) dealt at random into counts[dim] blocks of about `most` rows, each quantised and packed into a row."""
    of_dim = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        codes, numbers = quantised(pc_flat(table.column("vector")).reshape(-1, dim))
        packed = [table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("uid", "vec_id")] + [codes.tobytes(), numbers.tobytes()]
        return pa.table([pa.array([dim], pa.int32()), table.column("block").slice(0, 1), *(pa.array([x], pa.binary()) for x in packed)], names=["dim", "block", "uids", "ids", "codes", "numbers"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("uid"), of_dim[F.col("dim")]).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(run, _BLOCK)


def pc_flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0)]).astype(np.float64)


def _block(r: dict) -> Block:
    uids, ids = (np.frombuffer(r[x], np.int64) for x in ("uids", "ids"))
    return Block(uids, ids, np.frombuffer(r["codes"], np.int8).reshape(-1, r["dim"]), np.frombuffer(r["numbers"], np.float64).reshape(-1, 4))


def _rounds(asked: DataFrame, most: int) -> list[list[tuple[int, int]]]:
    """(dim, block) of the query blocks of each round: at least one, and about `most` bytes."""
    size = sum((F.octet_length(x) for x in ("uids", "ids", "codes", "numbers")), F.lit(0))
    out, room = [], 0
    for r in asked.select("dim", "block", size.alias("size")).orderBy("dim", "block").collect():  # a row for each query_block queries
        if not out or r.size > room:
            out.append([])
            room = most
        out[-1].append((r.dim, r.block))
        room -= r.size
    return out


def bounds(candidates: DataFrame, asked: list[Block], settings: Settings) -> DataFrame:
    """query, candidate, low, high: what each task of candidate blocks leaves of each query. asked: the blocks of a round, of a checked size."""
    shared = candidates.sparkSession.sparkContext.broadcast(asked)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def run(batches: Batches) -> Batches:
        asked = shared.value
        best = [np.full((len(q.ids), settings.k), -np.inf) for q in asked]
        kept = [none for _ in asked]

        def cut(b: int) -> tuple[np.ndarray, ...]:
            fits = kept[b][3] >= best[b].min(axis=1)[kept[b][0]]
            return tuple(x[fits] for x in kept[b])

        for batch in batches:
            for i in range(batch.num_rows):
                c = _block(batch.slice(i, 1).to_pylist()[0])
                for b, q in enumerate(asked):
                    if q.codes.shape[1] != c.codes.shape[1]:
                        continue
                    at, j, low, high = tile(q, c, best[b], settings.tile_rows)
                    kept[b] = tuple(np.concatenate(x) for x in zip(kept[b], (at, c.uids[j], low, high)))
                    if len(kept[b][0]) > 4 * settings.k * len(q.ids):
                        kept[b] = cut(b)
        for b, q in enumerate(asked):
            at, candidate, low, high = cut(b)
            yield pa.record_batch([pa.array(q.uids[at]), pa.array(candidate), pa.array(low), pa.array(high)], names=["query", "candidate", "low", "high"])

    return candidates.mapInArrow(run, _BOUNDS)


def nearest(vectors: DataFrame, is_query: Column, settings: Settings = Settings()) -> DataFrame:
    """query_id, query_row, rank, vec_id, score: the k rows with the largest inner product with each query."""
    spark, k = vectors.sparkSession, settings.k
    # Stored with a number for each row, by which what survives finds its vector again.
    rows = stored(usable(vectors).withColumns({"uid": F.monotonically_increasing_id(), "asks": is_query}))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).collect()  # a row a length of vectors
    if not sizes:
        sizes = [(1, 0, 0)]
    left = stored(blocks(rows.where("asks"), settings.query_block, {d: max(1, -(-q // settings.query_block)) for d, _, q in sizes}))
    right = stored(blocks(rows, settings.candidate_block, {d: max(1, -(-n // settings.candidate_block)) for d, n, _ in sizes}))
    folder, found, rounds = shared_folder(spark), spark.createDataFrame([], _BOUNDS), _rounds(left, settings.asked_bytes)
    for n, own in enumerate(rounds):
        named = F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(b).alias("block")) for d, b in own])
        asked = [_block(r.asDict()) for r in left.where(F.array_contains(named, F.struct("dim", "block"))).collect()]  # of asked_bytes bytes
        bounds(right, asked, settings).write.parquet(f"{folder}/round={n}")
    if rounds:
        found = spark.read.schema(_BOUNDS).parquet(*[f"{folder}/round={n}" for n in range(len(rounds))])
    of_query = Window.partitionBy("query")
    ranked = found.withColumn("place", F.row_number().over(of_query.orderBy(F.desc("low"))))
    pairs = stored(ranked.withColumn("least", F.max(F.when(F.col("place") == k, F.col("low"))).over(of_query)).where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("query", "candidate"))
    asked = rows.where("asks").select(F.col("uid").alias("query"), F.col("vec_id").alias("query_id"), F.col("mark").alias("query_row"), F.col("vector").alias("q"))
    both = pairs.join(rows.select(F.col("uid").alias("candidate"), "vec_id", "vector"), "candidate").join(asked, "query").select("query", "query_id", "query_row", "vec_id", "vector", "q")

    def recompute(batches: Batches) -> Batches:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            size = np.diff(batch.column("q").offsets.to_numpy())
            for dim in np.unique(size):  # vectors of one length at a time
                at = np.flatnonzero(size == dim)
                own = batch.take(pa.array(at))
                score[at] = exact_products(*(own.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for c in ("q", "vector")))
            yield pa.record_batch([*(batch.column(c) for c in ("query", "query_id", "query_row", "vec_id")), pa.array(score)], names=["query", "query_id", "query_row", "vec_id", "score"])

    def merge(batches: Batches) -> Batches:
        """Sorted by query: each query's rows go through a heap of k."""
        at, heap = None, []
        names = ["query_id", "query_row", "rank", "vec_id", "score"]

        def ranked_rows() -> list[tuple]:
            return [(at[1], at[2], n + 1, -v, s) for n, (s, v) in enumerate(sorted(heap, reverse=True))]

        for batch in batches:
            out: list[tuple] = []
            for query, query_id, query_row, vec_id, s in zip(*(batch.column(c).to_pylist() for c in ("query", "query_id", "query_row", "vec_id", "score"))):
                if at is None or query != at[0]:
                    out += ranked_rows() if at else []
                    at, heap = (query, query_id, query_row), []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -vec_id))
                else:
                    heapq.heappushpop(heap, (s, -vec_id))
            if out:
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*out), _RANKED)], names=names)
        if at:
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*ranked_rows()), _RANKED)], names=names)

    scored = both.mapInArrow(recompute, _SCORES).repartition("query").sortWithinPartitions("query")
    return scored.mapInArrow(merge, "query_id long, query_row long, rank int, vec_id long, score double")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows with the largest inner product with each row whose vec_id is divisible by 20: query_id, rank, vec_id, score.

    Shuffled: rows once into blocks, bounds of some 25 candidates a query and task, vectors of those that are left.  Broadcast: query blocks
    of 16 MB a round.  Vectors that are null, empty, zero or not finite take no part; a query's own vec_id is no candidate of it;
    repeated rows are candidates and queries of their own; an empty table gives no rows.
    """
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score")


op7_nearest.oracle = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
