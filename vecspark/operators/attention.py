"""Attention over tables of keys and values.

A table of entries has the columns page (any number of columns that name it), slot, and key and value vectors or codes.  Queries and
entries of a page meet in tiles, a block of each, where scores are one matrix product: no row is a pair.  The weights are a softmax over a
query's entries: over the k best, of which a tile sends k, or over all, by partial sums.  An entry set is never gathered in one row or
task.  Appending assigns the slots after the page's last one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecspark.functions import codes
from vecspark.functions import columns as c
from vecspark.functions.spec import ProductSpec, QuantizerSpec, packed_size

from . import encode
from .search import _found

#: Queries and entries of a tile.
QUERIES, ENTRIES = 1024, 4096


def weights(scored: DataFrame, by: list[str], k: int | None = None) -> DataFrame:
    """scored: by, slot, score. Adds weight; only the k best entries stay (larger scores, then lower slots), all if None."""
    if k is not None:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "slot")
        scored = scored.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")
    return scored.withColumn("weight", c.softmax("score", Window.partitionBy(*by)))


def weighted_sum(weighted: DataFrame, by: list[str], value: str = "value", scale: Column | None = None) -> DataFrame:
    """by, coordinate (from 0), output: the sum of weight times value, and times scale if given."""
    w = F.col("weight") if scale is None else F.col("weight") * scale
    each = weighted.select(*by, w.alias("_w"), F.posexplode(value).alias("coordinate", "_x"))
    return each.groupBy(*by, "coordinate").agg(F.sum(F.col("_w") * F.col("_x").cast("double")).alias("output"))


def gathered(outputs: DataFrame, by: list[str]) -> DataFrame:
    """by, output: the coordinates as one vector."""
    rows = F.sort_array(F.collect_list(F.struct("coordinate", "output")))
    return outputs.groupBy(*by).agg(F.transform(rows, lambda x: x["output"]).alias("output"))


def tiles(queries: DataFrame, entries: DataFrame, on: list[str], by: list[str], columns: list[str]) -> DataFrame:
    """on, _asked (by and q of up to about QUERIES queries of a page), _held (slot and columns of up to ENTRIES entries of it): a row a tile.

    Each block of queries meets each block of entries of its page once.  A page of any size is cut by its slots, the queries of a page by a
    hash: no row is a pair, and none grows with a page.
    """
    counts = queries.groupBy(*on).agg(F.ceil(F.count("*") / F.lit(QUERIES)).alias("_blocks"))
    dealt = queries.join(counts, on).withColumn("_qb", F.pmod(F.xxhash64(*by), F.col("_blocks")))
    asked = dealt.groupBy(*on, "_qb").agg(F.collect_list(F.struct(*by, "q")).alias("_asked"))
    held = entries.withColumn("_eb", F.floor(F.col("slot") / F.lit(ENTRIES))).groupBy(*on, "_eb").agg(F.collect_list(F.struct("slot", *columns)).alias("_held"))
    return asked.join(held, on).select(*on, "_asked", "_held")


#: score(entries of a tile, its queries as a matrix, its page): entries x queries.
Score = Callable[[pa.StructArray, np.ndarray, dict], np.ndarray]


def _each(batches: Iterator[pa.RecordBatch], on: list[str]) -> Iterator[tuple[dict, pa.StructArray, np.ndarray, pa.StructArray]]:
    """(page, queries, their vectors, entries) of each tile."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            asked, held = (row.column(c).flatten() for c in ("_asked", "_held"))
            q = asked.field("q")
            yield {c: row.column(c) for c in on}, asked, codes.matrix_of(q, len(q[0])), held


def _named(on: list[str], by: list[str], page: dict, asked: pa.StructArray, at: np.ndarray) -> list[pa.Array]:
    """The columns on and by of queries at these places of a tile."""
    own = [page[c].take(pa.array(np.zeros(len(at), int))) for c in on]
    return own + [asked.field(c).take(pa.array(at)) for c in by if c not in on]


def best_entries(queries: DataFrame, entries: DataFrame, on: list[str], by: list[str], columns: list[str], score: Score, k: int) -> DataFrame:
    """on, by, slot, score, weight: each query's k best entries (larger scores, then lower slots); only k a query leave a tile."""
    kinds = [queries.schema[c] for c in [*on, *(c for c in by if c not in on)]]
    schema = StructType([*kinds, *StructType.fromDDL("slot int, score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page, asked, q, held in _each(batches, on):
            at, slot, s = _found(score(held, q, page).T, held.field("slot").to_numpy(zero_copy_only=False), k)
            yield pa.record_batch([*_named(on, by, page, asked, at), pa.array(slot, pa.int32()), pa.array(s)], names=schema.names)

    return weights(tiles(queries, entries, on, by, columns).mapInArrow(run, schema), by, k)


def attend(queries: DataFrame, entries: DataFrame, on: list[str], by: list[str], scale: float = 1.0, k: int | None = None) -> DataFrame:
    """by, coordinate, output. queries: by (which names a query), on, q; entries: on, slot, key, value. An empty page gives no rows."""

    def score(held: pa.StructArray, q: np.ndarray, page: dict) -> np.ndarray:
        return codes.matrix_of(held.field("key"), q.shape[1]) @ q.T * scale

    if k is None:
        value = lambda held, page: codes.matrix_of(held.field("value"), len(held.field("value")[0]))
        return _over_all(tiles(queries, entries, on, by, ["key", "value"]), queries, on, by, score, value)
    picked = best_entries(queries, entries, on, by, ["key"], score, k)
    return weighted_sum(picked.join(entries.select(*on, "slot", "value"), [*on, "slot"]), by)


def _over_all(tiled: DataFrame, queries: DataFrame, on: list[str], by: list[str], score: Score, value: Callable[[pa.StructArray, dict], np.ndarray]) -> DataFrame:
    """A softmax over all entries without gathering them: a tile sends, of each query, the largest score, the sum of weights and the
    weighted sum of values, relative to that largest score; such parts are merged the same way."""
    keys = [queries.schema[n] for n in by]
    part = StructType([*keys, *StructType.fromDDL("most double, total double, parts array<double>").fields])
    out = StructType([*keys, *StructType.fromDDL("coordinate int, output double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page, asked, q, held in _each(batches, on):
            s = score(held, q, page)
            most = s.max(axis=0)
            share = np.exp(s - most)
            yield pa.record_batch([*(asked.field(c) for c in by), pa.array(most), pa.array(share.sum(axis=0)), codes.lists_of(share.T @ value(held, page), pa.float64())], names=part.names)

    def merge(table: pa.Table) -> pa.Table:
        parts, most = table.column("parts").combine_chunks(), table.column("most").to_numpy()
        dim, share = len(parts[0]), np.exp(most - most.max())
        total, sums = share @ table.column("total").to_numpy(), share @ codes.matrix_of(parts, dim)
        head = table.slice(0, 1).take(pa.array(np.zeros(dim, int)))
        return pa.table([*(head.column(n) for n in by), pa.array(np.arange(dim), pa.int32()), pa.array(sums / total)], names=out.names)

    return tiled.mapInArrow(run, part).groupBy(*by).applyInArrow(merge, out)


def attend_codes(queries: DataFrame, coded: DataFrame, on: list[str], by: list[str], keys: ProductSpec, values: QuantizerSpec, scale: float = 1.0, k: int | None = None, specs: Callable[[dict], tuple[ProductSpec, QuantizerSpec]] | None = None) -> DataFrame:
    """attend() on codes: keys by inner-product codes (mse, signs, res_norm), values by plain ones (packed, norm).

    Scores are taken on the packed codes, and only values that are selected are decoded.  specs(page): the specs of a page's own codes, where they
    differ from page to page (in seeds, say); keys and values give their sizes.
    """
    keys, values = keys.solved(), values.solved()
    of = specs or (lambda page: (keys, values))

    def score(held: pa.StructArray, q: np.ndarray, page: dict) -> np.ndarray:
        mse, signs = codes.rows_of(held.field("mse"), keys.base.code_bytes), codes.rows_of(held.field("signs"), packed_size(keys.dim, 1))
        return codes.packed_product_scores(mse, signs, held.field("res_norm").to_numpy(zero_copy_only=False).astype(float), q, of(page)[0]) * scale

    def decoded(packed: pa.Array, norm: pa.Array, page: dict) -> np.ndarray:
        cells = codes.unpack(codes.rows_of(packed, values.code_bytes), values.dim, values.bits)
        return codes.reconstruct(cells, of(page)[1]) * norm.to_numpy(zero_copy_only=False).astype(float)[:, None]

    columns = ["mse", "signs", "res_norm"]
    if k is None:
        return _over_all(tiles(queries, coded, on, by, [*columns, "packed", "norm"]), queries, on, by, score, lambda held, page: decoded(held.field("packed"), held.field("norm"), page))
    picked = best_entries(queries, coded, on, by, columns, score, k).join(coded.select(*on, "slot", "packed", "norm"), [*on, "slot"])
    if specs is None:
        return weighted_sum(encode.dequantize(picked, values), by, "recon", F.col("norm").cast("double"))
    kinds = StructType([*(queries.schema[c] for c in by), *StructType.fromDDL("weight double, value array<double>").fields])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.select(on).to_pandas().groupby(on, sort=False, dropna=False).indices if batch.num_rows else {}
            for at in pages.values():
                own = batch.take(pa.array(at))
                value = decoded(own.column("packed"), own.column("norm"), {c: own.column(c).slice(0, 1) for c in on})
                yield pa.record_batch([*(own.column(c) for c in by), own.column("weight"), codes.lists_of(value, pa.float64())], names=kinds.names)

    return weighted_sum(picked.mapInArrow(decode, kinds), by)


def grouped_heads(queries: DataFrame, heads: int, kv_heads: int) -> DataFrame:
    """queries (head) with kv_head: heads / kv_heads query heads read one key/value head."""
    if heads % kv_heads:
        raise ValueError(f"{heads} heads can't share {kv_heads} key/value heads")
    return queries.withColumn("kv_head", c.kv_head("head", F.lit(heads), F.lit(kv_heads)))


def append(entries: DataFrame, more: DataFrame, page: list[str], order: list[str]) -> DataFrame:
    """entries and more, whose slots go on from each page's last one in the given order."""
    last = entries.groupBy(*page).agg(F.max("slot").alias("_last"))
    at = F.row_number().over(Window.partitionBy(*page).orderBy(*order))
    placed = more.join(last, page, "left").withColumn("slot", (F.coalesce("_last", F.lit(-1)) + at).cast("int")).drop("_last")
    return entries.unionByName(placed.select(entries.columns))


def capacity(length: Column) -> Column:
    """Entries that a page which grew by doubling from 4 has room for."""
    doubled = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double")))).cast("long")
    return F.when(length == 0, F.lit(0)).otherwise(F.greatest(doubled, F.lit(4)))


def entry_bytes(dim: int, key_bits: int, value_bits: int) -> int:
    """Key cells at one bit less, key signs, value cells, and two norms."""
    size = lambda bits: (dim * bits + 7) // 8
    return size(key_bits - 1) + size(1) + size(value_bits) + 8


def uniform_bytes(dim: int, key_bits: int, value_bits: int) -> int:
    size = lambda bits: (dim * bits + 7) // 8
    return size(key_bits) + 4 + size(value_bits) + 4


def byte_rollup(entries: DataFrame, by: list[str], dim: int, key_bits: int, value_bits: int) -> DataFrame:
    """Live and storage bytes of each page, of each level above, and of all: by (null where summed), entries, live_bytes, storage_bytes."""
    one = entry_bytes(dim, key_bits, value_bits)
    pages = entries.groupBy(*by).agg(F.count("*").alias("n")).withColumn("room", capacity(F.col("n")))
    return pages.rollup(*by).agg(F.sum("n").alias("entries"), (F.sum("n") * one).alias("live_bytes"), (F.sum("room") * one).alias("storage_bytes"))
