"""SQL functions of a session, for spark.sql: column functions, functions on codes, and table functions.

Column functions are SQL bodies, inlined and optimised like any expression.  Functions on codes are Arrow functions, a batch a call; a
row whose input is null gets null, and vectors, bits and seeds may differ from row to row.  Table functions:

* `vq_search(TABLE(codes), queries, k, bits, seed)`: each task's k best rows for each query, by codes (id, packed, norm) or, where the
  table has mse, signs and res_norm, by inner-product codes.  queries is an array of (query_id, q), which travels beside each row, so it
  is for few queries; or the name of a set that query_set() has broadcast, which doesn't.  A window or ORDER BY over what comes back gives the global k best;
* `vq_config_grid(methods, key_bits, value_bits, top_k)`: a row a configuration; a wrong list is an error of analysis, before any job;
* `vq_layers(selector, layers)`: the layers that a selector names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import codes
from .spec import ProductSpec, QuantizerSpec, packed_size

#: name -> (parameters, type, body). Bodies are SQL, so calls are inlined and optimised like any expression.
FUNCTIONS = {
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) = size(b) THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) END"),
    "vec_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x))"),
    "vec_mse": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(a) = size(b) AND size(a) > 0 THEN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x) / size(a) END"),
    "vec_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN vec_norm(a) * vec_norm(b) = 0 THEN 0D ELSE vec_dot(a, b) / (vec_norm(a) * vec_norm(b)) END"),
    "packed_size": ("n INT, bits INT", "INT", "CAST(floor((n * bits + 7) / 8) AS INT)"),
    "kv_head_of": ("head INT, heads INT, kv_heads INT", "INT", "CAST(floor(head / (heads / kv_heads)) AS INT)"),
    "plain_name": ("x STRING", "STRING", "CASE WHEN trim(x) = '' THEN 'run' ELSE trim(BOTH '-' FROM regexp_replace(lower(trim(x)), '[^a-z0-9]', '-')) END"),
    "bench_kind": ("n_prompt INT, n_gen INT", "STRING", "CASE WHEN n_prompt > 0 AND n_gen > 0 THEN 'pg' WHEN n_prompt > 0 THEN 'pp' WHEN n_gen > 0 THEN 'tg' ELSE 'unknown' END"),
    "text_tokens": ("x STRING", "ARRAY<STRING>", r"CASE WHEN size(filter(split(lower(trim(x)), '[^\\p{L}\\p{N}]+'), t -> t <> '')) > 0 THEN filter(split(lower(trim(x)), '[^\\p{L}\\p{N}]+'), t -> t <> '') WHEN trim(x) <> '' THEN array(lower(trim(x))) ELSE CAST(array() AS ARRAY<STRING>) END"),
    "vq_text_vector": ("x STRING, place INT, dim INT", "ARRAY<DOUBLE>", "vq_word_vector(text_tokens(coalesce(x, '')), place, dim)"),
}


@lru_cache(64)
def _plain(dim: int, bits: int, seed: int) -> QuantizerSpec:
    return QuantizerSpec(dim, bits, seed).solved()


@lru_cache(64)
def _product(dim: int, bits: int, seed: int) -> ProductSpec:
    return ProductSpec(dim, bits, seed).solved()


def _by_setting(columns: list[pa.Array], settings: list[np.ndarray], kind: pa.DataType, make: Callable[..., pa.Array]) -> pa.Array:
    """make(columns' rows, *setting) for the rows of each setting; null where a column is null or a list has a null in it."""
    n = len(columns[0])
    ok = np.ones(n, bool)
    for c in columns:
        ok &= c.is_valid().to_numpy(zero_copy_only=False)
        if pa.types.is_list(c.type) and c.values.null_count:
            ok &= np.array([x is not None and None not in x for x in c.to_pylist()], bool)
    out, at = [], []
    rows = np.flatnonzero(ok)
    each = np.column_stack([s[rows] for s in settings]) if len(rows) else np.zeros((0, len(settings)), np.int64)
    for setting in np.unique(each, axis=0):
        own = rows[(each == setting).all(axis=1)]
        out.append(make([c.take(pa.array(own)) for c in columns], *map(int, setting)).cast(kind) if not pa.types.is_struct(kind) else make([c.take(pa.array(own)) for c in columns], *map(int, setting)))
        at.append(own)
    place = np.full(n, -1)
    if at:
        place[np.concatenate(at)] = np.arange(len(rows))
    made = pa.concat_arrays(out) if out else pa.array([], kind)
    return made.take(pa.array(place, mask=place < 0))


def _numbers(x: pa.Array) -> np.ndarray:
    return x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _sizes(x: pa.Array) -> np.ndarray:
    if pa.types.is_null(x.type):
        return np.zeros(len(x), np.int64)
    return _numbers(pc.list_value_length(x))


def _struct(**columns: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


_CODE, _SKETCH = pa.struct([("packed", pa.binary()), ("norm", pa.float32())]), pa.struct([("mse", pa.binary()), ("signs", pa.binary()), ("res_norm", pa.float32())])
_DOUBLES = pa.list_(pa.float64())
_floats = lambda x: x.to_numpy(zero_copy_only=False).astype(float)


def _quantize(v: pa.Array, bits: pa.Array, seed: pa.Array) -> pa.Array:
    def make(own, dim, bits, seed):
        cells, norm = codes.indices(codes.matrix_of(own[0], dim), _plain(dim, bits, seed))
        return _struct(packed=codes.bytes_of(codes.pack(cells, bits)), norm=pa.array(norm.astype(np.float32)))

    return _by_setting([v], [_sizes(v), _numbers(bits), _numbers(seed)], _CODE, make)


def _dequantize(packed: pa.Array, norm: pa.Array, dim: pa.Array, bits: pa.Array, seed: pa.Array) -> pa.Array:
    def make(own, dim, bits, seed):
        spec = _plain(dim, bits, seed)
        cells = codes.unpack(codes.rows_of(own[0], spec.code_bytes), dim, bits)
        return codes.lists_of(codes.reconstruct(cells, spec) * _floats(own[1])[:, None], pa.float64())

    return _by_setting([packed, norm], [_numbers(dim), _numbers(bits), _numbers(seed)], _DOUBLES, make)


def _score(packed: pa.Array, norm: pa.Array, q: pa.Array, bits: pa.Array, seed: pa.Array) -> pa.Array:
    def make(own, dim, bits, seed):
        spec = _plain(dim, bits, seed)
        cells = codes.unpack(codes.rows_of(own[0], spec.code_bytes), dim, bits)
        return pa.array(_floats(own[1]) * (spec.centroids[cells] * spec.rotate(codes.matrix_of(own[2], dim))).sum(axis=1))

    return _by_setting([packed, norm, q], [_sizes(q), _numbers(bits), _numbers(seed)], pa.float64(), make)


def _quantize_product(v: pa.Array, bits: pa.Array, seed: pa.Array) -> pa.Array:
    def make(own, dim, bits, seed):
        cells, signs, left = codes.encode_product(codes.matrix_of(own[0], dim), _product(dim, bits, seed))
        return _struct(mse=codes.bytes_of(codes.pack(cells, bits - 1)), signs=codes.bytes_of(codes.pack(signs, 1)), res_norm=pa.array(left.astype(np.float32)))

    return _by_setting([v], [_sizes(v), _numbers(bits), _numbers(seed)], _SKETCH, make)


def _score_product(mse: pa.Array, signs: pa.Array, res_norm: pa.Array, q: pa.Array, bits: pa.Array, seed: pa.Array) -> pa.Array:
    from vecspark.operators.encode import own_scores

    def make(own, dim, bits, seed):
        spec = _product(dim, bits, seed)
        cells = codes.unpack(codes.rows_of(own[0], spec.base.code_bytes), dim, bits - 1)
        return pa.array(own_scores(cells, codes.unpack(codes.rows_of(own[1], packed_size(dim, 1)), dim, 1), _floats(own[2]), codes.matrix_of(own[3], dim), spec))

    return _by_setting([mse, signs, res_norm, q], [_sizes(q), _numbers(bits), _numbers(seed)], pa.float64(), make)


def _pack(cells: pa.Array, bits: pa.Array) -> pa.Array:
    def make(own, count, bits):
        x = codes.matrix_of(own[0], count)
        if x.size and (x.min() < 0 or x.max() >= 1 << bits):
            raise ValueError(f"a cell is not from 0 to {(1 << bits) - 1}")
        return codes.bytes_of(codes.pack(x, bits))

    return _by_setting([cells], [_sizes(cells), _numbers(bits)], pa.binary(), make)


def _unpack(packed: pa.Array, count: pa.Array, bits: pa.Array) -> pa.Array:
    return _by_setting([packed], [_numbers(count), _numbers(bits)], pa.list_(pa.int32()), lambda own, count, bits: codes.lists_of(codes.unpack(codes.rows_of(own[0], packed_size(count, bits)), count, bits), pa.int32()))


def _wire(packed: pa.Array, norm: pa.Array, dim: pa.Array, bits: pa.Array) -> pa.Array:
    from vecspark.sources.blobs import wire

    return _by_setting([packed, norm], [_numbers(dim), _numbers(bits)], pa.binary(), lambda own, dim, bits: pa.array([wire(x, n, dim, bits) for x, n in zip(*(c.to_pylist() for c in own))], pa.binary()))


def _from_wire(data: pa.Array) -> pa.Array:
    from vecspark.sources.blobs import from_wire

    kinds = {"dim": pa.int32(), "bits": pa.int32(), "norm": pa.float32(), "packed": pa.binary(), "signs": pa.binary()}
    rows = [from_wire(x) if x is not None else None for x in data.to_pylist()]
    return pa.array([{k: r[k] for k in kinds} if r else None for r in rows], pa.struct(list(kinds.items())))


def _word_vector(words: pa.Array, place: pa.Array, dim: pa.Array) -> pa.Array:
    from vecspark.operators.turns import hashed_vectors

    return _by_setting([words, place], [_numbers(dim)], _DOUBLES, lambda own, dim: codes.lists_of(hashed_vectors(own[0].to_pylist(), own[1].to_pylist(), dim), pa.float64()))


#: name -> (function of Arrow arrays, type).
ARROW = {
    "vq_quantize": (_quantize, "packed binary, norm float"),
    "vq_dequantize": (_dequantize, "array<double>"),
    "vq_score": (_score, "double"),
    "vq_quantize_product": (_quantize_product, "mse binary, signs binary, res_norm float"),
    "vq_score_product": (_score_product, "double"),
    "vq_pack": (_pack, "binary"),
    "vq_unpack": (_unpack, "array<int>"),
    "vq_wire": (_wire, "binary"),
    "vq_from_wire": (_from_wire, "dim int, bits int, norm float, packed binary, signs binary"),
    "vq_word_vector": (_word_vector, "array<double>"),
}


def _arrow(make: Callable, kind: str):
    """An Arrow function of the parameters of make: the decorator reads them from the signature."""
    return F.arrow_udf(make, returnType=kind)


#: Query sets of this driver: name -> broadcast (query_ids, matrix).
_SETS: dict = {}


def _search_class(sets: dict):
    from vecspark.operators.search import _best, _found

    class Search:
        def __init__(self):
            self.asked, self.spec, self.k = None, None, 0
            self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

        def _begin(self, batch: pa.RecordBatch, queries: pa.Array, k: pa.Array, bits: pa.Array, seed: pa.Array) -> None:
            if pa.types.is_string(queries.type):
                name = queries[0].as_py()
                if name not in sets:
                    raise ValueError(f"there is no query set {name!r}")
                ids, q = sets[name].value
            else:
                own = queries.slice(0, 1).flatten()
                ids, vectors = own.field(0).to_numpy(zero_copy_only=False).astype(np.int64), own.field(1)
                q = codes.matrix_of(vectors, len(vectors[0])) if len(vectors) else np.zeros((0, 0))
            self.sketch = "mse" in batch.schema.names
            self.asked, self.k = (ids, q), k[0].as_py()
            if len(ids):
                self.spec = (_product if self.sketch else _plain)(q.shape[1], bits[0].as_py(), seed[0].as_py())

        def eval(self, batch, queries, k, bits, seed) -> Iterator[pa.Table]:
            if batch.num_rows:
                if self.asked is None:
                    self._begin(batch, queries, k, bits, seed)
                self._add(batch)
            return iter(())

        def _add(self, batch: pa.RecordBatch) -> None:
            asked, q = self.asked
            usable = batch.column("mse" if self.sketch else "packed").is_valid()
            batch = batch.filter(usable)
            step = max(1, min(2048, (1 << 21) // max(len(asked), 1)))
            for begin in range(0, batch.num_rows if len(asked) else 0, step):
                own = batch.slice(begin, step)
                if self.sketch:
                    s = codes.packed_product_scores(codes.rows_of(own.column("mse"), self.spec.base.code_bytes), codes.rows_of(own.column("signs"), packed_size(self.spec.dim, 1)), _floats(own.column("res_norm")), q, self.spec)
                else:
                    s = codes.packed_scores(codes.rows_of(own.column("packed"), self.spec.code_bytes), _floats(own.column("norm")), q, self.spec)
                new = _found(np.round(s.T, 6) + 0.0, own.column("id").to_numpy(zero_copy_only=False).astype(np.int64), self.k)
                self.best = _best(*(np.concatenate(x) for x in zip(self.best, new)), self.k)

        def terminate(self) -> Iterator[pa.Table]:
            at, ids, s = self.best
            yield pa.table({"query_id": pa.array(self.asked[0][at] if self.asked else at, pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(s, pa.float64())})

    return Search


def _list(argument: AnalyzeArgument, name: str, kind: type) -> list:
    """The values of a constant comma-separated list; each is checked when the query is analysed."""
    if not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} must be a constant list")
    try:
        return [kind(x.strip()) for x in str(argument.value).split(",") if x.strip()]
    except ValueError:
        raise ValueError(f"{name}: {argument.value!r} is no list of {kind.__name__} values") from None


class ConfigGrid:
    """A row a configuration: method, key_bits, value_bits, top_k."""

    @staticmethod
    def analyze(methods: AnalyzeArgument, key_bits: AnalyzeArgument, value_bits: AnalyzeArgument, top_k: AnalyzeArgument) -> AnalyzeResult:
        for x in _list(methods, "methods", str):
            if x.lower() not in ("primary", "uniform"):
                raise ValueError(f"methods: unknown method {x!r}")
        for argument, name, low, high in ((key_bits, "key_bits", 2, 8), (value_bits, "value_bits", 1, 8), (top_k, "top_k", 0, 1 << 31)):
            if bad := [x for x in _list(argument, name, int) if not low <= x <= high]:
                raise ValueError(f"{name}: {bad[0]} is not from {low} to {high}")
        return AnalyzeResult(StructType([StructField("method", StringType()), *[StructField(x, IntegerType()) for x in ("key_bits", "value_bits", "top_k")]]))

    def eval(self, methods: str, key_bits: str, value_bits: str, top_k: str):
        parts = [[x.strip().lower() for x in methods.split(",") if x.strip()], *([int(x) for x in str(y).split(",") if x.strip()] for y in (key_bits, value_bits, top_k))]
        yield from product(*(dict.fromkeys(p) for p in parts))


class Layers:
    """layer, place (from 0): the layers that a selector names."""

    def eval(self, selector: str, layers: int):
        from vecspark.sources.captures import layers_of

        for place, layer in enumerate(layers_of(selector, layers)):
            yield layer, place


def _register_search(spark: SparkSession) -> None:
    spark.udtf.register("vq_search", F.arrow_udtf(_search_class(dict(_SETS)), returnType="query_id long, id long, score double"))


#: Bytes of vectors of a query set.
SET_BYTES = 16 << 20


def query_set(spark: SparkSession, name: str, queries: DataFrame, dim: int) -> None:
    """Broadcasts queries (query_id, q) under a name that vq_search takes. Of a checked size: more queries go to operators.search.topk()."""
    if queries.count() * dim * 8 > SET_BYTES:
        raise ValueError(f"a query set of more than {SET_BYTES} bytes is not broadcast")
    table = queries.select("query_id", "q").toArrow().combine_chunks()
    _SETS[name] = spark.sparkContext.broadcast((table.column("query_id").to_numpy(), codes.matrix_of(table.column("q"), dim)))
    _register_search(spark)


def register(spark: SparkSession) -> SparkSession:
    """Makes FUNCTIONS, ARROW and the table functions functions of the session."""
    for name, (make, kind) in ARROW.items():
        spark.udf.register(name, _arrow(make, kind))
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    _register_search(spark)
    spark.udtf.register("vq_config_grid", F.udtf(ConfigGrid))
    spark.udtf.register("vq_layers", F.udtf(Layers, returnType="layer int, place int"))
    return spark
