"""Named queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.functions import columns as c
from vecspark.functions.registered import register
from vecspark.functions.spec import ProductSpec, QuantizerSpec
from vecspark.operators import accumulate, allocation, attention, encode, search, sweep, turns
from vecspark.operators.model_cache import LayerProfile, ModelCache
from vecspark.sources import blobs, captures, pages, reports
from vecspark.streaming import requests, sessions

from . import sql
from .data import DIM, cases, queries_of, shared_folder, table, vectors

SPEC = QuantizerSpec(DIM, 2, seed=42)
PRODUCT = ProductSpec(DIM, 3, seed=42)
K = 10
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "code_search"


def query(oracle: str | None = None):
    """Registers a query by its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle.strip()
        return f

    return keep


# Vectors and codes


@query(f"SELECT vec_id, round(sqrt({sql.dot('CAST(embedding AS DOUBLE[])', 'CAST(embedding AS DOUBLE[])')}), 6) AS norm, CASE WHEN len(embedding) <> 64 THEN 'bad' END AS error, CAST((len(embedding) * 3 + 7) // 8 AS INT) AS bytes_at_3 FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(c.norm("embedding"), 6).alias("norm"), c.vector_error("embedding", DIM).alias("error"), c.packed_size(F.size("embedding"), 3).alias("bytes_at_3"))


@query("WITH vecs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) " + sql.ranked(f"SELECT q.id AS query_id, r.id AS id, round({sql.dot('r.v', 'q.v')}, 6) + 0 AS score FROM vecs q, vecs r WHERE q.id % 100 = 0", K))
def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return search.exact_topk(rows, queries_of(rows), K, DIM)


@query(f"WITH {sql.coded(SPEC)} SELECT id, CAST(i AS INT) AS coordinate, round(y[i + 1], 6) + 0 AS value FROM (SELECT id, y, unnest(range({DIM})) AS i FROM rotated)")
def rotate_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.transform("v", lambda x: x.cast("double") / c.norm("v").cast("float"))
    rows = vectors(spark, sf_dir).select("id", unit.alias("v"))
    return encode.rotate(rows, SPEC).select("id", F.posexplode("rotated").alias("coordinate", "value")).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(f"WITH {sql.coded(SPEC)} SELECT id, {sql.packed_hex('cells', DIM, 2)} AS code, round(norm, 6) AS norm FROM coded")
def quantize_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.quantize(vectors(spark, sf_dir).select("id", "v"), SPEC).select("id", F.lower(F.hex("packed")).alias("code"), F.round(F.col("norm").cast("double"), 6).alias("norm"))


@query(f"WITH {sql.coded(SPEC)} SELECT id, CAST(i AS INT) AS coordinate, CAST(cells[i + 1] AS INT) AS cell FROM (SELECT id, cells, unnest(range({DIM})) AS i FROM coded)")
def unpack_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode.quantize(vectors(spark, sf_dir).select("id", "v"), SPEC)
    return encode.unpack(coded, DIM, SPEC.bits).select("id", F.posexplode("cells").alias("coordinate", "cell"))


def _error_sql(bits: int) -> str:
    spec = QuantizerSpec(DIM, bits, 42)
    diff = "list_transform(list_zip(y, list_transform(cells, lambda i: cen[i + 1])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))"
    return f"SELECT * FROM (WITH {sql.coded(spec)} SELECT {bits} AS bits, count(*) AS vectors, round(avg({sql.total(diff)}), 9) AS mean_error FROM coded, consts)"


@query(" UNION ALL ".join(map(_error_sql, range(1, 5))))
def error_by_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error of unit vectors' reconstructions: by rotating back, where the oracle stays in the rotated space."""
    unit = F.transform("v", lambda x: x.cast("double") / c.norm("v").cast("float"))
    rows, out = vectors(spark, sf_dir).select("id", unit.alias("v")), None
    for bits in range(1, 5):
        spec = QuantizerSpec(DIM, bits, 42)
        again = encode.dequantize(encode.quantize(rows, spec), spec)
        one = again.agg(F.lit(bits).alias("bits"), F.count("*").alias("vectors"), F.round(F.avg(c.mean_squared_error("v", "recon") * DIM), 9).alias("mean_error"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {sql.coded(SPEC)} {sql.ranked(sql.code_scores(SPEC), K)}")
def code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k by 2-bit codes."""
    rows = vectors(spark, sf_dir)
    return search.QuantizedIndex.fit(rows, SPEC).search(queries_of(rows), K)


@query(f"WITH {sql.sketched(PRODUCT)} SELECT id, {sql.packed_hex('cells', DIM, 2)} AS mse, {sql.packed_hex('signs', DIM, 1)} AS signs, round(res_norm, 6) AS res_norm FROM sketched")
def product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode.quantize_product(vectors(spark, sf_dir).select("id", "v"), PRODUCT)
    return coded.select("id", F.lower(F.hex("mse")).alias("mse"), F.lower(F.hex("signs")).alias("signs"), F.round(F.col("res_norm").cast("double"), 6).alias("res_norm"))


_ASKED = f"(SELECT id, list_transform(rot, lambda r: {sql.dot('r', 'v')}) AS ry, list_transform(s, lambda r: {sql.dot('r', 'v')}) AS sy FROM vecs, consts, proj WHERE id % 100 = 0)"
_PRODUCT_SCORES = f"""SELECT q.id AS query_id, c.id AS id, round({sql.dot("list_transform(c.cells, lambda i: cen[i + 1])", "q.ry")} + {PRODUCT.scale!r} * c.res_norm * {sql.dot("list_transform(c.signs, lambda b: CAST(2 * b - 1 AS DOUBLE))", "q.sy")}, 6) + 0 AS score
FROM {_ASKED} q, sketched c, consts"""


@query(f"WITH {sql.sketched(PRODUCT)} {sql.ranked(_PRODUCT_SCORES, K)}")
def product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k by 3-bit inner-product codes."""
    rows = vectors(spark, sf_dir)
    return search.QuantizedIndex.fit(rows, PRODUCT).search(queries_of(rows), K)


_PROJECTED = f"list_transform(range({DIM}), lambda j: {sql.total('list_transform(list_zip(s, signs), lambda p: p[1][j + 1] * (2 * p[2] - 1))')})"


@query(f"WITH {sql.sketched(PRODUCT)}, turned_s AS (SELECT list_transform(range({DIM}), lambda j: list_transform(s, lambda r: r[j + 1])) AS ts FROM proj), back AS (SELECT id, v, rest, list_transform(ts, lambda r: {PRODUCT.scale!r} * res_norm * {sql.dot('r', 'list_transform(signs, lambda b: CAST(2 * b - 1 AS DOUBLE))')}) AS lift FROM sketched, turned_s) SELECT id, round({sql.total('list_transform(list_zip(rest, lift), lambda p: (p[1] - p[2]) * (p[1] - p[2]))')}, 6) AS squared_error FROM back")
def product_dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error of what inner-product codes give back, for the unit vector."""
    unit = F.transform("v", lambda x: x.cast("double") / c.norm("v").cast("float"))
    again = encode.dequantize_product(encode.quantize_product(vectors(spark, sf_dir).select("id", unit.alias("v")), PRODUCT), PRODUCT)
    return again.select("id", F.round(c.mean_squared_error("v", "recon") * DIM, 6).alias("squared_error"))


@query(f"""WITH {sql.coded(SPEC)},
found AS ({sql.ranked(sql.code_scores(SPEC), K)}),
exact AS ({sql.ranked(f"SELECT q.id AS query_id, r.id AS id, round({sql.dot('r.v', 'q.v')}, 6) + 0 AS score FROM vecs q, vecs r WHERE q.id % 100 = 0", K)})
SELECT e.query_id, round(count(f.id) / count(*), 6) AS recall FROM exact e LEFT JOIN found f ON f.query_id = e.query_id AND f.id = e.id GROUP BY e.query_id""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recall(code_search(spark, sf_dir), exact_search(spark, sf_dir)).withColumn("recall", F.round("recall", 6))


_UNIFORM = "list_transform(v, lambda x: CASE WHEN norm = 0 THEN 0 ELSE (floor((least(greatest(x / norm, -1), 1) + 1) / 2 * 15 + 0.5) / 15 * 2 - 1) * norm END)"
_UNITS = f"vecs AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), units AS (SELECT id, label, v, CAST(CAST(sqrt({sql.dot('v', 'v')}) AS FLOAT) AS DOUBLE) AS norm FROM vecs)"


@query(f"WITH {_UNITS}, u AS (SELECT id, v, {_UNIFORM} AS r FROM units) SELECT id, round({sql.total('list_transform(list_zip(v, r), lambda p: (p[1] - p[2]) * (p[1] - p[2]))')} / {DIM}, 9) AS mse, round({sql.dot('v', 'r')} / (sqrt({sql.dot('v', 'v')}) * sqrt({sql.dot('r', 'r')})), 9) AS cosine FROM u")
def uniform_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("recon", c.uniform_reconstruct("v", 4))
    return rows.select("id", F.round(c.mean_squared_error("v", "recon"), 9).alias("mse"), F.round(c.cosine("v", "recon"), 9).alias("cosine"))


@query(f"WITH e AS (SELECT vec_id, unnest(range({DIM})) AS k, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), w AS (SELECT k, unnest(range({DIM})) AS j, unnest(r) AS y FROM (SELECT unnest(range({DIM})) AS k, unnest({sql.doubles(SPEC.dense)}) AS r)) SELECT e.vec_id AS i, CAST(w.j AS INT) AS j, round(sum(x * y), 6) + 0 AS value FROM e JOIN w ON e.k = w.k GROUP BY e.vec_id, w.j")
def matmul_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors times a matrix (a rotation), as a join."""
    a = vectors(spark, sf_dir).select(F.col("id").alias("i"), F.posexplode("v").alias("k", "x"))
    w = spark.createDataFrame([(k, j, float(y)) for k, row in enumerate(SPEC.dense) for j, y in enumerate(row)], "k int, j int, y double")
    return encode.matmul_relational(a, w).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(ORACLES["matmul_relational"])
def matmul_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same product with the matrix in every task: a map. The join is for matrices that are sparse, or too large to be broadcast."""
    out = encode.matmul(vectors(spark, sf_dir).select("id", "v"), SPEC.dense)
    return out.select(F.col("id").alias("i"), F.posexplode("product").alias("j", "value")).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(ORACLES["unpack_codes"])
def quantize_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as integers, never packed."""
    return encode.indices(vectors(spark, sf_dir).select("id", "v"), SPEC).select("id", F.posexplode("cells").alias("coordinate", "cell"))


# Attention: pages are labels, slots follow vec_id; keys and values are the vectors


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1
    return vectors(spark, sf_dir).select("id", "label", slot.cast("int").alias("slot"), F.col("v").alias("key"), F.col("v").alias("value"))


_SLOTS = "entries AS (SELECT vec_id AS id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS slot, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _attention_sql(scores: str, values: str, k: int | None) -> str:
    """scores: query_id, label, slot, score; values: label, slot, v."""
    some = f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slot) <= {k}" if k else ""
    return f"""scored AS ({scores}), picked AS (SELECT * FROM scored {some}),
shifted AS (SELECT *, exp(score - max(score) OVER (PARTITION BY query_id)) AS e FROM picked), weighted AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS w FROM shifted),
each AS (SELECT query_id, unnest(range({DIM})) AS coordinate, unnest(list_transform(x.v, lambda c: c * w)) AS part FROM weighted JOIN ({values}) x USING (label, slot))
SELECT query_id, CAST(coordinate AS INT) AS coordinate, round(sum(part), 6) + 0 AS output FROM each GROUP BY query_id, coordinate"""


def _rounded(outputs: DataFrame) -> DataFrame:
    return outputs.withColumn("output", F.round("output", 6) + F.lit(0.0))


_EXACT_SCORES = f"SELECT q.id AS query_id, e.label, e.slot, {sql.dot('q.v', 'e.v')} * 8 AS score FROM entries q JOIN entries e USING (label) WHERE q.id % 100 = 0"


@query(f"WITH {_SLOTS}, {_attention_sql(_EXACT_SCORES, 'SELECT label, slot, v FROM entries', None)}")
def attention_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    asked = entries.where("id % 100 = 0").select(F.col("id").alias("query_id"), "label", F.col("key").alias("q"))
    return _rounded(attention.attend(asked, entries.drop("id"), ["label"], ["query_id"], 8.0))


@query(f"WITH {_SLOTS}, {_attention_sql(_EXACT_SCORES, 'SELECT label, slot, v FROM entries', 16)}")
def attention_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    asked = entries.where("id % 100 = 0").select(F.col("id").alias("query_id"), "label", F.col("key").alias("q"))
    return _rounded(attention.attend(asked, entries.drop("id"), ["label"], ["query_id"], 8.0, 16))


def _on_codes(ask: str, page: str, where: str) -> str:
    """CTEs up to `entries` (id, page columns, slot, v, r: the decoded value) and the scores' SQL, for keys by PRODUCT and values by SPEC."""
    places = f"""{sql.sketched(PRODUCT)},
decoded AS (SELECT id, label, v, list_transform(tor, lambda r: norm * {sql.dot("r", "list_transform(cells, lambda i: cen[i + 1])")}) AS r FROM coded, consts, turned),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS INT) AS place FROM decoded),
entries AS (SELECT id, v, r, {page} FROM placed),
asked AS (SELECT id AS query_id, e.* EXCLUDE (id, r, v), v AS qv, list_transform(rot, lambda r: {sql.dot("r", "v")}) AS ry, list_transform(s, lambda r: {sql.dot("r", "v")}) AS sy FROM entries e, consts, proj WHERE {where})"""
    score = f"({sql.dot('list_transform(k.cells, lambda i: cen[i + 1])', 'q.ry')} + {PRODUCT.scale!r} * k.res_norm * {sql.dot('list_transform(k.signs, lambda b: CAST(2 * b - 1 AS DOUBLE))', 'q.sy')}) * 8"
    return f"{places}, code_scores AS (SELECT q.query_id, e.* EXCLUDE (id, v, r), {score} AS score FROM asked q JOIN entries e USING ({ask}) JOIN sketched k ON k.id = e.id, consts)"


@query(f"WITH {_on_codes('label', 'label, place AS slot', 'id % 100 = 0')}, {_attention_sql('SELECT query_id, label, slot, score FROM code_scores', 'SELECT label, slot, r AS v FROM entries', 16)}")
def attention_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by 3-bit inner-product codes, values by 2-bit codes."""
    entries = _entries(spark, sf_dir)
    coded = encode.quantize(encode.quantize_product(entries, PRODUCT, "key"), SPEC, "value").drop("id", "key", "value")
    asked = entries.where("id % 100 = 0").select(F.col("id").alias("query_id"), "label", F.col("key").cast("array<double>").alias("q"))
    return _rounded(attention.attend_codes(asked, coded, ["label"], ["query_id"], PRODUCT, SPEC, 8.0, 16))


_PAGE = 64


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of one layer each: up to 64 vectors of a label in a row as keys and values, the first of them as the query."""
    entries = _entries(spark, sf_dir).withColumn("page", F.floor(F.col("slot") / _PAGE).cast("int"))
    rows = entries.groupBy("label", "page").agg(F.sort_array(F.collect_list(F.struct("slot", F.col("key").cast("array<float>").alias("v")))).alias("e"))
    flat = F.flatten(F.transform("e", lambda x: x["v"]))
    return captures.with_defaults(rows.select(
        "label", "page", F.lit(1).alias("heads"), F.lit(0).alias("kv_heads"), F.lit(DIM).alias("head_dim"), F.size("e").alias("tokens"), F.lit(8.0).cast("float").alias("query_scale"),
        F.col("e")[0]["v"].alias("query"), flat.alias("keys"), flat.alias("values"),
    ))


_PAGED = "label, place // 64 AS page, place % 64 AS slot"


def _outputs_sql(name: str, scores: str, value: str, k: int | None) -> str:
    some = f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, slot) <= {k}" if k else ""
    return f"""{name}_w AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS w FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY query_id)) AS e FROM (SELECT * FROM ({scores}) {some}))),
{name}_each AS (SELECT query_id, unnest(range({DIM})) AS coordinate, unnest(list_transform({value}, lambda c: c * w)) AS part FROM {name}_w JOIN entries USING (label, page, slot)),
{name} AS (SELECT query_id, list(output ORDER BY coordinate) AS o FROM (SELECT query_id, coordinate, sum(part) AS output FROM {name}_each GROUP BY ALL) GROUP BY query_id)"""


_EVAL_BYTES = attention.entry_bytes(DIM, 3, 2)


@query(f"""WITH {_on_codes("label, page", _PAGED, "slot = 0")},
{_outputs_sql("exact", f"SELECT q.query_id, e.label, e.page, e.slot, {sql.dot('q.qv', 'e.v')} * 8 AS score FROM asked q JOIN entries e USING (label, page)", "v", None)},
{_outputs_sql("approx", "SELECT query_id, label, page, slot, score FROM code_scores", "r", 16)},
sizes AS (SELECT label, page, count(*) AS n FROM entries GROUP BY ALL)
SELECT s.label, CAST(s.page AS INT) AS page, CAST(n AS INT) AS tokens, CAST(least(n, 16) AS INT) AS top_k, n * {2 * DIM * 4} AS raw_kv_bytes, n * {_EVAL_BYTES} AS cache_live_bytes, greatest(n, 50) * {_EVAL_BYTES} AS cache_storage_bytes,
  round(n * {2 * DIM * 4} / (greatest(n, 50) * {_EVAL_BYTES}), 6) AS compression_ratio, round({sql.total("list_transform(list_zip(x.o, a.o), lambda p: (p[1] - p[2]) * (p[1] - p[2]))")} / {DIM}, 6) AS output_mse,
  round({sql.dot("x.o", "a.o")} / (sqrt({sql.dot("x.o", "x.o")}) * sqrt({sql.dot("a.o", "a.o")})), 6) AS output_cosine
FROM exact x JOIN approx a USING (query_id) JOIN asked q USING (query_id) JOIN sizes s USING (label, page)""")
def capture_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows of captures: 3-bit keys, 2-bit values, 16 entries, room for 50."""
    out = captures.evaluate(_captures(spark, sf_dir), ["label", "page"], 3, 2, DIM, 16, 42, "primary", 50)
    return out.select("label", "page", "tokens", "top_k", "raw_kv_bytes", "cache_live_bytes", "cache_storage_bytes", *[F.round(x, 6).alias(x) for x in ("compression_ratio", "output_mse", "output_cosine")])


def _swept_sql(k: int | None) -> str:
    score = f"SELECT q.query_id, e.label, e.page, e.slot, {sql.dot('q.qv', 'e.v')} * 8 AS score FROM asked q JOIN entries e USING (label, page)"
    return f"""SELECT * FROM (WITH {_on_codes("label, page", _PAGED, "slot = 0")}, {_outputs_sql("exact", score, "v", None)}, {_outputs_sql("approx", "SELECT query_id, label, page, slot, score FROM code_scores", "r", k)},
sizes AS (SELECT label, page, count(*) AS n FROM entries GROUP BY ALL)
SELECT s.label, CAST(s.page AS INT) AS page, CAST({k or 0} AS INT) AS requested_top_k, CAST({f'least(n, {k})' if k else 'n'} AS INT) AS top_k, n * {_EVAL_BYTES} AS cache_live_bytes, round({sql.total("list_transform(list_zip(x.o, a.o), lambda p: (p[1] - p[2]) * (p[1] - p[2]))")} / {DIM}, 6) AS output_mse,
  round({sql.dot("x.o", "a.o")} / (sqrt({sql.dot("x.o", "x.o")}) * sqrt({sql.dot("a.o", "a.o")})), 6) AS output_cosine FROM exact x JOIN approx a USING (query_id) JOIN asked q USING (query_id) JOIN sizes s USING (label, page))"""


@query(f"{_swept_sql(16)} UNION ALL {_swept_sql(None)} UNION ALL {_swept_sql(4)}")
def capture_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures under a grid of configurations (3-bit keys, 2-bit values; 16, all and 4 entries), in one map over the samples."""
    out = captures.sweep(_captures(spark, sf_dir), ["label", "page"], DIM, [3], [2], [16, 0, 4])
    return out.select("label", "page", "requested_top_k", "top_k", "cache_live_bytes", *[F.round(x, 6).alias(x) for x in ("output_mse", "output_cosine")])


@query(f"WITH {_UNITS}, entries AS (SELECT id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS INT) AS slot, v, {_UNIFORM} AS r FROM units), {_attention_sql(_EXACT_SCORES.replace('q.v, e.v', 'q.v, e.r'), 'SELECT label, slot, r AS v FROM entries', 16)}")
def attention_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    even = entries.select("label", "slot", c.uniform_reconstruct("key", 4).alias("key")).withColumn("value", F.col("key"))
    asked = entries.where("id % 100 = 0").select(F.col("id").alias("query_id"), "label", F.col("key").alias("q"))
    return _rounded(attention.attend(asked, even, ["label"], ["query_id"], 8.0, 16))


@query(f"WITH {_SLOTS}, heads AS (SELECT id AS query_id, h AS head, h // 2 AS label, v FROM (SELECT *, unnest(range(20)) AS h FROM entries WHERE id % 100 = 0)), scored AS (SELECT query_id * 20 + head AS query_id, e.label, e.slot, {sql.dot('q.v', 'e.v')} * 8 AS score FROM heads q JOIN entries e ON e.label = q.label), {_attention_sql('SELECT * FROM scored', 'SELECT label, slot, v FROM entries', 16).split(',', 1)[1]}".replace("picked AS (SELECT * FROM scored", "picked AS (SELECT * FROM scored"))
def attention_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 query heads over 10 key/value heads (labels). query_id is 20 times the vector's id plus the head."""
    entries = _entries(spark, sf_dir)
    asked = entries.where("id % 100 = 0").select("id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("head"), F.col("key").alias("q"))
    heads = attention.grouped_heads(asked, 20, 10).select((F.col("id") * 20 + F.col("head")).alias("query_id"), F.col("kv_head").alias("label"), "q")
    return _rounded(attention.attend(heads, entries.drop("id"), ["label"], ["query_id"], 8.0, 16))


_ENTRY = attention.entry_bytes(DIM, 3, 2)


@query(f"SELECT model, label, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(n) * {_ENTRY} AS BIGINT) AS live_bytes, CAST(sum(greatest(4, CAST(pow(2, ceil(log2(n))) AS BIGINT))) * {_ENTRY} AS BIGINT) AS storage_bytes FROM (SELECT CAST(vec_id % 3 AS INT) AS model, label, count(*) AS n FROM embeddings GROUP BY ALL) GROUP BY ROLLUP (model, label)")
def byte_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = vectors(spark, sf_dir).select((F.col("id") % 3).cast("int").alias("model"), "label")
    return attention.byte_rollup(entries, ["model", "label"], DIM, 3, 2)


# Evaluation results


_RANKS = {"mse": "output_mse, output_cosine DESC, storage_bytes", "cosine": "output_cosine DESC, output_mse, storage_bytes", "size": "storage_bytes, output_mse, output_cosine DESC"}
_CFG = ", ".join(sweep.CONFIG)
_WON = ", ".join(f"CASE WHEN row_number() OVER (PARTITION BY sample ORDER BY {o}, {_CFG}) = 1 THEN 1 ELSE 0 END AS {n}" for n, o in _RANKS.items())


def _lower(x: str, p: float) -> str:
    return f"list_sort(list({x}))[CAST(floor({p} * (count(*) - 1)) AS INT) + 1]"


_SUMMARY = f"""won AS (SELECT *, {_WON} FROM cases), summary AS (SELECT {_CFG}, count(*) AS cases, avg(output_mse) AS mean_mse, {_lower("output_mse", 0.5)} AS p50_mse, {_lower("output_mse", 0.95)} AS p95_mse, max(output_mse) AS max_mse,
avg(output_cosine) AS mean_cosine, {_lower("output_cosine", 0.05)} AS p05_cosine, {_lower("output_cosine", 0.5)} AS p50_cosine, min(output_cosine) AS min_cosine, avg(storage_bytes) AS mean_storage, avg(CAST(raw_bytes AS DOUBLE) / storage_bytes) AS mean_compression,
CAST(sum(mse) AS BIGINT) AS mse_wins, CAST(sum(cosine) AS BIGINT) AS cosine_wins, CAST(sum(size) AS BIGINT) AS size_wins FROM won GROUP BY {_CFG})"""
_NINE = ["mean_mse", "p50_mse", "p95_mse", "max_mse", "mean_cosine", "p05_cosine", "p50_cosine", "min_cosine", "mean_storage", "mean_compression"]
_ROUNDED = ", ".join(f"round({x}, 9) AS {x}" for x in _NINE)


def _nine(df: DataFrame, names: list[str] = _NINE) -> DataFrame:
    return df.withColumns({x: F.round(x, 9) for x in names if x in df.columns})


@query(f"WITH {sql.cases()}, {_SUMMARY} SELECT {_CFG}, cases, {_ROUNDED}, mse_wins, cosine_wins, size_wins FROM summary")
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nine(sweep.summary(cases(spark, sf_dir)))


@query(" UNION ALL ".join(f"SELECT '{n}' AS contest, sample, {_CFG}, output_mse, storage_bytes FROM (WITH {sql.cases()} SELECT * FROM cases QUALIFY row_number() OVER (PARTITION BY sample ORDER BY {o}, {_CFG}) = 1)" for n, o in _RANKS.items()))
def sweep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cases(spark, sf_dir)
    parts = [sweep.best_cases(found, by).select(F.lit(by).alias("contest"), "sample", *sweep.CONFIG, "output_mse", "storage_bytes") for by in _RANKS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {sql.cases()}, {_SUMMARY} SELECT {_CFG}, round(mean_storage, 9) AS mean_storage, round(mean_mse, 9) AS mean_mse, round(mean_cosine, 9) AS mean_cosine FROM summary a WHERE NOT EXISTS (SELECT 1 FROM summary b WHERE b.mean_storage <= a.mean_storage AND b.mean_mse <= a.mean_mse AND (b.mean_storage < a.mean_storage OR b.mean_mse < a.mean_mse OR b.mean_cosine > a.mean_cosine))")
def sweep_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nine(sweep.frontier(sweep.summary(cases(spark, sf_dir))).select(*sweep.CONFIG, "mean_storage", "mean_mse", "mean_cosine"))


def _group_sql(name: str) -> str:
    return f"SELECT '{name}' AS dimension, CAST({name} AS VARCHAR) AS label, key_bits, value_bits, top_k, count(*) AS cases, avg(output_mse) AS mean_mse, avg(output_cosine) AS mean_cosine, avg(storage_bytes) AS mean_storage FROM cases GROUP BY ALL"


@query(f"WITH {sql.cases()}, g AS ({' UNION ALL '.join(map(_group_sql, ('method', 'layer', 'tokens', 'position')))} UNION ALL {_group_sql('overall').replace('CAST(overall AS VARCHAR)', "'all'")}) SELECT dimension, label, key_bits, value_bits, top_k, cases, round(mean_mse, 9) AS mean_mse, round(mean_cosine, 9) AS mean_cosine, round(mean_storage, 9) AS mean_storage, CAST(row_number() OVER (PARTITION BY dimension, label ORDER BY round(mean_mse, 9), round(mean_cosine, 9) DESC, mean_storage, key_bits, value_bits, top_k) AS INT) AS place FROM g")
def summary_groupings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nine(sweep.groupings(cases(spark, sf_dir)))


_SHARE = "(CAST(l_orderkey % 1000 AS DOUBLE) / 999)"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN {_SHARE} < 0.125 THEN 'first' WHEN {_SHARE} < 0.375 THEN 'quarter' WHEN {_SHARE} < 0.625 THEN 'middle' WHEN {_SHARE} < 0.875 THEN 'three_quarter' ELSE 'last' END AS position, CAST(CASE WHEN {_SHARE} < 0.125 THEN 0 WHEN {_SHARE} < 0.375 THEN 1 WHEN {_SHARE} < 0.625 THEN 2 WHEN {_SHARE} < 0.875 THEN 3 ELSE 4 END AS INT) AS place FROM lineitem")
def position_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = c.relative_position(F.lit(""), F.col("l_orderkey") % 1000, F.lit(1000))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label.alias("position")).withColumn("place", c.position_rank("position"))


_CANDIDATES = "candidates AS (SELECT layer, key_bits, value_bits, top_k, avg(raw_bytes) AS raw_bytes, avg(CAST(raw_bytes AS DOUBLE) / storage_bytes) AS compression, count(*) AS cases, avg(output_mse) AS mean_mse, avg(output_cosine) AS mean_cosine, quantile_cont(output_cosine, 0.05) AS p05_cosine, min(output_cosine) AS min_cosine, avg(storage_bytes) AS storage_bytes, max(tokens) AS capacity FROM cases WHERE method = 'primary' GROUP BY ALL)"
_SKYLINE = "skyline AS (SELECT * FROM (SELECT *, min(mean_mse) OVER (PARTITION BY layer ORDER BY storage_bytes, mean_mse, mean_cosine DESC, key_bits, value_bits, top_k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM candidates) WHERE before IS NULL OR mean_mse < before)"
_LAYERED = "layer, key_bits, value_bits, top_k, cases, round(mean_mse, 9) AS mean_mse, round(mean_cosine, 9) AS mean_cosine, round(p05_cosine, 9) AS p05_cosine, round(min_cosine, 9) AS min_cosine, round(raw_bytes, 9) AS raw_bytes, round(storage_bytes, 9) AS storage_bytes, round(compression, 9) AS compression, capacity"
_TEN = [*_NINE, "raw_bytes", "storage_bytes", "compression"]


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.candidates(cases(spark, sf_dir), "primary")


@query(f"WITH {sql.cases()}, {_CANDIDATES} SELECT {_LAYERED} FROM candidates")
def profile_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nine(_candidates(spark, sf_dir), _TEN)


@query(f"WITH {sql.cases()}, {_CANDIDATES}, {_SKYLINE} SELECT {_LAYERED} FROM skyline")
def profile_skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nine(allocation.skyline(_candidates(spark, sf_dir)), _TEN)


@query(f"WITH {sql.cases()}, {_CANDIDATES} SELECT {_LAYERED} FROM candidates WHERE mean_cosine >= 0.9 AND p05_cosine >= 0.8 QUALIFY row_number() OVER (PARTITION BY layer ORDER BY storage_bytes, mean_mse, mean_cosine DESC, key_bits, value_bits, top_k) = 1")
def profile_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = allocation.floors(_candidates(spark, sf_dir), 0.9, 0.8)
    return _nine(allocation.best_by(kept, "size"), _TEN)


_BUDGETS = [("tight", 30000.0), ("wide", 45000.0)]


def _brute(layers: int) -> str:
    """All choices of one candidate of each of the first layers, the best under each budget."""
    names = [f"s{i}" for i in range(layers)]
    pick = " UNION ALL ".join(f"SELECT set, {i} AS layer, {n}.key_bits, {n}.value_bits, {n}.top_k, {n}.storage_bytes, {n}.mean_mse FROM best" for i, n in enumerate(names))
    units = " + ".join(f"CAST(ceil({n}.storage_bytes / 16) AS BIGINT)" for n in names)
    error = " + ".join(f"{n}.mean_mse" for n in names)
    join = ", ".join(f"(SELECT * FROM skyline WHERE layer = {i}) {n}" for i, n in enumerate(names))
    rows = ", ".join(f"{n}" for n in names)
    return f"best AS (SELECT * FROM (SELECT set, {rows}, row_number() OVER (PARTITION BY set ORDER BY {error}, {units}) AS n FROM (VALUES {', '.join(f'({s!r}, {b})' for s, b in _BUDGETS)}) AS budgets(set, budget), {join} WHERE {units} <= CAST(ceil(budget / 16) AS BIGINT)) WHERE n = 1) SELECT set, CAST(layer AS INT) AS layer, key_bits, value_bits, top_k, round(storage_bytes, 9) AS storage_bytes, round(mean_mse, 9) AS mean_mse FROM ({pick})"


@query(f"WITH {sql.cases()}, {_CANDIDATES}, {_SKYLINE}, {_brute(8)}")
def profile_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best choice for all layers under two budgets; the oracle tries all choices."""
    budgets = spark.createDataFrame(_BUDGETS, "set string, budget double")
    return _nine(allocation.allocate(allocation.skyline(_candidates(spark, sf_dir)), budgets, 16.0), _TEN)


_MODES = {"best": {}, "floor": {"mean_cosine": 0.9, "p05_cosine": 0.8}, "bytes": {"max_storage": 30000.0, "unit": 16.0}, "ratio": {"min_compression": 12.0, "mean_cosine": 0.85, "unit": 16.0}}
_SEEN = "layer, key_bits, value_bits, top_k"


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, out = _candidates(spark, sf_dir), None
    for name, limits in _MODES.items():
        one = allocation.select_profile(found, name, **limits)
        out = one if out is None else out.unionByName(one)
    return out


def _first(name: str, mode: str, order: str, where: str = "true") -> str:
    return f"SELECT '{name}' AS set, '{mode}' AS mode, * EXCLUDE (before) FROM skyline WHERE {where} QUALIFY row_number() OVER (PARTITION BY layer ORDER BY {order}, mean_cosine DESC, key_bits, value_bits, top_k) = 1"


def _tried(name: str, mode: str, budget: str, where: str = "true") -> str:
    """The best of all choices of one candidate of each of eight layers."""
    layers = [f"l{i}" for i in range(8)]
    units, error = " + ".join(f"CAST(ceil({n}.storage_bytes / 16) AS BIGINT)" for n in layers), " + ".join(f"{n}.mean_mse" for n in layers)
    picked = f"(SELECT {', '.join(layers)} FROM {', '.join(f'(SELECT * FROM skyline WHERE layer = {i} AND {where}) {n}' for i, n in enumerate(layers))} WHERE {units} <= CAST(ceil(({budget}) / 16) AS BIGINT) ORDER BY {error}, {units} LIMIT 1)"
    return " UNION ALL ".join(f"SELECT '{name}' AS set, '{mode}' AS mode, unnest({n}) FROM {picked}" for n in layers)


_RAW = "SELECT sum(raw_bytes) / 12 FROM (SELECT raw_bytes FROM skyline WHERE mean_cosine >= 0.85 QUALIFY row_number() OVER (PARTITION BY layer ORDER BY storage_bytes) = 1)"
_CHOSEN = f"""{_CANDIDATES}, {_SKYLINE}, chosen AS ({_first("best", "best-mse", "mean_mse, storage_bytes")} UNION ALL BY NAME {_first("floor", "fidelity-floor", "storage_bytes, mean_mse", "mean_cosine >= 0.9 AND p05_cosine >= 0.8")}
UNION ALL BY NAME SELECT * EXCLUDE (before) FROM ({_tried("bytes", "budgeted", "30000")}) UNION ALL BY NAME SELECT * EXCLUDE (before) FROM ({_tried("ratio", "budgeted-fidelity-floor", _RAW, "mean_cosine >= 0.85")}))"""


@query(f"WITH {sql.cases()}, {_CHOSEN} SELECT set, mode, {_LAYERED} FROM chosen")
def profile_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile by each mode: the most exact, the smallest above floors, under a budget in bytes, and by a compression above a floor."""
    return _nine(_modes(spark, sf_dir), _TEN)


@query(f"WITH {sql.cases()}, {_CHOSEN} SELECT set, count(*) AS layers, CAST(sum(cases) AS BIGINT) AS samples, round(avg(mean_mse), 9) AS mean_mse, round(avg(mean_cosine), 9) AS mean_cosine, round(sum(raw_bytes), 6) AS raw_bytes, round(sum(storage_bytes), 6) AS storage_bytes, round(sum(raw_bytes) / sum(storage_bytes), 6) AS compression FROM chosen GROUP BY set")
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = allocation.allocation_summary(_modes(spark, sf_dir))
    return _nine(out, ["mean_mse", "mean_cosine"]).withColumns({x: F.round(x, 6) for x in ("raw_bytes", "storage_bytes", "compression")})


@query("WITH own AS (SELECT n_nationkey AS layer, n_regionkey AS bits FROM nation WHERE n_nationkey IN (0, 6, 7, 15)), every AS (SELECT n_nationkey AS layer FROM nation) SELECT e.layer, o.bits, o.layer AS donor FROM every e, own o QUALIFY row_number() OVER (PARTITION BY e.layer ORDER BY abs(e.layer - o.layer), o.layer) = 1")
def profile_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    profile = nation.where(F.col("n_nationkey").isin(0, 6, 7, 15)).select(F.col("n_nationkey").alias("layer"), F.col("n_regionkey").alias("bits"))
    return allocation.expand(profile, nation.select(F.col("n_nationkey").alias("layer")))


@query("WITH runs AS (SELECT event_type AS variant, user_id % 7 AS depth, avg(value) AS rate FROM events GROUP BY ALL) SELECT r.variant, r.depth, round(r.rate, 6) AS rate, round(r.rate / b.rate, 6) AS ratio, round(r.rate - b.rate, 6) AS delta FROM runs r JOIN runs b ON b.variant = 'view' AND b.depth = r.depth AND b.rate <> 0 WHERE r.variant <> 'view'")
def bench_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("variant"), (F.col("user_id") % 7).alias("depth")).agg(F.avg("value").alias("rate"))
    out = allocation.against_baseline(runs, "view", ["depth"], "rate")
    return out.select("variant", "depth", *[F.round(x, 6).alias(x) for x in ("rate", "ratio", "delta")])


# Sessions, claims and turns


_EVENTS = "ev AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id, ts, event_type AS endpoint, CASE WHEN value > 40 THEN 500 WHEN value > 30 THEN 404 WHEN value > 25 THEN 401 ELSE 200 END AS status FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    status = F.when(v > 40, 500).when(v > 30, 404).when(v > 25, 401).otherwise(200)
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), "event_id", "ts", F.col("event_type").alias("endpoint"), status.alias("status"))


@query(f"WITH {_EVENTS} SELECT session, min(ts) AS created_at, max(ts) AS last_seen_at, count(*) AS requests, arg_max(endpoint, (ts, event_id)) AS last_endpoint FROM ev GROUP BY session")
def session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.touches(_events(spark, sf_dir))


@query(f"WITH {_EVENTS}, r AS (SELECT *, CASE WHEN before IS NULL OR ts > before + INTERVAL 1800 SECOND THEN 1 ELSE 0 END AS new FROM (SELECT *, lag(ts) OVER (PARTITION BY session ORDER BY ts, event_id) AS before FROM ev)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM r) SELECT session, run, min(ts) AS created_at, max(ts) AS last_seen_at, count(*) AS requests FROM s GROUP BY session, run")
def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.expired_runs(_events(spark, sf_dir), 1800)


@query(f"WITH {_EVENTS} SELECT session, max(ts) AS last_seen_at FROM ev GROUP BY session ORDER BY last_seen_at DESC, session LIMIT 10")
def session_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten sessions that stay: a limit that is the feature."""
    return sessions.live_sessions(sessions.touches(_events(spark, sf_dir)).select("session", "last_seen_at"), 10)


@query(f"WITH {_EVENTS} SELECT session, event_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY session) AS n FROM ev) WHERE seq > n - 64")
def event_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.event_log(_events(spark, sf_dir), 64).select("session", "event_id", "seq")


@query(f"WITH {_EVENTS} SELECT endpoint, count(*) AS requests, count(*) FILTER (status = 401) AS unauthorized, count(*) FILTER (status BETWEEN 400 AND 499 AND status <> 401) AS client_errors, count(*) FILTER (status >= 500) AS server_errors FROM ev GROUP BY endpoint")
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.request_counts(_events(spark, sf_dir))


_ACTIONS = "acts AS (SELECT CAST(user_id % 5 AS VARCHAR) AS session, CAST(event_id % 20 AS VARCHAR) AS entity, CAST(user_id AS VARCHAR) AS agent, CASE WHEN event_type = 'view' THEN 'shared' ELSE 'exclusive' END AS mode, CASE WHEN event_type = 'error' THEN 'release' ELSE 'claim' END AS action, ts, event_id FROM events)"


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("event_type") == "view", "shared").otherwise("exclusive")
    action = F.when(F.col("event_type") == "error", "release").otherwise("claim")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("string").alias("session"), (F.col("event_id") % 20).cast("string").alias("entity"), F.col("user_id").cast("string").alias("agent"), mode.alias("mode"), action.alias("action"), "ts", "event_id")


# A history is a fold in order: the state is a map of agent to mode for each entity, kept in a list of 'agent:mode'.
_STEP = """CASE WHEN action = 'release' THEN list_filter(h, lambda x: split_part(x, ':', 1) <> agent)
  WHEN len(list_filter(h, lambda x: split_part(x, ':', 1) <> agent AND (mode = 'exclusive' OR split_part(x, ':', 2) = 'exclusive'))) > 0 THEN h
  ELSE list_append(list_filter(h, lambda x: split_part(x, ':', 1) <> agent), agent || ':' || mode) END"""


@query(f"""WITH RECURSIVE {_ACTIONS}, numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session, entity ORDER BY ts, event_id) AS n FROM acts),
fold AS (
  SELECT session, entity, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS h, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS agent, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS outcome FROM (SELECT DISTINCT session, entity FROM numbered)
  UNION ALL
  SELECT session, entity, x.n, {_STEP}, x.event_id, agent, action,
    CASE WHEN action = 'release' THEN CASE WHEN len(list_filter(h, lambda x: split_part(x, ':', 1) = agent)) > 0 THEN 'released' ELSE 'absent' END
      WHEN len(list_filter(h, lambda x: split_part(x, ':', 1) <> agent AND (mode = 'exclusive' OR split_part(x, ':', 2) = 'exclusive'))) > 0 THEN 'conflict'
      WHEN len(list_filter(h, lambda x: split_part(x, ':', 1) = agent)) > 0 THEN 'renewed' ELSE 'acquired' END
  FROM (SELECT f.session, f.entity, f.h, a.n, a.event_id, a.agent, a.mode, a.action FROM fold f JOIN numbered a ON a.session = f.session AND a.entity = f.entity AND a.n = f.n + 1) x
)
SELECT session, event_id, entity, agent, action, outcome FROM fold WHERE n > 0""")
def claim_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and releases by user on one of 20 entities in each of five sessions."""
    return sessions.claims(_actions(spark, sf_dir))


_PRESENT = "acts AS (SELECT CAST(user_id % 5 AS VARCHAR) AS session, CAST(user_id AS VARCHAR) AS agent, event_type AS status, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'upsert' END AS action, ts, event_id FROM events)"


@query(f"WITH {_PRESENT}, gone AS (SELECT session, agent, max((ts, event_id)) AS g FROM acts WHERE action = 'remove' GROUP BY ALL) SELECT a.session, a.agent, min(a.ts) AS created_at, max(a.ts) AS updated_at, arg_max(a.status, (a.ts, a.event_id)) AS status FROM acts a LEFT JOIN gone g USING (session, agent) WHERE a.action = 'upsert' AND (g.g IS NULL OR (a.ts, a.event_id) > g.g) GROUP BY a.session, a.agent")
def agent_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "error", "remove").otherwise("upsert")
    return sessions.presence(e.select((F.col("user_id") % 5).cast("string").alias("session"), F.col("user_id").cast("string").alias("agent"), F.col("event_type").alias("status"), action.alias("action"), "ts", "event_id")).select("session", "agent", "created_at", "updated_at", "status")


_NEXT = "SELECT e.vec_id, e.label, CAST(e.embedding AS DOUBLE[]) AS v, CAST(n.embedding AS DOUBLE[]) AS w FROM embeddings e JOIN embeddings n ON n.vec_id = e.vec_id + 1"


@query(f"SELECT vec_id, round(sqrt({sql.dot('v', 'v')}), 6) AS norm, round({sql.dot('v', 'w')} / (sqrt({sql.dot('v', 'v')}) * sqrt({sql.dot('w', 'w')})), 6) + 0 AS cosine, round({sql.total('list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))')} / {DIM}, 6) AS mse, CAST((len(v) * (label + 1) + 7) // 8 AS INT) AS bytes, CAST(label // 2 AS INT) AS kv_head FROM ({_NEXT})")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered functions, called from SQL: each vector beside the next one."""
    return register(spark).sql(
        "SELECT e.vec_id, round(vec_norm(e.embedding), 6) AS norm, round(vec_cosine(e.embedding, n.embedding), 6) + 0D AS cosine, round(vec_mse(e.embedding, n.embedding), 6) AS mse,"
        " packed_size(size(e.embedding), CAST(e.label + 1 AS INT)) AS bytes, kv_head_of(CAST(e.label AS INT), 10, 5) AS kv_head FROM {e} e JOIN {e} n ON n.vec_id = e.vec_id + 1",
        e=table(spark, sf_dir, "embeddings"),
    )


@query(f"WITH {sql.coded(SPEC)} SELECT id, {sql.packed_hex('cells', DIM, 2)} AS code, round(norm, 6) AS norm, round(norm * {sql.dot('list_transform(cells, lambda i: cen[i + 1])', 'list_transform(rot, lambda r: ' + sql.dot('r', 'v') + ')')}, 6) + 0 AS own_score, CAST(cells[1] AS INT) AS first_cell FROM coded, consts")
def sql_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes made, sent as wire bytes, read again, unpacked and scored, all from SQL."""
    return register(spark).sql(
        "WITH coded AS (SELECT id, v, vq_quantize(v, 2, 42) AS c FROM {v}), sent AS (SELECT id, v, vq_from_wire(vq_wire(c.packed, c.norm, size(v), 2)) AS w FROM coded)"
        " SELECT id, lower(hex(w.packed)) AS code, round(CAST(w.norm AS DOUBLE), 6) AS norm, round(vq_score(w.packed, w.norm, v, w.bits, 42), 6) + 0D AS own_score, vq_unpack(w.packed, w.dim, w.bits)[0] AS first_cell FROM sent",
        v=vectors(spark, sf_dir).select("id", F.col("v").cast("array<double>").alias("v")),
    )


_SQL_SEARCH = "SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vq_search(TABLE({codes}), (SELECT collect_list(struct(id, v)) FROM {v} WHERE id % 100 = 0), 10, {bits}, 42)) WHERE rank <= 10"


def _sql_search(spark: SparkSession, sf_dir: str, made: str, bits: int) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", F.col("v").cast("array<double>").alias("v"))
    coded = register(spark).sql(f"SELECT id, c.* FROM (SELECT id, {made} AS c FROM {{v}})", v=rows)
    return spark.sql(_SQL_SEARCH.replace("{bits}", str(bits)), codes=coded, v=rows)


@query(ORACLES["code_search"])
def sql_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k by 2-bit codes from SQL alone: a code function, a table function, and a window."""
    return _sql_search(spark, sf_dir, "vq_quantize(v, 2, 42)", 2)


@query(ORACLES["product_search"])
def sql_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by 3-bit inner-product codes."""
    return _sql_search(spark, sf_dir, "vq_quantize_product(v, 3, 42)", 3)


@query("SELECT conv_id, t.turn AS turn, t.text AS text FROM (SELECT conv_id, arg_max({'turn': turn, 'text': text}, (CASE WHEN role = 'user' THEN 1 ELSE 0 END, turn)) AS t FROM conversations WHERE trim(text) <> '' GROUP BY conv_id)")
def turn_last_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.last_user_turn(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def turn_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.recent(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


@query()
def turn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.recall(table(spark, sf_dir, "conversations"), 4, 128)


@query(r"SELECT conv_id, turn, CAST(len(w) AS INT) AS words, CAST(len(list_distinct(w)) AS INT) AS distinct_words FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(trim(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM conversations)")
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = c.tokens("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct_words"))


@query("SELECT conv_id, turn, CASE WHEN octet_length(encode(one)) <= 40 THEN one ELSE concat(cut, '...') END AS summary FROM (SELECT *, list_reduce(list_prepend('', string_split(one, '')), lambda a, b: CASE WHEN octet_length(encode(concat(a, b))) <= 37 AND starts_with(one, concat(a, b)) THEN concat(a, b) ELSE a END) AS cut FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS one FROM conversations))")
def text_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", c.summary_text("text", 40).alias("summary"))


@query("SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'run' ELSE trim(regexp_replace(lower(trim(text)), '[^a-z0-9]', '-', 'g'), '-') END AS name FROM conversations")
def text_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", c.plain_name("text").alias("name"))


_FNV = f"lambda h, b: (xor(h, b) * {turns.FNV_PRIME}::HUGEINT) % 18446744073709551616::HUGEINT"
_HEX = "lambda i: CAST((strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1 AS HUGEINT)"


@query(rf"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(trim(text)), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS f, lower(trim(text)) AS low FROM conversations),
w AS (SELECT conv_id, turn, unnest(CASE WHEN len(f) > 0 THEN f WHEN low <> '' THEN [low] ELSE ['_empty'] END) AS word FROM t),
kinds AS (SELECT word, list_reduce(list_prepend({turns.FNV_OFFSET}::HUGEINT, list_transform(range(CAST(length(x) // 2 AS INT)), {_HEX})), {_FNV}) AS h FROM (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM w))),
parts AS (SELECT conv_id, turn, list_reduce([h, CAST(turn % 256 AS HUGEINT), 1::HUGEINT, step::HUGEINT], {_FNV}) % 64 AS slot, CASE WHEN list_reduce([h, 1::HUGEINT, step::HUGEINT, 127::HUGEINT], {_FNV}) % 2 = 0 THEN 1 ELSE -1 END AS sign
  FROM w JOIN kinds USING (word), (SELECT unnest(range(4)) AS step)),
sums AS (SELECT conv_id, turn, slot, CAST(sum(sign) AS DOUBLE) AS x FROM parts GROUP BY ALL)
SELECT conv_id, turn, CAST(slot AS INT) AS coordinate, round(x / sqrt(sum(x * x) OVER (PARTITION BY conv_id, turn)), 6) AS value FROM sums WHERE x <> 0""")
def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coordinates of turns' hashed vectors (64, lane 1) that aren't 0."""
    made = turns.text_vectors(table(spark, sf_dir, "conversations"), 64, lane=1)
    return made.select("conv_id", "turn", F.posexplode("v").alias("coordinate", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


_LOG = """concat('init: device{d} KV buffer size =   ', {a}, ' MiB\nllama: size = ', {b}, ' MiB ( 65536 cells,  32 layers), K (q8_0):  ', {c}, ' MiB, V (q4_0):  ', {e}, ' MiB\n[1]15.27\nFinal estimate: PPL = ', {f}, ' +/- ', {g}, '\n')"""
_LOGGED = _LOG.format(d="0", a="CAST(l_partkey AS STRING)", b="CAST(l_suppkey + 1 AS STRING)", c="CAST(l_suppkey AS STRING)", e="'1.5e0'", f="CAST(l_orderkey AS STRING)", g="CAST(l_linenumber AS STRING)")


@query("SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS DOUBLE) AS value, CAST(l_linenumber AS DOUBLE) AS error, CAST(l_suppkey + 1 AS DOUBLE) AS total, 'q8_0' AS key_type, CAST(l_suppkey AS DOUBLE) AS k, 'q4_0' AS value_type, CAST(1.5 AS DOUBLE) AS v, CAST(l_partkey AS DOUBLE) AS buffer FROM lineitem")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with the numbers of lineitem's rows, read back."""
    logs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_LOGGED).alias("text"))
    return logs.select("l_orderkey", "l_linenumber", reports.perplexity(F.col("text")).alias("p"), reports.kv_memory(F.col("text")).alias("m")).select("l_orderkey", "l_linenumber", "p.value", "p.error", *[f"m.{x}" for x in ("total", "key_type", "k", "value_type", "v", "buffer")])


# Binary forms


@query(f"WITH {sql.coded(SPEC)} SELECT id, CAST(38 AS INT) AS bytes, {sql.packed_hex('cells', DIM, 2)} AS code, round(norm, 6) AS norm, CAST({DIM} AS INT) AS dim, CAST({SPEC.bits} AS INT) AS bits FROM coded")
def wire_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the wire form: the oracle works the codes out from the vectors."""
    read = blobs.wire_fields(blobs.wire_column(encode.quantize(vectors(spark, sf_dir).select("id", "v"), SPEC), SPEC))
    return read.select("id", F.length("wire").cast("int").alias("bytes"), F.lower(F.hex("wire_packed")).alias("code"), F.round(F.col("wire_norm").cast("double"), 6).alias("norm"), F.col("wire_dim").cast("int").alias("dim"), F.col("wire_bits").cast("int").alias("bits"))


@query(f"WITH {sql.sketched(PRODUCT)} SELECT id, CAST(22 + {DIM * 2 // 8 + DIM // 8} AS INT) AS bytes, {sql.packed_hex('cells', DIM, 2)} AS mse, {sql.packed_hex('signs', DIM, 1)} AS signs, round(res_norm, 6) AS res_norm FROM sketched")
def wire_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the wire form of inner-product codes."""
    read = blobs.wire_fields(blobs.wire_product_column(encode.quantize_product(vectors(spark, sf_dir).select("id", "v"), PRODUCT), PRODUCT))
    return read.select("id", F.length("wire").cast("int").alias("bytes"), F.lower(F.hex("wire_packed")).alias("mse"), F.lower(F.hex("wire_signs")).alias("signs"), F.round(F.col("wire_norm").cast("double"), 6).alias("res_norm"))


_PARTED = f"""{sql.sketched(PRODUCT)}, parted AS (SELECT k.id, c.label, CAST(k.id // 256 AS BIGINT) AS part, {sql.packed_hex('k.cells', DIM, 2)} AS mse, {sql.packed_hex('k.signs', DIM, 1)} AS signs, {sql.packed_hex('c.cells', DIM, 2)} AS packed FROM sketched k JOIN coded c USING (id))"""


@query(f"""WITH {_PARTED} SELECT label, part, count(*) AS entries, 24 + 50 + count(*) * {attention.entry_bytes(DIM, 3, 2)} AS bytes, '54514b56010000001900000019000000' AS head, md5(string_agg(mse, '' ORDER BY id)) AS mse, md5(string_agg(signs, '' ORDER BY id)) AS signs, md5(string_agg(packed, '' ORDER BY id)) AS packed FROM parted GROUP BY label, part""")
def page_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of at most 256 entries in the page form: the oracle works the bytes of their columns out from the vectors; reading them again must give the entries."""
    part = F.floor(F.col("id") / 256).cast("long")
    slot = (F.row_number().over(Window.partitionBy("label", "part").orderBy("id")) - 1).cast("int")
    rows = vectors(spark, sf_dir).withColumn("part", part).select("label", "part", slot.alias("slot"), "v")
    coded = encode.quantize(encode.quantize_product(rows, PRODUCT), SPEC).drop("v")
    made = blobs.page_bytes(coded, ["label", "part"], PRODUCT, SPEC)
    again = blobs.page_bytes(blobs.page_entries(made, ["label", "part"]), ["label", "part"], PRODUCT, SPEC).withColumnRenamed("page", "again")
    checked = made.join(again, ["label", "part"]).withColumn("page", F.when(F.col("page") == F.col("again"), F.col("page")).otherwise(F.raise_error("a page reads otherwise").cast("binary")))
    n, at, columns = F.conv(F.hex(F.reverse(F.substring("page", 17, 4))), 16, 10).cast("long"), F.lit(75).cast("long"), {}
    for name, width in (("mse", 16), ("signs", 8), ("res_norm", 4), ("packed", 16), ("norm", 4)):
        columns[name] = F.md5(F.lower(F.hex(F.substring(F.col("page"), at.cast("int"), (n * width).cast("int")))))
        at = at + n * width
    head = F.substring(F.lower(F.hex("page")), 1, 32)
    return checked.select("label", "part", n.alias("entries"), F.length("page").cast("long").alias("bytes"), head.alias("head"), *(columns[x].alias(x) for x in ("mse", "signs", "packed")))


@query(f"""WITH {_PARTED}, placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS INT) AS slot FROM parted) SELECT CAST(label AS VARCHAR) AS page, slot, mse, signs, packed FROM placed WHERE label < 5 AND slot BETWEEN 8 AND 23""")
def page_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written as pages, of which a range of slots of some pages is read: files are chosen by page, bytes by slot."""
    slot = (F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1).cast("int")
    rows = vectors(spark, sf_dir).select(F.col("label").cast("string").alias("page"), slot.alias("slot"), "v")
    coded = encode.quantize(encode.quantize_product(rows, PRODUCT), SPEC, keep=[*("page", "slot", "mse", "signs", "res_norm")])
    path = shared_folder(spark)
    pages.write_pages(coded, path, PRODUCT, SPEC)
    some = pages.read_pages(spark, path).where(F.col("page").isin("0", "1", "2", "3", "4") & F.col("slot").between(8, 23))
    return some.select("page", "slot", *(F.lower(F.hex(x)).alias(x) for x in ("mse", "signs", "packed")))


_SETS = "sets AS (SELECT 'all' AS \"set\", * FROM cases UNION ALL SELECT position AS \"set\", * FROM cases WHERE position IN ('first', 'last'))"
_SET_CANDIDATES = _CANDIDATES.replace("SELECT layer, key_bits", "SELECT \"set\", layer, key_bits").replace("FROM cases WHERE", "FROM sets WHERE")
_SET_SKYLINE = _SKYLINE.replace("PARTITION BY layer", 'PARTITION BY "set", layer')


@query(f"WITH {sql.cases()}, {_SETS}, {_SET_CANDIDATES}, {_SET_SKYLINE} SELECT \"set\", 'best-mse' AS mode, {_LAYERED} FROM skyline QUALIFY row_number() OVER (PARTITION BY \"set\", layer ORDER BY mean_mse, storage_bytes, mean_cosine DESC, key_bits, value_bits, top_k) = 1")
def profile_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for all cases, and one for each of two positions, in one plan."""
    return _nine(allocation.select_sets(cases(spark, sf_dir), "last, all, start"), _TEN)


# A model's layers, runs, requests


_LAYERS = [LayerProfile(0, 10, DIM, 3, 2, 5, 100, 7), LayerProfile(1, 10, DIM, 3, 4, 5, 0, 8)]
_HEAD = _LAYERS[1].specs(2)[0]


@query(f"WITH {sql.sketched(_HEAD)} SELECT k.id, CAST(row_number() OVER (ORDER BY k.id) - 1 AS INT) AS slot, {sql.packed_hex('k.cells', DIM, 2)} AS mse, {sql.packed_hex('k.signs', DIM, 1)} AS signs, round(k.res_norm, 6) AS res_norm FROM sketched k JOIN coded c USING (id) WHERE c.label = 7")
def model_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a model's cache of two layers and five key/value heads (labels), and one head of one layer looked up: quantisers follow from the head's seed."""
    rows = vectors(spark, sf_dir).select(F.floor(F.col("label") / 5).cast("int").alias("layer"), (F.col("label") % 5).cast("int").alias("kv_head"), F.col("v").alias("key"), F.col("v").alias("value"), "id")
    cache = ModelCache.create(spark, shared_folder(spark), _LAYERS)
    cache.append(rows, ["id"])
    place = rows.select("layer", "kv_head", "id", (F.row_number().over(Window.partitionBy("layer", "kv_head").orderBy("id")) - 1).cast("int").alias("slot"))
    found = cache.layer(1, 2).join(place, ["layer", "kv_head", "slot"])
    return found.select("id", "slot", *(F.lower(F.hex(x)).alias(x) for x in ("mse", "signs")), F.round(F.col("res_norm").cast("double"), 6).alias("res_norm"))


_SIZES = {p.layer: p for p in _LAYERS}


@query(f"""WITH pages AS (SELECT CAST(label // 5 AS INT) AS layer, CAST(label % 5 AS INT) AS kv_head, count(*) AS n FROM embeddings GROUP BY ALL),
sized AS (SELECT *, n * CASE layer WHEN 0 THEN {_SIZES[0].entry_bytes} ELSE {_SIZES[1].entry_bytes} END AS live, greatest(n, CASE layer WHEN 0 THEN 100 ELSE 0 END) * CASE layer WHEN 0 THEN {_SIZES[0].entry_bytes} ELSE {_SIZES[1].entry_bytes} END AS room FROM pages)
SELECT layer, kv_head, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(live) AS BIGINT) AS live_bytes, CAST(sum(room) AS BIGINT) AS storage_bytes, CAST(sum(n) * {8 * DIM} AS BIGINT) AS raw_bytes FROM sized GROUP BY ROLLUP (layer, kv_head)""")
def model_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select(F.floor(F.col("label") / 5).cast("int").alias("layer"), (F.col("label") % 5).cast("int").alias("kv_head"), F.col("v").alias("key"), F.col("v").alias("value"), "id")
    cache = ModelCache.create(spark, shared_folder(spark), _LAYERS)
    for part in (rows.where("id % 2 = 0"), rows.where("id % 2 = 1")):
        cache.append(part, ["id"])
    return cache.sizes()


_RUNS = "SELECT sample AS \"group\", layer, tokens, raw_bytes AS raw_fp32, raw_bytes // 2 AS raw_fp16, storage_bytes - 512 AS live_bytes, storage_bytes, output_mse * 10 AS append_ms, CAST(1 + key_bits AS DOUBLE) AS attention_ms FROM cases"
_RATE = "CASE WHEN {ms} > 0 AND {n} > 0 THEN {n} * 1000.0 / {ms} ELSE 0 END"
_SAVED = ["compression_vs_fp32", "compression_vs_fp16"]
_RUN_MEANS = ["raw_fp32", "raw_fp16", "live_bytes", "storage_bytes", "append_ms", "attention_ms"]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select(
        F.col("sample").alias("group"), "layer", "tokens", F.col("raw_bytes").alias("raw_fp32"), F.floor(F.col("raw_bytes") / 2).alias("raw_fp16"), (F.col("storage_bytes") - 512).alias("live_bytes"), "storage_bytes",
        (F.col("output_mse") * 10).alias("append_ms"), (1 + F.col("key_bits")).cast("double").alias("attention_ms"),
    )


def _mean_sql(names: list[str]) -> str:
    return ", ".join(f"avg(CAST({x} AS DOUBLE)) AS mean_{x.replace('_bytes', '') + '_bytes' if x.endswith('_bytes') else x}" for x in names)


_SIX = lambda df: df.withColumns({x: F.round(x, 6) for x, kind in df.dtypes if kind == "double"})


def _six_sql(inner: str, plain: list[str], names: list[str]) -> str:
    saved = ", ".join(f"round(mean_raw_{x} / mean_live_bytes, 6) AS compression_vs_{x}" for x in ("fp32", "fp16"))
    return f"SELECT {', '.join([*plain, *(f'round({x}, 6) AS {x}' for x in names)])}, {saved} FROM ({inner})"


_MEAN_NAMES = ["mean_raw_fp32", "mean_raw_fp16", "mean_live_bytes", "mean_storage_bytes", "mean_append_ms", "mean_attention_ms"]


@query(f"WITH {sql.cases()}, runs AS ({_RUNS}) " + _six_sql(f"SELECT layer, count(*) AS runs, avg(tokens) AS mean_tokens, {_mean_sql(_RUN_MEANS)}, avg({_RATE.format(n='tokens', ms='append_ms')}) AS mean_tokens_per_s, avg({_RATE.format(n='1', ms='attention_ms')}) AS mean_queries_per_s FROM runs GROUP BY layer", ["layer", "runs"], ["mean_tokens", *_MEAN_NAMES, "mean_tokens_per_s", "mean_queries_per_s"]))
def layer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _SIX(accumulate.layer_summaries(_runs(spark, sf_dir)))


@query(f"WITH {sql.cases()}, runs AS ({_RUNS}), grouped AS (SELECT \"group\", count(*) AS layers, sum(tokens) AS tokens, {', '.join(f'sum({x}) AS {x}' for x in _RUN_MEANS)}, sum(append_ms) + sum(attention_ms) AS total_ms FROM runs GROUP BY \"group\") " + _six_sql(f"SELECT count(*) AS runs, CAST(sum(layers) AS BIGINT) AS layer_runs, {_mean_sql([*_RUN_MEANS, 'total_ms'])}, avg({_RATE.format(n='tokens', ms='append_ms')}) AS mean_tokens_per_s, avg({_RATE.format(n='layers', ms='attention_ms')}) AS mean_queries_per_s, avg({_RATE.format(n='1', ms='total_ms')}) AS mean_groups_per_s FROM grouped", ["runs", "layer_runs"], [*_MEAN_NAMES, "mean_total_ms", "mean_tokens_per_s", "mean_queries_per_s", "mean_groups_per_s"]))
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _SIX(accumulate.run_summary(_runs(spark, sf_dir)))


@query("""WITH t AS (SELECT role, CAST(length(text) AS DOUBLE) AS ms, length(text) AS chars, turn % 7 <> 3 AS fine FROM conversations)
SELECT role, count(*) FILTER (fine) AS ok, count(*) FILTER (NOT fine) AS failed, sum(ms) AS total_ms, round(avg(ms), 6) AS mean_ms, CAST(coalesce(sum(chars) FILTER (fine), 0) AS BIGINT) AS assistant_chars,
list_sort(list(ms) FILTER (fine))[CAST(floor((count(*) FILTER (fine) - 1) * 0.5) AS INT) + 1] AS p50_ms, list_sort(list(ms) FILTER (fine))[CAST(floor((count(*) FILTER (fine) - 1) * 0.95) AS INT) + 1] AS p95_ms FROM t GROUP BY role""")
def turn_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers of a run: their length is the time, each seventh one failed."""
    rows = table(spark, sf_dir, "conversations").select("role", F.length("text").cast("double").alias("duration_ms"), F.length("text").cast("long").alias("assistant_chars"), F.when(F.col("turn") % 7 == 3, "failed").alias("error"))
    return accumulate.turn_summaries(rows, ["role"]).withColumn("mean_ms", F.round("mean_ms", 6))


@query("""WITH r AS (SELECT event_id, CASE WHEN user_id % 9 = 8 THEN ' ' ELSE 'm' || (user_id % 9) END AS model FROM events), routes AS (SELECT 'm' || n_nationkey AS model, 'r' || n_regionkey AS backend, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS backend_model FROM nation WHERE n_nationkey < 7), backends AS (SELECT 'r' || r_regionkey AS backend FROM region WHERE r_regionkey <> 1)
SELECT event_id, r.model, CASE WHEN b.backend IS NOT NULL THEN o.backend END AS backend, CASE WHEN b.backend IS NOT NULL THEN coalesce(o.backend_model, r.model) END AS backend_model,
CASE WHEN trim(r.model) = '' THEN 'a model is required' WHEN o.model IS NULL THEN 'unknown model "' || r.model || '"' WHEN b.backend IS NULL THEN 'backend "' || o.backend || '" is unavailable' END AS route_error
FROM r LEFT JOIN routes o ON o.model = r.model LEFT JOIN backends b ON b.backend = o.backend""")
def request_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of a model; nations are the routes, regions the backends."""
    e = table(spark, sf_dir, "events")
    asked = e.select("event_id", F.when(F.col("user_id") % 9 == 8, " ").otherwise(F.concat(F.lit("m"), (F.col("user_id") % 9).cast("string"))).alias("model"))
    routes = table(spark, sf_dir, "nation").where("n_nationkey < 7").select(F.concat(F.lit("m"), "n_nationkey").alias("model"), F.concat(F.lit("r"), "n_regionkey").alias("backend"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("backend_model"))
    backends = table(spark, sf_dir, "region").where("r_regionkey <> 1").select(F.concat(F.lit("r"), "r_regionkey").alias("backend"))
    return requests.routed(asked, routes, backends)


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS began, event_type AS endpoint, 'server' AS backend, CAST(200 + 100 * (user_id % 4) AS INT) AS status, count(*) AS requests FROM events GROUP BY ALL")
def request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by hours and outcomes."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("endpoint"), F.lit(" ").alias("backend"), (200 + 100 * (F.col("user_id") % 4)).cast("int").alias("status"))
    return requests.windows(e, "1 hour").withColumn("began", F.unix_seconds("began"))
