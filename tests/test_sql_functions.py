"""Functions and table functions called from SQL, and scoring by look-up tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import codes, registered
from vecspark.functions.spec import ProductSpec, QuantizerSpec
from vecspark.operators import search, turns


@pytest.fixture(scope="module")
def sql(spark):
    return registered.register(spark).sql


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    df.createOrReplaceTempView("vecs")
    return df


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5, 8])
@pytest.mark.parametrize("queries", [0, 1, 3, 40])
def test_scores_by_lookup(bits, queries):
    rng = np.random.default_rng(bits)
    spec, q = QuantizerSpec(20, bits).solved(), rng.normal(size=(queries, 20))
    cells, norms = codes.indices(rng.normal(size=(700, 20)), spec)
    packed, want = codes.pack(cells, bits), codes.scores(cells, norms, q, spec)
    assert np.abs(codes.packed_scores(packed, norms, q, spec) - want).max(initial=0) < 1e-12
    sums = codes.byte_sums(spec.rotate(q), spec.centroids, bits)
    assert (sums is None) == (8 % bits > 0)
    if sums is not None:
        assert np.abs(norms[:, None] * codes.looked_up(packed, sums) - want).max(initial=0) < 1e-12
    if bits > 1:
        inner = ProductSpec(20, bits).solved()
        cells, signs, left = codes.encode_product(rng.normal(size=(90, 20)), inner)
        got = codes.packed_product_scores(codes.pack(cells, bits - 1), codes.pack(signs, 1), left, q, inner)
        assert np.abs(got - codes.product_scores(cells, signs, left, q, inner)).max(initial=0) < 1e-12


def test_code_functions(sql, vecs):
    r = sql("SELECT id, v, c.packed, c.norm, vq_dequantize(c.packed, c.norm, 24, 4, 7) AS again, vq_score(c.packed, c.norm, v, 4, 7) AS own, vq_unpack(c.packed, 24, 4) AS cells, vq_pack(vq_unpack(c.packed, 24, 4), 4) AS packed_again FROM (SELECT id, v, vq_quantize(v, 4, 7) AS c FROM vecs)").toPandas()
    spec, x = QuantizerSpec(24, 4, 7), np.stack(r.v)
    cells, norm = codes.indices(x, spec)
    assert (np.stack(r.cells) == cells).all() and (r.packed == r.packed_again).all() and np.allclose(r.norm, norm)
    again = codes.reconstruct(cells, spec) * norm[:, None]
    assert np.allclose(np.stack(r.again), again) and np.allclose(r.own, (again * x).sum(axis=1), atol=1e-6)


def test_settings_may_differ_by_row(sql, vecs):
    r = sql("SELECT v, bits, vq_quantize(v, bits, seed) AS c FROM (SELECT v, CAST(1 + id % 3 AS INT) AS bits, id % 2 AS seed, id FROM vecs) ORDER BY id").toPandas()
    for i in range(12):
        cells, norm = codes.indices(np.array([r.v[i]]), QuantizerSpec(24, int(r.bits[i]), i % 2))
        assert r.c[i]["packed"] == codes.pack(cells, int(r.bits[i]))[0].tobytes()


def test_nulls_in_code_functions(sql):
    rows = "VALUES (array(1D, 2D, 3D)), (CAST(NULL AS ARRAY<DOUBLE>)), (array(1D, NULL, 3D)), (array(4D, 5D)) AS t(v)"
    r = sql(f"SELECT vq_quantize(v, 2, 1) AS c, vq_quantize_product(v, 3, 1) AS p, vq_score(unhex('00'), 1F, v, 2, 1) AS s FROM {rows}").collect()
    assert [x.c is None for x in r] == [False, True, True, False] == [x.p is None for x in r] and [x.s is None for x in r] == [False, True, True, False]
    r = sql("SELECT vq_unpack(NULL, 4, 2) AS a, vq_pack(NULL, 2) AS b, vq_from_wire(NULL) AS c, vq_text_vector(NULL, 0, 8) AS d, vq_quantize_product(array(1D, 2D), 3, 0) AS e WHERE 1 = 1").first()
    assert r.a is None and r.b is None and r.c is None and len(r.d) == 8 and len(r.e.mse) == 1
    assert sql(f"SELECT vq_quantize(v, 2, 1) AS c FROM {rows} WHERE size(v) > 9").count() == 0
    with pytest.raises(Exception, match="a cell is not from 0 to 3"):
        sql("SELECT vq_pack(array(1, 4), 2)").collect()


def test_wire_and_text_functions(sql, vecs, spark):
    assert sql("SELECT count_if(w.packed = c.packed AND w.norm = c.norm AND w.dim = 24 AND w.bits = 2) AS n FROM (SELECT c, vq_from_wire(vq_wire(c.packed, c.norm, 24, 2)) AS w FROM (SELECT vq_quantize(v, 2, 1) AS c FROM vecs))").first().n == 300
    text = spark.createDataFrame([("A b, c", 0), ("", 1), ("..", 2), (None, 3)], "text string, turn int")
    want = {r.turn: r.v for r in turns.text_vectors(text, 16).collect()}
    text.createOrReplaceTempView("some_text")
    assert {r.turn: r.v for r in sql("SELECT turn, vq_text_vector(text, turn, 16) AS v FROM some_text").collect()} == want


RANKED = "SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vq_search(TABLE({t}), {q}, 5, {b}, 42)) WHERE rank <= 5"


def test_search_from_sql(sql, vecs, spark):
    asked = vecs.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    registered.query_set(spark, "asked", asked, 24)
    few = "(SELECT collect_list(struct(id, v)) FROM vecs WHERE id % 50 = 0)"
    sql("CREATE OR REPLACE TEMPORARY VIEW plain_codes AS SELECT id, c.* FROM (SELECT id, vq_quantize(v, 2, 42) AS c FROM vecs) UNION ALL SELECT 999, NULL, NULL")
    sql("CREATE OR REPLACE TEMPORARY VIEW inner_codes AS SELECT id, c.* FROM (SELECT id, vq_quantize_product(v, 3, 42) AS c FROM vecs)")
    for view, spec in (("plain_codes", QuantizerSpec(24, 2)), ("inner_codes", ProductSpec(24, 3))):
        want = sorted(map(tuple, search.QuantizedIndex.fit(vecs, spec).search(asked, 5).collect()))
        for q in (few, "'asked'"):
            assert sorted(map(tuple, sql(RANKED.format(t=view, q=q, b=spec.bits)).collect())) == want
    assert sql(RANKED.format(t="plain_codes", q="(SELECT collect_list(struct(id, v)) FROM vecs WHERE id < 0)", b=2)).count() == 0
    sql("CREATE OR REPLACE TEMPORARY VIEW no_codes AS SELECT * FROM plain_codes WHERE id < 0")
    assert sql(RANKED.format(t="no_codes", q="'asked'", b=2)).count() == 0
    with pytest.raises(Exception, match="there is no query set 'else'"):
        sql(RANKED.format(t="plain_codes", q="'else'", b=2)).collect()
    with pytest.raises(ValueError, match="is not broadcast"):
        registered.query_set(spark, "more", asked, 1 << 22)


def test_grid_and_layers(sql):
    got = [tuple(r) for r in sql("SELECT * FROM vq_config_grid('primary, uniform', '2,3', '2', '0,16,0')").collect()]
    assert len(got) == 8 and got[0] == ("primary", 2, 2, 0) and got[-1] == ("uniform", 3, 2, 16)
    for bad, text in (("'x', '2', '2', '0'", "unknown method"), ("'primary', '9', '2', '0'", "9 is not from 2 to 8"), ("'primary', 'a', '2', '0'", "no list of int"), ("'primary', '2', '2', '-1'", "-1 is not from 0")):
        with pytest.raises(Exception, match=text):
            sql(f"SELECT * FROM vq_config_grid({bad})")
    assert [tuple(r) for r in sql("SELECT * FROM vq_layers('spread:3', 32)").collect()] == [(0, 0), (16, 1), (31, 2)]
    assert [r.layer for r in sql("SELECT * FROM vq_layers('-1,0', 4)").collect()] == [3, 0]
