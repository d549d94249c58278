"""Operators 11 to 13 against brute force, exact arithmetic and held-out accuracy, and their defined cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vecspark.llm import language, periodic, whitening
from vecspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(words, least=6, times=4):
    """Each period for itself; a stretch counts for its smallest one."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > a and i - a + q >= max(least, times * q):
                out.setdefault((a, i - a + q), q)
            i += 1
    return sorted((a, length, q) for (a, length), q in out.items())


def plain_op11(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for a, length, q in found for i in range(a + q, a + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    lines = "".join(f"{a},{length},{q}\n" for a, length, q in found)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


RUNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("seed", range(4))
def test_maximal_runs(seed):
    rng = random.Random(seed)
    for _ in range(300):
        n, k = rng.randrange(0, 80), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5 and n > 4:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3 + 1))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        least, times = rng.choice([2, 6]), rng.choice([2, 3, 4])
        got = periodic.maximal_runs(np.array(w, np.uint64), periodic.Settings(least, times, rng.choice([5, 1 << 19])))
        assert [tuple(map(int, x)) for x in zip(*got)] == sorted(plain_runs(w, least, times), key=lambda r: (r[0], r[2]))


def test_long_texts_of_one_word_and_of_one_period():
    one = periodic.maximal_runs(np.zeros(200_000, np.uint64))
    assert [x.tolist() for x in one] == [[0], [200_000], [1]]
    period = np.random.default_rng(1).integers(0, 50, 900).astype(np.uint64)
    start, length, q = periodic.maximal_runs(np.tile(period, 120))
    assert (0, 108_000, 900) in set(zip(start.tolist(), length.tolist(), q.tolist()))
    with pytest.raises(ValueError):
        periodic.Settings(times=1)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "x " * 700, "a b " * 3, "a b " * 4, "é x " * 9 + "tail", "\x1c \x1c " * 8, "ab c\n" * 40 + "end " * 7]
    texts += [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = [(i, t, "b", 3, "r") for i, t in enumerate(texts)] + [(5, "k l m " * 5, "b", 3, "r"), (None, "n " * 30, "b", 3, "r"), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, runs string, words int, row string").repartition(3).cache()


def test_periodic_defined_cases(docs, spark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op11_periodic"](spark, str(tmp_path)).select(*RUNS).collect()]
    assert sorted(got, key=str) == sorted((plain_op11(r.doc_id, r.text) for r in docs.collect()), key=str)
    out = periodic.collapse(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.where("doc_id between 4 and 9 and doc_id <> 5").collect()}
    assert texts[4] == "x" and texts[6] == "a b" and texts[8] == "\x1c" and out.where("text is null").count() == 2
    assert periodic.runs(docs.where("false")).count() == 0


def test_op11_whole_table(spark, sf):
    table = pd.read_parquet(f"{sf}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op11_periodic"](spark, sf).select(*RUNS).collect())
    want = sorted(plain_op11(d, t) for d, t in zip(table.doc_id.tolist(), table.text) if len(t) < 8000)
    assert len(got) == len(table) and set(want) <= set(got)


def exact_covariance(x):
    rows = [list(map(int, r)) for r in x]
    n, sums = len(rows), [sum(c) for c in zip(*rows)]
    y = [[n * v - s for v, s in zip(r, sums)] for r in rows]
    return y, [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(len(sums))] for i in range(len(sums))]


def test_products_of_digits_are_exact():
    rng = np.random.default_rng(3)
    for bits in (3, 25, 62, 90):
        y = np.array([[int(rng.integers(-(1 << 31), 1 << 31)) << max(bits - 31, 0) | int(rng.integers(0, 1 << 20)) for _ in range(3)] for _ in range(9000)], object)
        own = whitening.digits(y)
        assert (whitening.product(own, own, (3, 3)) == y.T.dot(y)).all()


def test_components_of_any_scale():
    rng = np.random.default_rng(4)
    x = np.floor(256 * (rng.normal(size=(300, 6)) * 10.0 ** np.array([10, 4, 0, 0, -1, -1]) + 1e7)).astype(np.int64)
    n, sums = len(x), np.array([sum(map(int, c)) for c in x.T], object)
    y = whitening.centred(x, n, sums)
    d = whitening.digits(y)
    c = whitening.Components.of(n, sums, whitening.product(d, d, (6, 6)), whitening.Settings(components=6))
    v = exact_covariance(x)[1]
    trace, w = sum(v[i][i] for i in range(6)), c.whitened(y)
    for k in range(6):  # V u = e u, in exact arithmetic
        u = [Fraction(float(a)) for a in c.vectors[:, k]]
        e = sum(u[i] * v[i][j] * u[j] for i in range(6) for j in range(6))
        assert k < 1 or c.explained[k] <= c.explained[k - 1]
        assert abs(c.roots[k] ** 2 / float(trace) / c.explained[k] - 1) < 1e-12
        assert k > 0 or abs(float(e / trace) - c.explained[k]) < 1e-12
    assert np.abs(w.T @ w / n - np.eye(6)).max() < 1e-6


VECTORS = [
    (1, [1.5, -2.0, 0.25]), (2, [0.5, 1.0, -0.75]), (2, [0.5, 1.0, -0.75]), (3, [0.5, 1.0, -0.7499]), (None, [3.0, 0.1, 0.2]), (4, None), (5, [1.0, None, 2.0]), (6, [1.0, float("nan"), 2.0]),
    (7, [float("inf"), 0.0, 0.0]), (8, [0.0, 0.0, 0.0]), (9, []), (10, [1e6, 2e6, -3e6]), (11, [7.0]), (12, [7.0]), (13, [7.5, 1.0]), (14, [-7.5, 2.0]),
]


def test_whitening_defined_cases(spark):
    rows = spark.createDataFrame([(i, v, "x", 1) for i, v in VECTORS], "vec_id long, embedding array<double>, x string, component int").repartition(3)
    out = whitening.whiten(rows)
    got = out.select("row.vec_id", F.col("row.embedding").alias("v"), F.col("row.x").alias("own"), "component", "n", "deviation", "whitened", "explained", "identity_error").toPandas()
    assert set(got.own) == {"x"} and 9 not in set(got.vec_id)
    three = got[got.v.map(len) == 3]
    assert sorted(three.vec_id.dropna().astype(int)) == sorted([1, 2, 2, 3, 8, 10] * 3) and three.vec_id.isna().sum() == 3
    x = sorted({tuple(int(np.floor(256 * c)) for c in v) for v in three.v})
    y, v = exact_covariance(x)
    assert set(three.n) == {len(x)}
    deviation = {a: sum(c * c for c in b) for a, b in zip(x, y)}
    assert all(int(d) == deviation[tuple(int(np.floor(256 * c)) for c in e)] for d, e in zip(three.deviation, three.v))
    share = three.groupby("component").explained.first().to_numpy()
    (a, b, c), (_, d, f), (_, _, g) = v  # the eigenvalues' sum, sum of products of two, and product, exactly
    trace, pairs, product = a + d + g, a * d - b * b + a * g - c * c + d * g - f * f, a * (d * g - f * f) - b * (b * g - c * f) + c * (b * f - c * d)
    assert abs(share.sum() - 1) < 1e-15 and abs(share[0] * (share[1] + share[2]) + share[1] * share[2] - float(pairs / trace**2)) < 1e-9 * share[1]
    assert abs(share.prod() / float(product / trace**3) - 1) < 1e-9
    assert three.identity_error.max() < 1e-4
    one = got[got.v.map(len) == 1]  # one distinct vector: nothing varies
    assert len(one) == 2 and set(one.n) == {1} and one.whitened.isna().all() and one.explained.isna().all() and one.identity_error.isna().all()
    two = got[got.v.map(len) == 2].sort_values(["vec_id", "component"])  # two vectors: the second component has no variance
    assert np.allclose(np.abs(two[two.component == 1].whitened), 1) and two[two.component == 2].whitened.isna().all()
    assert two[two.component == 2].explained.tolist() == [0, 0] and two.identity_error.max() < 1e-9
    assert whitening.whiten(rows.where("false")).count() == 0


def test_op12_whole_table(spark, sf):
    table = pd.read_parquet(f"{sf}/embeddings.parquet").set_index("vec_id")
    got = QUERIES["op12_whitening"](spark, sf).toPandas()
    x = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, v in table.embedding.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    assert len(got) == 4 * len(table) and set(got.n) == {n}
    assert all(d == int(((n * x[i] - sums) ** 2).sum()) for i, d in zip(got.vec_id, got.deviation))
    c = (fit - sums / n).T @ (fit - sums / n) / n
    e, u = np.linalg.eigh(c)
    e, u = e[::-1], u[:, ::-1]
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    want = np.array([x[i] - sums / n for i in wide.index]) @ u[:, :4] / np.sqrt(e[:4])
    sign = np.sign((wide.to_numpy() * want).sum(axis=0))
    assert np.abs(wide.to_numpy() - sign * want).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), e[:4] / e.sum(), rtol=1e-9) and got.identity_error.max() < 1e-9


def plain_features(text, s):
    text = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
    return [text[i : i + n] for n in range(1, s.order + 1) for i in range(len(text) - n + 1) if text[i : i + n].strip()]


def test_features():
    s = language.Settings()
    texts = ["", "a", "Abba  ABBA!", "12 --", "Ünïcode 日本 x", "İstanbul ǅ", None or "", "a\n\nb c"]
    row, slot, count = language.counted(texts, s)
    for k, t in enumerate(texts):
        own = pd.Series(plain_features(t, s), dtype=object).value_counts()
        assert sorted(count[row == k]) == sorted(own), t
        assert len(np.unique(slot[row == k])) == (row == k).sum()
    assert language.counted([], s)[0].size == 0
    many = ["ab"] * 40_000  # more rows than 32 bits of keys hold
    row, _, count = language.counted(many, s)
    assert (np.bincount(row) == 7).all() and (count == 1).all()


def test_language_held_out(spark, sf):
    table = pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id", "lang", "text"])
    got = QUERIES["op13_language_id"](spark, sf).toPandas().merge(table, on="doc_id")
    assert len(got) == len(table) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert not set(got.lang_pred) - set(table.lang) - {"und"}
    sure = held[held.score > 0.9]
    assert len(sure) > 0.8 * len(held) and (sure.lang == sure.lang_pred).mean() > 0.98


def test_language_defined_cases(spark):
    rng = random.Random(2)
    text = lambda k: " ".join("".join(rng.choice(k) for _ in range(5)) for _ in range(30))
    rows = [(i, text("abcde" if i % 2 else "vwxyz"), "p" if i % 2 else "q", "m", "n", 1) for i in range(80)]
    rows += [(100, None, "p", "m", "n", 1), (101, "", "p", "m", "n", 1), (102, "12 %% 3", "q", "m", "n", 1), (103, text("abcde"), None, "m", "n", 1), (None, text("vwxyz"), None, "m", "n", 1), (3, text("vwxyz") * 300, None, "m", "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, lang_pred string, score int").repartition(3)
    model = language.train(docs)
    assert model.languages == ["p", "q"] and (np.abs(model.weights).max(axis=0) > 0).all() and len(model.weights) < 2000
    got = language.identify(docs, model).select("row.doc_id", "row.row", "lang_pred", "score").collect()
    assert {r.row for r in got} == {"m"} and len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert all(of[i] == [("und", 0.0)] for i in (100, 101, 102)) and of[103][0][0] == "p" and of[None][0][0] == "q"
    assert sorted(x[0] for x in of[3]) == ["p", "q"]
    only = language.train(docs.where("lang = 'q'"))
    assert {(r.lang_pred, r.score) for r in language.identify(docs, only).select("lang_pred", "score").collect()} == {("q", 1.0), ("und", 0.0)}
    assert language.train(docs.where("lang is null")) is None and language.train(docs.where("false")) is None
    assert {(r.lang_pred, r.score) for r in language.identify(docs, None).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert language.identify(docs.where("false"), model).count() == 0


def test_leader_against_a_plain_loop():
    """FTRL-proximal written out for each coordinate."""
    rng, s = np.random.default_rng(6), language.Settings(features=12)
    leader, z, n = language.Leader(3, s), np.zeros((13, 3)), np.zeros((13, 3))
    for _ in range(60):
        at = np.append(np.sort(rng.choice(12, 4, replace=False)), 12)
        x, y = np.append(rng.random(4), 1.0), int(rng.integers(3))
        w = np.zeros((5, 3))
        for a, i in enumerate(at):
            for k in range(3):
                l1, l2 = (0, 0) if i == 12 else (s.l1, s.l2)
                if abs(z[i, k]) > l1:
                    w[a, k] = -(z[i, k] - np.sign(z[i, k]) * l1) / ((s.beta + np.sqrt(n[i, k])) / s.alpha + l2)
        p = np.exp(x @ w) / np.exp(x @ w).sum()
        for a, i in enumerate(at):
            for k in range(3):
                g = x[a] * (p[k] - (k == y))
                z[i, k] += g - (np.sqrt(n[i, k] + g * g) - np.sqrt(n[i, k])) / s.alpha * w[a, k]
                n[i, k] += g * g
        leader.learn(at, x, y)
    assert np.allclose(leader.z, z) and np.allclose(leader.n, n) and (leader.weights(np.arange(12)) == 0).any()
