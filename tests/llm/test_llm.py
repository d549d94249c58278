"""The dealt operators against brute-force versions, and their defined cases on small tables."""

import base64
import hashlib
import io
import random
import re
import tarfile
import zlib
from collections import Counter
from math import log10

import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecspark.llm import bpe, elias_fano, lm_scoring, media, near_dedup, nearest, packing, quality, substring_dedup, token_counts, token_files, tokens
from vecspark.llm import words as words_
from vecspark.llm.common import shared_folder
from vecspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
JSON = P.path("byte_bpe_50k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def words(text):
    return WORD.findall(text or "")


def tokenizer():
    return Tokenizer.from_file(JSON)


def ids_of(texts):
    return [x.ids for x in tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def le(ids):
    return np.array(ids, "<u4").tobytes()


def noise(seed, n, vocabulary=5000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


BASE, OTHER = noise(1, 400), noise(2, 300)
ROWS = [
    (1, BASE, "s"),
    (2, BASE, "s"),
    (3, BASE.replace(" ", "\n", 3), "s"),
    (4, BASE + " tail of four words", None),
    (5, OTHER, "t"),
    (6, None, "t"),
    (7, "", None),
    (8, " \t\n", "t"),
    (9, "one", "t"),
    (10, "Ünïcode 日本語 😀 it's  we'll\r\n\x1c x²", "t"),
    (11, noise(3, 60) + " " + " ".join(OTHER.split()[100:180]) + " " + noise(4, 60), "t"),
    (11, "a row that repeats an id", "t"),
    (None, OTHER, "t"),
    (12, noise(5, 30000), "t"),
    (13, "x " * 500, "t"),
    (14, "x " * 500, "t"),
    (15, "a  <|endoftext|> b<|endoftext|><|endof", "t"),
    (16, "y" * 3000 + " " + "é" * 300, "t"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(i, t, s, "a", 1, "b") for i, t, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mark string, bucket int, row string").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def table(sf):
    return pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


# 1


def grouped(rows):
    """Plain connected components of weighted similarity over all pairs; document frequencies by the operator's slots."""
    n, features, damping = len(rows), near_dedup.Settings().features, near_dedup.Settings().damping
    slot, bags = {}, []
    for _, t in rows:
        w = words(t)
        own = [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))]
        slot.update(zip(own, near_dedup.slot(near_dedup.runs(words_.words_of(pa.array([t or ""])), 5)[1], features).tolist()))
        bags.append(Counter(own))
    df = Counter(x for bag in bags for x in {slot[k] for k in bag})
    bags = [{k: (1 + np.log(c)) * (1 + damping * np.log((1 + n) / (1 + df[slot[k]])) / np.log(1 + features)) for k, c in bag.items()} for bag in bags]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            keys = bags[i].keys() | bags[j].keys()
            least = sum(min(bags[i].get(k, 0), bags[j].get(k, 0)) for k in bags[i].keys() & bags[j].keys())
            most = sum(max(bags[i].get(k, 0), bags[j].get(k, 0)) for k in keys)
            if (not keys or least / most >= 0.8) and find(i) != find(j):
                root[find(i)] = find(j)
    out = {}
    for i, row in enumerate(rows):
        out.setdefault(find(i), []).append(row)
    return list(out.values())


def classes(rows):
    """(doc_id, class_id) and how often, of all rows."""
    return sorted(Counter((d, min((x for x, _ in group if x is not None), default=None)) for group in grouped(rows) for d, _ in group).items(), key=str)


def kept_of(rows):
    """Of each class, as a list of (doc_id, text), the row that stays."""
    return sorted(str(min((d for d, _ in own if d is not None), default=None)) for own in grouped(rows))


def test_near_dedup_defined_cases(docs, none):
    got = near_dedup.near_duplicates(docs).select("doc_id", "class_id").collect()
    assert sorted(Counter(map(tuple, got)).items(), key=str) == classes([(i, t) for i, t, _ in ROWS])
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == kept_of([(i, t) for i, t, _ in ROWS]) == sorted(map(str, [1, 5, 6, 9, 10, 11, 11, 12, 13, 15, 16]))
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.keep_one(none).count() == 0


def test_one_of_each_class_stays_whatever_its_ids(spark):
    rows = [(7, "first text of this id"), (7, "quite another one with it"), (7, "first text of this id"), (8, "first text of this id"), (None, "only here"), (None, "only here"), (None, "quite another one with it"), (None, None), (9, "")]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(7, "first text of this id"), (7, "quite another one with it"), (None, "only here"), (9, "")]))


def test_near_dedup_with_columns_of_its_own_names(spark):
    names = ["row", "mark", "n", "root", "class_id", "k", "none", "fingerprint", "_of", "_id", "_mark", "id"]
    rows = [(1, "same text here", *range(12)), (2, "same text here", *range(12)), (3, "another", *range(12))]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_recall_by_edit_strength(spark, table):
    """Copies with a share of their words replaced: similar ones are found, others are left alone."""
    rng, rows, strengths = random.Random(12), list(zip(table.doc_id.tolist(), table.text.tolist())), (0.005, 0.01, 0.02, 0.08)
    base = [(d, t) for d, t in rows if 60 <= len(words(t)) <= 2000][:40]
    planted = []
    for k, strength in enumerate(strengths):
        for d, t in base:
            w = words(t)
            for i in rng.sample(range(len(w)), max(1, round(strength * len(w)))):
                w[i] = f"new{rng.randrange(10**6)}"
            planted.append((d + (k + 1) * 10**6, " ".join(w)))
    root = {r.doc_id: r.root for r in near_dedup.near_duplicates(spark.createDataFrame(rows + planted, "doc_id long, text string")).collect()}
    found = [np.mean([root[d] == root[d + (k + 1) * 10**6] for d, _ in base]) for k in range(4)]
    assert found[0] >= 0.95 and found[1] >= 0.9 and found[3] <= 0.1, found


def test_near_dedup_query(spark, sf, table):
    got = {r.doc_id: r.class_id for r in QUERIES["op1_near_dedup"](spark, sf).collect()}
    want = dict(k for k, _ in classes(list(zip(table.doc_id, table.text))))
    assert got == want


def test_chains_and_a_large_group(spark):
    base = noise(9, 120).split()
    rows = [(i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :])) for i in range(100)]
    at = base[:]
    for i in range(30):  # neighbours are similar, the ends are not
        at = at[:]
        at[4 * i] = f"chain{i}"
        rows.append((1000 + i, " ".join(at)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_samples_estimate_similarity():
    rng = np.random.default_rng(3)
    keys, w = np.sort(rng.integers(0, 1 << 63, 400).astype(np.uint64)), rng.uniform(1, 9, 400)
    v = w * np.where(rng.random(400) < 0.3, rng.uniform(0.2, 3, 400), 1)
    sample = near_dedup.Sampler(1024, 5)(np.repeat([0, 1], 400), np.tile(keys, 2), np.concatenate((w, v)), 2)
    assert abs((sample[0] == sample[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.06


# 2


def check_packed(rows, got, capacity):
    pieces = got.sort_values(["doc_id", "start"])
    for (i, ids), (_, own) in zip(sorted(rows), pieces.groupby("doc_id", sort=True)):
        at = 0
        for p in own.itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(le(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        at = 0
        for p in own.itertuples():
            assert p.offset == at
            at += p.length
        assert at <= capacity


def test_packing_query(spark, sf, table):
    got = QUERIES["op2_packing"](spark, sf).toPandas()
    check_packed([(d, x + [0]) for d, x in zip(table.doc_id, ids_of(table.text))], got, 1024)
    filled = got.groupby("sequence_id")["length"].sum()
    assert filled.sum() / (1024 * len(filled)) > 0.97


def test_packing_defined_cases(docs, none):
    got = packing.pack(docs, JSON, carry=True).toPandas()
    assert got.length.sum() == sum(len(x) + 1 for x in ids_of([t for _, t, _ in ROWS]))
    assert (got.ids.map(len) == 4 * got.length).all() and got.doc_id.isna().sum() == 1 + len(ids_of([OTHER])[0]) // 1024
    assert packing.pack(none, JSON).count() == 0


def test_first_fit_decreasing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 57, 300):
        sizes = rng.integers(1, 100, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            room[b:] = room[b:] or [100]
            want[i] = (b, 100 - room[b])
            room[b] -= sizes[i]
        assert all((bins[i], offsets[i]) == want[i] for i in range(n))


# 3


def test_token_files_query(spark, sf, table):
    got = QUERIES["op3_token_files"](spark, sf).toPandas().set_index("doc_id")
    at = 0
    for d, ids in zip(table.doc_id, ids_of(table.text)):
        r = got.loc[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) + 1, zlib.crc32(le(ids + [2])))
        at += len(ids) + 1


def test_token_files_defined_cases(spark, docs, none):
    got = token_files.read_ids(token_files.write_ids(docs, JSON, shared_folder(spark))).orderBy("start").collect()
    want = sorted(Counter((d, tuple(x + [2])) for (d, _, _), x in zip(ROWS, ids_of([t for _, t, _ in ROWS]))).items(), key=str)
    assert sorted(Counter((r.doc_id, tuple(r.ids)) for r in got).items(), key=str) == want
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys) and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert token_files.read_ids(token_files.write_ids(none, JSON, shared_folder(spark))).count() == 0


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], list(range(0, 5000, 3)), [0, 1, 1 << 40], np.sort(np.random.default_rng(2).integers(0, 1 << 30, 3000)).tolist()])
def test_elias_fano(values):
    series, used = elias_fano.EliasFano.frombytes(elias_fano.EliasFano.of(np.array(values, np.uint64)).tobytes() + b"rest")
    assert series.select(np.arange(len(values))).tolist() == values
    if len(values) > 1000:
        bits = np.log2(values[-1] / len(values))
        assert 8 * used / len(values) < bits + 3


# 4


def test_bpe_query(spark, sf, table):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = QUERIES["op4_bpe"](spark, sf).toPandas().set_index("doc_id")
    for d, t in zip(table.doc_id, table.text):
        ids = plain.encode_ordinary(t)
        assert tuple(got.loc[d]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_bpe_defined_cases(docs, none):
    ranks = bpe.read_ranks(RANKS)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    want = sorted((str(d), plain.encode_ordinary(t or ""), (t or "").encode()) for d, t, _ in ROWS)
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in got) == want
    assert bpe.encode(none, RANKS, P.PATTERN).count() == 0


def test_bpe_on_noise():
    own, rng = bpe.bpe(RANKS, P.PATTERN), random.Random(4)
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for i in range(300):
        t = "".join(rng.choice("aàbß日 \n\t'rest12²½😀…\x85 ") for _ in range(rng.randrange(200)))
        ids = own.encode(pa.array([t]))[0].values.to_numpy()
        assert ids.tolist() == plain.encode_ordinary(t) and bpe.decoder(RANKS).decode(ids) == t.encode()
    assert own.piece("ab" * 3000) == plain.encode_ordinary("ab" * 3000)


def test_pieces_are_cut_as_by_the_pattern():
    rng, alphabet = random.Random(9), ["a", "b1", " ", "  ", "\n", "\t ", "\r\n", "é", "日本", "\u00a0", "\u2003 ", "\u3000", "\x85", "\x1c", "😀", "."]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(2000)] + [None, ""]
    got = tokens.cut(pa.array(texts))
    for i, t in enumerate(texts):
        assert [got.bytes(k).decode() for k in range(got.first[i], got.first[i + 1])] == tokens.PIECE.findall(t or "")


def test_ids_are_the_library_s_whatever_is_remembered():
    rng, own, t = random.Random(10), tokens.Pieces(JSON), tokenizer()
    own.known = tokens.Known(most=4000, longest=6)
    alphabet = ["a", "the ", " of", "\n\n", "<|endoftext|>", "  ", "\u00a0", "é", "12", "'ll", "x" * 40, " \t"]
    for _ in range(60):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 20))]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(pa.array(texts))] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert tokens.Known.ENTRY * len(own.known.h) + own.known.flat.nbytes <= 4000 and len(own.known.h)


# 5


@pytest.mark.parametrize("alphabet", [list(" \n\t'abrest1²,.é日"), ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "a", "<", "\n", "b1"]])
@pytest.mark.parametrize("leaf", [2, 64])
def test_edits_against_counting_anew(alphabet, leaf):
    c, t, rng = token_counts.counter(JSON, P.PATTERN), tokenizer(), random.Random(5)
    for k in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40 if k % 4 else 160)))
        doc = token_counts.Document(text, *c.split(pa.array([text]))[0], leaf=leaf)
        for _ in range(6):
            a = rng.randrange(len(text) + 2)
            b, new = a + rng.choice([0, 1, 5, 30]), "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 40])))
            want = text[: min(a, len(text))] + new + text[max(min(b, len(text)), min(a, len(text))) :]
            doc.edit(c, a, b, new)
            text, lengths, counts, sizes, chars, tree = doc.state()
            assert text == want and tree[1] == counts.sum() == len(t.encode(text, add_special_tokens=False).ids) and chars[1] == len(text)
            edges = np.append(0, np.cumsum(sizes))
            assert (tree == token_counts.tree_of(token_counts._sums(counts, edges))).all() and (chars == token_counts.tree_of(token_counts._sums(lengths, edges))).all()
            assert all((x == y).all() for x, y in zip(c.split(pa.array([text]))[0], (lengths, counts)))
            if rng.random() < 0.3:  # as read back from its row
                doc = token_counts.Document(*doc.state(), leaf=leaf)


def test_an_edit_touches_few_pretokens():
    c, text = token_counts.counter(JSON, P.PATTERN), noise(8, 20000)
    doc = token_counts.Document(text, *c.split(pa.array([text]))[0])
    assert max(doc.edit(c, at, at + 1, "some new words") for at in (0, 9, 30000, 60000, len(text))) < 30
    assert len(doc.own) < 12 and doc.blocks > 300


def test_token_counts_query(spark, sf, table):
    got = QUERIES["op5_token_counts"](spark, sf).toPandas().set_index("doc_id")
    edited = []
    for t in table.text:
        n, t = len(t), "Revised: " + t
        t = t[: n // 2] + t[n // 2 + 1 :]
        edited.append(t[: n + 5] + " (end)\n" + t[n + 9 :])
    for d, before, after, t in zip(table.doc_id, ids_of(table.text), ids_of(edited), edited):
        r = got.loc[d]
        assert (r.n_tokens, r.n_tokens_edited, r.edited_sha256) == (len(before), len(after), hashlib.sha256(t.encode()).hexdigest()) and r.n_encoded < 40


def test_token_counts_defined_cases(spark, docs, none):
    state = token_counts.count(docs, JSON, P.PATTERN)
    edits = spark.createDataFrame([(9, 2, 0, 99, "two words"), (9, 1, 3, 3, "!"), (6, 1, 5, 2, "new"), (7, 1, 0, 0, None), (11, 1, 0, 1, "Z"), (None, 1, 0, 0, "x"), (5, 1, None, 0, "x"), (99, 1, 0, 0, "x")], "doc_id long, seq int, start int, end int, new string")
    got = token_counts.apply_edits(state, edits, JSON, P.PATTERN).collect()
    assert len(got) == len(ROWS)
    texts = {9: ["two words"], 6: ["new"], 7: [""], 5: [OTHER], 11: sorted("Z" + t[1:] for i, t, _ in ROWS if i == 11)}
    for d, want in texts.items():
        assert sorted(r.text for r in got if r.doc_id == d) == want
    assert all(r.tree[1] == len(ids_of([r.text])[0]) for r in got)
    assert token_counts.apply_edits(token_counts.count(none, JSON, P.PATTERN), edits, JSON, P.PATTERN).count() == 0


# 6


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_quality"](spark, sf).toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    rows = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    rows = rows[rows.held_out]
    good, bad = rows[rows.quality == 1].score.values, rows[rows.quality == 0].score.values
    assert (good[:, None] > bad).mean() > 0.93 and (rows.predicted == rows.quality).mean() > 0.9


def test_quality_reads_no_held_out_label(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.learned(), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (quality.train(docs.where(quality.learned()), x.where(quality.learned())) for x in (labels, turned))
    assert a.good == b.good and a.bad == b.bad and (a.weight == b.weight).all()


def test_quality_defined_cases(spark, docs, none):
    labels = spark.createDataFrame([(5, 1), (9, None), (None, 0), (11, 3)], "doc_id long, quality int")
    one_class = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(one_class) == len(ROWS) and {r.score for r in one_class} == {1.0}
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.where("false"))).collect()} == {0.5}
    both = quality.train(docs, spark.createDataFrame([(5, 1), (1, 1), (13, 0), (14, 0)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality.score(docs, both).collect())
    assert quality.score(none, both).count() == 0 and quality.keep_good(docs, labels).columns == docs.columns


# 7


def brute_nearest(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, x in ok:
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q and len(y) == len(x))[:k]
            yield from ((q, n + 1, i, -s) for n, (s, i) in enumerate(found))


def test_nearest_query(spark, sf):
    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    got = [tuple(r) for r in QUERIES["op7_nearest"](spark, sf).orderBy("query_id", "rank").collect()]
    assert got == sorted(brute_nearest(list(zip(e.vec_id, e.embedding)), 20))


def test_nearest_defined_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (9, [0.5, 0.5, 0.5]), (40, [-1.0, 1.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, block int")
    got = [tuple(r) for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, nearest.Settings(k=3, query_block=1, candidate_block=2, tile_rows=1)).select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect()]
    again = [tuple(r) for r in nearest.nearest(df, F.col("vec_id") % 20 == 0, nearest.Settings(k=3, query_block=1, candidate_block=2, tile_rows=1, asked_bytes=1)).select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect()]  # a round for each query block
    assert again == got
    assert got == sorted(brute_nearest(rows, 3))
    assert nearest.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


# 8


def test_media_query(spark, sf, table):
    got = QUERIES["op8_media"](spark, sf).toPandas().set_index("doc_id")
    for d, t in zip(table.doc_id, table.text):
        data = t.encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got.loc[d]
        image = media.to_png(payload)
        counts = Counter(payload)
        mean, entropy = sum(k * n for k, n in counts.items()) / len(payload), abs(sum(n / len(payload) * np.log2(n / len(payload)) for n in counts.values()))
        about = f"64x{len(payload) // 64}x8 mean={mean:.3f} entropy={entropy:.3f}"
        assert tuple(r) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), about)


def test_images_are_read_by_another_reader():
    """What is stored is a PNG as the format says: chunks with right checks, filter 0 in each line."""
    for data in (b"", b"x" * 63, bytes(range(256)) * 5, "é日".encode() * 99):
        payload = media.pad(data)
        image, at, kinds = media.to_png(payload), 8, []
        while at < len(image):
            size = int.from_bytes(image[at : at + 4], "big")
            kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
            assert int.from_bytes(image[at + 8 + size : at + 12 + size], "big") == zlib.crc32(kind + body)
            kinds.append((kind, body))
            at += 12 + size
        lines = zlib.decompress(kinds[1][1])
        assert [k for k, _ in kinds] == [b"IHDR", b"IDAT", b"IEND"] and kinds[0][1] == (64).to_bytes(4, "big") + (len(payload) // 64).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
        assert b"".join(lines[i + 1 : i + 65] for i in range(0, len(lines), 65)) == payload == media.from_png(image) and not any(lines[::65])


def test_media_shards(spark, docs, none):
    folder = shared_folder(spark)
    rows = media.write(docs, folder)
    places = media.index(rows)
    texts = {media.pad((t or "").encode()) for _, t, _ in ROWS}
    assert {bytes(r.payload) for r in media.payloads(places).collect()} == texts
    for r in places.collect():
        with open(r.shard.removeprefix("file://"), "rb") as f:
            shard = f.read()
        names = {m.name: m for m in tarfile.open(fileobj=io.BytesIO(shard)).getmembers()}
        stored_form = shard[r.offset : r.offset + r.length]
        assert hashlib.sha256(stored_form).hexdigest() == r.digest and names[f"{r.digest}.png"].offset_data == r.offset
    about = media.metadata(places).collect()
    assert all((r.width, r.bits) == (64, 8) for r in about) and len(about) == len(texts)
    assert rows.count() == len(ROWS) and media.features(media.metadata(media.index(media.write(none, shared_folder(spark))))).count() == 0


# 9


def brute_substring(rows, window=50):
    first = {}
    for d, t in rows:
        w = words(t)
        for j in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[j : j + window])
                first[k] = min(first.get(k, d), d)
    for d, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if d is not None and first[tuple(w[j : j + window])] < d:
                keep[j : j + window] = [False] * window
        yield d, len(w), len(w) - sum(keep), hashlib.sha256(" ".join(x for x, k in zip(w, keep) if k).encode()).hexdigest()


def test_substring_query(spark, sf, table):
    got = sorted(tuple(r) for r in QUERIES["op9_substring_dedup"](spark, sf).collect())
    assert got == sorted(brute_substring(list(zip(table.doc_id, table.text)))) and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("hot", [1, 2, 1024])
def test_substring_defined_cases(docs, none, hot):
    s = substring_dedup.Settings(hot=hot, bits=1 << 16)
    cut = substring_dedup.cut_spans(docs, substring_dedup.earlier_windows(docs, s)).select("row.doc_id", "n", "removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    assert sorted(map(str, map(tuple, cut))) == sorted(map(str, brute_substring([(i, t) for i, t, _ in ROWS])))
    out = substring_dedup.dedup(docs, s)
    assert out.columns == docs.columns and {r.text for r in out.where("doc_id in (2, 14)").collect()} == {""}
    assert substring_dedup.dedup(none, s).count() == 0


def test_remove_reference(spark, docs):
    reference = spark.createDataFrame([(" ".join(OTHER.split()[90:190]),), (None,), ("short",)], "text string")
    got = {r.doc_id: r.text for r in substring_dedup.remove_reference(docs, reference, substring_dedup.Settings(shard_words=10)).where("doc_id in (1, 5, 11)").collect() if len(words(r.text)) > 9}
    w = OTHER.split()
    assert got[1] == BASE and got[5] == " ".join(w[:90] + w[190:]) and got[11] == noise(3, 60) + " " + noise(4, 60)
    with pytest.raises(ValueError):
        substring_dedup.remove_reference(docs, reference, substring_dedup.Settings(reference_words=10))


def test_automaton_against_search():
    rng = random.Random(6)
    for _ in range(200):
        a, texts = substring_dedup.SuffixAutomaton(), []
        for _ in range(rng.randrange(1, 4)):
            texts.append([rng.randrange(3) for _ in range(rng.randrange(12))])
            a.add(texts[-1])
        q = [rng.randrange(3) for _ in range(15)]
        held = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        assert a.matches(q).tolist() == [max((n for n in range(i + 2) if n == 0 or tuple(q[i + 1 - n : i + 1]) in held)) for i in range(15)]


# 10


def brute_base(rows):
    lower = lambda t: (t or "").translate({i: i + 32 for i in range(65, 91)})
    learned = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 != 0
    tokens = [(d, [*words(lower(t)), None]) for d, t in rows]
    count = Counter(x for d, w in tokens if learned(d) for x in w)
    n, v = sum(count.values()), len(count)
    for d, w in tokens:
        yield d, not learned(d), len(w), sum(count[x] > 0 for x in w), n, sum(log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)


def brute_scores(rows, s):
    """log10 probabilities by plain dictionaries of exact counts, rounded as the grid says."""
    lower = lambda t: (t or "").translate({i: i + 32 for i in range(65, 91)})
    grid, c, n = [1], Counter(), 0
    while grid[-1] < 10**7:
        grid.append(max(grid[-1] + 1, int(grid[-1] * s.base)))
    least = lambda x: max((g for g in grid if g <= x), default=0)
    most = lambda x: min(g for g in grid if g > x) - 1
    texts = [(d, [0, *words(lower(t)), 1]) for d, t in rows]
    for d, w in texts:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 10:
            n += len(w) - 1
            c.update([(x,) for x in w] + list(zip(w, w[1:])) + list(zip(w, w[1:], w[2:])))
    total = n + 0.1 * (sum(len(k) == 1 for k in c) - (n > 0) + 1)
    for d, w in texts:
        score = 0
        for i in range(1, len(w)):
            p = (c[w[i],] + 0.1) / total
            pair = least(min(c[w[i - 1], w[i]], c[w[i],]))
            p = (pair + s.pair * p) / (c[w[i - 1],] + s.pair)
            if i > 1:
                before = least(c[w[i - 2], w[i - 1]])
                p = (min(least(c[w[i - 2], w[i - 1], w[i]]), pair, before) + s.triple * p) / ((most(before) if before else 0) + s.triple)
            score += log10(p)
        yield score


SPARSE = dict(fill=0.01, probes=6)


@pytest.mark.parametrize("bits", [1 << 28, 64])
def test_lm_scores(spark, docs, none, bits, monkeypatch):
    monkeypatch.setattr(lm_scoring, "_BLOCK", 3000)
    s = lm_scoring.Settings(bits=bits, **SPARSE)
    marked = docs.withColumn("held_out", lm_scoring.held_out(10, 0))
    model = lm_scoring.train(marked.where("not held_out"), s)
    assert (model.held is None) == (bits == 64)
    got = sorted((tuple(r) for r in lm_scoring.score(marked, model).collect()), key=lambda r: (str(r[0]), r[2]))
    rows = [(i, t) for i, t, _ in ROWS]
    want = sorted((w + (x,) for w, x in zip(brute_base(rows), brute_scores(rows, s))), key=lambda r: (str(r[0]), r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for i in (5, 6):
        assert [r[i] for r in got] == pytest.approx([r[i] for r in want], rel=1e-9)
    assert lm_scoring.score(marked.where("false"), model).count() == 0
    empty = lm_scoring.score(marked, lm_scoring.train(none, s)).collect()
    assert len(empty) == len(ROWS) and all(r.base_score == 0 and r.score == pytest.approx(0) and r.train_tokens == 0 for r in empty)


def test_lm_query(spark, sf, table):
    got = QUERIES["op10_lm_scoring"](spark, sf).toPandas().set_index("doc_id")
    rows = list(zip(table.doc_id, table.text))
    scores = np.array(list(brute_scores(rows, lm_scoring.Settings())))
    for d, *want in brute_base(rows):
        r = got.loc[d]
        assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == want[:4] and r.base_score == pytest.approx(want[4], rel=1e-9)
    off = np.abs(got.loc[table.doc_id].score.to_numpy() / scores - 1)  # by false positives, and by nothing else
    assert np.median(off) < 0.01 and off.max() < 0.2 and got.score.sum() == pytest.approx(scores.sum(), rel=0.01)
    held = got[got.held_out]
    assert held.score.sum() / held.n_tokens.sum() > held.base_score.sum() / held.n_tokens.sum() + 0.3


def test_probabilities_add_up_to_one_at_most(spark):
    """Of all words that can follow, by the difference of two texts' scores: the first text ends before that word."""
    rng, letters = random.Random(4), "abcdefgh"
    texts = [" ".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(300)]
    model = lm_scoring.train(spark.createDataFrame([(t,) for t in texts], "text string"), lm_scoring.Settings(pair=2.0, triple=1.0, **SPARSE))
    small = lm_scoring._Small(model.settings, model.buckets, model.tokens, model.distinct)
    for before in ("", "a", "b c", "h a d"):
        own = [*before.split()]
        asked = [" ".join([*own, x]) for x in [*letters, "unseen"]]
        batch = pa.record_batch([pa.array([1] * (len(asked) + 1)), pa.array([True] * (len(asked) + 1)), pa.array([*asked, before])], names=["doc_id", "held_out", "text"])
        token_scores = []
        small_bincount = lm_scoring.np.bincount
        with pytest.MonkeyPatch.context() as m:
            m.setattr(lm_scoring.np, "bincount", lambda x, weights=None, minlength=0: token_scores.append((x, weights)) or small_bincount(x, weights=weights, minlength=minlength))
            small.lines(batch, model.held.count, model.held.level)
        row, score = token_scores[-1]
        at = [np.flatnonzero(row == i)[len(own)] for i in range(len(asked) + 1)]  # the word asked for; in the last row the end
        total = (10 ** score[at]).sum()
        assert 0.5 < total <= 1 + 1e-9


def _model(spark, text, s):
    return lm_scoring.train(spark.createDataFrame([(text,)], "text string"), s)


def test_levels_come_back_from_the_filter(spark):
    s = lm_scoring.Settings()
    text = " ".join(f"a{i} " * (i % 40 + 1) for i in range(200))
    model = _model(spark, text, s)
    t = lm_scoring.tokens_of(pa.array([text]), model.buckets)
    keys, count = np.unique(np.concatenate((t.pair, t.triple[~t.first])), return_counts=True)
    got, want = model.held.level(keys), lm_scoring.levels(count, s.base)
    assert (got >= want).all() and (got == want).mean() > 0.95 and (want >= 1).all() and want.max() > 10
    assert (lm_scoring.least_count(want, s.base) <= count).all() and (lm_scoring.most_count(want, s.base) >= count).all()


def test_the_filter_grows_with_the_keys(spark):
    """And stays as sparse."""
    s = lm_scoring.Settings()
    size, fill = [], []
    for n in (2000, 20000):
        model = _model(spark, noise(7, n), s)
        size.append(model.size)
        fill.append(model.fill)
    assert size[1] > 3 * size[0] and fill == pytest.approx([s.fill] * 2, rel=0.05)
    keys = words_.mix(np.arange(100_000, dtype=np.uint64))
    assert (model.held.level(keys) > 0).mean() < 1.5 * s.fill**s.probes


def test_packed_keys():
    keys = np.unique(words_.mix(np.arange(3000, dtype=np.uint64)))
    assert (lm_scoring.unpacked_keys(lm_scoring.packed_keys(keys)) == keys).all()
    cut = np.unique(lm_scoring.cut_keys(keys, 51))
    assert len(cut) == len(keys)
    assert (lm_scoring.unpacked_keys(lm_scoring.packed_keys(cut, lm_scoring.spare_bits(51)), lm_scoring.spare_bits(51)) == cut).all()
    assert len(lm_scoring.unpacked_keys(lm_scoring.packed_keys(keys[:0]))) == 0


def test_quality_learns_from_whole_texts(spark, monkeypatch):
    seen, made = [], quality._dictionary
    monkeypatch.setattr(quality, "_dictionary", lambda texts, size: seen.append(texts) or made(texts, size))
    texts = [noise(20 + i, 4000) for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    quality.train(docs, labels)
    own = {r.quality: texts[r.doc_id] for r in quality._sample(quality._labelled(docs, labels), quality.Settings()).where("part = 0").collect()}
    assert [sorted(x) for x in seen] == [sorted(own[q][i : i + 8192].encode() for i in range(0, len(own[q]), 8192)) for q in (1, 0)]


# All of them


CLASHING = ["row", "mark", "_mark", "_spans", "_n", "_key", "_doc", "spans", "n", "removed", "kept", "score", "_all", "key", "other", "begin", "end", "quality", "upto", "k"]


def test_columns_with_names_of_the_operators(spark):
    rows = [(1, BASE, *range(len(CLASHING))), (2, BASE + " x", *range(len(CLASHING))), (3, None, *range(len(CLASHING)))]
    df = spark.createDataFrame(rows, ["doc_id", "text", *CLASHING])
    out = {r.doc_id: tuple(r) for r in substring_dedup.dedup(df).collect()}
    assert out[1] == rows[0] and out[3] == rows[2] and out[2][2:] == rows[1][2:] and out[2][1] == "x"
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    kept = quality.keep_good(df, labels, threshold=0.0)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == rows


def test_equal_first_hashes_do_not_make_windows_equal(docs, monkeypatch):
    """With a window hash of four bits, frequent anchors' windows are told apart by the second hash."""
    plain = substring_dedup.windows_in
    monkeypatch.setattr(substring_dedup, "windows_in", lambda *a: (*(x := plain(*a))[:2], x[2] & np.uint64(15)))
    s = substring_dedup.Settings(hot=1, bits=1 << 16)
    cut = substring_dedup.cut_spans(docs, substring_dedup.earlier_windows(docs, s)).select("row.doc_id", "n", "removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    assert sorted(map(str, map(tuple, cut))) == sorted(map(str, brute_substring([(i, t) for i, t, _ in ROWS])))


def test_long_passages_go_in_parts(spark):
    """One repeated word and a period, in texts of which each is one passage; and an automaton of equal parts stays small."""
    period = noise(62, 30)
    rows = [(1, "x " * 9000), (2, "x " * 7000 + noise(63, 70)), (3, (period + " ") * 300), (4, noise(64, 55) + " " + (period + " ") * 200), (5, "y " + (period + " ") * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for longest in (7, 100, 4096):
        s = substring_dedup.Settings(longest=longest, bits=1 << 16)
        cut = substring_dedup.cut_spans(df, substring_dedup.earlier_windows(df, s)).select("row.doc_id", "n", "removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
        assert sorted(map(tuple, cut)) == sorted(brute_substring(rows))
    words = words_.words_of(pa.array(["x " * 200_000]))
    s = substring_dedup.Settings()
    row, begin, end, anchor = substring_dedup.anchored(words, s)
    parts = substring_dedup.in_parts(row, begin, end, anchor, s.longest)
    assert len(row) == 1 and (parts[2] - parts[1]).max() == s.longest and (parts[2] - parts[1]).sum() == end[0] - begin[0]
    symbols, automaton = substring_dedup.grams(words.hash, s.unit), substring_dedup.SuffixAutomaton()
    for data in {symbols[a : b + s.window - s.unit].tobytes() for a, b in zip(parts[1].tolist(), parts[2].tolist())}:
        automaton.add(np.frombuffer(data, np.uint64).tolist())
    assert len(automaton.length) < 3 * s.longest


def test_more_rows_a_batch_than_14_bits(spark):
    """20,000 empty texts, then a text twice, in one partition and in batches of 50,000 rows."""
    text = noise(61, 60)
    rows = [(i, "") for i in range(20_000)] + [(20_000, text), (20_001, text), (20_002, text + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    try:
        got = {r.doc_id: r.removed for r in substring_dedup.cut_spans(df, substring_dedup.earlier_windows(df)).where("n > 0").select("row.doc_id", "removed").collect()}
        classes_ = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).where("doc_id >= 20000").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {20_000: 0, 20_001: 60, 20_002: 60} and classes_ == {20_000: 20_000, 20_001: 20_000, 20_002: 20_000}


def test_a_passage_in_most_rows(spark):
    """One passage in two thirds of the rows, in contexts of their own."""
    common, rng = noise(50, 60), random.Random(51)
    rows = [(i, (noise(100 + i, 40) + " " + common + " " + noise(500 + i, 40)) if i % 3 else noise(900 + i, 120)) for i in range(150)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    s = substring_dedup.Settings(hot=20, bits=1 << 16)
    cut = substring_dedup.cut_spans(df, substring_dedup.earlier_windows(df, s)).select("row.doc_id", "n", "removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    assert sorted(map(tuple, cut)) == sorted(brute_substring(rows)) and sum(r.removed for r in cut) >= 60 * 99


def test_a_labelled_id_that_many_rows_repeat(spark):
    docs = spark.createDataFrame([(i % 4, noise(i % 4, 50) + f" {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    got = quality._sample(quality._labelled(docs, labels), quality.Settings()).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3] and sorted((r.quality, r.part) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_one_labelled_text_that_is_larger_than_all_others(spark):
    """It gives most pieces, but the class keeps its dictionary, and scores still differ."""
    rows = [(i, noise(i, 60, 40 if i % 2 else 5000)) for i in range(40)] + [(40, noise(99, 60_000, 5000)), (41, noise(98, 60_000, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(42)], "doc_id long, quality int")
    model = quality.train(docs, labels, quality.Settings(pieces=16, window=1024))
    assert len(model.good) > 1000 and len(model.bad) > 1000
    got = quality.score(docs, model).select("row.doc_id", "score").toPandas()
    short = got[got.doc_id < 40]
    assert got.score.nunique() > 30 and short[short.doc_id % 2 == 1].score.min() > short[short.doc_id % 2 == 0].score.max()


def test_labels_without_documents(spark):
    docs = spark.createDataFrame([(i, noise(i, 60, 40 if i % 2 else 5000)) for i in range(40)], "doc_id long, text string")
    own = [(i, i % 2) for i in range(40)]
    plain = quality.train(docs, spark.createDataFrame(own, "doc_id long, quality int"))
    more = quality.train(docs, spark.createDataFrame(own + [(i, 1) for i in range(1000, 5000)], "doc_id long, quality int"), quality.Settings(sample=30))
    assert len(more.good) > 100 and len(more.bad) > 100 and more.prior == plain.prior == 0.5
    assert quality.score(docs, more).select("score").distinct().count() > 20


def test_quality_against_a_plain_run(spark):
    """zstandard and a logistic fit by plain gradient steps, on the same sample."""
    import zstandard

    rows = [(i, noise(i, 20 + i, 40 if i % 3 else 3000)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0) if i % 17 else 1 - int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int")
    s = quality.Settings()
    part = {(r.doc_id, r.quality): r.part for r in quality._sample(quality._labelled(docs, labels), s).collect()}
    text = dict(rows)
    compress = {}
    for q in (0, 1):
        order = docs.where(F.col("doc_id").isin([d for (d, y), p in part.items() if y == q and p == 0])).select("doc_id").orderBy(F.xxhash64(F.lit(19), "doc_id", F.lit(0))).collect()
        pieces = [text[r.doc_id].encode() for r in order]
        try:
            data = zstandard.train_dictionary(s.dictionary, pieces).as_bytes()
        except zstandard.ZstdError:
            data = b"".join(pieces)[-s.dictionary :]
        compress[q] = zstandard.ZstdCompressor(level=s.level, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False)
    compress[2] = zstandard.ZstdCompressor(level=s.level, write_content_size=False)

    def features(t):
        good, bad, none = (len(compress[q].compress(t.encode())) for q in (1, 0, 2))
        return (bad - good) / none, none / len(t), np.log(len(t))

    held = sorted(k for k, p in part.items() if p == 1)
    x, y = np.array([features(text[d]) for d, _ in held]), np.array([float(q) for _, q in held])
    mean, scale = x.mean(axis=0), x.std(axis=0)

    def design(v):
        z = np.clip((v - mean) / scale, -6, 6)
        return np.column_stack((np.ones(len(z)), z, z[:, :1] * z[:, 1:2], z**2))

    a, w = design(x), np.zeros(8)
    for _ in range(200_000):
        w += 0.05 * (a.T @ (y - 1 / (1 + np.exp(-a @ w))) / len(a) - s.ridge * w)
    share, drawn = np.mean([q for _, q in part]), y.mean()
    w[0] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    want = 1 / (1 + np.exp(-design(np.array([features(t) for _, t in rows])) @ w))
    got = quality.score(docs, quality.train(docs, labels)).select("row.doc_id", "score").toPandas().sort_values("doc_id").score.to_numpy()
    assert np.abs(got - want).max() < 1e-3


def test_a_text_above_four_megabytes(spark):
    text = noise(70, 700_000, 10**6)
    assert len(text) > 4 << 20
    df = spark.createDataFrame([(1, text), (2, text), (3, "short " + text[:2000])], "doc_id long, text string")
    out = {r.doc_id: r.removed for r in substring_dedup.cut_spans(df, substring_dedup.earlier_windows(df)).select("row.doc_id", "removed").collect()}
    assert out[1] == 0 and out[2] == 700_000 and out[3] > 200
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    got = packing.pack(df, JSON).groupBy("doc_id").agg(F.max("doc_tokens").alias("n"), F.sum("length").alias("s")).collect()
    assert all(r.n == r.s for r in got) and len(got) == 3
