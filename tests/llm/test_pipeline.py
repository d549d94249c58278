import pandas as pd

import corpus_pipeline
from vecspark.llm import near_dedup, packing, quality
from vecspark.llm.tokens import tokenizer_path


def test_stages_in_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "packing"]


def test_pipeline_keeps_what_each_stage_keeps(spark, sf):
    from test_llm import brute_substring, classes

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, steps = dict(corpus_pipeline.STAGES), {}
    at = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.stored(f(spark, at, sf))
        assert at.columns == docs.columns
        steps[name] = at.toPandas().sort_values("doc_id")
    model = quality.train(docs.where(quality.learned()), spark.read.parquet(f"{sf}/labels.parquet").where(quality.learned()))
    good = quality.score(docs, model).where("score >= 0.7").select("row.doc_id").toPandas()
    assert sorted(good.doc_id) == steps["quality"].doc_id.tolist()
    rows = list(zip(steps["quality"].doc_id, steps["quality"].text))
    assert sorted({c for (_, c), _ in classes(rows)}) == steps["near_dedup"].doc_id.tolist()
    once = list(zip(steps["near_dedup"].doc_id, steps["near_dedup"].text))
    removed = {d: r for d, _, r, _ in brute_substring(once)}
    final = steps["substring_dedup"].set_index("doc_id")
    before = steps["near_dedup"].set_index("doc_id")
    for d, r in removed.items():
        n = len(before.text[d].split()) - r if r else None
        assert final.text[d] == before.text[d] if not r else len(final.text[d].split()) == n and final.n_chars[d] == len(final.text[d])
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert sorted(got.doc_id.unique()) == final.index.tolist()
    want = packing.pack(at, tokenizer_path("byte_bpe_50k.json")).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), want[key].sort_values(key).reset_index(drop=True))
    assert stages["near_dedup"] is corpus_pipeline.one_of_each and near_dedup.keep_one


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(f(spark, docs, sf))
    assert docs.count() == 0


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Null ids and texts, ties, repeated rows and columns with clashing names, stage by stage against plain versions and as a whole."""
    import zlib

    import numpy as np
    from test_llm import brute_substring, ids_of, kept_of, noise

    shared = noise(7, 70)
    good = [noise(100 + i, 80, 900) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(good)] + [(100 + i, noise(300 + i, 120, 9)) for i in range(60)]
    rows += [(200, good[3]), (201, good[3] + " more"), (None, good[5]), (None, None), (202, None), (203, ""), (204, " \t"), (7, noise(9, 90, 900)), (7, good[7]), (205, noise(11, 40, 900) + " " + shared), (206, noise(12, 40, 900) + " " + shared), (207, "one"), (208, good[8][:200])]
    docs = spark.createDataFrame([(i, t, "k", 1, "r", 0.5) for i, t in rows], "doc_id long, text string, key string, mark int, row string, score double").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 1) for i in range(60)] + [(5, None, 0), (None, 1, 0), (9999, 1, 0), (8, 0, 0), (8, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
    kept = corpus_pipeline.stored(corpus_pipeline.good(spark, docs, sf))
    assert kept.columns == docs.columns and {i for i, _ in plain(kept) if i is not None and i < 60} >= set(range(60)) - {7} and not any(i is not None and 100 <= i < 160 for i, _ in plain(kept))
    once = corpus_pipeline.stored(corpus_pipeline.one_of_each(spark, kept, sf))
    assert once.columns == docs.columns and sorted(str(i) for i, _ in plain(once)) == sorted(kept_of(plain(kept)))
    cut = corpus_pipeline.stored(corpus_pipeline.without_repeats(spark, once, sf))
    want = sorted(brute_substring([(i, t or "") for i, t in plain(once)]), key=str)
    assert sorted(((i, len((t or "").split())) for i, t in plain(cut)), key=str) == sorted(((i, n - gone) for i, n, gone, _ in want), key=str)
    got = corpus_pipeline.run(spark, sf).toPandas()
    pieces = {}
    for i, start, length, crc in zip(got.doc_id, got.start, got.length, got.ids_crc32):
        pieces.setdefault(None if np.isnan(i) else int(i), []).append((start, length, crc))
    whole = {}
    for (i, _), ids in zip(plain(cut), ids_of([t for _, t in plain(cut)])):
        whole.setdefault(i, []).append(ids + [0])
    assert pieces.keys() == whole.keys() and (got.groupby("sequence_id").length.sum() <= 1024).all()
    for i, texts in whole.items():
        crcs = {zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for ids in texts for a, n, _ in pieces[i]}
        assert sum(n for _, n, _ in pieces[i]) == sum(map(len, texts)) and {c for _, _, c in pieces[i]} <= crcs
