"""Model caches, attention in tiles, runs and their configurations, nested reports."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import codes
from vecspark.functions import columns as c
from vecspark.functions.spec import QuantizerSpec, exported, imported
from vecspark.operators import accumulate, allocation, attention, encode
from vecspark.operators.model_cache import LayerProfile, ModelCache
from vecspark.sources import bench_config, captures, reports
from vecspark.streaming import sessions

PROFILES = [LayerProfile(3, 4, 16, 3, 2, 2, 50, 5), LayerProfile(0, 2, 8, 4, 4, 0, 0, 6)]


def token_rows(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(p.layer, h, i, rng.normal(size=p.head_dim).tolist(), rng.normal(size=p.head_dim).tolist()) for p in PROFILES for h in range(p.key_heads) for i in range(n)]


ROWS = "layer int, kv_head int, token long, key array<double>, value array<double>"


@pytest.fixture(scope="module")
def cache(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "cache")
    made = ModelCache.create(spark, path, PROFILES)
    rows = token_rows(30)
    for part in (lambda t: t < 20, lambda t: t >= 20):
        made.append(spark.createDataFrame([r for r in rows if part(r[2])], ROWS), ["token"])
    return ModelCache.open(spark, path)


def test_profiles_and_lookups(spark, cache, tmp_path):
    assert cache.layers == [3, 0] and cache.profiles == PROFILES and cache.profile(0).key_heads == 2
    assert sorted(r.slot for r in cache.layer(3, 1).collect()) == list(range(30)) and cache.layer(0).count() == 60
    plan = cache.layer(3, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer#" in plan and "(kv_head#" in plan.split("PartitionFilters")[1].split("]")[0]
    for bad in (lambda: cache.layer(1), lambda: cache.layer(3, 2), lambda: cache.profile(7), lambda: ModelCache(spark, "x", []), lambda: ModelCache(spark, "x", [PROFILES[0], PROFILES[0]])):
        with pytest.raises(ValueError):
            bad()
    for bad in ({"heads": 3, "kv_heads": 2}, {"layer": -1}, {"head_dim": 1}, {"key_bits": 1}, {"value_bits": 9}, {"capacity": -1}, {"heads": 0}):
        with pytest.raises(ValueError):
            LayerProfile(**({"layer": 0, "heads": 2, "head_dim": 8, "key_bits": 3, "value_bits": 2} | bad))
    for layer, head, dim, text in ((9, 0, 16, "no layer 9"), (3, 2, 16, "no key/value head 2"), (3, 0, 8, "16 components")):
        with pytest.raises(Exception, match=text):
            cache.coded(spark.createDataFrame([(layer, head, 0, [1.0] * dim, [1.0] * dim)], "layer int, kv_head int, slot int, key array<double>, value array<double>")).collect()


@pytest.mark.parametrize("k", [None, 5])
def test_attention_of_a_layer(spark, cache, k):
    """Against codes worked out head by head, each with its own seed."""
    rng, profile = np.random.default_rng(9), PROFILES[0]
    asked = [(i, h, rng.normal(size=16).tolist()) for i in range(3) for h in range(4)]
    got = cache.attend(3, spark.createDataFrame(asked, "query long, head int, q array<double>"), ["query"], 0.5, k).collect()
    got = {(r["query"], r.head, r.coordinate): r.output for r in got}
    rows = token_rows(30)
    for query, head, q in asked:
        keys, values = profile.specs(head // 2)
        own = [r for r in rows if r[0] == 3 and r[1] == head // 2]
        cells, signs, left = codes.encode_product(np.array([r[3] for r in own]), keys)
        s = codes.product_scores(cells, signs, np.float32(left).astype(float), np.array([q]), keys)[:, 0] * 0.5
        best = np.argsort(-s, kind="stable")[: k or len(s)]
        plain, norm = codes.indices(np.array([r[4] for r in own]), values)
        w = np.exp(s[best] - s[best].max())
        want = (w / w.sum()) @ (codes.reconstruct(plain, values) * norm[:, None])[best]
        assert np.allclose([got[query, head, i] for i in range(16)], want, atol=1e-6)
    assert PROFILES[0].specs(0)[0].seed != PROFILES[0].specs(1)[0].seed and PROFILES[0].specs(0)[1].seed != PROFILES[0].specs(0)[0].seed


def test_sizes_of_a_model(cache):
    got = {(r.layer, r.kv_head): tuple(r)[2:] for r in cache.sizes().collect()}
    one = PROFILES[0].entry_bytes
    assert got[3, 0] == (30, 30 * one, 50 * one, 30 * 128) and got[0, None][0] == 60 and got[None, None][0] == 120 and len(got) == 7


def test_tiles_of_small_blocks(spark, monkeypatch):
    """Blocks of a few rows, so each page has many tiles; nulls and pages on one side only."""
    rng = np.random.default_rng(12)
    entries = [(p, s, rng.normal(size=6).tolist(), rng.normal(size=6).tolist()) for p, n in (("a", 23), ("b", 2), ("only entries", 3)) for s in range(n)]
    asked = [(i, ["a", "b", "only queries", None][i % 4], rng.normal(size=6).tolist()) for i in range(40)]
    e = spark.createDataFrame(entries, "page string, slot int, key array<double>, value array<double>")
    q = spark.createDataFrame(asked, "id long, page string, q array<double>")
    plain = {}
    for k in (None, 4):
        plain[k] = {(r.id, r.coordinate): r.output for r in attention.attend(q, e, ["page"], ["id"], 1.5, k).collect()}
        for i, page, v in asked:
            own = [x for x in entries if x[0] == page]
            if not own:
                assert (i, 0) not in plain[k]
                continue
            s = np.array([np.dot(x[2], v) for x in own]) * 1.5
            best = np.argsort(-s, kind="stable")[: k or len(s)]
            w = np.exp(s[best] - s[best].max())
            want = (w / w.sum()) @ np.array([own[j][3] for j in best])
            assert np.allclose([plain[k][i, c] for c in range(6)], want)
    monkeypatch.setattr(attention, "QUERIES", 3)
    monkeypatch.setattr(attention, "ENTRIES", 5)
    for k in (None, 4):
        again = {(r.id, r.coordinate): r.output for r in attention.attend(q, e, ["page"], ["id"], 1.5, k).collect()}
        assert again.keys() == plain[k].keys() and all(abs(again[x] - plain[k][x]) < 1e-12 for x in again)
    plan = attention.attend(q, e, ["page"], ["id"], 1.5, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan
    assert attention.attend(q.where("false"), e, ["page"], ["id"]).count() == attention.attend(q, e.where("false"), ["page"], ["id"], 1.0, 2).count() == 0


def test_sweep_equals_evaluations(spark):
    rng = np.random.default_rng(21)
    rows = [(i, heads, kv, 8, tokens, 0.5, rng.normal(size=heads * 8).tolist(), *(rng.normal(size=tokens * kv * 8).tolist() for _ in range(2))) for i, (heads, kv, tokens) in enumerate([(4, 2, 9), (2, 2, 1), (3, 1, 30)])]
    samples = spark.createDataFrame(rows, "sample int, heads int, kv_heads int, head_dim int, tokens int, query_scale float, query array<float>, keys array<float>, values array<float>")
    got = captures.sweep(samples, ["sample"], 8, [2, 4], [1, 2], [0, 3, 50], ("primary", "uniform"), 5, 12).collect()
    assert len(got) == 3 * 24
    find = {(r.sample, r.method, r.key_bits, r.value_bits, r.requested_top_k): r for r in got}
    for method, kb, vb, k in (("primary", 2, 1, 0), ("primary", 4, 2, 3), ("uniform", 4, 2, 3), ("uniform", 2, 1, 50)):
        for r in captures.evaluate(samples, ["sample"], kb, vb, 8, k, 5, method, 12).collect():
            own = find[r.sample, method, kb, vb, k]
            for name in r.asDict():
                a, b = r[name], own[name]
                if name == "heads_metrics":
                    assert np.allclose([tuple(x) for x in a], [tuple(x) for x in b], atol=1e-6)
                else:
                    assert a == b if not isinstance(a, float) else abs(a - b) < 1e-6, name
    for bad in ({"methods": ("x",)}, {"key_bits": [9]}, {"value_bits": [0]}):
        with pytest.raises(ValueError):
            captures.sweep(samples, ["sample"], **({"dim": 8, "key_bits": [2], "value_bits": [2], "top_k": [0]} | bad))
    assert captures.sweep(samples, ["sample"], 8, [], [2], [0]).count() == 0


GOOD = {"name": "r1", "model": "/m/x.gguf", "baseline": "f16", "perplexity_bin": "bin/p", "bench_bin": "/bin/b", "kv_types": [{"name": "f16", "type_k": "f16", "type_v": "f16"}, {"type_k": "q8", "type_v": "q4"}, {"type_v": "q4"}, {}], "perplexity": {"dataset": "wiki.raw", "ctx_sizes": [512]}, "bench": {"n_gen": [8]}}


def test_bench_configurations(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"runs": [GOOD, {**GOOD, "name": "r2", "baseline": "q8/q4", "bench": None, "extra": {"any": [1]}}]}))
    bad = [{}, {**GOOD, "baseline": "none", "kv_types": [{"name": "a"}, {"name": "a"}]}, {**GOOD, "perplexity_bin": " ", "perplexity": {"dataset": "", "ctx_sizes": []}, "bench_bin": "", "bench": {}}, {**GOOD, "bench": {"n_gen": ["x"], "threads": 3}, "kv_types": "f16"}]
    (tmp_path / "bad.json").write_text(json.dumps({"runs": bad}))
    (tmp_path / "empty.json").write_text('{"runs": []}')
    (tmp_path / "none.json").write_text("{not json")
    runs = bench_config.read_config(spark, str(tmp_path))
    got = {}
    for r in bench_config.config_violations(runs).orderBy("source", "run", "place").collect():
        got.setdefault((r.source.rpartition("/")[2], r.run), []).append(r.violation)
    assert got == {
        ("none.json", None): ["the file is no JSON"],
        ("empty.json", None): ["a configuration has one run or more"],
        ("bad.json", 0): ["a run has a name", "a run has a model", "a run has one entry of kv_types or more", "a run has perplexity or bench"],
        ("bad.json", 1): ["kv_types has a twice", "no entry of kv_types is the baseline none"],
        ("bad.json", 2): ["perplexity needs perplexity_bin", "perplexity needs a dataset", "perplexity needs ctx_sizes", "bench needs bench_bin", "bench needs n_prompt or n_gen"],
        ("bad.json", 3): ["kv_types is no list of variants", "a run has one entry of kv_types or more", "no entry of kv_types is the baseline f16", "bench needs n_prompt or n_gen", "bench.n_gen is no list of integers", "bench.threads is no list of integers"],
    }
    good = {r.name: r for r in runs.where("size(violations) = 0").collect()}
    assert set(good) == {"r1", "r2"} and good["r1"].perplexity_bin == f"{tmp_path}/bin/p" and good["r1"].dataset == f"{tmp_path}/wiki.raw" and good["r1"].model == "/m/x.gguf" and good["r1"].workdir == ""
    assert good["r1"].contexts == [512] and good["r1"].n_gen == [8] and good["r1"].has_bench and not good["r2"].has_bench
    assert [(r.variant, r.is_baseline) for r in bench_config.variants(runs).where("name = 'r2'").collect()] == [("f16", False), ("q8/q4", True), ("q4", False), ("default", False)]


RUNS = "group long, layer int, tokens int, raw_fp32 long, raw_fp16 long, live_bytes long, storage_bytes long, append_ms double, attention_ms double"


def test_accumulators(spark):
    rows = [(1, 0, 10, 800, 400, 100, 160, 2.0, 0.5), (1, 1, 10, 800, 400, 50, 80, 3.0, 0.0), (2, 0, 30, 2400, 1200, 300, 320, 0.0, 0.25), (2, 1, 30, 2400, 1200, 150, 160, 6.0, 1.0)]
    df = spark.createDataFrame(rows, RUNS)
    layers = {r.layer: r for r in accumulate.layer_summaries(df).collect()}
    assert layers[0].runs == 2 and layers[0].mean_tokens == 20 and layers[0].compression_vs_fp32 == 8 and layers[0].compression_vs_fp16 == 4
    assert layers[0].mean_tokens_per_s == (10 / 0.002 + 0) / 2 and layers[1].mean_queries_per_s == (0 + 1000) / 2
    whole = accumulate.run_summary(df).first()
    assert whole.runs == 2 and whole.layer_runs == 4 and whole.mean_raw_fp32 == 3200 and whole.mean_live_bytes == 300 and whole.mean_total_ms == (5.5 + 7.25) / 2
    assert whole.mean_tokens_per_s == (20 / 0.005 + 60 / 0.006) / 2 and whole.mean_queries_per_s == (2 / 0.0005 + 2 / 0.00125) / 2
    assert abs(whole.mean_groups_per_s - (1000 / 5.5 + 1000 / 7.25) / 2) < 1e-9 and abs(whole.compression_vs_fp32 - 3200 / 300) < 1e-12
    none = accumulate.run_summary(df.where("false")).first()
    assert none.runs == none.layer_runs == 0 and none.compression_vs_fp16 is None
    free = accumulate.layer_summaries(df.withColumn("live_bytes", F.lit(0).cast("long"))).first()
    assert free.compression_vs_fp32 is None
    turns = spark.createDataFrame([("a", 5.0, 10, None), ("a", 1.0, 20, ""), ("a", 9.0, 30, "x"), ("a", 3.0, 1, None), ("b", 4.0, 7, "y")], "target string, duration_ms double, assistant_chars long, error string")
    t = {r.target: r for r in accumulate.turn_summaries(turns, ["target"]).collect()}
    assert (t["a"].ok, t["a"].failed, t["a"].total_ms, t["a"].mean_ms, t["a"].assistant_chars, t["a"].p50_ms, t["a"].p95_ms) == (3, 1, 18.0, 4.5, 31, 3.0, 3.0)
    assert (t["b"].ok, t["b"].failed, t["b"].assistant_chars, t["b"].p50_ms) == (0, 1, 0, None)


def test_observed_counts_come_with_the_pass(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1.0, 2.0, 3.0, float(i)]) for i in range(50)], "id long, v array<double>")
    coded, seen = accumulate.observed(encode.quantize(rows, QuantizerSpec(4, 2)), "codes", code_bytes="packed")
    coded.write.parquet(str(tmp_path / "codes"))
    assert seen.get == {"rows": 50, "code_bytes": 50}


def test_reports_round_trip(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [("m", f"s{i}", i, i % 4, 3, "last", 9, 8, 2, 1, 16, m, 2 + b, 2, 0, 8, 100, 10, 12, 8.5, float(rng.random()), float(rng.random())) for i in range(30) for m in ("primary", "uniform") for b in range(2)]
    kinds = ["string"] * 2 + ["int"] * 3 + ["string"] + ["int"] * 5 + ["string"] + ["int"] * 4 + ["long"] * 3 + ["double"] * 3
    cases = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(reports.SAMPLE + reports.CASE, kinds)))
    monkeypatch.setattr(reports, "REPORT_SAMPLES", 8)
    reports.write_report(cases.repartition(5), str(tmp_path / "report"), "now")
    again = reports.read_report(spark, str(tmp_path / "report"))
    assert sorted(map(str, again.select(cases.columns).collect())) == sorted(map(str, cases.collect()))
    files = list((tmp_path / "report").glob("*.json"))
    assert len(files) == 4 and all(len(json.loads(f.read_text())["samples"]) for f in files)
    choices = [("a", 1, 4, 2, 16, 3, 2, 8, 100, 7), ("a", 0, 4, 2, 16, 4, 2, 8, 100, 7), ("b", 0, 2, 2, 8, 2, 2, 0, 0, 1)]
    df = spark.createDataFrame(choices, "label string, layer int, heads int, kv_heads int, head_dim int, key_bits int, value_bits int, top_k int, capacity int, seed long")
    reports.write_profiles(df, str(tmp_path / "profiles"))
    assert sorted(map(tuple, reports.read_profiles(spark, str(tmp_path / "profiles")).select(df.columns).collect())) == sorted(choices)


def profile_cases(spark):
    rng = np.random.default_rng(31)
    rows = [("primary", 2 + b, 2, 8, layer, 64, p, float(1 / (b + 1) + rng.random() / 100), 0.8 + 0.05 * b + 0.01 * (p == "last"), 1000, 100 * (b + 1)) for layer in range(3) for b in range(3) for p in ("first", "25%", "last") for _ in range(4)]
    return spark.createDataFrame(rows, "method string, key_bits int, value_bits int, top_k int, layer int, tokens int, position string, output_mse double, output_cosine double, raw_bytes long, storage_bytes long")


@pytest.mark.parametrize("limits", [{}, {"mean_cosine": 0.86}, {"max_storage": 600.0}, {"min_compression": 5.0, "mean_cosine": 0.8}])
def test_sets_are_profiles_of_their_own_cases(spark, limits):
    cases = profile_cases(spark)
    got = allocation.select_sets(cases, "quarter,all, end ,all", "start,25%,last", **limits)
    columns = [x for x in got.columns if x != "set"]
    assert {r.set for r in got.select("set").distinct().collect()} == {"all", "quarter", "last"}
    for name in ("all", "quarter", "last"):
        found = allocation.candidates(cases, "primary", None if name == "all" else [name])
        want = allocation.select_profile(found, name, **limits)
        assert sorted(map(str, got.where(F.col("set") == name).select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    with pytest.raises(Exception, match="no cases for the set middle"):
        allocation.select_sets(cases, "all,middle").collect()


def test_names_of_sets():
    assert allocation.set_names("end, ALL,first,start,") == ["all", "first", "last"] and allocation.set_names("") == []
    for text, whole in (("all", False), ("somewhere", True)):
        with pytest.raises(ValueError):
            allocation.set_names(text, whole)


def test_code_validators(spark):
    rows = [(b"\x01\x02", b"\x03", 0.5), (b"\x01", b"\x03", 0.5), (None, b"\x03", 0.5), (b"\x01\x02", b"\x03\x04", 0.5), (b"\x01\x02", b"\x03", float("nan")), (b"\x01\x02", b"\x03", float("inf")), (b"\x01\x02", b"\x03", None)]
    df = spark.createDataFrame(rows, "mse binary, signs binary, res_norm double")
    got = [r.e for r in df.select(c.product_error("mse", "signs", "res_norm", 8, 3).alias("e")).collect()]
    assert got == [None, "code has 1 bytes, expected 2", "code is missing", "code has 2 bytes, expected 1", *["residual norm is null or not finite"] * 3]
    assert df.select(c.packed_error("mse", 8, 2).alias("e")).where("e is null").count() == 5


def test_exported_specs_read_codes():
    for spec in (QuantizerSpec(12, 3, 5), QuantizerSpec(6, 2, 5, "dense")):
        again = imported(json.loads(json.dumps(exported(spec))))
        x = np.random.default_rng(1).normal(size=(9, spec.dim))
        assert np.allclose(again.rotate(x), spec.rotate(x)) and (codes.indices(x, again)[0] == codes.indices(x, spec)[0]).all()
        assert np.allclose(codes.reconstruct(codes.indices(x, spec)[0], again), codes.reconstruct(codes.indices(x, spec)[0], spec))


def test_restored_sessions(spark):
    at = lambda df, *names: df.withColumns({x: F.timestamp_seconds(x) for x in names})
    turns = spark.createDataFrame([("s", i, f"t{i}") for i in range(5)] + [("u", 0, "other")], "session string, turn int, text string")
    saves = at(spark.createDataFrame([("s", "a", 2, 10), ("s", "a", 4, 20), ("s", "b", 3, 30)], "session string, checkpoint string, turns int, ts long"), "ts")
    asked = at(spark.createDataFrame([("n1", "s", "a", 15), ("n2", "s", "a", 20), ("n3", "s", "b", 29), ("n4", "s", "zz", 40), ("n5", "s", "b", 31)], "session string, from_session string, checkpoint string, ts long"), "ts")
    made, failed = sessions.restore(turns, saves, asked)
    got = {}
    for r in made.orderBy("session", "turn").collect():
        got.setdefault(r.session, []).append(r.text)
    assert got == {"n1": ["t0", "t1"], "n2": ["t0", "t1", "t2", "t3"], "n5": ["t0", "t1", "t2"]}
    assert sorted((r.session, r.error) for r in failed.collect()) == [("n3", 'session "s" has no checkpoint "b"'), ("n4", 'session "s" has no checkpoint "zz"')]
    assert [r.checkpoint for r in sessions.listing(saves, "s", [F.desc("ts")], 2).collect()] == ["b", "a"]


def test_capacity_is_filled_from_the_fallback(spark):
    one = spark.createDataFrame([("a", "", 0, 5), ("b", "gpu", 3, None)], "backend string, device string, count int, used int")
    two = spark.createDataFrame([("a", "cpu", 2, 9, "n"), ("c", "tpu", 1, 1, None)], "backend string, device string, count int, used int, notes string")
    got = {r.backend: tuple(r)[1:] for r in sessions.merge_capacity(one, two, ["backend"]).select("backend", "device", "count", "used", "notes").collect()}
    assert got == {"a": ("cpu", 2, 5, "n"), "b": ("gpu", 3, None, None), "c": ("tpu", 1, 1, None)}


def test_the_first_complete_groups(spark):
    rows = [(g, layer, 2, 1, 4, "last") for g in ("d", "a", "c", "b") for layer in (0, 1) if (g, layer) != ("b", 1)]
    df = spark.createDataFrame(rows, "g string, layer int, heads int, kv_heads int, head_dim int, token_position string")
    profile = spark.createDataFrame([(0, 2, 1, 4), (1, 2, 1, 4)], "layer int, heads int, kv_heads int, head_dim int")
    for n, want in ((0, ["a", "c", "d"]), (2, ["a", "c"]), (9, ["a", "c", "d"])):
        assert sorted({r.g for r in captures.complete_groups(df, profile, ["g"], None, n).collect()}) == want


def test_small_readers_and_columns(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"n_prompt": 8, "n_gen": 0, "avg_ts": 2.5, "samples_ts": [2.0, 3.0]}, {"n_prompt": 8, "n_gen": 4}, {"n_gen": 4, "other": 1}, {}]))
    assert [(r.kind, r.n_prompt, r.avg_ts) for r in reports.read_bench(spark, str(tmp_path / "b.json")).collect()] == [("pg", 8, None), ("pp", 8, 2.5), ("tg", None, None), ("unknown", None, None)]
    (tmp_path / "p.txt").write_text(" one\ntwo\r\n\r\n\n  \nthree ")
    (tmp_path / "q.txt").write_text('["a", " ", " b "]')
    assert [(r.prompt_index, r.prompt) for r in reports.read_prompts(spark, str(tmp_path / "p.txt")).collect()] == [(0, "one\ntwo"), (1, "three")]
    assert [r.prompt for r in reports.read_prompts(spark, str(tmp_path / "q.txt")).collect()] == ["a", "b"]
    df = spark.createDataFrame([([" a ", "", None, "b"], " x\nyé\n")], "s array<string>, t string").select(c.clean_strings("s").alias("s"), *(c.preview_text("t", n).alias(f"p{n}") for n in (9, 4, 2, 0)))
    r = df.first()
    assert r.s == ["a", "b"] and (r.p9, r.p4, r.p2, r.p0) == ("x yé", "x...", "x ", "")


def test_event_listings(spark):
    events = spark.createDataFrame([("s", i) for i in range(700)], "session string, event_id long").withColumn("ts", F.timestamp_seconds("event_id"))
    log = sessions.event_log(events)
    assert log.count() == 512 and log.agg(F.min("seq")).first()[0] == 189
    page = lambda *a: [r.seq for r in sessions.list_events(log, "s", *a).collect()]
    assert page() == list(range(189, 289)) and page(690) == list(range(691, 701)) and page(0, 3) == [189, 190, 191] and len(page(0, 9999)) == 512 and page(700) == []


def test_indices_and_dense_products(spark):
    rng = np.random.default_rng(6)
    x, spec = rng.normal(size=(20, 6)), QuantizerSpec(6, 3, 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    made = encode.dequantize_indices(encode.indices(df, spec), spec).orderBy("id").toPandas()
    cells, norm = codes.indices(x, spec)
    assert (np.stack(made.cells) == cells).all() and np.allclose(made.norm, norm) and np.allclose(np.stack(made.recon), codes.reconstruct(cells, spec))
    with pytest.raises(Exception, match="an index is not from 0 to 7"):
        encode.dequantize_indices(spark.createDataFrame([([0, 1, 2, 3, 4, 8],)], "cells array<int>"), spec).collect()
    w = rng.normal(size=(6, 4))
    assert np.allclose(np.stack(encode.matmul(df, w).orderBy("id").toPandas()["product"]), x @ w)
    with pytest.raises(ValueError, match="isn't broadcast"):
        encode.matmul(df, np.zeros((1 << 12, 1 << 12)))


def test_a_removal_without_an_entity_is_no_silent_loss(spark, tmp_path):
    rows = spark.createDataFrame([("s", None, "a", "exclusive", "remove", 1)], "session string, entity string, agent string, mode string, action string, event_id long").withColumn("ts", F.timestamp_seconds("event_id"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = sessions.claim_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="a removal has to name its entity"):
        q.awaitTermination(120)
