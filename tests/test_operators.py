import json
import re
from math import e

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import codes
from vecspark.functions import columns as c
from vecspark.operators import allocation, attention, encode, search, sweep, turns
from vecspark.operators.search import QuantizedIndex
from vecspark.functions.spec import ProductSpec, QuantizerSpec
from vecspark.plans import catalogue
from vecspark.sources import captures, reports
from vecspark.streaming import sessions

HI, LO = e / (e + 1), 1 / (e + 1)


def capture(**more):
    return {"name": "x", "heads": 1, "head_dim": 2, "query": [1, 0], "keys": [1, 0, 0, 1], "values": [2, 0, 0, 4], "query_scale": 1.0} | more


def read(spark, tmp_path, *objects):
    for i, o in enumerate(objects):
        (tmp_path / f"{i}.json").write_text(json.dumps(o))
    return captures.read_captures(spark, str(tmp_path))


def outputs(df):
    return [r.output for r in df.orderBy("head", "coordinate").collect()]


def test_attention_in_closed_form(spark, tmp_path):
    found = read(spark, tmp_path, capture())
    assert found.first().capture_error is None and found.first().tokens == 2
    assert outputs(captures.reference_attention(found, ["name"])) == pytest.approx([2 * HI, 4 * LO], abs=1e-5)


def test_grouped_heads_in_closed_form(spark, tmp_path):
    given = capture(heads=4, kv_heads=2, query=[0, 1, 1, 0, 1, 0, 0, 1], keys=[1, 0, 0, 1, 0, 1, 1, 0], values=[6, 2, 1, 5, 3, 9, 7, 4])
    found = read(spark, tmp_path, {"samples": [given], "other": 1})
    want = [6 * LO + 3 * HI, 2 * LO + 9 * HI, 6 * HI + 3 * LO, 2 * HI + 9 * LO, LO + 7 * HI, 5 * LO + 4 * HI, HI + 7 * LO, 5 * HI + 4 * LO]
    assert outputs(captures.reference_attention(found, ["name"])) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("more,error", [({"heads": 0}, "no heads"), ({"keys": [1, 0, 0]}, "keys have another length"), ({"query": [1]}, "query has another length"), ({"heads": 3, "kv_heads": 2}, "heads is no multiple of kv_heads")])
def test_bad_captures(spark, tmp_path, more, error):
    assert read(spark, tmp_path, capture(**more)).first().capture_error == error


def test_empty_list_and_neither_form(spark, tmp_path):
    assert read(spark, tmp_path, {"samples": []}).count() == 0
    with pytest.raises(Exception, match="neither"):
        read(spark, tmp_path, {"other": 1}).collect()


@pytest.mark.parametrize("method", ["primary", "uniform"])
def test_evaluate(spark, tmp_path, method):
    given = capture(heads=2, head_dim=4, query=[0.1, 0.9, -0.3, 0.2] * 2, keys=[0.5, -0.2, 0.3, 0.9] * 6, values=[0.4, 0.1, 0.2, 0.7] * 6, query_scale=0.5)
    found = read(spark, tmp_path, given)
    (row,) = captures.evaluate(found, ["name"], 8, 8, 4, 2, method=method, capacity=5).collect()
    assert 0 <= row.output_mse < 0.01 and row.output_cosine > 0.99 and [h.head for h in row.heads_metrics] == [0, 1]
    assert (row.tokens, row.requested_top_k, row.top_k, row.capacity, row.raw_kv_bytes) == (3, 2, 2, 5, 192)
    one = attention.entry_bytes(4, 8, 8) if method == "primary" else attention.uniform_bytes(4, 8, 8)
    assert (row.cache_live_bytes, row.cache_storage_bytes) == (6 * one, 10 * one) and row.compression_ratio == pytest.approx(192 / (10 * one))
    assert all(h.exact_norm > 0 and h.quant_norm > 0 and h.output_mse >= 0 for h in row.heads_metrics)


def test_sweep_of_a_sample(spark, tmp_path):
    given = capture(heads=1, kv_heads=1, head_dim=4, query=[0.1, 0.9, -0.3, 0.2], keys=[0.5, -0.2, 0.3, 0.9] * 3, values=[0.4, 0.1, 0.2, 0.7] * 3)
    got = captures.sweep(read(spark, tmp_path, given), ["name"], 4, [2, 3], [2], [1, 2], ("primary", "uniform")).collect()
    assert sorted((r.method, r.key_bits, r.value_bits, r.top_k) for r in got) == sorted((m, kb, 2, k) for m in ("primary", "uniform") for kb in (2, 3) for k in (1, 2))


def test_complete_groups(spark):
    rows = [(g, layer, 4, 2, 8, pos) for g, layers, pos in (("a", [0, 3], "last"), ("b", [0], "last"), ("c", [0, 3, 9], "25%")) for layer in layers]
    df = spark.createDataFrame(rows, "prompt string, layer int, heads int, kv_heads int, head_dim int, token_position string")
    profile = spark.createDataFrame([(0, 4, 2, 8), (3, 4, 2, 8)], "layer int, heads int, kv_heads int, head_dim int")
    assert sorted((r.prompt, r.layer) for r in captures.complete_groups(df, profile, ["prompt"]).collect()) == [("a", 0), ("a", 3), ("c", 0), ("c", 3)]
    assert {r.prompt for r in captures.complete_groups(df, profile, ["prompt"], ["quarter"]).collect()} == {"c"}
    with pytest.raises(Exception, match="two captures"):
        captures.complete_groups(df.union(df.where("prompt = 'a' and layer = 0")), profile, ["prompt"]).collect()
    with pytest.raises(Exception, match="another shape"):
        captures.complete_groups(df, profile.withColumn("head_dim", F.lit(16)), ["prompt"]).collect()


def test_layer_selectors():
    assert captures.layers_of("all", 3) == [0, 1, 2] and captures.layers_of("spread:3", 9) == [0, 4, 8] and captures.layers_of("0,-1, 0", 5) == [0, 4] and captures.layers_of("spread:9", 4) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        captures.layers_of("7", 5)


def cases_of(rows):
    return [(layer, "primary", kb, vb, 8, "last", 64, mse, cosine, 2000, size, 4, 2, 16) for layer, kb, vb, mse, cosine, size in rows]


CASE = "layer int, method string, key_bits int, value_bits int, top_k int, position string, tokens int, output_mse double, output_cosine double, raw_bytes long, storage_bytes long, heads int, kv_heads int, head_dim int"


def test_profiles_by_mode(spark):
    rows = cases_of([(0, 2, 2, 9.0, 0.7, 90), (0, 4, 4, 4.0, 0.92, 160), (1, 2, 2, 21.0, 0.66, 70), (1, 4, 4, 5.0, 0.93, 140)])
    other = [(0, " Uniform ", 8, 8, 8, "last", 64, 0.0, 1.0, 2000, 1, 4, 2, 16), (0, None, 2, 2, 8, "first", 64, 11.0, 0.5, 2000, 90, 4, 2, 16)]
    df = spark.createDataFrame(rows + other, CASE)
    found = allocation.candidates(df, "primary", ["last"])
    assert {(r.layer, r.key_bits, r.cases) for r in found.collect()} == {(0, 2, 1), (0, 4, 1), (1, 2, 1), (1, 4, 1)} and allocation.candidates(df, "primary").where("cases = 2").count() == 1

    def bits(**limits):
        got = allocation.select_profile(found, **limits)
        return [r.key_bits for r in got.orderBy("layer").collect()], got.first().mode

    assert bits() == ([4, 4], "best-mse") and bits(mean_cosine=0.68) == ([2, 4], "fidelity-floor")
    assert bits(max_storage=235) == ([2, 4], "budgeted") and bits(min_compression=4000 / 235) == ([2, 4], "budgeted") and bits(max_storage=400, mean_cosine=0.68) == ([4, 4], "budgeted-fidelity-floor")
    total = allocation.allocation_summary(allocation.select_profile(found)).first()
    assert (total.layers, total.samples, total.mean_mse, total.raw_bytes, total.storage_bytes) == (2, 2, 4.5, 4000.0, 300.0) and total.compression == pytest.approx(4000 / 300)
    made = allocation.layer_profiles(allocation.select_profile(found), 42, 512).orderBy("layer").collect()
    assert [r.capacity for r in made] == [512, 512] and len({r.seed for r in made}) == 2
    with pytest.raises(Exception, match="differ in heads"):
        allocation.candidates(df.union(spark.createDataFrame([(*rows[0][:-3], 8, 2, 16)], CASE))).collect()


def test_token_index(spark):
    rows = spark.createDataFrame([("first", 9, 0), ("last", 9, 8), ("middle", 9, 4), ("50%", 9, 4), ("-1", 9, 8), ("3", 9, 3), ("10", 9, None), ("-10", 9, None), ("x", 9, None)], "s string, n int, want int")
    assert all(r.got == r.want for r in rows.withColumn("got", captures.token_index("s", "n")).collect())


def test_frontier_keeps_equal_rows(spark):
    rows = [(3, 2, 64.0, 7.0, 0.71), (4, 2, 80.0, 7.5, 0.7), (4, 4, 96.0, 3.0, 0.9), (5, 4, 96.0, 3.0, 0.9), (2, 2, 64.0, 8.0, 0.75)]
    df = spark.createDataFrame(rows, "kb int, vb int, mean_storage double, mean_mse double, mean_cosine double")
    assert sorted((r.kb, r.vb) for r in sweep.frontier(df).collect()) == [(3, 2), (4, 4), (5, 4)]


def test_frontier_of_equal_values_in_any_order(spark):
    """Two configurations of the same values, one of them larger: by sums of doubles it would depend on the order which one is more exact."""
    values = [0.1, 1e16, 0.2, -1e16, 0.3, 1e-9, 0.7, 3.0]
    rows = []
    for n, (bits, order, size) in enumerate([(2, values, 64), (3, values[::-1], 64), (4, sorted(values), 80), (5, sorted(values, key=abs), 80)]):
        rows += [(100 * n + i, "primary", bits, 2, 8, x, x, 65536, size, 0, 128, "first") for i, x in enumerate(order)]
    df = spark.createDataFrame(rows, "sample long, method string, key_bits int, value_bits int, top_k int, output_mse double, output_cosine double, raw_bytes long, storage_bytes long, layer int, tokens int, position string").coalesce(1)
    assert len({(r.mean_mse, r.mean_cosine) for r in sweep.summary(df).collect()}) == 1
    assert sorted(r.key_bits for r in sweep.frontier(sweep.summary(df)).collect()) == [2, 3]
    assert [r.key_bits for r in allocation.skyline(allocation.candidates(df)).collect()] == [2]


def test_steady_means(spark):
    import math

    rng = np.random.default_rng(5)
    wide = (rng.normal(size=400) * 10.0 ** rng.integers(-300, 300, 400)).tolist()
    groups = {"a": wide, "b": rng.random(500).tolist(), "c": [0.0, 0.0, None], "d": [1.0, math.inf], "e": [math.nan, 1.0], "f": [None], "g": [5e-324, 0.0, 5e-324], "h": [-1.5, 2.0**-30], None: [1.0, 2.0]}
    df = spark.createDataFrame([(g, x) for g, own in groups.items() for x in own], "g string, x double")
    got = {r.g: r.m for r in sweep.steady_means(df, ["g"], {"x": "m"}).collect()}
    for g in ("a", "b", "c", "h", None):
        own = [x for x in groups[g] if x is not None]
        assert got[g] == pytest.approx(math.fsum(own) / len(own), rel=1e-15, abs=0)
    assert got.keys() == groups.keys() and got["d"] == math.inf and math.isnan(got["e"]) and got["f"] is None and 0 <= got["g"] < 1e-300
    kept = sweep.with_steady_means(df.groupBy("g").count(), df, ["g"], {"x": "m"}).collect()
    assert {(r.g, r["count"]) for r in kept} == {(g, len(own)) for g, own in groups.items()}


def test_grid_and_lists(spark):
    assert sweep.ordered_unique("9, 3, 9, 5") == [9, 3, 5]
    assert sweep.grid(spark.range(1), ["primary"], [2, 3], [2], [1, 2]).count() == 4


def test_allocation_under_budget(spark):
    rows = [(0, 2, 2, 0, 8.0, 90.0), (0, 4, 4, 0, 3.0, 170.0), (1, 2, 2, 0, 15.0, 60.0), (1, 4, 4, 0, 2.0, 130.0)]
    found = spark.createDataFrame(rows, "layer int, key_bits int, value_bits int, top_k int, mean_mse double, storage_bytes double").withColumn("mean_cosine", F.lit(0.9))
    budgets = spark.createDataFrame([("b", 230.0), ("free", None)], "set string, budget double")
    got = {(r.set, r.layer): r.key_bits for r in allocation.allocate(found, budgets).collect()}
    assert got == {("b", 0): 2, ("b", 1): 4, ("free", 0): 4, ("free", 1): 4}
    assert allocation.choose([[(100, 1.0)]], 50, 1) is None


def test_floors_raise_for_an_empty_layer(spark):
    found = spark.createDataFrame([(0, 0.95, 0.9), (1, 0.5, 0.4)], "layer int, mean_cosine double, p05_cosine double")
    assert allocation.floors(found.where("layer = 0"), 0.9).count() == 1
    with pytest.raises(Exception, match="layer 1"):
        allocation.floors(found, 0.9).collect()


def test_expansion_prefers_the_lower_donor(spark):
    profile = spark.createDataFrame([(2, 2), (8, 4)], "layer int, bits int")
    got = {r.layer: r.donor for r in allocation.expand(profile, spark.range(10).select(F.col("id").cast("int").alias("layer"))).collect()}
    assert got == {i: 2 if i < 6 else 8 for i in range(10)}


def test_percentile_is_the_lower_rank(spark):
    assert sweep.lower_ranks(spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (0, 3.0), (0, None)], "g int, x double"), ["g"], "x", {"a": 0.95, "b": 0.5, "c": 0.0}).first() == (0, 3.0, 2.0, 1.0)


def test_append_goes_on_from_the_last_slot(spark):
    old = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "page string, slot int, x double")
    new = spark.createDataFrame([("a", 3.0), ("b", 4.0)], "page string, x double")
    got = {(r.page, r.x): r.slot for r in attention.append(old, new, ["page"], ["x"]).collect()}
    assert got == {("a", 1.0): 0, ("a", 2.0): 1, ("a", 3.0): 2, ("b", 4.0): 0}


def test_index(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(8)], "id long, v array<double>")
    index = QuantizedIndex.fit(rows.where("id < 6"), QuantizerSpec(8, 4), str(tmp_path / "codes")).append(rows.where("id >= 6"))
    asked = rows.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    assert all(r.id == r.query_id for r in index.search(asked, 3).where("rank = 1").collect())
    assert index.search(asked, 100).count() == 64
    with pytest.raises(ValueError):
        index.search(asked, 9, strict=True)


@pytest.mark.parametrize("old,new,action,n", [("ab", "ab", "none", 0), ("ab", "abc", "extend", 1), ("abc", "bcd", "extend", 1), ("abc", "x", "add", 1), ("abc", "xyz", "rebuild", 3), ("", "a", "extend", 1)])
def test_turn_sync(spark, old, new, action, n):
    row = spark.createDataFrame([(list(old), list(new))], "old array<string>, new array<string>").select(turns.sync_action("old", "new").alias("x")).first().x
    assert (row.action, row["append"]) == (action, n)


def test_texts(spark):
    one = lambda x: spark.range(1).select(x).first()[0]
    assert one(c.tokens(F.lit(" Héllo, wörld-42! "))) == ["héllo", "wörld", "42"] and one(c.tokens(F.lit(" !? "))) == ["!?"] and one(c.tokens(F.lit(" "))) == []
    assert one(c.plain_name(F.lit(" My Run #7 "))) == "my-run--7" and one(c.plain_name(F.lit("  "))) == "run"
    assert one(c.summary_text(F.lit("a  b\nc d e"), 7)) == "a b ..." and one(c.summary_text(F.lit("ééé"), 6)) == "ééé" and one(c.summary_text(F.lit("éééé"), 6)) == "é..." and one(c.preview_text(F.lit("ab\ncd"), 3)) == "ab "
    assert one(c.flat_content(F.lit('[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]'))) == "a\nb"
    assert one(c.flat_content(F.lit('"x y"'))) == "x y" and one(c.flat_content(F.lit("plain"))) == "plain"
    assert one(reports.prompts(F.lit("one\n\n two \n\n\n\n"))) == ["one", "two"] and one(reports.prompts(F.lit('["a", " b "]'))) == ["a", "b"]
    assert [one(c.bench_kind(F.lit(p), F.lit(g))) for p, g in ((1, 0), (0, 1), (1, 1), (0, 0))] == ["pp", "tg", "pg", "unknown"]


def test_log_scans_equal_plain_ones(spark):
    """Odd logs, found by one scan a kind of line, against Python's regular expressions over the whole text."""
    rng = np.random.default_rng(3)
    bits = [" KV buffer size = 1.5 MiB", "a.b", "Dev0", " ", "\n", "KV buffer size", " =  2 MiB", "llama: size = 3 MiB (x), K (f16): 1 MiB, V (q4): 2 MiB", "size = 4 MiB K (\nq8): 1e1 MiB , V ( q4 ): 2. MiB", "Final estimate: PPL = 7.5 +/- 0.25", "perplexity: 6.5", "%", ":", "+1", "MiB"]
    logs = ["".join(rng.choice(bits, rng.integers(0, 9)).tolist()) for _ in range(1500)]
    number, kind = r"([-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)", r"\(\s*([^\s()]+)\s*\)"
    names, sums = rf"([\w.+:-]+) +KV buffer size *= *{number} *MiB", rf"size *= *{number} *MiB\b[^\n]*?\bK *{kind} *: *{number} *MiB *, *V *{kind} *: *{number} *MiB"
    df = spark.createDataFrame(list(enumerate(logs)), "i int, t string").select("i", reports.perplexity(F.col("t")).alias("p"), reports.kv_memory(F.col("t")).alias("m"))
    for r in df.collect():
        final, older = re.search(rf"Final estimate: *PPL *= *{number} *\+/- *{number}", logs[r.i]), re.findall(rf"perplexity: *{number}", logs[r.i])
        assert (r.p.value, r.p.error) == ((float(final[1]), float(final[2])) if final else (float(older[-1]) if older else None, None))
        buffers, last = re.findall(names, logs[r.i], re.ASCII), (re.findall(sums, logs[r.i], re.ASCII) or [None])[-1]
        if not buffers and not last:
            assert r.m is None
            continue
        assert [(b.name, b.mib) for b in r.m.buffers] == [(n, float(x)) for n, x in buffers] and r.m.buffer == sum(float(x) for _, x in buffers)
        assert (r.m.total, r.m.key_type, r.m.k, r.m.value_type, r.m.v) == ((float(last[0]), last[1], float(last[2]), last[3], float(last[4])) if last else (0.0, None, 0.0, None, 0.0))


def test_logs_are_scanned_once_a_kind_of_line(spark, sf):
    """Each kind of line is looked for once, whatever the number of fields that are read from it."""
    plan = catalogue.log_lines(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 3


def test_logs(spark):
    log = """
llama_kv_cache_init:        Dev7 KV buffer size =   91.25 MiB
llama_kv_cache_init: size =  150.50 MiB ( 2048 cells,  10 layers,  1/1 seqs), K (f16):  100.25 MiB, V (q5_1):  50.25 MiB
[1]11.5,[2]8.25
Final estimate: PPL = 8.125 +/- 0.0625
"""
    row = spark.createDataFrame([(log,), ("nothing",), ("perplexity: 7.5e0 [1]\nperplexity: 6.25 x",)], "t string").select(reports.perplexity(F.col("t")).alias("p"), reports.kv_memory(F.col("t")).alias("m")).collect()
    assert tuple(row[0].p) == (8.125, 0.0625) and row[2].p.value == 6.25
    assert tuple(row[0].m)[:6] == (150.5, "f16", 100.25, "q5_1", 50.25, 91.25) and [tuple(b) for b in row[0].m.buffers] == [("Dev7", 91.25)] and row[1].m is None and row[1].p.value is None


def test_metric_lines(spark):
    rows = spark.createDataFrame([("/a", "x", 200), ("/a", "x", 200), ("/b", "x", 503)], "endpoint string, backend string, status int")
    got = [r.value for r in reports.metric_lines(rows, spark.createDataFrame([("s",)], "session string")).collect()]
    assert got == ["# TYPE requests_total counter", 'requests_total{endpoint="/a",backend="x",status="200"} 2', 'requests_total{endpoint="/b",backend="x",status="503"} 1', "# TYPE responses_total counter", 'responses_total{class="2xx"} 2', 'responses_total{class="5xx"} 1', "# TYPE sessions gauge", "sessions 1"]


def plain_vector(text, index, lane, dim):
    """The hashed vector by a loop over bytes."""
    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    found = [w for w in re.split(r"[^\w]|_", text.strip().lower()) if w] or ([text.strip().lower()] if text.strip() else ["_empty"])
    v = np.zeros(dim)
    for w in found:
        for step in range(4):
            v[fnv(w.encode() + bytes([index % 256, lane, step])) % dim] += -1.0 if fnv(w.encode() + bytes([lane, step, 127])) & 1 else 1.0
    return v / (np.linalg.norm(v) or 1)


def test_settle_looks_at_no_other_holder():
    """Actions on an entity with many holders don't walk over them, and give what walking over them gives."""

    class Counted(sessions.Held):
        seen = 0

        def items(self):
            for x in super().items():
                self.seen += 1
                yield x

    def plain(held, agent, mode, action, at, ttl):
        for a in [a for a, (_, when) in held.items() if ttl and at - when > ttl]:
            del held[a]
        if action == "release":
            return "released" if held.pop(agent, None) else "absent"
        others = [m for a, (m, _) in held.items() if a != agent]
        if others and (mode == "exclusive" or "exclusive" in others):
            return "conflict"
        known = agent in held
        held[agent] = mode, at
        return "renewed" if known else "acquired"

    for ttl in (0.0, 40.0):
        rng, held, want, at = np.random.default_rng(2), Counted(ttl), {}, 0.0
        for _ in range(4000):
            at += rng.random() * 2 - 0.2  # now and then late
            if rng.random() < 0.01:
                at += 30
            x = (str(rng.integers(0, 30)), str(rng.choice(["shared", "exclusive"], p=[0.8, 0.2])), str(rng.choice(["claim", "release"], p=[0.7, 0.3])), at, ttl)
            assert sessions.settle(held, *x) == plain(want, *x) and held == want
    held = Counted()
    for i in range(3000):
        assert sessions.settle(held, str(i), "shared", "claim") == "acquired"
    assert held.seen == 0


def test_hashed_vectors_of_a_long_word_take_little_memory():
    """One long word among many: memory follows the bytes of a piece, not the number of words times the longest."""
    import tracemalloc

    words = [[f"w{(i * 7 + j) % 900}" for j in range(50)] for i in range(400)]
    words[200].append("x" * 4000)
    tracemalloc.start()
    got = turns.hashed_vectors(words, [i % 3 for i in range(400)], 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    for i in (0, 200, 399):
        assert np.array_equal(got[i], turns.hashed_vectors([words[i]], [i % 3], 16)[0])


def test_hashed_vectors():
    texts = ["Hello, world", "", " !? ", "a1 b2 a1", "é 日本"]
    words = [[w for w in re.split(r"[^\w]|_", t.strip().lower()) if w] or ([t.strip().lower()] if t.strip() else []) for t in texts]
    for lane in (0, 1):
        got = turns.hashed_vectors(words, [0, 3, 300, 7, 7], 24, lane)
        assert np.allclose(got, [plain_vector(t, i, lane, 24) for t, i in zip(texts, [0, 3, 300, 7, 7])])


def test_recall_against_a_loop(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    got = {}
    for r in turns.recall(table, 4, 64).collect():
        got.setdefault(r.conv_id, []).append((r["rank"], r.turn, r.role, r.score))
    spec, want = ProductSpec(64, 3, 42), {}
    for conv, own in table.toPandas().sort_values("turn").groupby("conv_id"):
        texts, roles = own.text.tolist(), own.role.tolist()
        blank = [t.strip() == "" for t in texts]
        users = [i for i in range(len(texts)) if roles[i] == "user" and not blank[i]] or [i for i in range(len(texts)) if not blank[i]]
        if not users:
            continue
        question = texts[users[-1]]
        keys = np.array([plain_vector(t, i, 0, 64) for i, t in enumerate(texts)])
        q = plain_vector(question, len(texts), 0, 64)
        scores = np.round(codes.product_scores(*codes.encode_product(keys, spec), q[None], spec)[:, 0], 6) + 0.0
        top = sorted(range(len(texts)), key=lambda i: (-scores[i], own.turn.iloc[i]))[:4]
        kept = []
        for i in top:
            if not (roles[i].lower() == "user" and texts[i] == question.strip()) and (roles[i], texts[i], scores[i]) not in [(roles[j], texts[j], scores[j]) for j in kept]:
                kept.append(i)
        if kept:
            want[conv] = [(n + 1, int(own.turn.iloc[i]), roles[i], pytest.approx(scores[i], abs=2e-6)) for n, i in enumerate(kept)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_codes_of_bad_vectors_are_null(spark):
    spec = QuantizerSpec(4, 2, seed=1)
    rows = [(1, [1.0, 2.0, 3.0, 4.0], "kept"), (2, None, "kept"), (3, [1.0, 2.0], "kept"), (4, [1.0, None, 3.0, 4.0], "kept"), (5, [4.0, 3.0, 2.0, 1.0], "kept")]
    df = spark.createDataFrame(rows, "id long, v array<double>, other string").withColumn("packed", F.lit("old"))
    coded = encode.quantize(df, spec)
    again = encode.dequantize(encode.quantize(coded, spec), spec)
    assert coded.columns == ["id", "v", "other", "packed", "norm"] and again.columns.count("packed") == 1
    got = {r.id: r for r in again.collect()}
    assert all(got[i].packed is None and got[i].recon is None and got[i].other == "kept" for i in (2, 3, 4)) and all(len(got[i].recon) == 4 for i in (1, 5))
    product = encode.quantize_product(df, ProductSpec(4, 3, 1))
    assert {r.id for r in product.where("mse is null").collect()} == {2, 3, 4}


def test_reports(spark, tmp_path):
    case = {"method": "primary", "key_bits": 2, "value_bits": 2, "requested_top_k": 0, "top_k": 4, "output_mse": 1.0}
    (tmp_path / "r.json").write_text(json.dumps({"samples": [{"name": "a", "layer": 1, "cases": [case, case | {"requested_top_k": 9}]}]}))
    assert sorted(r.top_k for r in reports.read_report(spark, str(tmp_path / "r.json")).collect()) == [4, 9]
    (tmp_path / "p.json").write_text(json.dumps({"reports": [{"label": "x", "profiles": [{"layer": 0, "heads": 4, "kv_heads": 0}]}, {"profiles": [{"layer": 1, "heads": 2, "kv_heads": 1}]}]}))
    assert {(r.label, r.layer, r.kv_heads) for r in reports.read_profiles(spark, str(tmp_path / "p.json")).collect()} == {("x", 0, 4), ("all", 1, 1)}


def test_claims_conflict(spark):
    held = {}
    assert sessions.settle(held, "a", "exclusive", "claim") == "acquired" and sessions.settle(held, "b", "shared", "claim") == "conflict"
    assert sessions.settle(held, "a", "shared", "claim") == "renewed" and sessions.settle(held, "b", "shared", "claim") == "acquired"
    assert sessions.settle(held, "a", "", "release") == "released" and sessions.settle(held, "a", "", "release") == "absent"


def test_expiry_is_strict(spark):
    rows = spark.sql("SELECT 's' AS session, id AS event_id, timestamp_seconds(CASE id WHEN 0 THEN 0 WHEN 1 THEN 60 ELSE 121 END) AS ts FROM range(3)")
    assert [(r.run, r.requests) for r in sessions.expired_runs(rows, 60).orderBy("run").collect()] == [(1, 2), (2, 1)]


def test_streams_agree_with_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 5).cast("string").alias("session"), (F.col("event_id") % 3).cast("string").alias("entity"), F.col("user_id").cast("string").alias("agent"), F.lit("exclusive").alias("mode"), F.when(F.col("event_type") == "error", "release").otherwise("claim").alias("action"), F.col("event_type").alias("endpoint"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    for i in range(2):
        events.where(F.col("event_id") % 1000 >= 500 if i else F.col("event_id") % 1000 < 500).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(180)
        return spark.table(name)

    got = {r.event_id: r.outcome for r in run(sessions.claim_stream(stream), "append", "claims_out").collect()}
    assert got == {r.event_id: r.outcome for r in sessions.claims(events).collect()}
    seen = run(sessions.touch_stream(stream), "update", "touch_out").groupBy("session").agg(F.max("requests").alias("n"))
    assert {r.session: r.n for r in seen.collect()} == {r.session: r["count"] for r in events.groupBy("session").count().collect()}
    last = spark.table("touch_out").groupBy("session").agg(F.max_by(F.struct("created_at", "last_seen_at", "last_endpoint"), "requests").alias("x")).select("session", "x.*")
    want = sessions.touches(events).select("session", "created_at", "last_seen_at", "last_endpoint")
    second = lambda df: sorted((r.session, round(r.created_at.timestamp(), 3), round(r.last_seen_at.timestamp(), 3), r.last_endpoint) for r in df.collect())
    assert second(last) == second(want)


def test_search_by_blocks_finds_the_same(spark, sf, monkeypatch):
    """Queries too many to be broadcast, and ties at the last place."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    rows = rows.union(rows.where("id < 30").withColumn("id", F.col("id") + 10_000))
    asked = rows.where("id < 5").select(F.col("id").alias("query_id"), F.col("v").cast("array<double>").alias("q"))
    one = [tuple(r) for r in search.exact_topk(rows, asked, 7, 64).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(search, "ASKED_BYTES", 0)
    assert one == [tuple(r) for r in search.exact_topk(rows, asked, 7, 64).orderBy("query_id", "rank").collect()] and len(one) == 35
    assert all(r[2] == r[0] for r in one if r[1] == 1)


def test_claims_end_with_their_time_and_their_agent(spark):
    rows = [("s", "e", "a", "", "claim", 0), ("s", "e", "b", "shared", "claim", 50), ("s", "f", "a", "shared", "claim", 60), ("s", "e", "b", "shared", "claim", 101), ("s", None, "a", None, "remove", 110), ("s", "f", "b", "exclusive", "claim", 120), ("s", "e", "a", None, "release", 130)]
    df = spark.createDataFrame([(s, e, a, m, x, n, t) for n, (s, e, a, m, x, t) in enumerate(rows)], "session string, entity string, agent string, mode string, action string, event_id long, at long").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    out = sessions.claims(df, 100)
    got = sorted((r.event_id, r.entity, r.outcome) for r in out.collect())
    assert got == [(0, "e", "acquired"), (1, "e", "conflict"), (2, "f", "acquired"), (3, "e", "acquired"), (4, "e", "absent"), (4, "f", "released"), (5, "f", "acquired"), (6, "e", "absent")]
    assert {(r.event_id, r.type, r.summary) for r in sessions.claim_events(out).collect()} >= {(1, "claim.conflict", ""), (4, "claim.release", "agent_removed")}
    held = sessions.holders(df, out)
    assert sorted((r.entity, r.agent, r.mode) for r in held.where("agent = 'b'").collect()) == [("e", "b", "shared"), ("f", "b", "exclusive")]
    agents = sessions.presence(df.where("action = 'remove' or event_id < 2").withColumn("status", F.lit(" ")))
    assert [(r.agent, r.status) for r in agents.collect()] == [("b", "active")]
    assert [tuple(r) for r in sessions.live_counts(agents, held.where("agent = 'b'")).collect()] == [("s", 1, 2)]


def test_checkpoints(spark):
    turns_ = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 3, "c")], "session string, turn int, text string")
    saves = spark.createDataFrame([("s", "x", 1, 1), ("s", "x", 2, 5), ("s", "y", 3, 3)], "session string, checkpoint string, turns int, ts int")
    assert sorted((r.checkpoint, r.text) for r in sessions.checkpoints(turns_, saves).collect()) == [("x", "a"), ("x", "b"), ("y", "a"), ("y", "b"), ("y", "c")]


def test_turns_are_compared_as_they_are_normalised(spark):
    df = spark.sql("""SELECT array(named_struct('role', 'User ', 'content', ' hi '), named_struct('role', '', 'content', '  ')) AS old,
        array(named_struct('role', NULL, 'content', 'hi'), named_struct('role', 'assistant', 'content', 'yes')) AS new""")
    row = df.select(turns.sync_action(turns.normal_turns("old"), turns.normal_turns("new")).alias("x"), turns.normal_turns("old").alias("o")).first()
    assert tuple(row.x) == ("extend", 1) and [tuple(x) for x in row.o] == [("user", "hi")]
