"""Streams against the batch forms of the same operators: several batches, restarts, late rows, timers."""

import os

import numpy as np
from pyspark.sql import functions as F

from vecspark.functions import codes
from vecspark.functions.spec import VALUE_SEED, ProductSpec, QuantizerSpec, derived_seed
from vecspark.operators import turns
from vecspark.streaming import collaboration, requests, sessions


class Feed:
    """A table that comes as a stream, a file a batch; a query is stopped and resumed as often as files are added."""

    def __init__(self, spark, folder, schema):
        self.spark, self.path, self.schema, self.folder = spark, str(folder / "in"), schema, folder
        os.makedirs(self.path)

    def add(self, df):
        df.coalesce(1).write.mode("append").parquet(self.path)

    def stream(self, watermark=None):
        out = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)
        return out.withWatermark("ts", watermark) if watermark else out

    def run(self, df, name):
        """All that the stream has given, over all its restarts."""
        out, at = str(self.folder / f"out_{name}"), str(self.folder / f"at_{name}")
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
        return self.spark.read.schema(df.schema).parquet(out)


def actions(spark, n=240):
    rng = np.random.default_rng(11)
    kinds = rng.choice(["claim", "claim", "claim", "release", "upsert", "remove"], n)
    rows = [(f"s{rng.integers(2)}", i, 1_700_000_000 + 7 * i + int(rng.integers(5)), str(k), f"e{rng.integers(4)}" if k in ("claim", "release") else None, f"a{rng.integers(3)}", ["exclusive", "shared", "", None][rng.integers(4)], "busy" if i % 2 else " ") for i, k in enumerate(kinds)]
    rows += [(f"s{i}", n + i, 1_700_000_000 + 7 * n + 3600, "upsert", None, "a9", None, None) for i in range(2)]  # much later: the watermark passes all before
    df = spark.createDataFrame(rows, "session string, event_id long, sec long, action string, entity string, agent string, mode string, status string")
    return df.withColumn("ts", F.timestamp_seconds("sec")).drop("sec").cache()


def test_claims_and_agents_as_one_stream(spark, tmp_path):
    all_actions, ttl = actions(spark), 90.0
    feed = Feed(spark, tmp_path, all_actions.schema)
    for part in range(3):
        feed.add(all_actions.where((F.col("event_id") >= 80 * part) & (F.col("event_id") < 80 * part + (80 if part < 2 else 90))))
        if part > 0:  # the second run goes on from the first one's checkpoint
            got = feed.run(collaboration.collaborate(feed.stream("1 minute"), ttl), "both").cache()
    outcomes = got.where("kind = 'outcome'")
    plain = all_actions.where("action <> 'upsert'")
    want = sessions.claims(plain, ttl)
    key = lambda df: sorted((r.session, r.event_id, r.entity, r.agent, r.outcome) for r in df.select("session", "event_id", "entity", "agent", "outcome").collect())
    asked = outcomes.where("type in ('claim', 'release') or (type = 'remove' and outcome <> 'absent')")
    assert key(asked) == key(want.where("action <> 'remove' or outcome <> 'absent'")) and asked.count() > 120
    # Agents: those that are there in the end, and since when.
    seen = {}
    for r in sorted(all_actions.collect(), key=lambda r: (r.ts, r.event_id)):
        if r.action == "upsert":
            seen.setdefault((r.session, r.agent), r.ts)
        elif r.action == "remove":
            seen.pop((r.session, r.agent), None)
    joined = {(r.session, r.agent): r.ts for r in outcomes.where("outcome = 'joined'").orderBy("ts").collect()}
    assert {(r.session, r.agent): r.created_at for r in sessions.presence(all_actions.where("action in ('upsert', 'remove')")).collect()} == seen
    assert all(joined[k] == v for k, v in seen.items())
    # Events: numbered without a gap, in order; the ones of claims are those of the batch form.
    events = got.where("kind = 'event'")
    for s in ("s0", "s1"):
        assert sorted(r.seq for r in events.where(F.col("session") == s).collect()) == list(range(1, events.where(F.col("session") == s).count() + 1))
    claim = lambda df: sorted((r.session, r.event_id, r.type, r.agent, r.entity, r.summary) for r in df.select("session", "event_id", "type", "agent", "entity", "summary").collect())
    assert claim(events.where("type like 'claim%'")) == claim(sessions.claim_events(want))
    # What the watermark has passed is let go of by timers, each claim once after it was last renewed.
    gone = outcomes.where("outcome = 'expired'").collect()
    assert gone and all(r.event_id is None for r in gone)
    ring = collaboration.ring_of(spark, str(tmp_path / "at_both"))
    assert sorted((r.session, r.seq, r.type) for r in ring.collect()) == sorted((r.session, r.seq, r.type) for r in events.collect())


def test_an_idle_agent_lets_go(spark, tmp_path):
    rows = [(0, 0, "upsert", None, "a"), (1, 1, "claim", "e", "a"), (2, 2, "claim", "f", "a"), (3, 3, "upsert", None, "b"), (4, 300, "upsert", None, "b"), (5, 301, "claim", "e", "b"), (6, 900, "upsert", None, "b")]
    df = spark.createDataFrame([("s", *r, None, None) for r in rows], "session string, event_id long, sec long, action string, entity string, agent string, mode string, status string").withColumn("ts", F.timestamp_seconds(F.col("sec") + 1000)).drop("sec")
    feed = Feed(spark, tmp_path, df.schema)
    for some in ("event_id < 4", "event_id = 4", "event_id = 5", "event_id = 6"):
        feed.add(df.where(some))
        got = feed.run(collaboration.collaborate(feed.stream("1 second"), idle=100.0), "idle")
    rows = [(r.type, r.agent, r.entity, r.outcome) for r in got.where("kind = 'outcome' and (event_id is null or event_id in (5, 6))").collect()]
    assert sorted(rows, key=str) == sorted([("expire", "a", None, "left"), ("expire", "a", "e", "released"), ("expire", "a", "f", "released"), ("claim", "b", "e", "acquired"), ("expire", "b", None, "left"), ("expire", "b", None, "left"), ("expire", "b", "e", "released"), ("upsert", "b", None, "joined")], key=str)
    assert [r.summary for r in got.where("type = 'claim.release'").collect()] == ["agent_removed"] * 3


def test_event_log_survives_restarts(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 3).cast("string").alias("session"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("agent"), F.lit(None).cast("string").alias("entity"), F.lit("").alias("summary"))
    feed = Feed(spark, tmp_path, events.schema)
    cuts = events.agg(F.percentile_approx(F.unix_micros("ts"), F.array(F.lit(0.3), F.lit(0.7))).alias("cuts")).first().cuts
    at = F.unix_micros("ts")
    for low, high in ((None, cuts[0]), (cuts[0], cuts[1]), (cuts[1], None)):
        feed.add(events.where((at > low if low is not None else F.lit(True)) & (at <= high if high is not None else F.lit(True))))
        got = feed.run(collaboration.keep_events(feed.stream(), keep=40), "log")
    want = {(r.session, r.event_id): r.seq for r in sessions.event_log(events, 1 << 30).collect()}
    assert {(r.session, r.event_id): r.seq for r in got.collect()} == want and len(want) == events.count()
    ring = collaboration.ring_of(spark, str(tmp_path / "at_log")).collect()
    assert {(r.session, r.event_id, r.seq) for r in ring} == {(r.session, r.event_id, r.seq) for r in sessions.event_log(events, 40).collect()} and len(ring) == 120


def test_sync_is_the_batch_action(spark):
    rng = np.random.default_rng(4)
    lists = [[("user", str(x)) for x in rng.integers(0, 3, rng.integers(0, 5))] for _ in range(120)]
    pairs = [(a, b) for a, b in zip(lists, lists[1:]) if b]
    kind = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame(pairs, f"old {kind}, new {kind}").select("old", "new", turns.sync_action("old", "new").alias("s"))
    for r in df.collect():
        assert collaboration.sync([tuple(x) for x in r.old], [tuple(x) for x in r.new]) == (r.s.action, r.s.append)


def test_recall_from_stored_turns(spark, sf, tmp_path):
    """Each conversation comes in two requests: its first turns, then all; what is recalled then is the batch form's."""
    table = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("text", F.trim("text")).where("text <> ''").withColumn("conv_id", F.col("conv_id").cast("string"))
    table = table.withColumn("role", F.lower(F.trim("role")))
    order = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    whole = table.groupBy("conv_id").agg(order.alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), F.transform("m", lambda x: x["turn"]).alias("numbers"))
    first = whole.select("conv_id", F.lit(1).cast("long").alias("event_id"), F.timestamp_seconds(F.lit(1)).alias("ts"), F.slice("messages", 1, F.greatest(F.floor(F.size("messages") / 2).cast("int"), F.lit(1))).alias("messages"))
    second = whole.select("conv_id", F.lit(2).cast("long").alias("event_id"), F.timestamp_seconds(F.lit(2)).alias("ts"), "messages")
    feed = Feed(spark, tmp_path, first.schema)
    for part in (first, second):
        feed.add(part)
        got = feed.run(collaboration.converse(feed.stream(), 64), "talk")
    rows = {r.conv_id: r for r in got.where("event_id = 2").collect()}
    numbers = {r.conv_id: r.numbers for r in whole.select("conv_id", "numbers").collect()}
    assert all(r.action in ("extend", "none") and r.turns == len(numbers[c]) for c, r in rows.items())
    want = {}
    for r in turns.recall(table, 4, 64).orderBy("conv_id", "rank").collect():
        want.setdefault(r.conv_id, []).append((r["rank"], r.turn, r.role, r.score))
    have = {c: [(m["rank"], numbers[c][m.turn], m.role, m.score) for m in r.memories] for c, r in rows.items() if r.memories}
    assert have.keys() == want.keys()
    for c in want:
        assert [x[:3] for x in have[c]] == [x[:3] for x in want[c]] and np.allclose([x[3] for x in have[c]], [x[3] for x in want[c]], atol=2e-6)
    focus = {r.conv_id: r.focus_norm for r in turns.focus(table, 4, 64).collect()}
    assert focus.keys() == rows.keys() and all(abs(focus[c] - rows[c].focus_norm) < 1e-5 for c in focus)


def test_focus_against_a_plain_run(spark):
    texts = ["red green", "blue", "red red", "green"]
    df = spark.createDataFrame([("c", i, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)], "conv_id string, turn long, role string, text string")
    keys, values = ProductSpec(32, 3, 42), QuantizerSpec(32, 2, derived_seed(42, VALUE_SEED))
    vec = lambda t, i, lane: turns.hashed_vectors([t.split()], [i], 32, lane)
    k = np.vstack([vec(t, i, 0) for i, t in enumerate(texts)])
    v = np.vstack([vec(t, i, 1) for i, t in enumerate(texts)])
    score = codes.product_scores(*codes.encode_product(k, keys), vec("green", 4, 0), keys)[:, 0]
    cells, norm = codes.indices(v, values)
    best = np.argsort(-np.round(score, 6), kind="stable")[:2]
    w = np.exp(score[best]) / np.exp(score[best]).sum()
    want = np.linalg.norm(w @ (codes.reconstruct(cells, values) * norm[:, None])[best])
    assert abs(turns.focus(df, 2, 32).first().focus_norm - want) < 1e-6


def test_turns_are_rebuilt_and_added(spark, tmp_path):
    kind = "conv_id string, event_id long, ts timestamp, messages array<struct<role:string,content:string>>"
    say = lambda *x: [("user", t) for t in x]
    steps = [say("a", "b", "c"), say("a", "b", "c"), say("b", "c", "d"), say("x"), say("p", "q", "r"), say(" ", ""), say("q", "r", "s")]
    df = spark.createDataFrame([("c", i, m) for i, m in enumerate(steps)], "conv_id string, event_id long, messages array<struct<role:string,content:string>>").select("conv_id", "event_id", F.timestamp_seconds("event_id").alias("ts"), "messages")
    feed = Feed(spark, tmp_path, spark.createDataFrame([], kind).schema)
    for some in ("event_id < 3", "event_id in (3, 4)", "event_id > 4"):
        feed.add(df.where(some))
        got = feed.run(collaboration.converse(feed.stream(), 32), "talk")
    assert [(r.action, r.append, r.turns) for r in got.orderBy("event_id").collect()] == [("extend", 3, 3), ("none", 0, 3), ("extend", 1, 4), ("add", 1, 5), ("rebuild", 3, 3), ("none", 0, 3), ("extend", 1, 4)]


REQUESTS = "event_id long, ts timestamp, model string, endpoint string, backend string, status int"


def some_requests(spark):
    rows = [(i, 1_700_000_000 + 20 * i, ["m1", "m2", "m3", "none", " ", None][i % 6], ["chat", "", None][i % 3], ["b", None][i % 2], [200, 401, 404, 503][i % 4]) for i in range(120)]
    return spark.createDataFrame(rows, "event_id long, sec long, model string, endpoint string, backend string, status int").select("event_id", F.timestamp_seconds("sec").alias("ts"), "model", "endpoint", "backend", "status").cache()


def test_counts_of_a_stream_with_late_rows_and_restarts(spark, tmp_path):
    rows = some_requests(spark)
    feed = Feed(spark, tmp_path, rows.schema)
    path, at = str(tmp_path / "counts"), str(tmp_path / "at_counts")
    for some in ("event_id between 40 and 79", "event_id >= 80", "event_id < 40"):  # the last ones are late by an hour
        feed.add(rows.where(some))
        q = requests.count_into(feed.stream(), path).option("checkpointLocation", at).trigger(availableNow=True).start()
        q.awaitTermination(300)
    want = requests.counts(rows)
    assert sorted(map(str, requests.counted(spark, path).collect())) == sorted(map(str, want.collect()))
    # The last batch again, as after a failure between its write and its commit: counts stay.
    last = max(int(x.removeprefix("batch=")) for x in os.listdir(path) if x.startswith("batch="))
    requests.replaced(requests.counts(rows.where("event_id < 40")), path, last)
    assert requests.totals(requests.counted(spark, path)).first().asDict() == {"requests": 120, "unauthorized": 30, "client_errors": 30, "server_errors": 30}
    by_endpoint = {r.endpoint: r.requests for r in sessions.request_counts(rows.withColumn("endpoint", F.coalesce(F.nullif("endpoint", F.lit("")), F.lit("unknown")))).collect()}
    assert {r.endpoint: r.n for r in requests.counted(spark, path).groupBy("endpoint").agg(F.sum("requests").alias("n")).collect()} == by_endpoint
    assert requests.totals(want.where("false")).first().asDict() == {"requests": 0, "unauthorized": 0, "client_errors": 0, "server_errors": 0}


def test_windows_of_a_stream(spark, tmp_path):
    rows = some_requests(spark)
    feed = Feed(spark, tmp_path, rows.schema)
    for some in ("event_id < 60 and event_id <> 7", "event_id >= 60", "event_id = 7"):  # the last one comes when its window is closed
        feed.add(rows.where(some))
        got = feed.run(requests.windows(feed.stream(), "5 minutes", "2 minutes"), "windows")
    have = sorted(map(str, got.collect()))
    end = rows.agg(F.max("ts")).first()[0]
    whole = requests.windows(rows.where("event_id <> 7"), "5 minutes").where(F.col("began") + F.expr("interval 7 minutes") <= F.lit(end))
    assert have == sorted(map(str, whole.collect())) and len(have) > 20


ROUTES = [("m1", "b1", "real-1"), ("m2", "b1", None), ("m3", "gone", None)]


def test_routes(spark, tmp_path):
    rows = some_requests(spark)
    routes, backends = spark.createDataFrame(ROUTES, "model string, backend string, backend_model string"), spark.createDataFrame([("b1",), ("b2",)], "backend string")
    plain = rows.drop("backend")
    want = {"m1": ("b1", "real-1", None), "m2": ("b1", "m2", None), "m3": (None, None, 'backend "gone" is unavailable'), "none": (None, None, 'unknown model "none"'), " ": (None, None, "a model is required"), None: (None, None, "a model is required")}
    out = requests.routed(plain, routes, backends)
    assert out.count() == 120 and all((r.backend, r.backend_model, r.route_error) == want[r.model] for r in out.collect())
    free = requests.routed(plain).collect()
    assert all((r.backend, r.backend_model) == (("default", r.model) if (r.model or "").strip() else (None, None)) for r in free)
    assert requests.routed(plain, routes).where("model = 'm3'").first().backend == "gone"
    feed = Feed(spark, tmp_path, plain.schema)
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    for some in ("event_id < 50", "event_id >= 50"):
        feed.add(plain.where(some))
        q = requests.split(lambda b: requests.routed(b, routes, backends), feed.stream(), good, bad).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination(300)
    sides = spark.read.parquet(good).drop("batch"), spark.read.parquet(bad).drop("batch")
    assert sorted(map(str, sides[0].collect())) == sorted(map(str, out.where("route_error is null").drop("route_error").select(sides[0].columns).collect()))
    assert sorted(map(str, sides[1].collect())) == sorted(map(str, out.where("route_error is not null").select(sides[1].columns).collect()))
    assert set(sides[1].columns) == {"event_id", "ts", "model", "endpoint", "status", "route_error"}
