"""Sessions, claims, event logs and turns: state by key, as batch windows and as streaming state.

Batch functions take whole histories; streaming ones take the same rows as a stream and keep state by session.  Rows of one
session are ordered by (ts, event_id).
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

#: How many events a session keeps, how many a listing returns by default and at most.
RING, PAGE, MOST = 512, 100, 512


def _ordered(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy("ts", "event_id")


def touches(events: DataFrame) -> DataFrame:
    """A row a session: first and last time seen, requests, and the last endpoint."""
    return events.groupBy("session").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("requests"), F.max_by("endpoint", F.struct("ts", "event_id")).alias("last_endpoint"))


def expired_runs(events: DataFrame, seconds: int) -> DataFrame:
    """Sessions start anew when more than `seconds` passed since the last touch: session, run (from 1), created_at, last_seen_at, requests."""
    before = F.lag("ts").over(_ordered("session"))
    new = before.isNull() | (F.col("ts") > before + F.make_dt_interval(secs=F.lit(seconds)))
    runs = events.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(_ordered("session")))
    return runs.groupBy("session", "run").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("requests"))


def live_sessions(sessions: DataFrame, most: int) -> DataFrame:
    """The `most` sessions seen last; ties go to the smaller id. A top-k, not a sort of all."""
    return sessions.orderBy(F.desc("last_seen_at"), "session").limit(most)


def event_log(events: DataFrame, keep: int = RING) -> DataFrame:
    """events with seq, counted from 1 in each session; only each session's last `keep` stay.

    The last ones are found by their rank from the end, a limit that tasks apply before the shuffle; counts add up to the seq.
    """
    back = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("event_id"))
    last = events.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= keep)
    counts = events.groupBy("session").agg(F.count("*").alias("_n"))
    return last.join(counts, "session").withColumn("seq", (F.col("_n") - F.col("_back") + 1).cast("long")).drop("_n", "_back")


def list_events(log: DataFrame, session, after: int = 0, limit: int = 0) -> DataFrame:
    """A session's events behind a seq, oldest first: at most PAGE, or `limit` up to MOST."""
    return log.where((F.col("session") == session) & (F.col("seq") > after)).orderBy("seq").limit(min(limit, MOST) if limit > 0 else PAGE)


def request_counts(events: DataFrame) -> DataFrame:
    """Requests by endpoint, and how many of them failed by class of status (401, other 4xx, 5xx)."""
    s = F.col("status")
    return events.groupBy("endpoint").agg(F.count("*").alias("requests"), F.count_if(s == 401).alias("unauthorized"), F.count_if(s.between(400, 499) & (s != 401)).alias("client_errors"), F.count_if(s >= 500).alias("server_errors"))


_RESULT = "session string, event_id long, entity string, agent string, action string, outcome string"
_RESULT_TYPE = StructType([StructField("session", StringType()), StructField("event_id", LongType()), *[StructField(n, StringType()) for n in ("entity", "agent", "action", "outcome")]])
#: How long a claim is held without a renewal, in seconds; the types of events.
CLAIM_TTL = 1800
EVENT_TYPES = {"acquired": "claim.acquire", "renewed": "claim.acquire", "conflict": "claim.conflict", "released": "claim.release"}


class Held(dict):
    """An entity's claims, agent -> (mode, when). With a ttl they are also in a heap by when, so that those that are over are found without looking at all."""

    def __init__(self, ttl: float = 0.0, claims: dict[str, tuple[str, float]] | None = None):
        super().__init__(claims or {})
        self.ttl, self.due = ttl, []
        self._heap()

    def _heap(self) -> None:
        self.due = [(when, agent) for agent, (_, when) in self.items()] if self.ttl else []
        heapify(self.due)

    def __setitem__(self, agent: str, claim: tuple[str, float]) -> None:
        super().__setitem__(agent, claim)
        if self.ttl:
            heappush(self.due, (claim[1], agent))
            if len(self.due) > 2 * len(self) + 64:  # mostly renewed or let go since
                self._heap()

    def over(self, at: float, ttl: float) -> list[str]:
        """Agents whose claims were not renewed for longer than the ttl."""
        found = []
        while self.due and at - self.due[0][0] > ttl:
            when, agent = heappop(self.due)
            if agent in self and self[agent][1] == when:
                found.append(agent)
        return list(dict.fromkeys(found))


def settle(held: dict[str, tuple[str, float]], agent: str, mode: str, action: str, at: float = 0.0, ttl: float = 0.0) -> str:
    """Applies one action to an entity's claims (agent -> (mode, when)): claim, release, or remove (the agent leaves and lets go of all).

    Claims conflict if another agent holds it and either is exclusive.  With a ttl, claims that were not renewed for longer are gone.
    So an exclusive claim is held alone, and no action looks at all holders; Held(ttl) also spares that where claims run out.
    """
    if ttl:
        for a in held.over(at, ttl) if isinstance(held, Held) else [a for a, (_, when) in held.items() if at - when > ttl]:
            del held[a]
    if action in ("release", "remove"):
        return "released" if held.pop(agent, None) is not None else "absent"
    known = agent in held
    if len(held) > known and (mode == "exclusive" or next(iter(held.values()))[0] == "exclusive"):
        return "conflict"
    held[agent] = mode, at
    return "renewed" if known else "acquired"


def _mode(actions: DataFrame) -> DataFrame:
    return actions.withColumn("mode", F.coalesce(F.nullif(F.lower(F.trim("mode")), F.lit("")), F.lit("exclusive")))


def _with_removals(actions: DataFrame) -> DataFrame:
    """An agent's removal, which names no entity, as one action on each entity that it has claimed in the session."""
    removed = actions.where("action = 'remove'")
    claimed = actions.where("action = 'claim'").select("session", "agent", "entity").distinct()
    each = removed.drop("entity").join(claimed, ["session", "agent"]).select(*actions.columns)
    return actions.where("action <> 'remove'").unionByName(each)


def claims(actions: DataFrame, ttl: float = 0.0) -> DataFrame:
    """The outcome of each action (session, entity, agent, mode, action: claim, release or remove, ts, event_id), in order.

    Dealt out by (session, entity) and sorted; a task streams its rows and holds the claims of one entity at a time, so a long history takes
    no memory.  A session's actions on other entities don't wait for it.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}
        for rows in parts:
            outcomes = []
            for s, e, a, m, x, when in zip(rows["session"], rows["entity"], rows["agent"], rows["mode"], rows["action"], rows["at"]):
                if (s, e) != at:
                    at, held = (s, e), Held(ttl)
                outcomes.append(settle(held, a, m, x, when, ttl))
            yield rows.assign(outcome=outcomes)[["session", "event_id", "entity", "agent", "action", "outcome"]]

    rows = _with_removals(_mode(actions)).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    dealt = rows.repartition("session", "entity").sortWithinPartitions("session", "entity", "ts", "event_id")
    return dealt.select("session", "event_id", "entity", "agent", "mode", "action", "at").mapInPandas(run, _RESULT)


def claim_events(outcomes: DataFrame) -> DataFrame:
    """The events that outcomes of claims() leave: session, event_id, type, agent, entity, summary (why a claim was let go)."""
    kinds = F.create_map(*[F.lit(y) for pair in EVENT_TYPES.items() for y in pair])
    why = F.when(F.col("action") == "remove", "agent_removed").otherwise("")
    return outcomes.where("outcome <> 'absent'").select("session", "event_id", F.try_element_at(kinds, F.col("outcome")).alias("type"), "agent", "entity", why.alias("summary"))


def holders(actions: DataFrame, outcomes: DataFrame, at=None, ttl: float = CLAIM_TTL) -> DataFrame:
    """session, entity, agent, mode, acquired_at, updated_at of the claims that are held in the end (`at`: only those renewed within ttl)."""
    done = outcomes.where("outcome in ('acquired', 'renewed', 'released')").join(_mode(actions).select("session", "event_id", "mode", "ts"), ["session", "event_id"])
    order = F.struct("ts", "event_id")
    last = done.groupBy("session", "entity", "agent").agg(F.max_by(F.struct("outcome", "mode", "ts"), order).alias("l"), F.max(F.when(F.col("outcome") == "acquired", F.col("ts"))).alias("acquired_at"))
    found = last.where("l.outcome <> 'released'").select("session", "entity", "agent", "l.mode", "acquired_at", F.col("l.ts").alias("updated_at"))
    return found if at is None else found.where(F.unix_seconds(F.lit(at).cast("timestamp")) - F.unix_seconds(F.col("updated_at").cast("timestamp")) <= ttl)


def presence(updates: DataFrame) -> DataFrame:
    """Agents that are there, by their updates (session, agent, status, action: upsert or remove, ts, event_id): the last status, and since when.

    An agent that was removed and comes back is there since it came back.
    """
    order = Window.partitionBy("session", "agent").orderBy("ts", "event_id")
    stays = updates.withColumn("_stay", F.sum(F.when(F.col("action") == "remove", 1).otherwise(0)).over(order))
    own = stays.where("action <> 'remove'").groupBy("session", "agent", "_stay").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max_by(F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("active")), F.struct("ts", "event_id")).alias("status"))
    gone = stays.groupBy("session", "agent").agg(F.max("_stay").alias("_stay"))
    return own.join(gone, ["session", "agent", "_stay"]).drop("_stay")


def live_counts(agents: DataFrame, held: DataFrame) -> DataFrame:
    """session, agents, claims: how many of each there are now."""
    a, h = agents.groupBy("session").agg(F.count("*").alias("agents")), held.groupBy("session").agg(F.count("*").alias("claims"))
    return a.join(h, "session", "full").select("session", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("agents", "claims")])


class ClaimProcessor(StatefulProcessor):
    """claims() on a stream: the holders of each (session, entity) are state. Within a batch rows are put in order. A removal has to name its entity."""

    def __init__(self, ttl: float = 0.0):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", StructType([StructField("agent", StringType())]), StructType([StructField("mode", StringType()), StructField("at", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before = {k[0]: (v[0], v[1]) for k, v in self.held.iterator()}
        held = Held(self.ttl, before)
        outcomes = [settle(held, a, m or "exclusive", x, t.timestamp(), self.ttl) for a, m, x, t in zip(every["agent"], every["mode"], every["action"], every["ts"])]
        for agent in before.keys() - held.keys():
            self.held.removeKey((agent,))
        for agent, state in held.items():
            if before.get(agent) != state:
                self.held.updateValue((agent,), state)
        yield every.assign(outcome=outcomes)[["session", "event_id", "entity", "agent", "action", "outcome"]]

    def close(self) -> None:
        pass


def claim_stream(actions: DataFrame, ttl: float = 0.0) -> DataFrame:
    """A streaming DataFrame of outcomes; needs the RocksDB state store provider. A removal without an entity is an error: collaboration.collaborate() takes those."""
    lost = (F.col("action") == "remove") & F.col("entity").isNull()
    actions = actions.withColumn("entity", F.when(lost, F.raise_error("a removal has to name its entity")).otherwise(F.col("entity")))
    return actions.groupBy("session", "entity").transformWithStateInPandas(ClaimProcessor(ttl), _RESULT_TYPE, "Append", "None")


_SEEN = StructType([StructField("requests", LongType()), StructField("created", LongType()), StructField("last", LongType()), StructField("event", LongType()), StructField("endpoint", StringType())])


class TouchProcessor(StatefulProcessor):
    """touches() on a stream: a session's state is dropped `ttl_seconds` after its last update."""

    def __init__(self, ttl_seconds: int = 0):
        self.ttl = ttl_seconds * 1000 or None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _SEEN, self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        first, last = every["ts"].iloc[0].value // 1000, every.iloc[-1]  # microseconds
        now = (last["ts"].value // 1000, int(last["event_id"]), str(last["endpoint"]))
        old = self.seen.get() if self.seen.exists() else None
        # A batch that comes late changes the counts, but not what was seen last.
        created, kept = (min(old[1], first), max(now, (old[2], old[3], old[4]))) if old else (first, now)
        state = ((old[0] if old else 0) + len(every), created, *kept)
        self.seen.update(state)
        yield pd.DataFrame({"session": [key[0]], "requests": [state[0]], "created_at": [pd.Timestamp(created, unit="us")], "last_seen_at": [pd.Timestamp(kept[0], unit="us")], "last_endpoint": [kept[2]]})

    def close(self) -> None:
        pass


def touch_stream(events: DataFrame, ttl_seconds: int = 0) -> DataFrame:
    """A streaming DataFrame of sessions as they are after each batch that touches them; needs the RocksDB state store provider."""
    kind = StructType([StructField("session", StringType()), StructField("requests", LongType()), StructField("created_at", TimestampType()), StructField("last_seen_at", TimestampType()), StructField("last_endpoint", StringType())])
    return events.groupBy("session").transformWithStateInPandas(TouchProcessor(ttl_seconds), kind, "Update", "ProcessingTime" if ttl_seconds else "None")


def checkpoints(turns: DataFrame, saves: DataFrame) -> DataFrame:
    """The turns that each checkpoint (session, checkpoint, turns: how many there were, ts) holds; of those that repeat a name the last counts.

    Restoring one is a selection of its rows; branching from it is their union with the branch's own turns.
    """
    last = saves.groupBy("session", "checkpoint").agg(F.max_by("turns", "ts").alias("_turns"))
    placed = turns.withColumn("_n", F.row_number().over(Window.partitionBy("session").orderBy("turn")))
    return placed.join(last, "session").where(F.col("_n") <= F.col("_turns")).drop("_n", "_turns")


def restore(turns: DataFrame, saves: DataFrame, restores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of the sessions that are made by restoring, restores that fail). restores: session (the new one), from_session, checkpoint, ts.

    A restore takes the last save of that name at or before it; the new session has the turns that the save held, numbered as they were, and goes on
    from there by rows of its own.  Without such a save, it fails, and says so in `error`.
    """
    own = saves.select(F.col("session").alias("from_session"), "checkpoint", F.col("turns").alias("_turns"), F.col("ts").alias("_saved"))
    known = restores.join(own, ["from_session", "checkpoint"], "left").withColumn("_fits", F.col("_saved") <= F.col("ts"))
    last = known.groupBy("session", "from_session", "checkpoint", "ts").agg(F.max_by(F.when(F.col("_fits"), F.col("_turns")), F.when(F.col("_fits"), F.col("_saved"))).alias("_turns"))
    placed = turns.withColumn("_n", F.row_number().over(Window.partitionBy("session").orderBy("turn"))).withColumnRenamed("session", "from_session")
    made = placed.join(last.where("_turns IS NOT NULL").drop("ts"), "from_session").where(F.col("_n") <= F.col("_turns"))
    failed = last.where("_turns IS NULL").drop("_turns").withColumn("error", F.concat(F.lit('session "'), "from_session", F.lit('" has no checkpoint "'), "checkpoint", F.lit('"')))
    return made.select(*turns.columns), failed


def listing(rows: DataFrame, session: str, order: list[Column | str], limit: int = PAGE) -> DataFrame:
    """A session's agents, claims or checkpoints in order, a page of them (at most MOST)."""
    return rows.where(F.col("session") == session).orderBy(*order).limit(min(limit, MOST) if limit > 0 else PAGE)


def merge_capacity(primary: DataFrame, fallback: DataFrame, by: list[str]) -> DataFrame:
    """What backends say of their capacity: each number that is 0 or null, and each text that is blank or null, comes from the fallback."""
    both = primary.join(fallback.select(*by, *(F.col(x).alias(f"_{x}") for x in fallback.columns if x not in by)), by, "full")

    def filled(name: str, kind: str) -> Column:
        own, other = (F.col(x) if x.removeprefix("_") in names else F.lit(None).cast(kind) for x, names in ((name, primary.columns), (f"_{name}", fallback.columns)))
        return F.coalesce(F.when(F.trim(own) != "", own) if kind == "string" else F.nullif(own, F.lit(0).cast(kind)), other, own)

    kinds = dict(fallback.dtypes) | dict(primary.dtypes)
    return both.select(*by, *(filled(x, kind).alias(x) for x, kind in kinds.items() if x not in by))
