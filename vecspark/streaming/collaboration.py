"""Collaboration on a stream: agents, claims and the event log of a session as one state, and conversations kept as codes.

`collaborate` keeps, for each session, the agents that are there, the claims (entity, agent) that are held, a sequence number and a ring of the last events.
Rows of a batch are taken in the order of (ts, event_id).  What comes out are rows of two kinds: an outcome for each action, as
sessions.claims() gives it, and the events that it leaves, numbered.  Claims that aren't renewed within `ttl`, and agents not seen within `idle`, go
before the next action of the session, or when the watermark passes, by timers; an agent that goes, or is removed, lets go of all its claims, without naming an entity.

`keep_events` is the event log alone, for events of any kind; its numbers and its ring survive restarts, as all state does.  `ring_of` reads rings
from a checkpoint.

`converse` keeps a conversation's turns and their codes: what a request's turns change is what turns.sync_action() says, and
recall reads the stored codes.  The functions need the RocksDB state store provider; sessions and conversations are of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from vecspark.functions import codes
from vecspark.functions import columns as c
from vecspark.functions.spec import VALUE_SEED, ProductSpec, QuantizerSpec, derived_seed
from vecspark.operators.turns import hashed_vectors, normal_turns

from .sessions import EVENT_TYPES, RING, Held, _mode, settle


def _type(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_TEXT, _LONG, _TIME = StringType(), LongType(), TimestampType()
_EVENT = _type(seq=_LONG, event_id=_LONG, ts=_LONG, type=_TEXT, agent=_TEXT, entity=_TEXT, summary=_TEXT)
_OUT = _type(session=_TEXT, kind=_TEXT, seq=_LONG, event_id=_LONG, ts=_TIME, type=_TEXT, agent=_TEXT, entity=_TEXT, outcome=_TEXT, summary=_TEXT)


def _micros(ts: pd.Timestamp) -> int:
    return ts.value // 1000


class _Ring:
    """The last `keep` events and the number of the last one, as state."""

    def __init__(self, handle: StatefulProcessorHandle, keep: int):
        self.last, self.ring, self.keep = handle.getValueState("seq", _type(seq=_LONG)), handle.getListState("ring", _EVENT), keep

    def append(self, events: list[tuple]) -> list[tuple]:
        """events without seq; with it, as they are stored."""
        if not events:
            return []
        seq = self.last.get()[0] if self.last.exists() else 0
        new = [(seq + 1 + i, *e) for i, e in enumerate(events)]
        self.last.update((new[-1][0],))
        if seq + len(new) <= self.keep:
            self.ring.appendList(new)
        else:
            self.ring.put([*([tuple(x) for x in self.ring.get()] if self.ring.exists() else []), *new][-self.keep :])
        return new


def _rows(session: str, outcomes: list[tuple], events: list[tuple]) -> pd.DataFrame:
    """outcomes: (event_id, micros, action, agent, entity, outcome); events: as stored."""
    rows = [(session, "outcome", None, i, pd.Timestamp(at, unit="us"), action, agent, entity, outcome, None) for i, at, action, agent, entity, outcome in outcomes]
    rows += [(session, "event", seq, i, pd.Timestamp(at, unit="us"), kind, agent, entity, None, summary) for seq, i, at, kind, agent, entity, summary in events]
    return pd.DataFrame(rows, columns=_OUT.fieldNames()).astype({"seq": "Int64", "event_id": "Int64"})


class Collaboration(StatefulProcessor):
    def __init__(self, ttl: float, idle: float, keep: int):
        self.ttl, self.idle, self.keep = ttl, idle, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", _type(entity=_TEXT, agent=_TEXT), _type(mode=_TEXT, at=DoubleType()))
        self.agents = handle.getMapState("agents", _type(agent=_TEXT), _type(status=_TEXT, created=_LONG, updated=_LONG))
        self.ring = _Ring(handle, self.keep)

    def _loaded(self) -> tuple[dict, dict]:
        held: dict[str, dict] = {}
        for (entity, agent), (mode, at) in self.held.iterator():
            held.setdefault(entity, Held(self.ttl))[agent] = (mode, at)
        return held, {k[0]: tuple(v) for k, v in self.agents.iterator()}

    def _saved(self, state, before: dict, after: dict) -> None:
        for key in before.keys() - after.keys():
            state.removeKey(key)
        for key, value in after.items():
            if before.get(key) != value:
                state.updateValue(key, value)

    @staticmethod
    def _flat(held: dict) -> dict:
        return {(entity, agent): claim for entity, own in held.items() for agent, claim in own.items()}

    def _alarm(self, seconds: float) -> None:
        self.handle.registerTimer(int(seconds * 1000) + 1)

    def _prune(self, at: int, held: dict, agents: dict, outcomes: list, events: list) -> None:
        """Agents that are idle at this time (microseconds) leave, and let go of their claims."""
        for agent in sorted(a for a, (_, _, updated) in agents.items() if self.idle and (at - updated) / 1e6 > self.idle):
            del agents[agent]
            outcomes.append((None, at, "expire", agent, None, "left"))
            for entity in sorted(held):
                if held[entity].pop(agent, None) is not None:
                    outcomes.append((None, at, "expire", agent, entity, "released"))
                    events.append((None, at, "claim.release", agent, entity, "agent_removed"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held, agents = self._loaded()
        before, agents_before, outcomes, events = self._flat(held), dict(agents), [], []
        for r in every.itertuples():
            at, when, i = _micros(r.ts), _micros(r.ts) / 1e6, int(r.event_id)
            self._prune(at, held, agents, outcomes, events)
            if r.action in ("claim", "release"):
                outcome = settle(held.setdefault(r.entity, Held(self.ttl)), r.agent, r.mode, r.action, when, self.ttl)
                outcomes.append((i, at, r.action, r.agent, r.entity, outcome))
                if outcome in EVENT_TYPES:
                    events.append((i, at, EVENT_TYPES[outcome], r.agent, r.entity, ""))
                if outcome in ("acquired", "renewed") and self.ttl:
                    self._alarm(when + self.ttl)
            elif r.action == "remove":
                agents.pop(r.agent, None)
                for entity in sorted(held):
                    if settle(held[entity], r.agent, "", "remove", when, self.ttl) == "released":
                        outcomes.append((i, at, "remove", r.agent, entity, "released"))
                        events.append((i, at, "claim.release", r.agent, entity, "agent_removed"))
                events.append((i, at, "agent.remove", r.agent, None, ""))
            elif r.action == "upsert":
                status = (r.status or "").strip() or "active"
                outcomes.append((i, at, "upsert", r.agent, None, "present" if r.agent in agents else "joined"))
                agents[r.agent] = (status, agents[r.agent][1] if r.agent in agents else at, at)
                events.append((i, at, "agent.upsert", r.agent, None, status))
                if self.idle:
                    self._alarm(when + self.idle)
            else:
                raise ValueError(f"unknown action {r.action!r}")
        self._saved(self.held, before, self._flat(held))
        self._saved(self.agents, {(k,): v for k, v in agents_before.items()}, {(k,): v for k, v in agents.items()})
        yield _rows(key[0], outcomes, self.ring.append(events))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held, agents = self._loaded()
        before, agents_before, outcomes, events = self._flat(held), dict(agents), [], []
        at = now * 1000
        for (entity, agent), (_, when) in sorted(before.items()):
            if self.ttl and now / 1000 - when > self.ttl:
                del held[entity][agent]
                outcomes.append((None, at, "expire", agent, entity, "expired"))
        self._prune(at, held, agents, outcomes, events)
        self._saved(self.held, before, self._flat(held))
        self._saved(self.agents, {(k,): v for k, v in agents_before.items()}, {(k,): v for k, v in agents.items()})
        if outcomes:
            yield _rows(key[0], outcomes, self.ring.append(events))

    def close(self) -> None:
        pass


def collaborate(actions: DataFrame, ttl: float = 0.0, idle: float = 0.0, keep: int = RING) -> DataFrame:
    """A streaming DataFrame of outcomes and events of actions (session, event_id, ts, action: claim, release, upsert or remove, entity, agent, mode, status).

    With a ttl or idle time (seconds) actions need a watermark on ts: timers follow it, and rows behind it are dropped by Spark.
    """
    rows = _mode(actions).select("session", "event_id", "ts", "action", "entity", "agent", "mode", "status")
    return rows.groupBy("session").transformWithStateInPandas(Collaboration(ttl, idle, keep), _OUT, "Append", "EventTime" if ttl or idle else "None")


class EventLog(StatefulProcessor):
    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = _Ring(handle, self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        new = self.ring.append([(int(r.event_id), _micros(r.ts), r.type, r.agent, r.entity, r.summary) for r in every.itertuples()])
        yield _rows(key[0], [], new)

    def close(self) -> None:
        pass


def keep_events(events: DataFrame, keep: int = RING) -> DataFrame:
    """A streaming DataFrame of events (session, event_id, ts, type, agent, entity, summary) with their seq; the last `keep` of a session are state."""
    rows = events.select("session", "event_id", "ts", "type", "agent", "entity", "summary")
    out = rows.groupBy("session").transformWithStateInPandas(EventLog(keep), _OUT, "Append", "None")
    return out.drop("kind", "outcome")


def ring_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """session, seq, event_id, ts, type, agent, entity, summary: the rings that a stopped query has left below its checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "ring").load()
    return state.select("key.session", "list_element.*").withColumn("ts", F.timestamp_micros("ts"))


def sync(old: list[tuple[str, str]], new: list[tuple[str, str]]) -> tuple[str, int]:
    """turns.sync_action() on lists: the action, and how many of the last new turns are appended."""
    if old == new or not new:
        return "none", 0
    if new[: len(old)] == old:
        return "extend", len(new) - len(old)
    both = next((n for n in range(min(len(old), len(new)), 0, -1) if old[-n:] == new[:n]), 0)
    if both:
        return "extend", len(new) - both
    return ("add", len(new)) if len(new) <= 2 else ("rebuild", len(new))


_TURN = _type(role=_TEXT, content=_TEXT, mse=BinaryType(), signs=BinaryType(), res_norm=DoubleType(), packed=BinaryType(), norm=DoubleType())
_MEMORY = ArrayType(_type(rank=IntegerType(), turn=IntegerType(), role=_TEXT, score=DoubleType()))
_TALK = _type(conv_id=_TEXT, event_id=_LONG, action=_TEXT, append=IntegerType(), turns=IntegerType(), memories=_MEMORY, focus_norm=FloatType())


class Conversation(StatefulProcessor):
    def __init__(self, keys: ProductSpec, values: QuantizerSpec, k: int):
        self.keys, self.values, self.k = keys, values, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", _TURN)

    def _coded(self, turns: list[tuple[str, str, list]], first: int) -> list[tuple]:
        """Turns (role, content, words) as they are stored; the first is number `first`."""
        if not turns:
            return []
        words, places = [list(w) for _, _, w in turns], list(range(first, first + len(turns)))
        cells, signs, left = codes.encode_product(hashed_vectors(words, places, self.keys.dim, 0), self.keys)
        plain, norm = codes.indices(hashed_vectors(words, places, self.values.dim, 1), self.values)
        parts = codes.pack(cells, self.keys.bits - 1), codes.pack(signs, 1), codes.pack(plain, self.values.bits)
        return [(role, content, parts[0][i].tobytes(), parts[1][i].tobytes(), float(left[i]), parts[2][i].tobytes(), float(norm[i])) for i, (role, content, _) in enumerate(turns)]

    def _recalled(self, stored: list[tuple], question: str, words: list) -> tuple[list[tuple], float | None]:
        """The memories that answer a question (its place is the number of stored turns), and the norm of what the best of them hold."""
        if not stored or not question:
            return [], None
        rows = lambda i: np.frombuffer(b"".join(t[i] for t in stored), np.uint8).reshape(len(stored), -1)
        q = hashed_vectors([list(words)], [len(stored)], self.keys.dim, 0)
        score = codes.packed_product_scores(rows(2), rows(3), np.array([t[4] for t in stored]), q, self.keys)[:, 0]
        best = np.lexsort((np.arange(len(score)), -(np.round(score, 6) + 0.0)))[: self.k]
        weight = np.exp(score[best] - score[best].max())
        decoded = codes.reconstruct(codes.unpack(rows(5)[best], self.values.dim, self.values.bits), self.values) * np.array([stored[i][6] for i in best])[:, None]
        focus = float(np.linalg.norm((weight / weight.sum()) @ decoded))
        kept: list[tuple] = []
        for i in best.tolist():
            role, content, s = stored[i][0], stored[i][1], float(np.round(score[i], 6) + 0.0)
            if not (role.lower() == "user" and content == question) and (role, content, s) not in [x[2:] for x in kept]:
                kept.append((len(kept) + 1, i, role, content, s))
        return [(rank, i, role, s) for rank, i, role, _, s in kept], focus

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        before, rebuilt, out = len(stored), False, []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            new = [(t["role"], t["content"], t["words"]) for t in r.turns]
            action, n = sync([t[:2] for t in stored], [t[:2] for t in new])
            if action == "rebuild":
                stored, rebuilt = [], True
            stored += self._coded(new[len(new) - n :], len(stored))
            asked = next((t for t in reversed(new) if t[0] == "user"), new[-1] if new else None)
            memories, focus = self._recalled(stored, asked[1], asked[2]) if asked else ([], None)
            out.append((key[0], int(r.event_id), action, n, len(stored), memories, focus))
        if rebuilt:
            self.turns.put(stored)
        elif len(stored) > before:
            self.turns.appendList(stored[before:])
        names = ("rank", "turn", "role", "score")
        yield pd.DataFrame([(*x[:5], [dict(zip(names, m)) for m in x[5]], x[6]) for x in out], columns=_TALK.fieldNames())

    def close(self) -> None:
        pass


def converse(requests: DataFrame, dim: int, k: int = 4, key_bits: int = 3, value_bits: int = 2, seed: int = 42) -> DataFrame:
    """A streaming DataFrame: what each request (conv_id, event_id, ts, messages: role and content) changed, and what the stored turns recall to its last user turn.

    focus_norm is the norm of an attention over the k best stored turns: a softmax of their scores over decoded value vectors.
    """
    words = F.transform(normal_turns("messages"), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"), c.tokens(t["content"]).alias("words")))
    rows = requests.select(F.col("conv_id").cast("string").alias("conv_id"), "event_id", "ts", words.alias("turns"))
    keys, values = ProductSpec(dim, key_bits, seed).solved(), QuantizerSpec(dim, value_bits, derived_seed(seed, VALUE_SEED)).solved()
    return rows.groupBy("conv_id").transformWithStateInPandas(Conversation(keys, values, k), _TALK, "Append", "None")
