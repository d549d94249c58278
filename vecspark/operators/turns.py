"""Turns of conversations: what changes a stored conversation, the last question, hashed text vectors and recall."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions import columns as c
from vecspark.functions.spec import VALUE_SEED, ProductSpec, QuantizerSpec, derived_seed

from . import encode

#: Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
SLOTS = 4


def last_user_turn(turns: DataFrame) -> DataFrame:
    """conv_id, turn, text of the last user turn that isn't blank; of the last turn that isn't, if no user has one."""
    some = turns.where(F.trim("text") != "")
    order = F.struct((F.col("role") == "user").cast("int"), "turn")
    return some.groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), order).alias("t")).select("conv_id", "t.turn", "t.text")


def recent(turns: DataFrame, n: int = 8) -> DataFrame:
    """Each conversation's last n turns."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def normal_turns(messages: Column | str) -> Column:
    """An array of (role, content) as turns are compared: roles in lower case ("user" if blank), contents trimmed, blank ones dropped."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    role = lambda m: F.coalesce(F.nullif(F.lower(F.trim(m["role"])), F.lit("")), F.lit("user"))
    return F.filter(F.transform(messages, lambda m: F.struct(role(m).alias("role"), F.trim(m["content"]).alias("content"))), lambda m: m["content"] != "")


def sync_action(old: Column | str, new: Column | str) -> Column:
    """struct(action, append): what makes the stored turns (strings, or normal_turns()) equal to the new ones, and how many of the last new
    ones to append.

    none: they are equal; extend: the stored ones are a prefix, or the new ones start with the stored ones' end; add: at most two
    new turns that overlap nowhere; rebuild: anything else, all are stored anew.
    """
    old, new = (F.col(x) if isinstance(x, str) else x for x in (old, new))
    both = c.overlap(old, new)
    fresh = F.size(new) - both
    made = lambda name, n: F.struct(F.lit(name).alias("action"), n.cast("int").alias("append"))
    return (
        F.when(old == new, made("none", F.lit(0)))
        .when(c.prefix(old, new), made("extend", F.size(new) - F.size(old)))
        .when(both > 0, made("extend", fresh))
        .when(F.size(new) <= 2, made("add", F.size(new)))
        .otherwise(made("rebuild", F.size(new)))
    )


def _hashes(words: list[bytes], tail: np.ndarray) -> np.ndarray:
    """FNV-1a of each word and of each row of tail bytes behind it: words x tails. A step takes the next byte of all words that have one."""
    prime, sizes = np.uint64(FNV_PRIME), np.array([len(x) for x in words], np.int64)
    order = np.argsort(-sizes, kind="stable")
    chars, begin = np.frombuffer(b"".join(words), np.uint8), (np.cumsum(sizes) - sizes)[order]
    counts = len(words) - np.cumsum(np.bincount(sizes))
    own = np.full(len(words), FNV_OFFSET, np.uint64)
    for i, n in enumerate(counts[:-1].tolist()):
        own[:n] = (own[:n] ^ chars[begin[:n] + i]) * prime
    h = np.empty((len(words), len(tail)), np.uint64)
    h[order] = own[:, None]
    for i in range(tail.shape[1]):
        h = (h ^ tail[:, i]) * prime
    return h


#: Words, and bytes of words, that are hashed at once (one list of words more, at the most).
PIECE_WORDS, PIECE_BYTES = 1 << 15, 1 << 20


def hashed_vectors(words: Iterable[list[str]], index: list[int], dim: int, lane: int = 0) -> np.ndarray:
    """A row for each list of words: SLOTS hashed places a word, plus or minus 1 by another hash, of unit length.

    A place is the hash of the word's bytes and the bytes (index, lane, step), a sign the parity of that of (lane, step, 127): equal words of
    different indices (the turn's number) have other places.  No words count as the word "_empty".  Rows are worked on in pieces of so many words.
    """
    out, steps = np.zeros((len(index), dim)), np.arange(SLOTS, dtype=np.uint64)
    numbers = np.array(index, np.int64) & 255
    byte = lambda x: np.full(SLOTS, x, np.uint64)

    def add(first: int, kinds: dict[bytes, int], at: list[int], counts: list[int]) -> None:
        data, rows = list(kinds), np.repeat(np.arange(first, first + len(counts)), counts)
        place = np.array(at, np.int64)
        signs = np.where(_hashes(data, np.column_stack((byte(lane), steps, byte(127)))) & np.uint64(1), -1.0, 1.0)
        for n in np.unique(numbers[rows]).tolist():
            own = numbers[rows] == n
            used, which = np.unique(place[own], return_inverse=True)
            slots = (_hashes([data[i] for i in used.tolist()], np.column_stack((byte(n), byte(lane), steps))) % np.uint64(dim)).astype(np.int64)
            np.add.at(out, (np.repeat(rows[own], SLOTS), slots[which].reshape(-1)), signs[place[own]].reshape(-1))

    first, kinds, at, counts, size = 0, {}, [], [], 0
    for own in words:
        own = own or ["_empty"]
        for word in own:
            data = word.encode()
            if data not in kinds:
                kinds[data] = len(kinds)
                size += len(data)
            at.append(kinds[data])
        counts.append(len(own))
        if len(at) >= PIECE_WORDS or size >= PIECE_BYTES:
            add(first, kinds, at, counts)
            first, kinds, at, counts, size = first + len(counts), {}, [], [], 0
    if counts:
        add(first, kinds, at, counts)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1.0)


def _lists(words: pa.ListArray) -> Iterator[list[str]]:
    """The lists of an Arrow column, some rows at a time."""
    for begin in range(0, len(words), 256):
        part = words.slice(begin, 256)
        flat, at = part.flatten().to_numpy(zero_copy_only=False).tolist(), 0
        for n in part.value_lengths().to_pylist():
            yield flat[at : at + n]
            at += n


def text_vectors(rows: DataFrame, dim: int, text: str = "text", index: str = "turn", out: str = "v", lane: int = 0) -> DataFrame:
    """rows with the hashed vector of a text column; index: a column of numbers."""

    @F.arrow_udf("array<double>")
    def make(words: pa.Array, at: pa.Array) -> pa.Array:
        made = hashed_vectors(_lists(words), at.to_pylist(), dim, lane)
        return pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * dim, made.reshape(-1))

    return rows.withColumn(out, make(c.tokens(F.coalesce(F.col(text), F.lit(""))), F.col(index)))


def _scored(turns: DataFrame, spec: ProductSpec) -> DataFrame:
    """conv_id, turn, place, role, text, question, score: each turn that is stored against its conversation's question."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    placed = turns.withColumn("place", F.row_number().over(order) - 1)
    asked = last_user_turn(turns).join(turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("place")), "conv_id").select("conv_id", F.col("text").alias("question"), "place")
    asked = text_vectors(asked, spec.dim, "question", "place", "q").drop("place")
    coded = encode.quantize_product(text_vectors(placed, spec.dim, index="place"), spec, keep=["conv_id", "turn", "place", "role", "text"])
    return encode.score_product(coded.join(asked, "conv_id"), spec, "q").drop("q", "mse", "signs", "res_norm")


def focus(turns: DataFrame, k: int, dim: int, key_bits: int = 3, value_bits: int = 2, seed: int = 42) -> DataFrame:
    """conv_id, focus_norm: the norm of an attention over the k turns that answer the last user turn best, whose values are text vectors of lane 1, coded."""
    spec, values = ProductSpec(dim, key_bits, seed), QuantizerSpec(dim, value_bits, derived_seed(seed, VALUE_SEED))
    order = Window.partitionBy("conv_id").orderBy(F.desc(F.round("score", 6)), "place")
    top = _scored(turns, spec).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    weighted = top.withColumn("weight", c.softmax("score", Window.partitionBy("conv_id"))).select("conv_id", "place", "text", "weight")
    coded = encode.quantize(text_vectors(weighted, dim, index="place", lane=1), values, keep=["conv_id", "weight"])
    each = encode.dequantize(coded, values).select("conv_id", (F.col("weight") * F.col("norm").cast("double")).alias("w"), F.posexplode("recon").alias("coordinate", "x"))
    sums = each.groupBy("conv_id", "coordinate").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return sums.groupBy("conv_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("focus_norm"))


def recall(turns: DataFrame, k: int, dim: int, bits: int = 3, seed: int = 42) -> DataFrame:
    """conv_id, rank, turn, role, score: what a conversation's stored turns say to its last user turn, by inner-product codes of text vectors.

    A turn's key has its place in the conversation as the index, the question has the number of turns.  The k turns with the best scores
    are taken; of these, user turns that are the question itself, and repeats of a role and text with the same score, are left out.
    """
    spec = ProductSpec(dim, bits, seed)
    scored = _scored(turns, spec).withColumn("score", F.round("score", 6) + F.lit(0.0))
    best = Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn")
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    once = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "score").orderBy("turn"))
    kept = top.where(~((F.lower("role") == "user") & (F.col("text") == F.trim("question")))).withColumn("_n", once).where("_n = 1")
    return kept.withColumn("rank", F.row_number().over(best)).select("conv_id", "rank", "turn", "role", "score")
