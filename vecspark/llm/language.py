"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, by follow-the-regularised-leader.

A text's characters are its letters in lower case; everything else counts as a space, and spaces in a row as one.  Its features are
the n-grams of one to three such characters, hashed to `features` slots: (1 + log count) * IDF, scaled to length 1.

1. IDF: each task counts the texts that have a slot; the counts are added over all texts that are learned from.  A table of fixed size.
2. A sample of at most `sample` texts, as many of each language, those with the smallest hash of doc_id and text; only their features leave the
   tasks.  It is stored, and the driver reads it again for each epoch, a part at a time.
3. FTRL-proximal with elastic net: each coordinate has a rate of its own, and a weight whose gradients haven't outweighed `l1` is exactly 0,
   so the model holds only the slots that tell languages apart.  It is broadcast.
4. Of the sample each `part`-th text isn't trained on: on these the temperature is chosen that makes the log loss smallest.
5. One map over all texts gives the language with the largest probability, softmax(products / temperature).

Only the sample is bounded, and it is the only thing that is fitted; document frequencies are of all texts learned from.

Defined cases: a text that is null or has no letter is `und` with score 0, and so is every text where nothing was learned.  With one
language learned every text with a letter is of it, with score 1.  Ties go to the language that sorts first.  Rows without lang, or with a null text or one without
letters, are not learned from; a row without a doc_id is learned from as if its doc_id were an empty text.  Repeated rows count each
for itself in the IDF; in the sample too.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, chunks, documents, stored, whole_rows, with_row
from .quality import learned
from .words import mix

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    order: int = 3
    features: int = 1 << 17
    sample: int = 4000
    epochs: int = 4
    part: int = 5
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.1


@cache
def _characters() -> np.ndarray:
    """For each code point itself where it is a letter, else a space."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], np.uint32)


def counted(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, count) of all n-grams, each slot of a row once, sorted by both; a row without letters has none."""
    texts = [t.lower() for t in texts]
    size = np.array([len(t) + 2 for t in texts], np.int64)
    data = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le"), np.uint32) if texts else np.zeros(0, np.uint32)
    c, row = _characters()[data], np.repeat(np.arange(len(texts), dtype=np.uint32), size)
    space = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(space[1:] & space[:-1]) | (row[1:] != row[:-1])
    c, row = c[keep], row[keep]
    keys, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, s.order + 1):
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
        ok = (row[: len(h)] == row[n - 1 :]) if n > 1 else c != 32
        if n == 2:
            ok &= (c[:-1] != 32) | (c[1:] != 32)
        slot = (mix(h[ok] + np.uint64(n)) >> np.uint64(32)) * np.uint64(s.features) >> np.uint64(32)
        keys.append(row[: len(h)][ok].astype(np.uint64) * np.uint64(s.features) + slot)
    key = np.concatenate(keys)
    if len(texts) * s.features < 1 << 32:
        key = key.astype(np.uint32)  # sorted twice as fast
    key.sort()
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    row, slot = np.divmod(key[begin].astype(np.int64), s.features)
    return row, slot, np.diff(np.append(begin, len(key)))


def weighted(texts: list[str], idf: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges of rows, slot, value): TF-IDF of length 1."""
    row, slot, count = counted(texts, s)
    value = (1 + np.log(count)) * idf[slot]
    length = np.sqrt(np.bincount(row, weights=value**2, minlength=len(texts)))
    return np.searchsorted(row, np.arange(len(texts) + 1)), slot, value / length[row]


def frequencies(docs: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """(texts that have each slot, texts), of all rows."""
    n = s.features

    def run(batches: Batches) -> Batches:
        total = np.zeros(n + 1, np.int64)
        for batch in chunks(batches):
            _, slot, _ = counted(batch.column("text").to_pylist(), s)
            total[:n] += np.bincount(slot, minlength=n)
            total[n] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "texts"])

    got = docs.select("text").mapInArrow(run, "slot int, texts long").groupBy("slot").agg(F.sum("texts").alias("texts")).toArrow()  # features + 1 rows at the most
    total = np.zeros(n + 1, np.int64)
    total[got.column("slot").to_numpy()] = got.column("texts").to_numpy()
    return total[:n], int(total[n])


def sampled(docs: DataFrame, languages: dict[str, int], idf, s: Settings) -> DataFrame:
    """order, lang, slots, values (bytes): of each language about sample / languages rows, at most s.sample in all, stored in an order by hash."""
    each = max(1, s.sample // max(1, len(languages)))
    # A hash of 2**32 values is cut so that a fifth more than needed are expected; then there is little to sort.
    cut = {lang: min(1 << 32, 64 + int(1.2 * each * 2**32 / n)) if n > 2 * each else 1 << 32 for lang, n in languages.items()}
    some = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair])
    order = F.xxhash64(F.lit(23), "doc_id", "text")
    near = docs.withColumn("order", order).where(F.pmod("order", F.lit(1 << 32)) < some[F.col("lang")]).withColumn("share", F.pmod("order", F.lit(1 << 32)) / some[F.col("lang")])
    chosen = near.orderBy("share", "order", "lang").limit(s.sample)

    def run(batches: Batches) -> Batches:
        for batch in chunks(batches):
            edges, slot, value = weighted(batch.column("text").to_pylist(), idf.value, s)
            parts = [(slot[a:b].astype(np.int32).tobytes(), value[a:b].astype(np.float32).tobytes()) for a, b in zip(edges, edges[1:])]
            yield pa.record_batch([batch.column("order"), batch.column("lang"), *(pa.array(x, pa.binary()) for x in zip(*parts))], names=["order", "lang", "slots", "values"])

    dealt = chosen.repartition(32, F.pmod("order", F.lit(32))).mapInArrow(run, "order long, lang string, slots binary, values binary")
    return stored(dealt.sortWithinPartitions("order", "lang", "slots"))


class Leader:
    """FTRL-proximal for k classes; the last slot is a constant that isn't regularised."""

    def __init__(self, k: int, s: Settings):
        self.s = s
        self.z, self.n = (np.zeros((s.features + 1, k)) for _ in range(2))

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z = self.s, self.z[at]
        constant = (at == s.features)[:, None]
        shrunk = np.where(constant, z, np.sign(z) * np.maximum(np.abs(z) - s.l1, 0))
        return -shrunk / ((s.beta + np.sqrt(self.n[at])) / s.alpha + np.where(constant, 0, s.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = _softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + g * g


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    """place: of each slot its row in weights, 0 for a slot without any (row 0 is zeros)."""

    settings: Settings
    languages: list[str]
    idf: np.ndarray
    place: np.ndarray
    weights: np.ndarray
    constant: np.ndarray
    temperature: float

    def products(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(whether a text has a letter, a product for each language)."""
        edges, slot, value = weighted(texts, self.idf, self.settings)
        some = np.diff(edges) > 0
        out = np.repeat(self.constant[None], len(texts), axis=0)
        if some.any():
            out[some] += np.add.reduceat(self.weights[self.place[slot]] * value[:, None], edges[:-1][some], axis=0)
        return some, out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        some, a = self.products(texts)
        p = _softmax(a / self.temperature)
        best = p.argmax(axis=1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist())], np.where(some, p[np.arange(len(p)), best], 0.0)


def _temperature(a: np.ndarray, y: np.ndarray) -> float:
    """The one with the smallest mean log loss: golden sections of its logarithm."""
    def loss(t: float) -> float:
        return -float(np.log(np.maximum(_softmax(a / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean())

    low, high, ratio = -5.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        x, y_ = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, y_) if loss(x) <= loss(y_) else (x, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, s: Settings = Settings()) -> Model | None:
    """docs (doc_id, text, lang): learns from all rows with a language and a letter; None where there are none."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    languages = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}  # a row a language
    if not languages:
        return None
    frequency, n = frequencies(docs, s)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    sample = sampled(docs, languages, spark.sparkContext.broadcast(idf), s)
    names = sorted(languages)
    number = {lang: k for k, lang in enumerate(names)}
    leader, held, truth = Leader(len(names), s), [], []
    for epoch in range(s.epochs + 1):
        for i, r in enumerate(sample.toLocalIterator()):
            at, x = np.append(np.frombuffer(r.slots, np.int32), s.features), np.append(np.frombuffer(r["values"], np.float32), 1.0).astype(float)
            if i % s.part:
                if epoch < s.epochs:
                    leader.learn(at, x, number[r.lang])
            elif epoch == s.epochs:
                held.append(x @ leader.weights(at))
                truth.append(number[r.lang])
    weights = leader.weights(np.arange(s.features + 1))
    used = np.flatnonzero(np.abs(weights[:-1]).max(axis=1))
    place = np.zeros(s.features, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    return Model(s, names, idf, place, np.vstack((np.zeros((1, len(names))), weights[used])), weights[-1], _temperature(np.array(held), np.array(truth)))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """row (a struct of all columns of docs), lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = whole_rows(docs, F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Batches) -> Batches:
        m = shared.value
        for batch in chunks(batches):
            lang, score = m.predict(batch.column("text").to_pylist()) if m else ([UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows))
            yield pa.record_batch([batch.column("row"), pa.array(lang, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return source.mapInArrow(run, with_row(docs, "lang_pred string, score double"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those whose crc32(doc_id) mod 3 is not 1: doc_id, held_out, lang_pred, score.

    Shuffled: counts by slot, the features of 4,000 texts.  Broadcast: IDF and weights of 2^17 slots.  A text that is null or has no letter
    is `und` with score 0; a null doc_id counts as an empty one for the fold; repeated rows are judged each for itself; an empty table gives no rows.
    """
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(docs.where(learned(3, 1)))
    return identify(docs.select("doc_id", "text"), model).select(F.col("row.doc_id").alias("doc_id"), (~learned(3, 1, "row.doc_id")).alias("held_out"), "lang_pred", "score")
