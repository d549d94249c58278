"""Quality classifier: compression with dictionaries of good and bad text.

zstandard dictionaries are built from labelled good and bad texts.  A text is compressed with each of them, and with
none.  Its features are the normalised difference (bad - good) / none, the compressibility none / length, and the log
of the length; a logistic model of these, fitted on labelled texts that were not used to build the dictionaries, turns
them into a calibrated score.  The model and the dictionaries have a fixed size.  Scoring is one map over all texts.

Only the labelled sample is bounded.  Labels are joined with the documents first; of each class the `2 * sample` documents with the
smallest hash of doc_id are taken, so it doesn't depend on partitioning.  Every other one is for the dictionary: it is cut into pieces
of `window` characters, one after another, and of the pieces of a class `pieces` with the smallest hash reach the driver.  So a very long text
gives more pieces, but never takes the place of all others, and the driver gets pieces of a bounded number and length.
The other documents are for the calibration: tasks compress them whole, and send three numbers each.  Scores read whole texts.

The score is not the difference alone: the dictionaries' difference is what the method names, and compressibility and length
correct it (README has the figures of each).

Defined cases: a null text is empty, and an empty text has a difference of 0 and a compressibility of 1.  Labels that
are null or neither 0 nor 1, or that have no document with a text, are not learned from; a doc_id with several labels counts for each.
Without documents of both classes every score is the share of good ones among the labelled (0.5 without any).  Repeated rows are
scored each for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Batches, chunks, documents, id_and_text, stored, whole_rows, with_row

THRESHOLD = 0.7


@dataclass(frozen=True)
class Settings:
    sample: int = 1500
    pieces: int = 4096
    window: int = 8192
    dictionary: int = 64 << 10
    level: int = 3
    steps: int = 30
    ridge: float = 1e-3


@dataclass
class Model:
    settings: Settings
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    prior: float


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A dictionary of the texts; where they are too few to train one, the texts themselves."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


class Compressors:
    def __init__(self, model: Model):
        level = model.settings.level
        made = [zstandard.ZstdCompressionDict(x) if x else None for x in (model.good, model.bad)]
        for d in made:
            if d is not None:
                d.precompute_compress(level=level)
        options = {"level": level, "write_content_size": False, "write_checksum": False}
        self.each = [zstandard.ZstdCompressor(dict_data=d, **options) if d is not None else zstandard.ZstdCompressor(**options) for d in [*made, None]]

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 3))
        for row, text in zip(out, texts):
            if text:
                good, bad, none = (len(c.compress(text)) for c in self.each)
                row[:] = (bad - good) / none, none / len(text), np.log(len(text))
            else:
                row[:] = 0.0, 1.0, 0.0
        return out


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.column_stack((np.ones(len(z)), z, z[:, 0] * z[:, 1], z**2))


def _fit(x: np.ndarray, y: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's steps with a small ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = _design(x, mean, scale)
    w = np.zeros(a.shape[1])
    for _ in range(settings.steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + settings.ridge * len(a) * np.eye(len(w))
        w += np.linalg.solve(h, a.T @ (y - p) - settings.ridge * len(a) * w)
    return mean, scale, w


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), quality: a row for each label of 0 or 1 that has a document with a text.

    Narrow: no text leaves its task.  Of rows that repeat a doc_id the one with the smallest hash of its text.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").distinct()
    marks = id_and_text(docs).where(F.length("text") > 0).groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("mark"))
    return labels.join(marks, "doc_id")


def _sample(labelled: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, mark, quality, part: of each class those with the smallest hash of doc_id, by turns for the dictionary (0) and the calibration (1)."""
    order = F.xxhash64(F.lit(17), "doc_id"), F.col("doc_id")
    picked = None
    for quality in (0, 1):
        own = labelled.where(F.col("quality") == quality).orderBy(*order).limit(2 * settings.sample)
        picked = own if picked is None else picked.union(own)
    place = F.row_number().over(Window.partitionBy("quality").orderBy(*order))  # of 2 x sample narrow rows a class
    return picked.withColumn("part", (place - 1) % 2)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """docs (doc_id, text), labels (doc_id, quality): learns from all of these rows that have a label of 0 or 1."""
    spark = docs.sparkSession
    labelled = stored(_labelled(docs, labels))
    counts = {r.quality: r["count"] for r in labelled.groupBy("quality").count().collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    model = Model(settings, b"", b"", np.zeros(3), np.ones(3), np.zeros(8), prior)
    if len(counts) < 2:
        return model
    picked = stored(_sample(labelled, settings))  # at most 4 x sample narrow rows
    marked = id_and_text(docs).withColumn("mark", F.xxhash64("text"))
    texts = stored(marked.join(F.broadcast(picked), ["doc_id", "mark"]).groupBy("doc_id", "quality", "part").agg(F.first("text").alias("text")))

    def cut_up(batches: Batches) -> Batches:
        for batch in batches:
            for doc, label, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "quality", "text"))):
                own = [text[i : i + settings.window] for i in range(0, len(text), settings.window)]
                yield pa.record_batch([pa.array([doc] * len(own)), pa.array([label] * len(own), pa.int32()), pa.array(range(len(own)), pa.int32()), pa.array(own)], names=["doc_id", "quality", "place", "piece"])

    cut = texts.where("part = 0").select("doc_id", "quality", "text").mapInArrow(cut_up, "doc_id long, quality int, place int, piece string")
    order = F.xxhash64(F.lit(19), "doc_id", "place"), F.col("doc_id"), F.col("place")
    pieces = {q: [r.piece.encode() for r in cut.where(F.col("quality") == q).orderBy(*order).limit(settings.pieces).select("piece").collect()] for q in (0, 1)}
    model.good, model.bad = (_dictionary(pieces[q], settings.dictionary) for q in (1, 0))
    # A class of one document has none for the calibration: the same one serves.
    alone = [q for q in (0, 1) if counts[q] == 1]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        own = Compressors(shared.value)
        for batch in chunks(batches):
            x = own.features([t.encode() for t in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), *(pa.array(c) for c in x.T.copy())], names=["doc_id", "quality", "a", "b", "c"])

    held = texts.where((F.col("part") == 1) | F.col("quality").isin(alone))
    rows = sorted(held.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, a double, b double, c double").collect())
    x, y = np.array([r[2:] for r in rows]), np.array([float(r.quality) for r in rows])
    model.mean, model.scale, model.weight = _fit(x, y, settings)
    # The sample has as many bad as good texts; the intercept moves to the share among all labelled documents.
    drawn, share = y.mean(), min(max(prior, 1e-3), 1 - 1e-3)
    model.weight[0] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of all columns of docs), score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = whole_rows(docs, F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Batches) -> Batches:
        m = shared.value
        own = Compressors(m)
        for batch in chunks(batches):
            if m.good:
                x = own.features([t.encode() for t in batch.column("text").to_pylist()])
                s = 1 / (1 + np.exp(-np.clip(_design(x, m.mean, m.scale) @ m.weight, -30, 30)))
            else:
                s = np.full(batch.num_rows, m.prior)
            yield pa.record_batch([batch.column("row"), pa.array(s)], names=["row", "score"])

    return source.mapInArrow(run, with_row(docs, "score double"))


def learned(folds: int = 4, fold: int = 2, doc_id: str = "doc_id"):
    """Whether a row may be learned from: crc32(doc_id as text) mod folds isn't fold."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds != fold


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs whose score is at least the threshold, with all their columns.

    A null text is scored as an empty one; repeated rows and rows without a doc_id each for itself; an empty table gives no rows.
    """
    model = train(docs.where(learned()), labels.where(learned()), settings)
    return score(docs, model).where(F.col("score") >= threshold).select("row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labelled ones that are not held out: doc_id, held_out, score, predicted.

    The driver gets a bounded sample of labelled texts; dictionaries and weights (some 130 KB) are broadcast; scoring is one map.  A
    null or empty text is scored as an empty one; a null doc_id and repeated rows are scored each for itself; an empty table gives
    no rows.
    """
    docs, labels = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, train(docs.where(learned()), labels.where(learned()))).select("row.doc_id", "score")
    return out.select("doc_id", (~learned()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
