"""Periodic runs of words: branching tandem repeats of a suffix tree, rotated and merged into maximal runs.

A run of a text is a stretch of words with smallest period q (words q apart are identical) of at least `times` periods
and `least` words that neither neighbour extends.  The way to them is Stoye and Gusfield's, for all texts of a batch at once:

1. Suffixes of words are sorted by doubling: level t has the class of each suffix by its first 2**t words.  A word's first
   class is of its text alone, so no common prefix crosses from one text into the next.
2. Common prefixes of neighbours in that order give the suffix tree: its inner nodes are intervals of the order, each with a depth.
3. Of each node all children but the largest are walked, so a suffix is looked at O(log n) times.  For suffix i below a node of
   depth d, where i + d or i - d is below the same node but under another child, the 2d words there are a tandem repeat that
   does not go on: a branching one.
4. A branching repeat is rotated to the left as long as the words agree.  Levels are compared from the longest down,
   so that takes O(log n) steps, whatever the length.  Repeats of one run (its periods q, 2q, ...) have the same first and last
   word then: they are merged, and the smallest period is the run's.

Runs are compared by 64-bit hashes of words (classes of equal words within one text).  A task holds one batch of about 512 KB of
text, or one longer text; a text of n words needs about 90 bytes a word, and 4 more for each doubling up to its longest repeat.

Defined cases: a null text has no words, no runs, and the empty text is what is kept of it.  Each row is worked on for itself,
whatever its doc_id (null, or the same as another's).  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, chunks, documents, whole_rows, with_row
from .words import mix, words_of

_RUNS = "words long, runs array<struct<start:long,length:long,period:long>>, kept string"
_WORD = r"([^\x20\x09-\x0D]+)"


@dataclass(frozen=True)
class Settings:
    least: int = 6
    times: int = 4
    pairs: int = 1 << 19  # (suffix, node) looked at together

    def __post_init__(self):
        if self.times < 2:
            raise ValueError("a tandem repeat has two periods: times must be 2 or more")


class SuffixTree:
    """Of codes of words. order: the suffixes, sorted; levels[t][i]: the class of suffix i by its first 2**t words."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        order = np.argsort(codes, kind="stable").astype(np.int32)
        group, size = _groups(codes[order])
        rank = np.full(n + 1, -1, np.int32)
        rank[order] = group
        levels, opened, width = [rank], np.flatnonzero(size > 1), 1
        while len(opened):
            own = order[opened]
            key = rank[own].astype(np.int64) * (n + 1) + rank[np.minimum(own + width, n)] + 1
            by = np.argsort(key, kind="stable")
            order[opened] = own = own[by]
            group, size = _groups(key[by])
            rank = rank.copy()
            rank[own] = opened[group]
            levels.append(rank)
            opened, width = opened[size > 1], 2 * width
        self.order, self.levels = order, levels
        self.place = np.empty(n, np.int32)
        self.place[order] = np.arange(n, dtype=np.int32)

    def prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """(places r, words that the suffixes at r - 1 and r share), where they share any."""
        a, b = self.order[:-1].astype(np.int64), self.order[1:].astype(np.int64)
        some = np.flatnonzero(self.levels[0][a] == self.levels[0][b])
        a, b = a[some], b[some]
        top = np.zeros(len(some), np.int8)
        at = np.arange(len(some))
        for t in range(1, len(self.levels)):
            at = at[self.levels[t][a[at]] == self.levels[t][b[at]]]
            top[at] = t
        shared = np.zeros(len(some), np.int64)
        for t in reversed(range(len(self.levels))):
            at = np.flatnonzero(top >= t)
            same = at[self.levels[t][a[at] + shared[at]] == self.levels[t][b[at] + shared[at]]]
            shared[same] += 1 << t
        return some + 1, shared

    def suffixes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i agree with those before j."""
        shared = np.zeros(len(i), np.int64)
        for t in reversed(range(len(self.levels))):
            a, b = i - shared - (1 << t), j - shared - (1 << t)
            same = np.flatnonzero(np.minimum(a, b) >= 0)
            same = same[self.levels[t][a[same]] == self.levels[t][b[same]]]
            shared[same] += 1 << t
        return shared


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: the place of the first equal one, and how many are equal."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    size = np.diff(np.append(begin, len(values)))
    return np.repeat(begin, size), np.repeat(size, size)


def nodes(places: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(depth, left, right) of the inner nodes, as intervals of the order; the node of which each place begins another child."""
    depth, left, right, owner, path, before = [], [], [], [], [], -1
    for r, d in zip(places.tolist(), shared.tolist()):
        if r != before + 1:  # the two suffixes before share nothing
            for node in path:
                right[node] = before
            path.clear()
        first = r - 1
        while path and depth[path[-1]] > d:
            node = path.pop()
            right[node], first = r - 1, left[node]
        if not path or depth[path[-1]] < d:
            path.append(len(depth))
            depth.append(d)
            left.append(first)
            right.append(0)
        owner.append(path[-1])
        before = r
    for node in path:
        right[node] = before
    return tuple(np.array(x, np.int64) for x in (depth, left, right, owner))


def smaller_children(places: np.ndarray, left: np.ndarray, right: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, first, last) of all children of each node but its largest."""
    node, first = np.concatenate((np.arange(len(left)), owner)), np.concatenate((left, places))
    by = np.lexsort((first, node))
    node, first = node[by], first[by]
    final = np.append(node[1:] != node[:-1], True)
    last = np.where(final, right[node], np.append(first[1:], 0) - 1)
    size = last - first + 1
    by = np.lexsort((-size, node))  # of each node the largest comes first
    by = by[np.concatenate(([False], node[by][1:] == node[by][:-1]))]
    return node[by], first[by], last[by]


def branching_repeats(tree: SuffixTree, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, period) of all branching tandem repeats; some of them twice."""
    places, shared = tree.prefixes()
    depth, left, right, owner = nodes(places, shared)
    if not len(depth):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    node, first, last = smaller_children(places, left, right, owner)
    size, n, found = last - first + 1, len(tree.order), []
    upto, begin = np.cumsum(size), 0
    while begin < len(node):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + most, "right")))
        each = np.repeat(np.arange(begin, end), size[begin:end])
        i = tree.order[first[each] + np.arange(len(each)) - (upto - size)[each] + (upto - size)[begin]].astype(np.int64)
        d = depth[node[each]]
        for j, start in ((i + d, i), (i - d, i - d)):
            at = np.flatnonzero((j >= 0) & (j < n))
            p, child = tree.place[j[at]], each[at]
            own = node[child]
            at = at[(p >= left[own]) & (p <= right[own]) & ((p < first[child]) | (p > last[child]))]
            found.append((start[at], d[at]))
        begin = end
    return tuple(np.concatenate(x) for x in zip(*found))


def maximal_runs(codes: np.ndarray, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) by start, then period. Equal codes: equal words of one text."""
    tree = SuffixTree(codes)
    i, period = branching_repeats(tree, s.pairs)
    start, end = i - tree.suffixes(i, i + period), i + 2 * period
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    keep &= end - start >= np.maximum(s.least, s.times * period)
    start, length, period = start[keep], (end - start)[keep], period[keep]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def runs(docs: DataFrame, s: Settings = Settings(), columns: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns of docs, or those named), words (their number), runs by start and period, and the text that is kept.

    Kept are the words that no run contains after its first period, joined by single spaces.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    source = whole_rows(docs, text) if columns is None else docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), text)

    def run(batches: Batches) -> Batches:
        for batch in chunks(batches):
            words = words_of(batch.column("text"))
            count = np.diff(words.first)
            codes = mix(words.hash + mix(words.row().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            start, length, period = maximal_runs(codes, s)
            edges = np.searchsorted(start, words.first)
            kept = []
            for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                own = text.split()  # bytes are split at space and the controls 9 to 13
                if edges[k] < edges[k + 1]:
                    keep = np.ones(len(own), bool)
                    for r in range(edges[k], edges[k + 1]):
                        a = start[r] - words.first[k]
                        keep[a + period[r] : a + length[r]] = False
                    own = [own[i] for i in np.flatnonzero(keep).tolist()]
                kept.append(b" ".join(own))
            at = start - words.first[np.repeat(np.arange(len(count)), np.diff(edges))]
            each = pa.StructArray.from_arrays([pa.array(at), pa.array(length), pa.array(period)], ["start", "length", "period"])
            yield pa.record_batch([batch.column("row"), pa.array(count), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), each), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "words", "runs", "kept"])

    return source.mapInArrow(run, with_row(docs if columns is None else docs.select(*columns), _RUNS))


def collapse(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs, all columns; a text with runs keeps the first period of each, its words joined by single spaces."""
    out = runs(docs, s)
    text = F.when(F.size("runs") > 0, F.col("kept")).otherwise(F.col("row").getField("text"))
    return out.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def planted(doc_id: Column, text: Column) -> Column:
    """The query's texts: where h % 10 = 0 (h the crc32 of doc_id), words from a on repeat with period p. A null doc_id plants nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def repeated(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i))), " ")

    words = F.filter(F.array(F.regexp_extract_all(text, F.lit(_WORD), F.lit(1))), lambda w: F.size(w) > 0)
    return F.when(h % 10 == 0, F.coalesce(F.get(F.transform(words, repeated), F.lit(0)), text)).otherwise(text)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of words in all documents: doc_id, n_runs, the longest run, digests of all runs and of what is kept.

    One map over all texts; nothing is shuffled or broadcast.  A null text has no words; a row with a null doc_id has its text
    unchanged; repeated rows are worked on each for itself; an empty table gives no rows.
    """
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text", planted(F.col("doc_id"), F.col("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("minus"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return (
        runs(docs, columns=["doc_id"])
        .withColumn("best", best)
        .select(
            "row.doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.minus")).alias("length"), F.col("best.period").alias("period"),
            F.floor(-1000 * F.col("best.minus") / F.col("best.period")).cast("long").alias("exponent_milli"),
            sha(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")).alias("runs_sha256"), sha(F.col("kept")).alias("collapsed_sha256"),
        )
    )
