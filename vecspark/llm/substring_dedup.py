"""Substring dedup: suffix automata over words give matching statistics; spans of at least `window` words go.

Two uses:

* `remove_reference` takes out what also stands in a bounded reference (a benchmark, say).  The reference is cut into
  shards, an automaton of each shard is built and broadcast, and each document is streamed through it: after each word
  the matching statistic is the length of the longest run of words ending there which the shard holds.  Maximal spans of
  `window` words or more go.  The size of the reference is checked before.

* `earlier_windows` finds, in the whole corpus, the windows of `window` words that also start in a document with a smaller
  doc_id.  Here the corpus is its own reference, and broadcasting automata of all of it would take (documents x shards)
  passes.  So reference shards are made by content, and each document visits only those which can match it:

  1. Each window has an anchor: among its runs of `gram` words the one with the smallest hash.  Equal windows have equal
     anchors, and one anchor serves some (window - gram) / 2 windows in a row.  Fixed-size bit tables (two, with hashes of
     their own) tell which anchors can occur in several documents, another which can in more than `hot` ones.
  2. A passage is all windows in a row with one anchor.  It is sent as symbols: hashes of the runs of `unit` words in it,
     so window - unit + 1 symbols in a row are a window, and most of a window's words need not be sent twice.  A passage of more than
     `longest` windows goes in parts, each with all words of its windows: a text of one repeated word is many equal parts, which an
     automaton takes once.  Passages whose anchor occurs in several documents are grouped by anchor.  A group's automaton takes its passages in the
     order of doc_id, and each is matched before it is added; equal passages are added once.
  3. Anchors in more than `hot` documents would make a group large, up to a third of all rows.  Their windows go
     another, exact way: bit tables of their own tell which windows can be in several documents; a task decides those
     that a smaller document of the same batch has; the others go by hash of the window, the smallest doc_id that has it
     (pre-aggregated), joined back.

  Both ways are exact but for collisions of hashes, and no window is dropped.  Passages are compared with the others of their anchor only,
  by 64-bit hashes of runs of words; windows of frequent anchors, which are compared with all others, by 128 bits.

Defined cases: a null text has no words; a text with fewer words than a window loses nothing.  Rows with a null doc_id
lose nothing and take nothing.  Rows that repeat a doc_id aren't smaller than each other; a row's spans are found by
doc_id and the hash of its text.  Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, chunks, documents, packed, partitions, stored, unpacked, whole_rows, with_row
from .words import Words, distinct, grams, mix, words_of


@dataclass(frozen=True)
class Settings:
    window: int = 50
    gram: int = 16
    unit: int = 45
    hot: int = 1024
    longest: int = 4096
    bits: int = 1 << 27
    reference_words: int = 2_000_000
    shard_words: int = 200_000


class SuffixAutomaton:
    """Of runs of words that are added one after another; a match never crosses from one run to the next."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            q = nexts[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:
                last = self._clone(last, w, q)
                continue
            new = len(length)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = new

    def _clone(self, p: int, w, q: int) -> int:
        nexts, link = self.next, self.link
        new = len(self.length)
        nexts.append(dict(nexts[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = new
            p = link[p]
        return new

    def matches(self, words: list) -> np.ndarray:
        """After each word, the length of the longest run ending there that was added."""
        nexts, link, length = self.next, self.link, self.length
        out = np.zeros(len(words), np.int64)
        at = n = 0
        for i, w in enumerate(words):
            to = nexts[at].get(w)
            while to is None and at:
                at = link[at]
                n = length[at]
                to = nexts[at].get(w)
            if to is not None:
                at, n = to, n + 1
            out[i] = n
        return out


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row."""
    out, width = values, 1
    while width < n:
        step = min(width, n - width)
        out = np.minimum(out[: len(out) - step], out[step:])
        width += step
    return out


def anchored(words: Words, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, end, anchor): windows in a row that have one anchor, by their places in words."""
    windows = np.maximum(np.diff(words.first) - s.window + 1, 0)
    total = int(windows.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    anchor = least_of(grams(words.hash, s.gram), s.window - s.gram + 1)
    row = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + words.first[:-1][row]
    a = anchor[place]
    new = np.ones(total, bool)
    new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    return row[begin], place[begin], place[np.append(begin[1:], total) - 1] + 1, a[begin]


def _bit(hashes: np.ndarray, bits: int, buckets: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, place in the bucket's part of the table, first place of that part), in the first or the second table."""
    hashes = mix(hashes + np.uint64(which) * np.uint64(0x9E3779B97F4A7C15))
    edges = np.arange(buckets + 1, dtype=np.int64) * (bits // 8) // buckets * 8
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    size = (edges[bucket + 1] - edges[bucket]).astype(np.uint64)
    return bucket, ((mix(hashes) >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64), edges[bucket]


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(place, how many, least, most) of such parts, each place once and in order."""
    place, n, low, high = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(place, kind="stable")
    place, n, low, high = place[order], n[order], low[order], high[order]
    begins = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
    if not len(begins):
        return place, n, low, high
    return place[begins], np.add.reduceat(n, begins), np.minimum.reduceat(low, begins), np.maximum.reduceat(high, begins)


def tables(docs: DataFrame, hashes: Callable[[Words], tuple[np.ndarray, np.ndarray]], s: Settings, hot: bool, most: int = 500_000) -> tuple[np.ndarray, ...]:
    """Bits of hashes: in several documents, by the first and by the second hash; if hot, those in more than s.hot, by the second.

    hashes(words): (row, hash) of what is looked at.  A task sends a place of the table once for each `most` places that it has gathered: in
    how many documents, the smallest and the largest of them.  So a place that a third of all rows has costs some numbers a task.
    """
    buckets, half = partitions(docs.sparkSession), s.bits // 2
    edges = np.arange(buckets + 1, dtype=np.int64) * (half // 8) // buckets * 8

    def emit(batches: Batches) -> Batches:
        kept: tuple[list, list] = ([], [])

        def packed_rows(which: int) -> pa.RecordBatch:
            place, n, low, high = _merged(kept[which])
            kept[which].clear()
            cut = np.searchsorted(place, edges)
            some = np.flatnonzero(np.diff(cut))
            columns = [[packed(x[cut[b] : cut[b + 1]]) for b in some] for x in (np.diff(place, prepend=0), n, low, high - low)]
            columns[0] = [packed(np.diff(place[cut[b] : cut[b + 1]] - edges[b], prepend=0)) for b in some]
            return pa.record_batch([pa.array(some, pa.int32()), pa.array(np.full(len(some), which, np.int32)), *(pa.array(x, pa.binary()) for x in columns)], names=["bucket", "which", "places", "times", "low", "more"])

        for batch in chunks(batches):
            row, h = hashes(words_of(batch.column("text")))
            docs_ = batch.column("doc_id").to_numpy(zero_copy_only=False)[: batch.num_rows].astype(np.int64)
            for which in (0, 1):
                _, place, first = _bit(h, half, buckets, which)
                own = distinct((place + first) * (1 << 14) + row)  # a batch has less than 2**14 rows
                at, doc = own >> 14, docs_[own & ((1 << 14) - 1)]
                kept[which].append(_merged([(at, np.ones(len(at), np.int64), doc, doc)]))
                if sum(len(x[0]) for x in kept[which]) > most:
                    yield packed_rows(which)
        for which in (0, 1):
            if kept[which]:
                yield packed_rows(which)

    def reduce(table: pa.Table) -> pa.Table:
        b = table.column("bucket")[0].as_py()
        parts = []
        for columns in zip(*(table.column(c) for c in ("places", "times", "low", "more"))):
            gap, n, low, more = (unpacked(x.as_py()).view(np.int64) for x in columns)
            parts.append((np.cumsum(gap), n, low, low + more))
        place, n, low, high = _merged(parts)
        out = []
        for found in (high > low, n > s.hot):
            bits = np.zeros(int(edges[b + 1] - edges[b]), np.uint8)
            bits[place[found]] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
        return pa.table({"bucket": pa.array([b], pa.int32()), "which": table.column("which").slice(0, 1), "several": pa.array([out[0]], pa.binary()), "hot": pa.array([out[1] if hot else None], pa.binary())})

    got = docs.mapInArrow(emit, "bucket int, which int, places binary, times binary, low binary, more binary").groupBy("bucket", "which").applyInArrow(reduce, "bucket int, which int, several binary, hot binary")
    out = tuple(np.zeros(half // 8, np.uint8) for _ in range(3 if hot else 2))
    for r in got.toLocalIterator():  # two rows a bucket; together at most 2 x s.bits bits
        at = int(edges[r.bucket]) // 8
        for table, data in ((out[r.which], r.several), *([(out[2], r.hot)] if hot and r.which else [])):
            table[at : at + len(data)] = np.frombuffer(bytes(data), np.uint8)
    return out


def _holds(table: np.ndarray, hashes: np.ndarray, bits: int, buckets: int, which: int) -> np.ndarray:
    _, place, first = _bit(hashes, bits, buckets, which)
    at = place + first
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def repeated(words: Words, anchors: tuple[np.ndarray, ...], buckets: int, s: Settings) -> tuple[np.ndarray, ...]:
    """(row, first window, end, anchor, whether it is hot) of the passages whose anchor can be in several documents."""
    row, begin, end, anchor = anchored(words, s)
    first, second, hot = anchors
    keep = _holds(first, anchor, s.bits // 2, buckets, 0) & _holds(second, anchor, s.bits // 2, buckets, 1)
    row, begin, end, anchor = row[keep], begin[keep], end[keep], anchor[keep]
    return row, begin, end, anchor, _holds(hot, anchor, s.bits // 2, buckets, 1)


def in_parts(row: np.ndarray, begin: np.ndarray, end: np.ndarray, anchor: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The same windows in passages of `most` windows or fewer."""
    parts = -(-(end - begin) // most)
    each = np.repeat(np.arange(len(row)), parts)
    first = begin[each] + (np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts)) * most
    return row[each], first, np.minimum(first + most, end[each]), anchor[each]


def windows_in(words: Words, row: np.ndarray, begin: np.ndarray, end: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash) of each window of these passages."""
    size = end - begin
    each = np.repeat(np.arange(len(row)), size)
    place = begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
    return row[each], place, grams(words.hash, s.window)[place] if len(each) else np.zeros(0, np.uint64)


def other_hash(words: Words, place: np.ndarray, s: Settings) -> np.ndarray:
    """A second hash of the windows at these places: windows are equal where both agree."""
    return grams(mix(words.hash ^ np.uint64(0x2545F4914F6CDD1D)), s.window)[place] if len(place) else np.zeros(0, np.uint64)


_PASSAGE = "deal long, key long, other long, doc_id long, mark long, start long, end long, symbols binary"
_MATCHED = "key long, other long, doc_id long, mark long, begin long, end long"


def passages(docs: DataFrame, anchors, windows, s: Settings) -> DataFrame:
    """Passages by their anchors, with their symbols; for hot anchors, windows without symbols.

    Of the windows of a hot anchor only those go on that can be in several documents.  If a smaller document of the same
    batch has a window too, it is decided here: such windows are spans, without a key.  Others have their hash as the key.
    deal: what the rows are to be dealt out by, the anchor, or for windows and spans each row's own hash.
    """
    buckets, half = partitions(docs.sparkSession), s.bits // 2
    names = ["deal", "key", "other", "doc_id", "mark", "start", "end", "symbols"]

    def run(batches: Batches) -> Batches:
        for batch in chunks(batches):
            words = words_of(batch.column("text"))
            row, begin, end, anchor, is_hot = repeated(words, anchors.value, buckets, s)
            doc, mark = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "mark"))
            at, cold_begin, cold_end, cold_anchor = in_parts(row[~is_hot], begin[~is_hot], end[~is_hot], anchor[~is_hot], s.longest)
            symbols, more = grams(words.hash, s.unit), s.window - s.unit
            data = [symbols[a : b + more].tobytes() for a, b in zip(cold_begin.tolist(), cold_end.tolist())]
            start = cold_begin - words.first[:-1][at]
            yield pa.record_batch([pa.array(cold_anchor.view(np.int64)), pa.array(cold_anchor.view(np.int64)), pa.nulls(len(at), pa.int64()), pa.array(doc[at]), pa.array(mark[at]), pa.array(start), pa.nulls(len(at), pa.int64()), pa.array(data, pa.binary())], names=names)
            at, place, h = windows_in(words, row[is_hot], begin[is_hot], end[is_hot], s)
            for which, table in enumerate(windows.value):
                keep = _holds(table, h, half, buckets, which)
                at, place, h = at[keep], place[keep], h[keep]
            other = other_hash(words, place, s)
            order = np.lexsort((doc[at], other, h))
            at, place, h, other = at[order], place[order], h[order], other[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (other[1:] != other[:-1])
            later = doc[at] > doc[at][np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else np.zeros(0, bool)
            own = np.flatnonzero(~later)
            # Windows that a smaller document of this batch has, joined where they touch.
            order = np.argsort(place[later])
            span_row, span = at[later][order], place[later][order]
            cut = np.flatnonzero((np.diff(span) > s.window) | (np.diff(span_row) > 0))
            a, b = (np.append(0, cut + 1), np.append(cut, len(span) - 1)) if len(span) else (np.zeros(0, int),) * 2
            at, start, end_ = np.append(at[own], span_row[a]), np.append(place[own], span[a]), np.append(place[own], span[b]) + s.window
            start, end_ = start - words.first[:-1][at], end_ - words.first[:-1][at]
            deal = mix(mix(doc[at].astype(np.uint64)) + start.astype(np.uint64))
            key, other = (pa.array(np.append(x[own].view(np.int64), np.zeros(len(a), np.int64)), mask=np.arange(len(at)) >= len(own)) for x in (h, other))
            yield pa.record_batch([pa.array(deal.view(np.int64)), key, other, pa.array(doc[at]), pa.array(mark[at]), pa.array(start), pa.array(end_), pa.nulls(len(at), pa.binary())], names=names)

    return docs.mapInArrow(run, _PASSAGE)


def _spans(ends: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """(first, end) of windows that end at these places, joined where they touch."""
    if len(ends):
        cut = np.flatnonzero(np.diff(ends) > window)
        for a, b in zip(np.append(0, cut + 1), np.append(cut, len(ends) - 1)):
            yield int(ends[a]) - window + 1, int(ends[b]) + 1


def match_passages(s: Settings):
    """Sorted by anchor and doc_id: the spans of each passage that an earlier document holds (key null). Windows and spans pass."""
    least = s.window - s.unit + 1

    def run(batches: Batches) -> Batches:
        at, before, automaton, added, waiting = None, None, SuffixAutomaton(), set(), {}
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            columns = [batch.column(c).to_pylist() for c in ("key", "other", "doc_id", "mark", "start", "end", "symbols")]
            for key, other, doc, mark, start, end, data in zip(*columns):
                if data is None:
                    for to, x in zip(out, (key, other, doc, mark, start, end)):
                        to.append(x)
                    continue
                if key != at:
                    at, before, automaton, added, waiting = key, doc, SuffixAutomaton(), set(), {}
                elif doc != before:
                    for x in waiting.values():
                        automaton.add(x)
                    added.update(waiting)
                    before, waiting = doc, {}
                if data in added:
                    spans = [(0, len(data) // 8)]
                else:
                    own = waiting[data] = np.frombuffer(data, np.uint64).tolist()
                    spans = _spans(np.flatnonzero(automaton.matches(own) >= least), least) if added else ()
                for a, b in spans:  # of symbols; the last one has unit - 1 words more
                    for to, x in zip(out, (None, None, doc, mark, start + a, start + b + s.unit - 1)):
                        to.append(x)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["key", "other", "doc_id", "mark", "begin", "end"])

    return run


def earlier_windows(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), begin, end: words covered by windows that start in an earlier document too."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    buckets = partitions(docs.sparkSession)

    def anchors_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
        row, _, _, anchor = anchored(words, s)
        return row, anchor

    anchors = sc.broadcast(tables(docs, anchors_of, s, hot=True))

    def hot_windows(words: Words) -> tuple[np.ndarray, np.ndarray]:
        row, begin, end, _, is_hot = repeated(words, anchors.value, buckets, s)
        row, _, h = windows_in(words, row[is_hot], begin[is_hot], end[is_hot], s)
        return row, h

    # Without a hot anchor there is nothing to look at.
    windows = sc.broadcast(tables(docs, hot_windows, s, hot=False) if anchors.value[2].any() else ())
    dealt = passages(docs.withColumn("mark", F.xxhash64("text")), anchors, windows, s).repartition(partitions(docs.sparkSession), "deal")
    found = stored(dealt.sortWithinPartitions("deal", "key", "doc_id").drop("deal").mapInArrow(match_passages(s), _MATCHED))
    windows = found.where("key is not null")
    # Stored, so that the join is one of two plain exchanges, whose large partitions Spark can split.
    first = stored(windows.groupBy("key", "other").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    again = windows.join(first, ["key", "other"]).where(F.col("doc_id") > F.col("first"))
    return found.where("key is null").drop("key", "other").union(again.select("doc_id", "mark", "begin", "end"))


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """row (a struct of all columns of docs), n, removed, kept: word counts and what is kept. spans: doc_id, mark, begin, end."""
    spans = spans.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    rows = whole_rows(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    source = rows.join(spans, ["doc_id", "mark"], "left").select("row", "text", "spans")

    def run(batches: Batches) -> Batches:
        for batch in chunks(batches):
            words = words_of(batch.column("text"))
            data, n = words.data.tobytes(), np.diff(words.first)
            removed, kept = np.zeros(batch.num_rows, np.int64), []
            for i, spans_ in enumerate(batch.column("spans").to_pylist()):
                keep = np.ones(n[i] + 1, bool)
                for x in spans_ or ():
                    keep[x["begin"] : x["end"]] = False
                at = np.flatnonzero(keep[:-1]) + words.first[i]
                removed[i] = n[i] - len(at)
                kept.append(b" ".join([data[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]))
            yield pa.record_batch([batch.column("row"), pa.array(n), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n", "removed", "kept"])

    return source.mapInArrow(run, with_row(docs, "n long, removed long, kept string"))


def dedup(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs, all columns, without the words that earlier documents hold; a text that loses words has its others joined by spaces.

    A null text stays null; rows without a doc_id stay as they are; rows that repeat a doc_id are not earlier than each other.
    """
    return _applied(docs, cut_spans(docs, earlier_windows(docs, s)))


def _applied(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """The columns of docs, with what is kept as the text; n_chars, where there is one, is counted again."""
    changed, out = F.col("removed") > 0, []
    for name, kind in docs.dtypes:
        own = F.col("row").getField(name)
        if name == "text":
            own = F.when(changed, F.col("kept")).otherwise(own)
        elif name == "n_chars":
            own = F.when(changed, F.length("kept")).otherwise(own).cast(kind)
        out.append(own.alias(name))
    return cut.select(*out)


def remove_reference(docs: DataFrame, reference: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs without maximal spans of s.window words or more that a text of reference holds; broadcasts automata.

    A reference of more than s.reference_words words is refused: union it with the corpus under smaller ids and use dedup().
    """
    sc = docs.sparkSession.sparkContext
    size = reference.agg(F.coalesce(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
    if size > s.reference_words:
        raise ValueError(f"a reference of {size} words is not broadcast; the bound is {s.reference_words}")
    texts, shards, filled = [r.text for r in reference.where(F.col("text").isNotNull()).select("text").distinct().collect()], [], s.shard_words
    for text in sorted(texts):
        own = words_of(pa.array([text])).hash
        if filled >= s.shard_words:
            shards.append([])
            filled = 0
        shards[-1].append(own.tobytes())
        filled += len(own)
    sent, built = [sc.broadcast(x) for x in shards], {}

    def run(batches: Batches) -> Batches:
        for batch in chunks(batches):
            words = words_of(batch.column("text"))
            out: tuple[list, ...] = ([], [], [], [])
            doc, mark = (batch.column(c).to_pylist() for c in ("doc_id", "mark"))
            for k, shard in enumerate(sent):
                if k not in built:
                    built[k] = SuffixAutomaton()
                    for x in shard.value:
                        built[k].add(np.frombuffer(x, np.uint64).tolist())
                for i in range(batch.num_rows):
                    own = words.hash[words.first[i] : words.first[i + 1]].tolist()
                    for a, b in _spans(np.flatnonzero(built[k].matches(own) >= s.window), s.window):
                        for to, x in zip(out, (doc[i], mark[i], a, b)):
                            to.append(x)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["doc_id", "mark", "begin", "end"])

    source = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    return _applied(docs, cut_spans(docs, source.mapInArrow(run, "doc_id long, mark long, begin long, end long")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without words of windows that a smaller doc_id has: doc_id, n_words, n_removed, kept_sha256.

    Shuffled: passages that can repeat, the texts once.  Broadcast: up to five bit tables of 8 MB.  A null text has no words; a text of
    fewer than 50 words and a row without a doc_id lose nothing; rows that repeat a doc_id are not smaller than each other; an empty
    table gives no rows.
    """
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = cut_spans(docs, earlier_windows(docs))
    return cut.select("row.doc_id", F.col("n").alias("n_words"), F.col("removed").alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
