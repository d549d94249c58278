"""Token counts: edit-aware counting with a segment tree over the pre-tokens of each document.

The state of a document is a row: its text, the length (in characters) and the number of ids of each pre-token, how many
pre-tokens each block of them has, and two segment trees over blocks, whose nodes hold the characters and the ids below
them (node i has children 2 i and 2 i + 1; the root of the second is the document's count).

An edit replaces characters [start, end) by a text.  A walk down the first tree finds its block.  Only the pre-tokens that it
touches are encoded anew, the one before (its match has seen up to two characters behind its end, or the beginning of what is
now an added token), and those behind until the new boundaries meet an old one: the split from a boundary on depends on nothing
before it.  The blocks that were touched get new members and the sums above them are updated; all others stay as they are,
text included.  Blocks grow and shrink; once one would have over four times `LEAF` members the document's blocks are dealt anew.

Documents and edits are joined by doc_id, a shuffle on both sides; a document's edits are applied in the order of
seq, each to the text that the one before left.

Defined cases: a null text is empty (no pre-tokens, a count of 0).  An edit with a null position or document is ignored,
positions are cut to the text, an end before its start counts as the start, a null replacement is empty.  Edits of a
doc_id that several rows have are applied to each of them.  A document without edits keeps its state.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, chunks, documents, id_and_text
from .tokens import Known, cut, pieces, tokenizer_path

_STATE = "doc_id long, text string, lengths array<int>, counts array<int>, sizes array<int>, chars array<long>, tree array<long>"
LEAF = 64


class Counter:
    """Ids of pre-tokens by a tokenizer file; a worker's own."""

    def __init__(self, path: str, pattern: str):
        self.pattern, self.pieces, self.encoded = regex.compile(pattern), pieces(path), 0
        self.special = self.pieces.special
        #: How far behind a pre-token its match may have looked: to the end of an added token that begins there.
        self.reach = max(map(len, self.pieces.added), default=0) + 2
        #: Of each piece, length and number of ids of its pre-tokens, one after another.
        self.known = Known()
        #: Numbers of ids of the pre-tokens that edits have touched.
        self.sizes: dict[str, int] = {}

    def each(self, new: list[str]) -> list[list[int]]:
        found = [self.pattern.findall(x) for x in new]
        kinds = list(set(chain.from_iterable(found)))
        size = {x: len(i) for x, i in zip(kinds, self.pieces.each(kinds))}
        return [[n for x in own for n in (len(x), size[x])] for own in found]

    def split(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(lengths, counts) of the pre-tokens of whole texts."""
        pieces_ = cut(column)
        flat, size = self.known.values(pieces_, self.each)
        edges = np.concatenate(([0], np.cumsum(size // 2)))[pieces_.first].tolist()
        lengths, counts = flat[::2].astype(np.int64), flat[1::2].astype(np.int64)
        out = [(lengths[a:b], counts[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        for i in self.pieces.special_rows(pieces_):
            own = self._sections(pieces_.row(i))
            out[i] = np.array([len(x) for x in own], np.int64), np.array(self.counts(own), np.int64)
        return out

    def _sections(self, text: str) -> list[str]:
        """The pre-tokens of a text with added tokens, each of which is one."""
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.pattern.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def counts(self, found: list[str]) -> list[int]:
        new = [x for x in set(found).difference(self.sizes) if x not in self.pieces.added]
        if len(self.sizes) > 20_000:
            self.sizes.clear()
            new = [x for x in set(found) if x not in self.pieces.added]
        own = {x: len(i) for x, i in zip(new, self.pieces.each(new))} | dict.fromkeys(self.pieces.added, 1)
        self.sizes.update((x, n) for x, n in own.items() if len(x) <= 64)
        return [own[x] if x in own else self.sizes[x] for x in found]

    def end_of(self, text: str, at: int) -> int:
        """Where the pre-token that begins at `at` ends."""
        end = self.pattern.match(text, at).end()
        found = self.special.search(text, at, min(len(text), end + self.reach)) if self.special else None
        if found is None:
            return end
        return found.end() if found.start() == at else self.pattern.match(text, at, found.start()).end()


def tree_of(values: np.ndarray) -> np.ndarray:
    """Sums of the values of blocks: as many leaves as a power of two, node 0 is not used."""
    leaves = 1 << max(len(values) - 1, 0).bit_length()
    tree = np.zeros(2 * leaves, np.int64)
    tree[leaves : leaves + len(values)] = values
    level = leaves
    while level > 1:
        tree[level // 2 : level] = tree[level : 2 * level].reshape(-1, 2).sum(axis=1)
        level //= 2
    return tree


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0], np.cumsum(values)))
    return upto[edges[1:]] - upto[edges[:-1]]


class Document:
    """A document's state while it is edited. Blocks that no edit has touched are slices of the text and arrays that it came with."""

    def __init__(self, text: str, lengths: np.ndarray, counts: np.ndarray, sizes: np.ndarray | None = None, chars: np.ndarray | None = None, tree: np.ndarray | None = None, leaf: int = LEAF):
        self.leaf = leaf
        self._take(text, lengths, counts, sizes, chars, tree)

    def _take(self, text, lengths, counts, sizes=None, chars=None, tree=None) -> None:
        self.text, self.lengths, self.counts = text, lengths, counts
        if sizes is None:
            n = len(lengths)
            sizes = np.diff(np.append(np.arange(0, n, self.leaf), n)) if n else np.zeros(1, np.int64)
        self.at = np.concatenate(([0], np.cumsum(sizes)))  # pre-tokens before each block
        self.chars = tree_of(_sums(lengths, self.at)) if chars is None else chars.copy()
        self.tree = tree_of(_sums(counts, self.at)) if tree is None else tree.copy()
        self.leaves = len(self.tree) // 2
        self.place = np.concatenate(([0], np.cumsum(self.chars[self.leaves : self.leaves + len(sizes)])))
        self.own: dict[int, tuple[str, list[int], list[int]]] = {}

    @property
    def blocks(self) -> int:
        return len(self.at) - 1

    def block(self, b: int) -> tuple[str, list[int], list[int]]:
        if b in self.own:
            return self.own[b]
        i, j = self.at[b], self.at[b + 1]
        return self.text[self.place[b] : self.place[b + 1]], self.lengths[i:j].tolist(), self.counts[i:j].tolist()

    def find(self, p: int) -> tuple[int, int]:
        """The block with character p, which there is unless the text is empty, and how many characters are before it."""
        if not self.chars[1]:
            return 0, 0
        node, rest = 1, p
        while node < self.leaves:
            node *= 2
            if rest >= self.chars[node]:
                rest -= int(self.chars[node])
                node += 1
        return node - self.leaves, p - rest

    def _next(self, b: int, step: int) -> int | None:
        b += step
        while 0 <= b < self.blocks and not self.chars[self.leaves + b]:
            b += step
        return b if 0 <= b < self.blocks else None

    def edit(self, counter: Counter, start: int, end: int, new: str) -> int:
        """Replaces characters; returns how many pre-tokens were encoded."""
        n = int(self.chars[1])
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        low = max(start - counter.reach + 2, 0)
        b, base = self.find(min(low, max(n - 1, 0)))
        last_block = b
        text, lengths, counts = self.block(b)
        lengths, counts = [*lengths], [*counts]
        ends = list(accumulate(lengths))
        if bisect_left(ends, low - base) == 0 and (before := self._next(b, -1)) is not None:
            more = self.block(before)
            b, base, text, lengths, counts = before, base - len(more[0]), more[0] + text, more[1] + lengths, more[2] + counts
            ends = list(accumulate(lengths))
        first = max(bisect_left(ends, low - base) - 1, 0)

        def more_text() -> bool:
            nonlocal text, last_block
            following = self._next(last_block, 1)
            if following is None:
                return False
            last_block = following
            t, own, numbers = self.block(last_block)
            text += t
            lengths.extend(own)
            counts.extend(numbers)
            upto = ends[-1] if ends else 0
            ends.extend([x + upto for x in accumulate(own)])
            return True

        while base + len(text) < end and more_text():
            pass
        text = text[: start - base] + new + text[end - base :]
        edge, moved, at = start - base + len(new), len(new) - (end - start), ends[first - 1] if first else 0
        last, found = bisect_left(ends, end - base), []
        while True:
            if at >= len(text):
                if more_text():
                    continue
                last = len(ends)
                break
            stop = counter.end_of(text, at)
            if stop + counter.reach > len(text) and more_text():
                continue
            found.append(text[at:stop])
            at = stop
            while last < len(ends) and ends[last] + moved < at:
                last += 1
            # Behind the edit all text is old: from a common boundary on the old split goes on.
            if at >= edge and last < len(ends) and ends[last] + moved == at:
                last += 1
                break
        counter.encoded += len(found)
        self._put(b, last_block, text, lengths[:first] + [len(x) for x in found] + lengths[last:], counts[:first] + counter.counts(found) + counts[last:])
        return len(found)

    def _put(self, b: int, last: int, text: str, lengths: list[int], counts: list[int]) -> None:
        """New members for blocks b .. last, dealt out evenly."""
        blocks = last - b + 1
        each = -(-len(lengths) // blocks)
        at = 0
        for k in range(blocks):
            own = slice(k * each, (k + 1) * each)
            size = sum(lengths[own])
            self.own[b + k] = text[at : at + size], lengths[own], counts[own]
            self.chars[self.leaves + b + k], self.tree[self.leaves + b + k] = size, sum(counts[own])
            at += size
        low, high = self.leaves + b, self.leaves + last
        while low > 1:
            low, high = low // 2, high // 2
            for tree in (self.chars, self.tree):
                tree[low : high + 1] = tree[2 * low : 2 * high + 2].reshape(-1, 2).sum(axis=1)
        if each > 4 * self.leaf:
            self._take(*self.state()[:3])

    def state(self) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, lengths, counts, sizes, chars, tree."""
        texts, lengths, counts, sizes, b = [], [], [], np.diff(self.at), 0
        for k in [*sorted(self.own), self.blocks]:
            i, j = self.at[b], self.at[k]
            texts.append(self.text[self.place[b] : self.place[k]])
            lengths.append(self.lengths[i:j])
            counts.append(self.counts[i:j])
            if k < self.blocks:
                own = self.own[k]
                texts.append(own[0])
                lengths.append(np.array(own[1], np.int64))
                counts.append(np.array(own[2], np.int64))
                sizes[k] = len(own[1])
            b = k + 1
        return "".join(texts), np.concatenate(lengths), np.concatenate(counts), sizes, self.chars, self.tree


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


def _lists(values: list, kind: pa.DataType) -> pa.ListArray:
    first = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(first), pa.array(flat).cast(kind))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column without nulls."""
    first, values = column.offsets.to_numpy(), column.values.to_numpy().astype(np.int64)
    return [values[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _states(doc_ids: pa.Array, documents_: list[Document], **more: list[int]) -> pa.RecordBatch:
    text, lengths, counts, sizes, chars, tree = zip(*(d.state() for d in documents_))
    lists = [_lists(x, kind) for x, kind in zip((lengths, counts, sizes, chars, tree), [pa.int32()] * 3 + [pa.int64()] * 2)]
    names = ["doc_id", "text", "lengths", "counts", "sizes", "chars", "tree", *more]
    return pa.record_batch([doc_ids, pa.array(text, pa.string()), *lists, *(pa.array(x, pa.int64()) for x in more.values())], names=names)


def _edited(own: Counter, documents_: list[Document], edits: list[list[dict] | None], doc_ids: pa.Array) -> pa.RecordBatch:
    before = [int(d.tree[1]) for d in documents_]
    encoded = [sum(d.edit(own, e["start"], e["end"], e["new"]) for e in each or ()) for d, each in zip(documents_, edits)]
    return _states(doc_ids, documents_, encoded=encoded, n_before=before)


def count(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The state of each document: doc_id, text, lengths, counts, sizes, chars, tree (tree[1] is the number of ids)."""

    def run(batches: Batches) -> Batches:
        own = counter(path, pattern)
        for batch in chunks(batches):
            text = batch.column("text")
            yield _states(batch.column("doc_id"), [Document(t, *x) for t, x in zip(text.to_pylist(), own.split(text))])

    return id_and_text(docs).mapInArrow(run, _STATE)


def _usable(edits: DataFrame) -> DataFrame:
    """doc_id, edits: those of a document in the order of seq."""
    usable = edits.where("doc_id is not null and start is not null and end is not null")
    return usable.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", F.coalesce("new", F.lit("")).alias("new")))).alias("edits"))


def apply_edits(state: DataFrame, edits: DataFrame, path: str, pattern: str) -> DataFrame:
    """state after edits (doc_id, seq, start, end, new); encoded: how many pre-tokens that took; n_before: the count before."""
    both = state.join(_usable(edits).withColumnRenamed("doc_id", "_of"), F.col("doc_id") == F.col("_of"), "left").drop("_of")

    def run(batches: Batches) -> Batches:
        own = counter(path, pattern)
        for batch in chunks(batches):
            parts = zip(batch.column("text").to_pylist(), *(_arrays(batch.column(c)) for c in ("lengths", "counts", "sizes", "chars", "tree")))
            yield _edited(own, [Document(*x) for x in parts], batch.column("edits").to_pylist(), batch.column("doc_id"))

    return both.mapInArrow(run, f"{_STATE}, encoded long, n_before long")


def count_and_edit(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """count() and then the edits that each row brings along (a column of them, in their order), in one map: as apply_edits()."""

    def run(batches: Batches) -> Batches:
        own = counter(path, pattern)
        for batch in chunks(batches):
            text = batch.column("text")
            yield _edited(own, [Document(t, *x) for t, x in zip(text.to_pylist(), own.split(text))], batch.column("edits").to_pylist(), batch.column("doc_id"))

    return docs.select("doc_id", "text", "edits").mapInArrow(run, f"{_STATE}, encoded long, n_before long")


def sample_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text, edits: three for each text. A word goes in at the start, a character goes from the middle, the end is replaced."""
    n = F.length("text")
    one = lambda seq, start, end, new: F.struct(F.lit(seq).alias("seq"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(new).alias("new"))
    return docs.withColumn("edits", F.array(one(1, F.lit(0), F.lit(0), "Revised: "), one(2, F.floor(n / 2), F.floor(n / 2) + 1, ""), one(3, n + 5, n + 9, " (end)\n")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after three edits each: doc_id, n_tokens, n_tokens_edited, n_pretokens, n_encoded, edited_sha256.

    One map over the table: these edits are made from the text itself and are in its row, so no join is needed, and nothing is
    shuffled or broadcast.  A null text is empty (0 tokens) and is edited like one; repeated rows and null ids are rows like
    any other; an empty table gives no rows.
    """
    import public_tokenizers

    after = count_and_edit(sample_edits(id_and_text(documents(spark, sf_dir))), tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return after.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("tree")[1].alias("n_tokens_edited"), F.size("counts").cast("long").alias("n_pretokens"), F.col("encoded").alias("n_encoded"), F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"))
