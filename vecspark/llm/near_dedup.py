"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A shingle is five words in a row; a text of one to four words has one shingle, all its words.  Its weight is 1 + log
of its count in the text, times its IDF.  Shingles are hashed to `features` slots, and a slot's document frequency is
the number of documents with a shingle in it, counted over all documents: a table of fixed size, safe to broadcast.  Shingles of
many documents stand out from what the slots hold anyway (about features / shingles of a document, as a share of all
documents, whatever the corpus).  The IDF is damped, 1 + damping * log((1 + N) / (1 + df)) / log(1 + features): what a large group of
near copies shares is frequent because of them, and undamped weights would take it out of the comparison and leave the edits alone.
The unweighted similarity that a pair needs for a weighted one of 0.8, by its group's share of all rows (a rare shingle in 0.07 %):

    damping   group of 1/3   1/20    1/1000   weights from 1 to
    1         0.85           0.84    0.80     1.6
    0.5       0.83           0.82    0.80     1.3
    0.25      0.82           0.81    0.80     1.15     (what is used)

Steps, each a Spark job over all documents:

1. Texts with the same words are one node, named by the smallest doc_id (pre-aggregated: a large group costs one row a
   task).  Everything that follows works on nodes.
2. Each node has `bands * rows` weighted samples; nodes that agree in all samples of a band share that band's bucket.
3. Each bucket's smallest node is its hub.  All members are compared with the hub by exact weighted Jaccard similarity.
4. Classes are the connected components of the links, by minimum labels with shortcuts, in tables.
5. A bucket whose members are all in one component is done: a bucket of n similar nodes costs n - 1 comparisons.  In others,
   members of other components than the hub's may still be similar to further members.  One minus the weighted Jaccard
   similarity is a metric, so a pair with distances x and y to the hub is at least |x - y| apart; members that can't be in a
   link any more are left out, and buckets with equal members are taken once.  What remains is compared in tiles of two blocks
   of members: a tile's shared weights are matrix products over columns of shingles, so a text is sent once a tile, not once
   a pair, and a tile returns at most one link a member.  No link between components is lost.  Then step 4 again.

A link between nodes that share no bucket is missed; with 16 bands of 4 samples that has a probability of 0.0002 at a
similarity of 0.8 and less above.

Defined cases: a null text is an empty one, and texts without words are equal to each other (similarity 1).  Rows that
repeat a doc_id are nodes by their texts; each row gets its own text's class, told from others by its root even where the
smallest doc_id is the same.  A row with a null doc_id gets a class like any other (class_id is null only if no row of its
class has an id).  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, chunks, documents, dropped, id_and_text, shared_folder, stored, whole_rows
from .words import Words, distinct, mix, words_of

_GAMMA = np.uint64(0x9FB21C651E98DF25)
#: Bits of a shingle's hash; with the row above them it is one number, so rows of a batch are sorted at once.
_BITS = np.uint64(48)
_MASK = np.uint64((1 << 48) - 1)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 16
    rows: int = 4
    features: int = 1 << 18
    damping: float = 0.25
    seed: int = 7


def runs(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of all rows, in the order of the text."""
    count = np.diff(words.first)
    width = np.minimum(count, n)
    each = np.where(count > 0, count - width + 1, 0)
    row = np.repeat(np.arange(len(count)), each)
    at = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + words.first[:-1][row]
    short = width[row]
    h = short.astype(np.uint64)
    for i in range(n if len(row) else 0):
        ok = short > i
        h = np.where(ok, mix(h * _GAMMA + words.hash[np.where(ok, at + i, 0)]), h)
    return row, h >> (np.uint64(64) - _BITS)


def slot(shingle: np.ndarray, features: int) -> np.ndarray:
    return (shingle >> np.uint64(20)).astype(np.int64) % features


def counted(words: Words, idf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, IDF, count), each shingle of a row once, sorted by both."""
    row, h = runs(words, n)
    h |= row.astype(np.uint64) << _BITS
    h.sort()
    begins = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(begins, len(h)))
    h = h[begins]
    row = (h >> _BITS).astype(np.int64)
    h &= _MASK
    return row, h, idf[slot(h, len(idf))], count


def shingles(words: Words, idf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of all rows, each shingle of a row once, sorted by both."""
    row, h, idf_, count = counted(words, idf, n)
    return row, h, idf_ * (1 + np.log(count))


class Sampler:
    """Improved consistent weighted sampling: for each of k samples the shingle that has the smallest value.

    r and c are Gamma(2, 1) and beta uniform, for each sample and each of `table` residues of the shingle's hash; two
    shingles of one residue are told apart by their hashes.
    """

    def __init__(self, k: int, seed: int, table: int = 1 << 14):
        rng = np.random.default_rng(seed)
        self.table = table
        r = rng.gamma(2.0, 1.0, (table, k)).astype(np.float32)
        self.r, self.log_c = np.maximum(r, np.float32(1e-4)), np.log(rng.gamma(2.0, 1.0, (table, k))).astype(np.float32)
        self.beta = rng.random((table, k), np.float32)

    def __call__(self, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, block: int = 2048) -> np.ndarray:
        """rows x k hashes of (shingle, level); rows without a shingle have zeros. Sorted input: of equal values the smallest hash wins."""
        k = self.r.shape[1]
        out, every = np.zeros((rows, k), np.uint64), np.arange(k)
        log_w = np.log(weight).astype(np.float32)[:, None]
        residue = (shingle & np.uint64(self.table - 1)).astype(np.int64)
        edges = np.searchsorted(row, np.arange(rows + 1))
        for i in np.flatnonzero(np.diff(edges)):
            least = np.full(k, np.inf, np.float32)
            for begin in range(edges[i], edges[i + 1], block):
                own = slice(begin, min(begin + block, edges[i + 1]))
                at = residue[own]
                r, beta = self.r[at], self.beta[at]
                t = log_w[own] / r
                t += beta
                np.floor(t, out=t)
                beta -= t
                beta -= 1
                beta *= r
                beta += self.log_c[at]  # log c - r (t - beta + 1)
                first = beta.argmin(axis=0)
                value = beta[first, every]
                h = mix(shingle[own][first] + t[first, every].astype(np.int64).astype(np.uint64) * _GAMMA)
                out[i] = np.where(value < least, h, out[i])
                least = np.minimum(least, value)
        return out


def idf_of(frequency: np.ndarray, documents_: int, damping: float) -> np.ndarray:
    """The damped IDF of each slot."""
    return 1 + damping * np.log((1 + documents_) / (1 + frequency)) / np.log(1 + len(frequency))


def idf_table(docs: DataFrame, settings: Settings) -> np.ndarray:
    """The IDF of each slot, from all documents; `features` numbers."""
    n = settings.features

    def run(batches: Batches) -> Batches:
        frequency, rows = np.zeros(n + 1, np.int64), 0
        for batch in chunks(batches):
            row, h = runs(words_of(batch.column("text")), settings.words)
            frequency[:n] += np.bincount(distinct(row * n + slot(h, n)) % n, minlength=n)
            rows += batch.num_rows
        frequency[n] = rows
        at = np.flatnonzero(frequency)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(frequency[at])], names=["feature", "documents"])

    got = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "feature int, documents long").groupBy("feature").agg(F.sum("documents").alias("n"))
    frequency = np.zeros(n + 1, np.int64)
    table = got.toArrow()  # settings.features + 1 rows of two numbers at the most, whatever the corpus
    frequency[table.column("feature").to_numpy()] = table.column("n").to_numpy()
    return idf_of(frequency[:n], frequency[n], settings.damping)


def signatures(docs: DataFrame, idf, settings: Settings) -> DataFrame:
    """doc_id, mark, fingerprint of the words (16 bytes), bands (hashes; none without words)."""
    sampler = Sampler(settings.bands * settings.rows, settings.seed)

    def run(batches: Batches) -> Batches:
        table, band = idf.value, np.arange(settings.bands, dtype=np.uint64)
        for batch in chunks(batches):
            words = words_of(batch.column("text"))
            rows = batch.num_rows
            row, shingle, weight = shingles(words, table, settings.words)
            sample = sampler(row, shingle, weight, rows).reshape(rows, settings.bands, settings.rows)
            h = np.zeros((rows, settings.bands), np.uint64) + band
            for i in range(settings.rows):
                h = mix(h * _GAMMA + sample[:, :, i])
            place = np.arange(len(words.hash), dtype=np.uint64) - words.first[:-1].astype(np.uint64)[words.row()]
            marks = np.empty((rows, 2), np.uint64)
            for i, odd in enumerate((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))):
                marks[:, i] = _sums(mix(words.hash + (place + np.uint64(1)) * odd), words.first)
            some = np.diff(words.first) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some)).astype(np.int32) * settings.bands), pa.array(h[some].reshape(-1).view(np.int64)))
            yield pa.record_batch([
                batch.column("doc_id"), batch.column("mark"), pa.array([m.tobytes() for m in marks], pa.binary()), lists,
            ], names=["doc_id", "mark", "fingerprint", "bands"])

    return docs.mapInArrow(run, "doc_id long, mark long, fingerprint binary, bands array<long>")


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def similarities(pairs: DataFrame, texts: DataFrame, idf, settings: Settings) -> DataFrame:
    """a, b (fingerprints), similarity of pairs: each text goes to the pairs that need it, then each pair is worked out."""
    pairs = pairs.withColumn("pair", F.xxhash64("a", "b"))
    needed = pairs.select("pair", "a", "b", F.posexplode(F.array("a", "b")).alias("side", "fingerprint"))
    sides = needed.join(texts, "fingerprint").select("pair", "a", "b", "side", "text")
    both = sides.groupBy("pair", "a", "b").agg(F.max(F.when(F.col("side") == 0, F.col("text"))).alias("text"), F.max(F.when(F.col("side") == 1, F.col("text"))).alias("other"))

    def run(batches: Batches) -> Batches:
        table = idf.value
        for batch in chunks(batches, most=1 << 20):
            n = batch.num_rows
            row, h, w = (np.concatenate(x) for x in zip(*(shingles(words_of(batch.column(c)), table, settings.words) for c in ("text", "other"))))
            order = np.lexsort((h, row))
            row, h, w = row[order], h[order], w[order]
            same = np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1]))
            least = np.bincount(row[same], weights=np.minimum(w[same], w[same + 1]), minlength=n)
            total = np.bincount(row, weights=w, minlength=n) - least
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(least / np.where(total > 0, total, 1))], names=["a", "b", "similarity"])

    return both.select("a", "b", "text", "other").mapInArrow(run, "a binary, b binary, similarity double")


def shared_weights(row: np.ndarray, h: np.ndarray, idf: np.ndarray, count: np.ndarray, rows: int, width: int = 4096) -> np.ndarray:
    """rows x rows: the sums of the smaller weights. A count of c is c columns, whose weights add up to its own."""
    each = np.repeat(np.arange(len(row)), count)
    level = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + 1
    weight = idf[each] * np.where(level == 1, 1.0, np.log(level / np.maximum(level - 1, 1)))
    key, at, times = np.unique(mix(h[each] + level.astype(np.uint64) * _GAMMA), return_inverse=True, return_counts=True)
    own = np.flatnonzero(times[at] > 1)  # a column of one row is in no sum
    order = own[np.argsort(at[own], kind="stable")]
    column, who, w = at[order], row[each][order], weight[order]
    dense = np.cumsum(np.concatenate(([0], column[1:] != column[:-1]))) if len(column) else column
    out = np.zeros((rows, rows))
    for begin in range(0, int(dense[-1]) + 1 if len(dense) else 0, width):
        lo, hi = np.searchsorted(dense, [begin, begin + width])
        m = np.zeros((rows, min(width, int(dense[-1]) + 1 - begin)), np.float32)
        m[who[lo:hi], dense[lo:hi] - begin] = np.sqrt(w[lo:hi])
        out += m @ m.T
    return out


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold the same components together, at most one a row. linked: a symmetric matrix."""
    seen, out = np.zeros(len(linked), bool), []
    for i in range(len(linked)):
        stack = [] if seen[i] else [i]
        seen[i] = True
        while stack:
            at = stack.pop()
            for j in np.flatnonzero(linked[at] & ~seen).tolist():
                seen[j] = True
                out.append((at, j))
                stack.append(j)
    return out


def tile_links(members: DataFrame, texts: DataFrame, idf, settings: Settings, block: int = 256, chars: int = 1 << 20) -> DataFrame:
    """a, b: links between components among the members (band, key, fingerprint, root) of each bucket, in tiles of two blocks.

    A block has about `block` members and `chars` characters at the most; a longer text is a block of about its own.
    """
    long = texts.select("fingerprint", F.length("text").alias("chars"))
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("chars") / F.lit(chars))).cast("int")
    sizes = members.join(long, "fingerprint").groupBy("band", "key").agg(blocks.alias("blocks"))
    dealt = members.join(sizes, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = other.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fingerprint", "root")

    def run(table: pa.Table) -> pa.Table:
        prints, roots = table.column("fingerprint").to_pylist(), np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
        n = len(prints)
        row, h, value, count = counted(words_of(table.column("text")), idf.value, settings.words)
        total = np.bincount(row, weights=value * (1 + np.log(count)), minlength=n)
        least = shared_weights(row, h, value, count, n)
        # Products are in single precision: what is close to the bound is worked out again in double.
        similarity = least / np.maximum(total[:, None] + total - least, 1e-300)
        apart = roots[:, None] != roots
        linked = apart & (similarity >= settings.similarity + 1e-4)
        edges = np.searchsorted(row, np.arange(n + 1))
        for i, j in zip(*np.nonzero(np.triu(apart & (np.abs(similarity - settings.similarity) < 1e-4)))):
            x, y = (slice(edges[k], edges[k + 1]) for k in (i, j))
            _, p, q = np.intersect1d(h[x], h[y], assume_unique=True, return_indices=True)
            sums = np.minimum(value[x][p] * (1 + np.log(count[x][p])), value[y][q] * (1 + np.log(count[y][q]))).sum()
            linked[i, j] = linked[j, i] = sums / (total[i] + total[j] - sums) >= settings.similarity
        found = _spanning(linked)
        return pa.table({"a": pa.array([prints[i] for i, _ in found], pa.binary()), "b": pa.array([prints[j] for _, j in found], pa.binary())})

    both = tiles.join(texts, "fingerprint").select("band", "key", "i", "j", "fingerprint", "root", "text")
    return both.groupBy("band", "key", "i", "j").applyInArrow(run, "a binary, b binary")


def open_members(of_hub: DataFrame, root: DataFrame, settings: Settings, at) -> DataFrame:
    """band, key, fingerprint, root: members of buckets that can still be in a link between components.

    of_hub: band, key, fingerprint, hub, apart. Buckets with the same such members are one. at: the path of a table to be stored.
    """
    label = root.select(F.col("node").alias("fingerprint"), "root")
    of_its_hub = root.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    named = of_hub.join(label, "fingerprint", "left").join(of_its_hub, "hub", "left")
    named = stored(named.withColumns({"root": F.coalesce("root", "fingerprint"), "hub_root": F.coalesce("hub_root", "hub")}).withColumn("far", F.col("root") != F.col("hub_root")).drop("hub", "hub_root"), at("named"))
    reach = 1 - settings.similarity + 1e-6
    # Buckets without a far member are done, and find no partner here. Stored, so that Spark can split a large bucket's side.
    nearest = stored(named.where("far").groupBy("band", "key").agg(F.min("apart").alias("nearest")), at("nearest"))
    kept = named.join(nearest, ["band", "key"]).where(F.col("far") | (F.col("apart") >= F.col("nearest") - reach))
    same = kept.groupBy("band", "key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fingerprint")).alias("x"), F.min("root").alias("least"), F.max("root").alias("most"))
    once = same.where("least <> most").groupBy("n", "x").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key")
    return kept.join(once, ["band", "key"], "left_semi").select("band", "key", "fingerprint", "root")


def components(links: DataFrame) -> DataFrame:
    """node, root of links (a, b): every node gets the smallest node that it is connected to."""
    spark, folder, step = links.sparkSession, shared_folder(links.sparkSession), 0
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{folder}/edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{folder}/0")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        next_ = stored(labels.join(near, labels.node == near.a).select("node", "root", F.least("root", "near").alias("new")), f"{folder}/next{step}")
        # A shortcut: the label's own label. It halves the length of chains.
        up = next_.select(F.col("node").alias("new"), F.col("new").alias("up"))
        jumped = next_.join(up, "new", "left").select("node", F.least("new", F.coalesce("up", "new")).alias("root"), "root").toDF("node", "root", "was")
        jumped = stored(jumped, f"{folder}/{step + 1}")
        dropped(spark, f"{folder}/next{step}", f"{folder}/{step}")
        if not jumped.where(~F.col("root").eqNullSafe(F.col("was"))).limit(1).count():
            dropped(spark, f"{folder}/edges")
            return jumped.select("node", "root")
        step, labels = step + 1, jumped.select("node", "root")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs (doc_id, text): doc_id, mark (xxhash64 of the text), class_id (the smallest doc_id of its class), root (names the class)."""
    classes = _classes(docs, settings)
    least = stored(classes.groupBy("root").agg(F.min("doc_id").alias("class_id")))
    return classes.join(least, "root").select("doc_id", "mark", "class_id", "root")


def _classes(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, mark, root of each row, stored."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    at = lambda name: f"{folder}/{name}"
    docs = id_and_text(docs).withColumn("mark", F.xxhash64("text"))
    idf = spark.sparkContext.broadcast(idf_table(docs, settings))
    marked = stored(signatures(docs, idf, settings), at("marked"))
    nodes = marked.groupBy("fingerprint").agg(F.first("bands").alias("bands"))
    banded = stored(nodes.where(F.size("bands") > 0).select("fingerprint", F.posexplode("bands").alias("band", "key")), at("banded"))
    # Stored, as other small sides below: a join of two plain exchanges, whose large partitions Spark can split.
    hubs = stored(banded.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("fingerprint").alias("hub")).where("n > 1").drop("n"), at("hubs"))
    members = stored(banded.join(hubs, ["band", "key"]).where(F.col("fingerprint") != F.col("hub")), at("members"))
    dropped(spark, at("banded"), at("hubs"))
    first = members.select(F.col("hub").alias("a"), F.col("fingerprint").alias("b")).distinct()
    texts = _texts(docs, marked, members.select("fingerprint").union(members.select("hub")).distinct(), at("texts"))
    known = stored(similarities(first, texts, idf, settings), at("known"))
    of_hub = members.join(known, (members.hub == known.a) & (members.fingerprint == known.b)).select("band", "key", "fingerprint", "hub", (1 - F.col("similarity")).alias("apart"))
    links = known.where(F.col("similarity") >= settings.similarity).select("a", "b")
    root = components(links)
    more = stored(tile_links(stored(open_members(of_hub, root, settings, at), at("open")), texts, idf, settings), at("more"))
    root = components(links.union(more))
    classes = stored(marked.join(root, marked.fingerprint == root.node, "left").select("doc_id", "mark", F.coalesce("root", "fingerprint").alias("root")))
    dropped(spark, folder)
    return classes


def _texts(docs: DataFrame, marked: DataFrame, wanted: DataFrame, path: str) -> DataFrame:
    """fingerprint, text of the wanted fingerprints: that of the smallest row which has it (rows without an id first)."""
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "mark")
    ids = wanted.join(marked.groupBy("fingerprint").agg(F.min(key).alias("k")), "fingerprint").select("fingerprint", "k.id", "k.mark")
    found = docs.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(ids, ["id", "mark"])
    # Rows that repeat both are the same text.
    return stored(found.groupBy("fingerprint").agg(F.first("text").alias("text")), path)


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs without all but one row of each class; all columns stay.

    The row with the smallest doc_id stays (one without an id only where its whole class has none), of those the one with the
    smallest hash of the text, and of equal ones any.  Classes are told apart by their roots, so rows that share a doc_id but not a
    class stay each for its own.
    """
    out = _classes(docs, settings)
    which = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    chosen = out.groupBy("root").agg(F.min(which).alias("k")).select("k.doc_id", "k.mark")
    repeats = out.groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    same = lambda a, b: a.doc_id.eqNullSafe(b.doc_id) & (a.mark == b.mark)
    keep = stored(chosen.join(repeats, same(chosen, repeats)).select(chosen.doc_id, chosen.mark, "n"))
    rows = whole_rows(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    kept = rows.join(keep, same(rows, keep)).select("row", rows.doc_id, rows.mark, "n")
    once = kept.where("n > 1").groupBy("doc_id", "mark").agg(F.first("row").alias("row"))
    return kept.where("n = 1").select("row").union(once.select("row")).select("row.*")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents (five words, weighted similarity 0.8): doc_id, class_id (the smallest doc_id of the class).

    Shuffled: band hashes, pairs with a bucket's hub, texts of such pairs.  Broadcast: the IDF of 2^18 slots, 2 MB.  Null and empty
    texts are one class; a null doc_id has its text's class; repeated rows share one; an empty table gives no rows.
    """
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id")
