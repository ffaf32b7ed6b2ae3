"""Near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

Shingles are ``shingle`` consecutive words (lower case, without punctuation at their edges; a shorter text is one shingle). The weight of a
shingle is its count times its inverse document frequency, augmented as it is usual for counts: 0.5 + 0.5 idf / (most idf). Frequencies come from
a count sketch over every document, less the mean of what its counters share by chance; shares of documents under ``RARE`` count as
``RARE``, which such a sketch of fixed size resolves at any number of documents. Half of each weight doesn't depend on the frequency, or
else the shingles of a large group of near copies would be worth nothing for being frequent, and the group would fall apart.

1. One pass counts the sketch; the partial sketches are merged in a tree of tasks.
2. One pass samples ``bands`` x ``rows`` times per text and keeps the band keys and a 128-bit digest of the words. Texts of equal digest
   are copies and go on as one node, so that a large group of copies costs one row.
3. In a bucket of few nodes all pairs are compared. In a crowded bucket all are compared with one center, the node that shares most
   buckets with others, and in one order by further samples each with the ``beside`` nodes before it: rows in proportion to the members.
4. What these links leave in different classes of a crowded bucket is settled exactly: blocks of members meet, and each pair of other
   classes is verified unless its ``MARKS`` further samples agree too seldom (by four standard errors, which one pair at the threshold in
   30,000 does). Blocks return links between classes, never pairs. This step grows with the product of the classes' members, where a bucket
   holds members that no link joins.
5. Links of similarity ``threshold`` or more join nodes into classes.

Every join on a band key reads written tables on both sides, so that Spark can split a hot one; grouped minima and counts are combined
before the shuffle; texts are only shuffled for documents that share a bucket with another. Nothing is collected but counts and the sketch.

Defined results: null text counts as empty; texts without words are copies of each other; null doc_id sorts first and stays null (a
class that holds a null id has a null class_id); rows that share a doc_id are classed by their own texts; repeated rows fall into one
class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import NULL_ID, Hashes, as_bytes, blocks, doc_id_of, kept_rows, materialize, mix, window_hashes, with_id
from lodestar.llm.components import components

#: Counters in each of the two rows of the document-frequency sketch.
WIDTH = 1 << 19
#: The least share of documents that counts as one of its own.
RARE = 1 / 1024
#: Further samples of members of crowded buckets, kept as a byte each.
MARKS = 128
_DRAW_BITS = 14
_DRAWS = 1 << _DRAW_BITS
_EDGES = b"!?.,;:\"'`()[]{}<>*#$%&|~^_+-=/\\@"


class _Words(Hashes):
    """Hashes of words in lower case and without edge punctuation; 0 for what is punctuation only."""

    def hashed(self, word: bytes) -> int:
        bare = word.strip(_EDGES).decode("utf-8", "ignore").lower().encode()
        return (xxhash.xxh3_64_intdigest(bare) or 1) if bare else 0


def _shingles(text: bytes, known: _Words, size: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Distinct shingles, their counts, and a digest of all words."""
    words = text.split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    h = h[h != 0]
    found = window_hashes(h, min(size, len(h))) if len(h) else h
    u, n = np.unique(found, return_counts=True)
    return u, n, xxhash.xxh3_128_digest(h.tobytes())


def _slots(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (u & np.uint64(WIDTH - 1)).astype(np.int64), (WIDTH + ((u >> np.uint64(32)) & np.uint64(WIDTH - 1))).astype(np.int64)


def _sketched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, docs = _Words(), np.zeros(2 * WIDTH, np.uint32), 0
        for batch in blocks(batches):
            found = [_shingles(x, known, size)[0] for x in as_bytes(batch.column("text"))]
            docs += sum(len(u) > 0 for u in found)
            for slot in _slots(np.concatenate(found)):
                total += np.bincount(slot, minlength=2 * WIDTH).astype(np.uint32)
        yield _sketch_row(total, docs)

    return run


def _sketch_row(total: np.ndarray, docs: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array([zlib.compress(total.astype(np.uint64).tobytes(), 1)], pa.binary()), pa.array([docs], pa.int64())], names=["sketch", "docs"])


def _merged(rows: Iterator[tuple[bytes, int]]) -> tuple[np.ndarray, int]:
    total, docs = np.zeros(2 * WIDTH, np.uint64), 0
    for sketch, n in rows:
        total += np.frombuffer(zlib.decompress(sketch), np.uint64)
        docs += n
    return total, docs


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _sketch_row(*_merged((s, n) for b in batches for s, n in zip(b.column("sketch").to_pylist(), b.column("docs").to_pylist(), strict=True)))


def idf_weights(counts: np.ndarray, docs: int) -> np.ndarray:
    """For each counter of the sketch the weight that it gives."""
    counts = counts.reshape(2, -1).astype(np.float64)
    total = counts.sum(1, keepdims=True)
    # what other shingles add to a counter by chance, on average
    own = np.maximum(0.0, (counts - total / WIDTH) * (WIDTH / (WIDTH - 1)))
    share = np.clip(own / max(1, docs), max(RARE, 1 / max(1, docs)), 1.0)
    return (0.5 + 0.5 * np.log1p(1 / share) / np.log1p(1 / RARE)).astype(np.float32).ravel()


def frequency_weights(texts: DataFrame, size: int, at_once: int = 16) -> np.ndarray:
    """For each counter of the sketch the weight it gives, over all texts. 2 x WIDTH numbers, whatever the size of texts."""
    sketches = texts.select("text").mapInArrow(_sketched(size), "sketch binary, docs long")
    parts = texts.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // at_once)
        sketches = sketches.repartition(parts).mapInArrow(_merge, "sketch binary, docs long")
    return idf_weights(*_merged((bytes(r.sketch), r.docs) for r in sketches.collect()))  # one row


def _weights(u: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    a, b = _slots(u)
    return n * np.maximum(table[a], table[b])


@lru_cache(maxsize=16)
def _draws(samples: int, seed: int) -> tuple[np.ndarray, ...]:
    """For each draw r, 1 / r, log c + r beta - r and beta; an odd multiplier for each sample."""
    rng = np.random.default_rng(seed)
    r, c, beta = rng.gamma(2, 1, _DRAWS), rng.gamma(2, 1, _DRAWS), rng.random(_DRAWS)
    odd = rng.integers(0, 2**63, samples, np.uint64) * np.uint64(2) + np.uint64(1)
    return *(x.astype(np.float32) for x in (r, 1 / r, np.log(c) + r * beta - r, beta)), odd


def sample(u: np.ndarray, w: np.ndarray, samples: int, seed: int = 1, at_once: int = 2048) -> np.ndarray:
    """Hashes of consistent weighted samples of the sorted shingles u with weights w.

    Two sets agree in one with the probability of their weighted Jaccard similarity: log a = log c - r (t - beta) - r with
    t = floor(log w / r + beta), and the shingle with the least a is drawn, with its t.
    """
    r, inverse, constant, beta, odd = _draws(samples, seed)
    log_w, best, out, rows = np.log(w).astype(np.float32), np.full(samples, np.inf, np.float32), np.zeros(samples, np.uint64), np.arange(samples)
    for k in range(0, len(u), at_once):
        part = u[k : k + at_once]
        draw = (np.multiply.outer(odd, part) >> np.uint64(64 - _DRAW_BITS)).view(np.int64)
        t = inverse.take(draw)
        t *= log_w[k : k + at_once]
        t += beta.take(draw)
        np.floor(t, out=t)
        a = r.take(draw)
        a *= t
        np.subtract(constant.take(draw), a, out=a)
        at = a.argmin(1)
        least = a[rows, at]
        better = least < best
        best[better] = least[better]
        out[better] = mix(part[at] + mix(t[rows, at].astype(np.int64).view(np.uint64)))[better]
    return out


def _signed(size: int, bands: int, rows: int, table):
    salts = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = _Words(), table.value
        for batch in blocks(batches, 2 << 20):
            keys, digests = [], []
            for x in as_bytes(batch.column("text")):
                u, n, digest = _shingles(x, known, size)
                digests.append(digest)
                if not len(u):
                    keys.append(None)
                    continue
                s = sample(u, _weights(u, n, weights), bands * rows).reshape(bands, rows)
                k = salts.copy()
                for j in range(rows):
                    k = mix(k + s[:, j])
                keys.append(k.view(np.int64))
            yield pa.record_batch([batch.column("id"), batch.column("h"), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "h", "digest", "keys"])

    return run


def _packed(size: int, table):
    """The texts of nodes, and MARKS samples of each that shares a crowded bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, z = _Words(), table.value, zstandard.ZstdCompressor(level=3)
        for batch in blocks(batches, 2 << 20):
            out = []
            for x, node, digest, crowded in zip(as_bytes(batch.column("text")), *(batch.column(c).to_pylist() for c in ("node", "digest", "crowded")), strict=True):
                u, n, own = _shingles(x, known, size)
                if own == digest:
                    marks = sample(u, _weights(u, n, weights), MARKS, seed=2).astype(np.uint8).tobytes() if crowded else b""
                    out.append((node, z.compress(x), len(x), marks))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["node", "packed", "size", "marks"])

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of distinct sorted shingles with weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum())
    most = float(a[1].sum()) + float(b[1].sum()) - least
    return least / most if most else 0.0


class _Reader:
    """Shingles and weights of packed texts."""

    def __init__(self, size: int, table):
        self.size, self.weights, self.known, self.z = size, table.value, _Words(), zstandard.ZstdDecompressor()

    def counts(self, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        return _shingles(self.z.decompress(packed), self.known, self.size)[:2]

    def __call__(self, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        u, n = self.counts(packed)
        return u, _weights(u, n, self.weights)


_LINKS = "a long, b long"


def _links_of(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compared(size: int, threshold: float, table):
    """Links among pairs (a, b), whose texts are packed_a and packed_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, last = _Reader(size, table), (None, None)
        for batch in blocks(batches, 1 << 20):
            found = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "packed_a", "packed_b")), strict=True):
                if last[0] != b:
                    last = (b, read(y))
                if similarity(read(x), last[1]) >= threshold:
                    found.append((a, b))
            yield _links_of(*zip(*found, strict=True)) if found else _links_of([], [])

    return run


def _least_agreement(threshold: float) -> int:
    return math.floor(MARKS * threshold - 4 * math.sqrt(MARKS * threshold * (1 - threshold)))


def _neighbours(size: int, threshold: float, table, beside: int):
    """Links of members in order (key, marks) with the ``beside`` members of the same bucket before them."""
    least = _least_agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, key, before = _Reader(size, table), None, []
        for batch in blocks(batches, 1 << 20):
            found = []
            for k, node, root, packed, marks in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "root", "packed", "marks")), strict=True):
                if k != key:
                    key, before = k, []
                marks, own = np.frombuffer(marks, np.uint8), None
                for other in before:
                    if other[1] != root and np.count_nonzero(other[2] == marks) >= least:
                        own = own or read(packed)
                        other[4] = other[4] or read(other[3])
                        if similarity(own, other[4]) >= threshold:
                            found.append((node, other[0]))
                before = [*before[-beside + 1 :], [node, root, marks, packed, own]]
            yield _links_of(*zip(*found, strict=True)) if found else _links_of([], [])

    return run


def similarities(docs: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray, table: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """Weighted Jaccard similarities of the documents at left with those at right, each given by its shingles and their counts.

    A shingle of count n is n shingles of count one, so that the least weights add up to a product of matrices. Weights are sums
    of floats of 24 bits in doubles, so that the result is that of ``similarity``.
    """
    u, n = (np.concatenate([d[k] for d in docs]) for k in (0, 1))
    row = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
    one = _weights(u, np.ones(len(u)), table)
    total = np.bincount(row, one * n, len(docs))
    copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    code = np.repeat(np.unique(u, return_inverse=True)[1], n) * (int(n.max()) if len(n) else 1) + copy
    row, one = np.repeat(row, n), np.repeat(one, n)
    place = np.full((2, len(docs)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    kinds, code = np.unique(code, return_inverse=True)
    both = np.logical_and(*(np.bincount(code[p[row] >= 0], minlength=len(kinds)) > 0 for p in place))
    kept = np.flatnonzero(both[code])
    code = (np.cumsum(both) - 1)[code[kept]]
    order = np.argsort(code, kind="stable")
    code, row, one = code[order], row[kept][order], one[kept][order]
    least, width = np.zeros((len(left), len(right))), int(both.sum())
    for k in range(0, width, at_once):
        part = slice(*np.searchsorted(code, (k, k + at_once)))
        sides = []
        for p, many, w in zip(place, least.shape, (np.ones(len(one)), one), strict=True):
            at = p[row[part]]
            m = np.zeros((many, min(at_once, width - k)))
            m[at[at >= 0], code[part][at >= 0] - k] = w[part][at >= 0]
            sides.append(m)
        least += sides[0] @ sides[1].T
    most = total[left][:, None] + total[right] - least
    return np.divide(least, most, out=np.zeros_like(least), where=most > 0)


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many samples each row of a shares with each row of b."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        out += x[:, None] == y
    return out


def _blocks_compared(size: int, threshold: float, table):
    """Links between the classes in two blocks of a bucket: all pairs of other classes that share no earlier bucket, where they are compared."""
    least = _least_agreement(threshold)

    def run(rows: pa.Table) -> pa.Table:
        read, none = _Reader(size, table), pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        root, first, key = rows.column("root").to_numpy(), rows.column("first").to_numpy(), rows.column("key")[0].as_py()
        left = np.flatnonzero(first)
        right = left if rows.column("i")[0] == rows.column("j")[0] else np.flatnonzero(~first)
        if not len(left) or not len(right):
            return none
        marks = np.frombuffer(b"".join(rows.column("marks").to_pylist()), np.uint8).reshape(-1, MARKS)
        wanted = (root[left][:, None] != root[right]) & (agreements(marks[left], marks[right]) >= least)
        if not wanted.any():
            return none
        keys = np.array(rows.column("keys").to_pylist(), np.int64)
        at = np.zeros(wanted.shape, np.int8)
        for band in reversed(range(keys.shape[1])):
            at[keys[left, band][:, None] == keys[right, band]] = band
        wanted &= keys[left[:, None], at] == key
        # only documents of a wanted pair are read
        some, other = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
        if not len(some):
            return none
        packed = rows.column("packed").to_pylist()
        used = np.unique(np.concatenate([left[some], right[other]]))
        docs = [read.counts(packed[k]) for k in used]
        near = wanted[np.ix_(some, other)] & (similarities(docs, np.searchsorted(used, left[some]), np.searchsorted(used, right[other]), table.value) >= threshold)
        a, b = np.nonzero(near)
        found = np.unique(np.stack([root[left[some[a]]], root[right[other[b]]]], 1), axis=0)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return run


def _parts(rows: int, each: int) -> int:
    """So many tasks that each has about ``each`` rows."""
    return max(1, -(-rows // each))


def _classed(crowd: DataFrame, links: DataFrame) -> DataFrame:
    """crowd with root, the class that links put a node in."""
    roots = components(links).withColumnRenamed("node", "_node")
    return crowd.join(roots, F.col("node") == F.col("_node"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))


def _open(classed: DataFrame) -> DataFrame:
    """key, root, and members m of each class in buckets that hold several."""
    per = classed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    several = per.groupBy("key").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("key")
    return materialize(per.join(several, "key"), "classes")


def _beside_links(crowd: DataFrame, packed: DataFrame, links: DataFrame, size: int, threshold: float, table, beside: int) -> DataFrame:
    """Links between members of crowded buckets that are near in an order by samples. Rows are dealt out by range, so no bucket is one task's."""
    classed = materialize(_classed(crowd, links), "classed")
    going = classed.join(_open(classed), ["key", "root"], "left_semi").join(packed, "node").select("key", "node", "root", "packed", "marks")
    ordered = going.repartitionByRange(_parts(classed.count(), 2000), "key", "marks", "node").sortWithinPartitions("key", "marks", "node")
    return materialize(ordered.mapInArrow(_neighbours(size, threshold, table, beside), _LINKS), "beside")


def _far_links(crowd: DataFrame, keyed: DataFrame, packed: DataFrame, links: DataFrame, size: int, threshold: float, table, side: int = 512, most: int = 8 << 20) -> DataFrame:
    """Verified links between members of crowded buckets that ``links`` leave in different classes.

    The members of a bucket are dealt into blocks of about ``side`` and ``most`` bytes, a class of more than that into blocks of its own, and
    each block meets each other one, but for those of one class.
    """
    sized = crowd.join(packed.select("node", "size"), "node")
    classed = _classed(crowd, links)
    full = materialize(classed.join(sized, ["key", "node"]), "classed")
    counts = full.groupBy("key", "root").agg(F.greatest(F.count(F.lit(1)) / side, F.sum("size") / most).alias("m"))
    big = F.col("m") > 1
    of_key = counts.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.sum(F.when(big, 0.0).otherwise(F.col("m"))).alias("rest")).where("classes > 1").select("key", "rest")
    plan = materialize(counts.join(of_key, "key"), "plan")
    deal = F.pmod(F.xxhash64(F.when(big, F.col("node")).otherwise(F.col("root"))), F.greatest(F.lit(1), F.ceil(F.when(big, F.col("m")).otherwise(F.col("rest"))))).cast("int")
    block = F.struct(big.alias("big"), F.when(big, F.col("root")).otherwise(F.lit(0).cast("long")).alias("own"), deal.alias("part"))
    dealt = materialize(full.join(plan, ["key", "root"]).select("key", "node", "root", block.alias("block")), "dealt")
    each = dealt.select("key", "block").distinct()
    met = each.withColumnRenamed("block", "i").join(each.withColumnRenamed("block", "j"), "key").where("i <= j and not (i.big and j.big and i.own = j.own)")
    met = materialize(met, "met")
    sides = met.withColumn("block", F.col("i")).unionByName(met.where("i < j").withColumn("block", F.col("j")))
    texts_of = sides.join(dealt, ["key", "block"]).join(keyed.select("node", "keys"), "node").join(packed.select("node", "packed", "marks"), "node")
    texts_of = texts_of.select("key", "i", "j", (F.col("block") == F.col("i")).alias("first"), "root", "keys", "packed", "marks").repartition(_parts(met.count(), 2), "key", "i", "j")
    return materialize(texts_of.groupBy("key", "i", "j").applyInArrow(_blocks_compared(size, threshold, table), _LINKS), "far")


def _links(texts: DataFrame, keyed: DataFrame, size: int, threshold: float, table, few: int = 8, beside: int = 8, most_broadcast: int = 300_000) -> DataFrame:
    """Verified links (a, b) of nodes, enough to join the classes of all buckets. texts: id, h (of the text), text; keyed: node, first (an id), h, digest, keys (one for each band)."""
    spread = lambda df: F.broadcast(df) if df.count() <= most_broadcast else df  # noqa: E731  written tables of a few numbers a row
    each_key = keyed.select("node", F.explode("keys").alias("key"))
    shared = materialize(each_key.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    members = materialize(each_key.join(spread(shared), "key"), "members")
    wanted = materialize(members.groupBy("node").agg((F.max("n") > few).alias("crowded")).join(keyed, "node").select(F.col("first").alias("id"), "h", "node", "digest", "crowded"), "wanted")
    packed = texts.join(spread(wanted), ["id", "h"]).mapInArrow(_packed(size, table), "node long, packed binary, size long, marks binary").dropDuplicates(["node"])
    packed = materialize(packed, "texts")
    # a crowded bucket: all against the member that shares most buckets with others, which is what most are copies of
    crowd = members.where(F.col("n") > few)
    ranked = crowd.join(crowd.groupBy("node").agg(F.sum("n").alias("known")), "node")
    centers = materialize(ranked.groupBy("key").agg(F.max(F.struct("known", "node")).alias("c")).select("key", F.col("c.node").alias("b")), "centers")
    pairs = crowd.join(spread(centers), "key").where("node <> b").select(F.col("node").alias("a"), "b")
    # a bucket of few: all its pairs, at most few for each member
    small = members.where(F.col("n") <= few)
    others = small.groupBy("key").agg(F.collect_list("node").alias("others"))
    each = small.join(others, "key").select(F.col("node").alias("a"), F.explode("others").alias("b")).where("a > b")
    pairs = materialize(pairs.unionByName(each).distinct(), "pairs")
    side = lambda c: packed.select(F.col("node").alias(c), F.col("packed").alias(f"packed_{c}"))
    # dealt out by center and a salt, so that a center's text is read once a task and no center is one task's
    texts_of = pairs.join(side("a"), "a").join(side("b"), "b").repartition(_parts(pairs.count(), 2000), "b", F.pmod(F.xxhash64("a"), F.lit(64))).sortWithinPartitions("b")
    links = materialize(texts_of.mapInArrow(_compared(size, threshold, table), _LINKS), "compared")
    if crowd.isEmpty():
        return links
    crowd = materialize(crowd.select("key", "node"), "crowd")
    links = links.unionByName(_beside_links(crowd, packed, links, size, threshold, table, beside))
    return links.unionByName(_far_links(crowd, keyed, packed, links, size, threshold, table))


def _classes(docs: DataFrame, threshold: float, shingle: int, bands: int, rows: int) -> DataFrame:
    """id, h (of the text), class (the least id of its class), and stays (whether id and h are those of the row that stands for the class) of each row of docs."""
    # an id alone may be that of many texts, null above all
    spark, texts = docs.sparkSession, with_id(docs, F.xxhash64(F.col("text").cast("string")).alias("h"))
    table = spark.sparkContext.broadcast(frequency_weights(texts, shingle))  # fixed size: 2 x WIDTH numbers
    signed = materialize(texts.mapInArrow(_signed(shingle, bands, rows, table), "id long, h long, digest binary, keys array<bigint>"), "signed")
    # written, so that Spark deals out the joins below anew and can split a digest that many rows share
    nodes = signed.groupBy("digest").agg(F.min(F.struct("id", "h", "keys")).alias("least"))
    nodes = materialize(nodes.select("digest", F.monotonically_increasing_id().alias("node"), F.col("least.id").alias("first"), F.col("least.h").alias("h"), F.col("least.keys").alias("keys")), "nodes")
    keyed = nodes.where("keys is not null")
    roots = components(_links(texts, keyed, shingle, threshold, table))
    rooted = nodes.select("digest", "node", F.struct("first", "h").alias("own")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("own").alias("least")), "least")
    classes = materialize(rooted.join(least, "root").select("digest", "least"), "classes")
    return signed.select("id", "h", "digest").join(classes, "digest").select("id", "h", F.col("least.first").alias("class"), ((F.col("id") == F.col("least.first")) & (F.col("h") == F.col("least.h"))).alias("stays"))


def near_dedup(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, bands: int = 10, rows: int = 3) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class of near copies) of each row of docs."""
    found = _classes(docs, threshold, shingle, bands, rows)
    return found.select(doc_id_of(), F.when(F.col("class") == NULL_ID, F.lit(None).cast("long")).otherwise(F.col("class")).alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, bands: int = 10, rows: int = 3) -> DataFrame:
    """Of each class of near copies one row, that with the least doc_id (null before all, ties by a hash of the text), with all columns of docs.

    Null text counts as empty, all texts without words are one class; columns of docs may have any names; an empty table stays empty.
    """
    stays = _classes(docs, threshold, shingle, bands, rows).where("stays").select("id", "h").distinct()
    return kept_rows(docs, stays)
