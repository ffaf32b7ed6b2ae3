"""Exact dedup through an extendible-hash index on shared files.

Build: one pass over the texts writes segment files to the shared folder: a row for each document with its 64-bit key, and the
(compressed) normalised text for the first of each text in a block, its leader, which also carries the block's count and its
best row. A hot text thus costs one leader for each block, not one row for each copy.

Directory: one bucket of all keys is doubled until a bucket's share of all bytes is half its ``capacity``, which is the same at any size
of input. Each bucket that is overfull then is split by further bits of its keys, from counts over key prefixes below overfull buckets
alone; buckets that aren't split are never listed. A bucket of one key can't be split: its leaders are dealt out to salts of ``capacity`` bytes.

Probe: leaders are dealt out by ranges of keys. An owner task reads its buckets in key order, chains rows of one key and compares
their bytes, so different texts with one key stay apart. It returns, for each leader, the row that stays and the size of its group. What salts
found of one key goes through the same index again, as one leader for each text and salt, until no bucket is overfull.
Documents look up their leader; every such join is on the leader's own number, so no key of it is hot.

Defined results: null text counts as empty, and empty texts equal each other; null doc_id sorts first and stays null; of rows that
agree in text, length and doc_id one is kept; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import NULL_ID, as_bytes, blocks, doc_id_of, kept_rows, materialize, with_id

_SPACE = b" \t\n\x0b\x0c\r"
#: Further bits of the key that each round of counting below overfull buckets looks at.
_BITS = 6
#: What a leader takes besides its text.
_ROW = 64


def _segments(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _segments_of(batches, block)

    return run


def _segments_of(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    number = TaskContext.get().partitionId() << 40
    for batch in blocks(batches, block):
        ids = batch.column("id").to_pylist()
        chars = pa.compute.utf8_length(batch.column("text")).fill_null(0).to_pylist()
        texts = [x.translate(None, _SPACE) for x in as_bytes(batch.column("text"))]
        leader: dict[bytes, int] = {}
        count, best = [0] * len(ids), list(range(len(ids)))
        led = []
        for k, text in enumerate(texts):
            j = leader.setdefault(text, k)
            led.append(j)
            count[j] += 1
            if (-chars[k], ids[k], k) < (-chars[best[j]], ids[best[j]], best[j]):
                best[j] = k
        first = [j == k for k, j in enumerate(led)]
        some = lambda xs: [x if f else None for x, f in zip(xs, first, strict=True)]
        yield pa.record_batch(
            {
                "row": pa.array([number + k for k in range(len(ids))], pa.int64()),
                "id": batch.column("id"),
                "h": batch.column("h"),
                "sha": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                "leader": pa.array([number + j for j in led], pa.int64()),
                "key": pa.array(some([xxhash.xxh3_64_intdigest(t) - 2**63 for t in texts]), pa.int64()),
                "packed": pa.array([z.compress(t) if f else None for t, f in zip(texts, first, strict=True)], pa.binary()),
                "n": pa.array(some(count), pa.int64()),
                "chars": pa.array(some([chars[b] for b in best]), pa.int64()),
                "best_id": pa.array(some([ids[b] for b in best]), pa.int64()),
                "best_row": pa.array(some([number + b for b in best]), pa.int64()),
            }
        )
        number += len(ids)


_SEGMENT = "row long, id long, h long, sha binary, leader long, key long, packed binary, n long, chars long, best_id long, best_row long"


def _low(key: Column, depth: int) -> Column:
    """The least key of the bucket of this depth that holds key."""
    return F.shiftleft(F.shiftright(key, 64 - depth), 64 - depth) if depth else F.lit(-(2**63)).cast("long")


class Directory:
    """Buckets of an extendible-hash index, each a range of keys.

    All have ``depth`` bits, but for those in ``below``: there, by the least key of a bucket of ``depth`` bits, are the buckets that it was
    split into, as their least keys. ``salts`` has the parts of buckets of one key that stay overfull.
    """

    def __init__(self, capacity: int, salted: bool = True):
        self.capacity, self.salted, self.depth, self.tasks = capacity, salted, 0, 1
        self.below: dict[int, list[int]] = {}
        self.salts: dict[int, int] = {}

    def grow(self, leaders: DataFrame) -> Directory:
        """leaders: key, size. Doubles and splits until no bucket is overfull, but for those of one key."""
        total = leaders.agg(F.sum("size")).first()[0] or 0
        while total << 1 > self.capacity << self.depth and self.depth < 40:
            self.depth += 1
        self.tasks = max(1, -(-total // self.capacity))
        at, top = self.depth, {}  # top: the undivided bucket that each open one is in
        found = self._counted(leaders, at).where(F.col("b") > self.capacity).collect()
        while found:
            open_ = []
            for r in found:
                top.setdefault(r.p, r.p)
                if r.lo != r.hi:
                    open_.append(r.p)
                elif r.n > 1 and self.salted:
                    self.salts[r.p] = max(2, min(-(-r.b // self.capacity), -(-r.n // 2)))
            if not open_ or at == 64:
                break
            deep = min(at + _BITS, 64)
            inside = leaders.where(_low(F.col("key"), at).isin(open_)) if at else leaders
            held = defaultdict(list)
            for r in self._counted(inside, deep).collect():
                held[r.p >> (64 - at) << (64 - at) if at else -(2**63)].append(r)
            found = []
            for p in open_:
                known = self.below.setdefault(top[p], [top[p]])
                found += self._split(p, at, deep, sorted(held[p], key=lambda r: r.p), known)
            for r in found:
                top[r.p] = top[next(p for p in open_ if p <= r.p < p + (1 << (64 - at)))]
            at = deep
        for lows in self.below.values():
            lows.sort()
        return self

    @staticmethod
    def _counted(leaders: DataFrame, depth: int) -> DataFrame:
        return leaders.groupBy(_low(F.col("key"), depth).alias("p")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))

    def _split(self, low: int, depth: int, deep: int, held: list, known: list[int]) -> list:
        """Splits a bucket, by its counts at depth deep; returns what is still overfull there."""
        if depth == deep or sum(r.b for r in held) <= self.capacity or not held:
            return [r for r in held if depth == deep and r.b > self.capacity]
        middle = low + (1 << (63 - depth))
        known.append(middle)
        return self._split(low, depth + 1, deep, [r for r in held if r.p < middle], known) + self._split(middle, depth + 1, deep, [r for r in held if r.p >= middle], known)

    def placed(self, leaders: DataFrame) -> DataFrame:
        """leaders with low (its bucket's least key), salts and salt."""
        top = _low(F.col("key"), self.depth)
        rows = [(p, sorted((q, self.salts.get(q, 1)) for q in self.below.get(p, [p]))) for p in {*self.below, *(q for q in self.salts if not any(q in lows for lows in self.below.values()))}]
        split = leaders.sparkSession.createDataFrame(rows, "top long, inside array<struct<low:long,salts:int>>")  # overfull buckets alone
        found = leaders.withColumn("top", top).join(F.broadcast(split), "top", "left")
        own = F.array_max(F.filter("inside", lambda x: x.low <= F.col("key")))
        placed = found.withColumn("own", F.coalesce(own, F.struct(F.col("top").alias("low"), F.lit(1).alias("salts"))))
        return placed.select(F.col("own.low").alias("low"), F.col("own.salts").alias("salts"), F.pmod(F.xxhash64("leader"), F.col("own.salts")).cast("int").alias("salt"), *leaders.columns)


_CHAINED = pa.schema([(c, pa.int64()) for c in ("leader", "rep", "n", "chars", "best_id", "best_row", "key")] + [("packed", pa.binary()), ("hot", pa.bool_())])
_CHAINED_DDL = "leader long, rep long, n long, chars long, best_id long, best_row long, key long, packed binary, hot boolean"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket, salt and key: of each key a chain of texts, compared byte by byte. The text goes on for the first leader of a salted key.

    A bucket or salt holds its capacity at most, and so does the list of leaders of a chain.
    """
    z = zstandard.ZstdDecompressor()
    place, chain, rows = None, [], []

    def close() -> None:
        for c in chain:
            minus, best_id, best_row = c["best"]
            for k, leader in enumerate(c["leaders"]):
                rows.append((leader, c["leaders"][0], c["n"], -minus, best_id, best_row, place[2], c["packed"] if place[3] and not k else None, place[3]))

    def taken() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHAINED, strict=True)], schema=_CHAINED)

    for batch in batches:
        for low, salts, salt, key, leader, packed, n, chars, best_id, best_row in zip(*(batch.column(c).to_pylist() for c in ("low", "salts", "salt", "key", "leader", "packed", "n", "chars", "best_id", "best_row")), strict=True):
            now = (low, salt, key, salts > 1)
            if now != place:
                close()
                place, chain = now, []
            text, best = z.decompress(packed), (-chars, best_id, best_row)
            for c in chain:
                if c["text"] == text:
                    c["n"] += n
                    c["best"] = min(c["best"], best)
                    c["leaders"].append(leader)
                    break
            else:
                chain.append({"text": text, "packed": packed, "n": n, "best": best, "leaders": [leader]})
        if rows:
            yield taken()
            rows = []
    close()
    if rows:
        yield taken()


def _groups(leaders: DataFrame, capacity: int, salted: bool = True) -> DataFrame:
    """leader, keep_id, keep_row, group_size for each leader. salted: whether leaders of one overfull key are dealt out."""
    directory = Directory(capacity, salted).grow(leaders.select("key", (F.length("packed") + _ROW).cast("long").alias("size")))
    ranges = directory.placed(leaders).repartitionByRange(directory.tasks, "low", "salt").sortWithinPartitions("low", "salt", "key")
    chained = ranges.mapInArrow(_chained, _CHAINED_DDL)
    settled = ["leader", F.col("best_id").alias("keep_id"), F.col("best_row").alias("keep_row"), F.col("n").alias("group_size")]
    if not directory.salts:
        return chained.select(*settled)
    chained = materialize(chained, "chained")
    own = chained.where("hot and leader = rep").select("key", "leader", "packed", "n", "chars", "best_id", "best_row")
    # texts that share a key but are different don't get fewer; they are chained in one place
    fewer = own.count() < chained.where("hot").count()
    above = materialize(_groups(own, capacity, fewer), "above").withColumnRenamed("leader", "rep")
    hot = chained.where("hot").select("leader", "rep").join(above, "rep").select("leader", "keep_id", "keep_row", "group_size")
    return chained.where("not hot").select(*settled).unionByName(hot)


def _found(docs: DataFrame, capacity: int, block: int) -> DataFrame:
    """A row for each row of docs: id, h (a hash of the original text), row, keep_row, and what ``exact_dedup`` returns."""
    segments = materialize(with_id(docs, F.xxhash64(F.col("text").cast("string")).alias("h")).mapInArrow(_segments(block), _SEGMENT), "segments")
    leaders = segments.where("key is not null").select("key", "leader", "packed", "n", "chars", "best_id", "best_row")
    return segments.select("row", "id", "h", "sha", "leader").join(_groups(leaders, capacity), "leader")


def exact_dedup(docs: DataFrame, capacity: int = 32 << 20, block: int = 8 << 20) -> DataFrame:
    """For each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (whitespace removed). capacity: bytes of compressed text in a bucket; block: bytes of text that share leaders."""
    return _found(docs, capacity, block).select(
        doc_id_of(),
        F.when(F.col("keep_id") == NULL_ID, F.lit(None).cast("long")).otherwise(F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, capacity: int = 32 << 20, block: int = 8 << 20) -> DataFrame:
    """The rows of docs that ``exact_dedup`` keeps, with all their columns, whatever these are named.

    Null text counts as empty, of texts without other characters than white space one stays; of repeated rows one stays; an empty table stays empty.
    """
    stays = _found(docs, capacity, block).where(F.col("row") == F.col("keep_row")).select("id", "h").distinct()
    return kept_rows(docs, stays)
