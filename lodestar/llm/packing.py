"""Best-fit packing of tokenized documents into sequences of fixed length.

Tokenizing is one narrow pass: the tokenizer drops white space and no token spans it, so each pre-token is merged
once per worker and remembered, up to a bound in bytes (see ``tokens``). Only numbers go on: a row for each piece of a document, written to the shared folder.

Pieces are dealt out evenly by a hash to shards of about ``shard`` pieces (their number follows the input, their size doesn't), and each
shard is packed online, longest piece first, into at most ``open_bins`` open bins. Open bins stand in a bitset over free space: best fit is
the lowest set bit at or above the length of the piece. With all bins open, the fullest closes to make room. A shard's state is the
bitset and one stack of bins for each free space.

Defined results: null text counts as empty and packs as its end token alone; equal rows are packed each; a null doc_id stays null;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import blocks, materialize
from lodestar.llm.tokens import Ids

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=1)
def _known(name: str) -> Ids:
    """Kept by the worker from task to task."""
    return Ids(name)


def _pieces(name: str, length: int, end: int):
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(name)
        for batch in blocks(batches, 2 << 20):
            rows = []
            for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = known.of(x or "") + last
                for k in range(0, len(ids), 4 * length):
                    part = ids[k : k + 4 * length]
                    rows.append((i, k // (4 * length), k // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return run


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", length: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer, length, end), _DDL)


class Bins:
    """At most ``most`` open bins of one size, in a bitset keyed by free space."""

    def __init__(self, size: int, most: int, number: int = 0):
        self.size, self.most, self.next = size, most, number
        self.bits, self.open, self.at = 0, 0, [[] for _ in range(size + 1)]

    def _pop(self, free: int) -> int:
        bin_ = self.at[free].pop()
        self.bits ^= 0 if self.at[free] else 1 << free
        self.open -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the place in it where a piece goes."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._pop(free)
        else:
            if self.open == self.most:
                self._pop((self.bits & -self.bits).bit_length() - 1)
            free, bin_ = self.size, self.next
            self.next += 1
        left = free - length
        if left:
            self.at[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.size - free


def _packed(size: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bins = None, None
        for batch in batches:
            got = []
            for s, n in zip(batch.column("shard").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if s != shard:
                    shard, bins = s, Bins(size, most, s << 32)
                got.append(bins.put(n))
            put = [pa.array(x, pa.int64()) for x in zip(*got, strict=True)] if got else [pa.array([], pa.int64())] * 2
            yield pa.record_batch([*(batch.column(f.name) for f in _PIECES), *put], names=[*_PIECES.names, "sequence_id", "offset"])

    return run


def pack(found: DataFrame, length: int = 4096, open_bins: int = 16_384, shard: int = 65_536) -> DataFrame:
    """Adds sequence_id and offset to pieces (see ``pieces``)."""
    found = materialize(found, "pieces")
    shards = max(1, -(-found.count() // shard))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    order = ["shard", F.col("length").desc(), "doc_id", "piece", "ids_crc32"]
    return dealt.repartition(shards, "shard").sortWithinPartitions(*order).mapInArrow(_packed(length, open_bins), _DDL + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", length: int = 4096, end: int = 1, open_bins: int = 16_384) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each row of docs goes."""
    return pack(pieces(docs, tokenizer, length, end), length, open_bins)
