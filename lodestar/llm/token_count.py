"""Token counts by a map-side two-tier lookup of pre-tokens.

Byte-level BPE never merges across pre-tokens, so a text has as many tokens as its pre-tokens together. Tier one is a hash table of the
lengths (in tokens) of frequent pre-tokens, fixed in size (``frequent`` entries of ``longest`` characters at most), which every task gets by
broadcast. Tier two is each worker's cache: it encodes what tier one misses, and keeps short pre-tokens while there is room
(see ``tokens`` for its bound). No pre-token is shuffled.

The frequent pre-tokens come from one pass over all texts: each task keeps a Misra-Gries summary of ``frequent`` counters, and
summaries are merged, a few at a time, in a tree of tasks. Which pre-tokens it finds decides the speed, never a count.

Defined results: null text counts as empty, 0 tokens; a null doc_id stays null; equal rows are counted each; extra columns are
ignored; a text without spaces is cut into pre-tokens like any other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import blocks
from lodestar.llm.tokens import Lengths


def _cut(counts: Counter, most: int) -> Counter:
    """The Misra-Gries step: what is over ``most`` counters goes, and all lose as much as the largest that goes."""
    if len(counts) <= most:
        return counts
    least = sorted(counts.values(), reverse=True)[most]
    return Counter({u: n - least for u, n in counts.items() if n > least})


def _summary(counts: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))], names=["parts", "counts"])


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


def _counted(name: str, most: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = _worker(name), Counter()
        for batch in blocks(batches, 2 << 20):
            for x in _texts(batch):
                counts.update(known.pre_tokens(x))
            if len(counts) > 2 * most:
                counts = _cut(Counter({u: n for u, n in counts.items() if len(u) <= longest}), most)
        yield _summary(_cut(Counter({u: n for u, n in counts.items() if len(u) <= longest and n > 1}), most))

    return run


def _merged(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for u, n in zip(batch.column("parts").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts.update(dict(zip(u, n, strict=True)))
                counts = _cut(counts, most)
        yield _summary(counts)

    return run


def frequent_parts(docs: DataFrame, tokenizer: str, most: int = 1 << 15, longest: int = 32, at_once: int = 16) -> list[str]:
    """At most ``most`` pre-tokens that are frequent over all texts."""
    ddl = "parts array<string>, counts array<bigint>"
    summaries = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted(tokenizer, most, longest), ddl)
    parts = docs.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // at_once)
        summaries = summaries.repartition(parts).mapInArrow(_merged(most), ddl)
    return [u for r in summaries.collect() for u in r.parts]


@lru_cache(maxsize=2)
def _worker(name: str) -> Lengths:
    """Without tier one."""
    return Lengths(name, most=50_000)


@lru_cache(maxsize=1)
def _known(name: str, table) -> Lengths:
    """Both tiers; kept by the worker from task to task."""
    return Lengths(name, dict(zip(*table.value, strict=True)))


def _lengths(name: str, table, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(name, table)
        for batch in blocks(batches, 2 << 20):
            texts = _texts(batch)
            tokens = list(map(known.of, texts))
            sizes = pa.compute.binary_length(batch.column("text")).fill_null(0).cast(pa.int64())
            yield pa.record_batch([batch.column("doc_id"), sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, frequent: int = 1 << 15) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = frequent_parts(rows, tokenizer, frequent)
    lengths = list(map(Lengths(tokenizer).parts.__getitem__, found))
    table = docs.sparkSession.sparkContext.broadcast((found, lengths))  # ``frequent`` short entries at most
    return rows.mapInArrow(_lengths(tokenizer, table, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
