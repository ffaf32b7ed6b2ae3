"""Substring dedup: level-wise doubling over windows of words.

A window of ``length`` words can repeat only if each shorter window in it repeats. Level 1 therefore looks at windows of
``first`` words. Each window of ``length`` words names one of the windows of ``first`` words inside it (the one with the
smallest hash), so equal long windows name equal short ones, and only the named ones are shuffled (about a sixth). Those that
repeat, and nothing else, are extended to twice their length, and so on until none survive or ``length`` is reached; longer
windows decide nothing, since each of their words lies in a repeated window of ``length`` words too.

Scale: a task sends a short window once, however often it holds it (what repeats inside a task is known to repeat), so a
passage that stands in a third of all documents costs one row for each block of documents. Documents whose words equal those
of a document with a smaller id are copies: all their windows repeat, and they leave the search after the first level. Documents
without candidates are done where they stand; only the texts of the others are joined with their candidates, by id (of up to
``most_broadcast`` ids all tasks get the list, so that the others are never shuffled).
The last level aggregates the earliest place of each surviving window and returns these places alone; what is a candidate and
not an earliest place goes.

Defined results: null text has no words; null doc_id sorts first and stays null; rows that share a doc_id count as one
document (a window stays if one of them has it first, at that place), but only those rows are copies whose words stand
under a smaller id; documents under ``length`` words lose nothing; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Hashes, as_bytes, blocks, doc_id_of, materialize, mix, window_hashes, with_id, word_hashes

_ANCHORS = pa.schema([("key", pa.int64()), ("known", pa.int32()), ("id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_PLACES = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("id", pa.int64()), ("start", pa.int32())])


def _lengths(first: int, length: int) -> list[int]:
    """first, 2 first, ... length."""
    out = [first]
    while out[-1] * 2 <= length:
        out.append(out[-1] * 2)
    if first < 1 or out[-1] != length:
        raise ValueError("length must be first times a power of two")
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def _named(flat: np.ndarray, at: np.ndarray, short: int, length: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of ``length`` words inside a document: its start, the hash and the place of the short window it names."""
    if starts is None:
        counts = np.maximum(0, np.diff(at) - length + 1)
        starts = _ranges(at[:-1], counts)
    keys = window_hashes(flat, short)
    if not len(starts):
        return starts, np.empty(0, np.uint64), starts
    best, place = keys[starts].copy(), starts.copy()
    for k in range(1, length - short + 1):
        other = keys[starts + k]
        less = other < best
        best[less] = other[less]
        place[less] = starts[less] + k
    return starts, best, place


def _anchors(short: int, length: int):
    """Map side of a level: one row for each run of long windows that name the same short window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in blocks(batches, 2 << 20):
            ids = np.asarray(batch.column("id"))
            words = [x.split() for x in as_bytes(batch.column("text"))]
            flat, at = word_hashes(words, known)
            starts = _spread(batch.column("runs"), at, length) if "runs" in batch.schema.names else None
            starts, best, place = _named(flat, at, short, length, starts)
            if not len(starts):
                continue
            new = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(starts) != 1)])
            first, n, key = starts[new], np.diff(np.r_[new, len(starts)]), best[new]
            doc = np.searchsorted(at, first, "right") - 1
            order = np.argsort(key, kind="stable")
            lead = np.r_[True, np.diff(key[order]) != 0]
            size = np.diff(np.r_[np.flatnonzero(lead), len(order)])
            asks = order[lead]
            # what repeats here is known to repeat: one row asks for the others' sake, all pass
            more = np.zeros(len(key), bool)
            more[order] = np.repeat(size > 1, size)
            twice = np.flatnonzero(more)
            same = np.r_[True, (first[twice][1:] != (first + n)[twice][:-1]) | (np.diff(doc[twice]) != 0)] if len(twice) else np.empty(0, bool)
            head = twice[same]
            total = np.add.reduceat(n[twice], np.flatnonzero(same)) if len(head) else np.empty(0, np.int64)
            spread = mix(key[head] + mix(ids[doc[head]].view(np.uint64) + first[head].astype(np.uint64)))
            yield pa.record_batch(
                [
                    np.concatenate([key[asks], spread]).view(np.int64),
                    np.concatenate([(size > 1).astype(np.int32), np.full(len(head), 2, np.int32)]),
                    np.concatenate([ids[doc[asks]], ids[doc[head]]]),
                    np.concatenate([first[asks] - at[doc[asks]], first[head] - at[doc[head]]]).astype(np.int32),
                    np.concatenate([n[asks], total]).astype(np.int32),
                ],
                schema=_ANCHORS,
            )

    return run


def _spread(runs: pa.ListArray, at: np.ndarray, length: int) -> np.ndarray:
    """The window starts that the runs of each document cover, in order, as places in the flat array of words."""
    counts = pa.compute.list_value_length(runs).fill_null(0).to_numpy(zero_copy_only=False)
    start, n = runs.flatten().flatten()
    base, last = np.repeat(at[:-1], counts), np.repeat(at[1:] - length, counts)
    first = np.asarray(start).astype(np.int64) + base
    # of rows that share an id, runs of one may pass the end of another
    return np.unique(_ranges(first, np.clip(last + 1 - first, 0, np.asarray(n).astype(np.int64))))


def _survivors(anchors: DataFrame) -> DataFrame:
    """Of each document, the runs of window starts whose named window repeats."""
    of_key = Window.partitionBy("key")
    kept = anchors.withColumns({"times": F.count(F.lit(1)).over(of_key), "any": F.max("known").over(of_key)}).where("times > 1 or any > 0")
    return kept.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def _sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        words = [x.split() for x in as_bytes(batch.column("text"))]
        yield pa.record_batch([batch.column("id"), pa.array([len(w) for w in words], pa.int64()), pa.array([_digest(w) for w in words], pa.binary())], names=["id", "n_words", "sha"])


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _copies(rows: DataFrame, length: int) -> DataFrame:
    """id and sha of documents whose words, ``length`` or more, are those of a document with a smaller id."""
    long = rows.where(F.col("n_words") >= length).select("id", "sha")
    first = materialize(long.groupBy("sha").agg(F.min("id").alias("id")), "first")
    # the id is part of the key: no large group of copies meets in one task
    return materialize(long.join(first, ["sha", "id"], "left_anti").distinct(), "copies")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for batch in blocks(batches):
        yield pa.record_batch([batch.column("id"), pa.array([z.compress(x) for x in as_bytes(batch.column("text"))], pa.binary())], names=["id", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are copies go; the others have their text again."""
    z = zstandard.ZstdDecompressor()
    for batch in blocks(batches, 1 << 20):
        texts = [z.decompress(x) for x in batch.column("packed").to_pylist()]
        stays = [not c or _digest(x.split()) not in c for x, c in zip(texts, batch.column("copied").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("id"), pa.array(texts, pa.binary()).cast(pa.string()), batch.column("runs")], names=["id", "text", "runs"]).filter(pa.array(stays))


def _candidates(texts: DataFrame, runs: DataFrame, most_broadcast: int) -> DataFrame:
    """id, text and runs of the documents that runs (id, runs, copied) has. Other texts aren't shuffled while the ids are few."""
    ids = runs.select("id")
    some = texts.join(F.broadcast(ids), "id", "left_semi") if runs.count() <= most_broadcast else texts  # 8 bytes an id
    return some.mapInArrow(_packed, "id long, packed binary").join(runs, "id").mapInArrow(_unpacked, "id long, text string, runs array<struct<start:int,n:int>>")


def _places(length: int):
    """The surviving windows of the last level, each once a block, at its earliest place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in blocks(batches, 1 << 20):
            ids = np.asarray(batch.column("id"))
            flat, at = word_hashes([x.split() for x in as_bytes(batch.column("text"))], known)
            starts = _spread(batch.column("runs"), at, length)
            if not len(starts):
                continue
            doc = np.searchsorted(at, starts, "right") - 1
            h = window_hashes(flat, length)[starts].view(np.int64)
            g = (window_hashes(flat, length, 77)[starts] >> np.uint64(33)).astype(np.int32)
            place = (starts - at[doc]).astype(np.int32)
            order = np.lexsort((place, ids[doc], g, h))
            lead = order[np.r_[True, (np.diff(h[order]) != 0) | (np.diff(g[order]) != 0)]]
            yield pa.record_batch([h[lead], g[lead], ids[doc[lead]], place[lead]], schema=_PLACES)

    return run


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (h, g, id, start), the first of each (h, g)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, g = np.asarray(batch.column("h")), np.asarray(batch.column("g"))
        lead = np.r_[(h[0], g[0]) != last, (np.diff(h) != 0) | (np.diff(g) != 0)]
        last = (h[-1], g[-1])
        yield batch.filter(pa.array(lead)).select(["id", "start"])


def _cut(length: int):
    """Candidate windows that aren't an earliest place go, with all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1 << 20):
            words = [x.split() for x in as_bytes(batch.column("text"))]
            at = np.zeros(len(words) + 1, np.int64)
            np.cumsum([len(w) for w in words], out=at[1:])
            firsts = batch.column("firsts")
            kept = np.asarray(firsts.flatten()).astype(np.int64) + np.repeat(at[:-1], pa.compute.list_value_length(firsts).fill_null(0).to_numpy(zero_copy_only=False))
            goes = np.setdiff1d(_spread(batch.column("runs"), at, length), kept)
            gone = np.zeros(at[-1] + 1, np.int32)
            gone[goes] += 1
            gone[goes + length] -= 1  # goes are distinct, so no two of them fall on one place
            stays = np.cumsum(gone[:-1]) == 0
            masks = [stays[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([len(m) - sum(m) for m in masks], pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(compress(w, m))).hexdigest() for w, m in zip(words, masks, strict=True)]),
                ],
                names=["id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def substring_dedup(docs: DataFrame, length: int = 20, first: int = 5, most_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document once the windows that start earlier elsewhere are gone."""
    levels = _lengths(first, length)
    texts = with_id(docs)
    rows = materialize(texts.mapInArrow(_sequence, "id long, n_words long, sha binary"), "sequences")
    copies = _copies(rows, length)
    own = rows.join(copies, ["id", "sha"], "left_anti")
    schema = "key long, known int, id long, start int, n int"
    # rows of one id are few, so are its copies under other ids
    copied = copies.groupBy("id").agg(F.collect_set("sha").alias("copied"))

    def going(runs: DataFrame) -> DataFrame:
        return materialize(runs.join(own.select("id"), "id", "left_semi").join(copied, "id", "left"), "runs")

    runs = going(_survivors(texts.mapInArrow(_anchors(levels[0], length), schema)))
    held = _candidates(texts, runs, most_broadcast)
    for short in levels[1:-1]:
        held = materialize(held, "candidates")
        runs = going(_survivors(held.mapInArrow(_anchors(short, length), schema)))
        held = _candidates(held.select("id", "text"), runs, most_broadcast)
    held = materialize(held, "candidates")
    places = held.mapInArrow(_places(length), "h long, g int, id long, start int")
    firsts = places.repartition("h").sortWithinPartitions("h", "g", "id", "start").mapInArrow(_first, "id long, start int").groupBy("id").agg(F.collect_set("start").alias("firsts"))
    cut = held.join(firsts, "id", "left").mapInArrow(_cut(length), "id long, n_words long, n_removed long, kept_sha256 string")
    none = hashlib.sha256(b"").hexdigest()
    gone = rows.join(copies, ["id", "sha"], "left_semi").select("id", "n_words", F.col("n_words").alias("n_removed"), F.lit(none).alias("kept_sha256"))
    clean = own.join(runs.select("id"), "id", "left_anti").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("sha")).alias("kept_sha256"))
    return cut.unionByName(gone).unionByName(clean).select(doc_id_of(), "n_words", "n_removed", "kept_sha256")
