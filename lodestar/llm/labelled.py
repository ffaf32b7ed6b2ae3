"""The bounded sample of labelled documents that the classifiers are fitted on, and byte statistics that both use."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialize


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as decimal text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """doc_id, text, y, part (0 to 99, seeded by the id) of at most ``most`` labelled documents, those with the least hash of their id.

    usable: a condition over doc_id. Labels other than 0 and 1, and null ids, are left out; of labels that disagree the larger counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    # at most ``most`` rows of two numbers: a proven bound for the broadcast
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most)
    part = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(100)).cast("int").alias("part")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return materialize(found.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y", part), "sample")


_UPPER, _LOWER, _DIGIT, _LOUD, _SIGN, _SPACE, _HIGH = range(1, 8)
_KINDS = np.zeros(256, np.uint8)
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_KINDS[[ord(c) for c in "!?"]] = _LOUD
_KINDS[[ord(c) for c in "\"#$%&()*+/:;<=>@[\\]^_`{|}~"]] = _SIGN
_KINDS[[ord(c) for c in " \t\n\r\x0b\x0c"]] = _SPACE


def byte_rates(texts: list[bytes]) -> np.ndarray:
    """For each text: bytes, and the shares of capitals, loud marks, signs, digits, signs or digits inside words, and letters said three times."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=at[1:])
    raw = np.frombuffer(b"".join(texts) + b"  ", np.uint8)
    kind = _KINDS[raw]

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[at[1:]] - total[at[:-1]]).astype(np.float64)

    kind, size = kind[: at[-1] + 2], np.maximum(1.0, np.diff(at))
    letter = (kind == _UPPER) | (kind == _LOWER) | (kind == _HIGH)
    odd = (kind == _SIGN) | (kind == _DIGIT)
    inner = np.zeros(len(kind), bool)
    inner[1:-1] = odd[1:-1] & letter[:-2] & letter[2:]
    thrice = np.zeros(len(kind), bool)
    thrice[:-2] = letter[:-2] & (raw[: len(kind) - 2] == raw[1 : len(kind) - 1]) & (raw[1 : len(kind) - 1] == raw[2 : len(kind)])
    upper = per_text(kind == _UPPER)
    return np.column_stack(
        [np.diff(at), upper / np.maximum(1.0, upper + per_text(kind == _LOWER)), *(per_text(kind == k) / size for k in (_LOUD, _SIGN, _DIGIT)), per_text(inner) / size, per_text(thrice) / size]
    )
