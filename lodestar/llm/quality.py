"""Quality: Bradley-Terry scores learned from preference pairs.

A labelled document of quality 1 is preferred to one of quality 0. Seeded pairs give differences of feature vectors; logistic
loss on them, with a ridge, is minimised by Newton steps, so that score = w . x ranks documents. Features are shape statistics
of the whole text, each cut at its quantiles into steps. The threshold is the score quantile of the sample that splits its labels
best; scores are reported as quantiles, stretched so that this one falls on 0.7.

Fitting uses a bounded sample (``most`` rows, 12,000 unless told otherwise). Scoring is one narrow pass: no shuffle.

Defined results: null text counts as empty; empty texts are scored like any other; a null doc_id is not held out; without labels
of both kinds every score is the share of label 1 (0 without any).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import as_bytes, blocks
from lodestar.llm.labelled import byte_rates, crc_of_id, labelled_sample

#: A score at or above this is a prediction of quality 1.
CUT = 0.7


def features(texts: list[bytes]) -> np.ndarray:
    rows = []
    for x in texts:
        words, lines = x.split(), x.split(b"\n")
        n = max(1, len(words))
        ends = x.count(b".") + x.count(b"?") + x.count(b"!")
        rows.append(
            (
                math.log1p(len(words)),
                len(set(words)) / n,
                len(set(words)) / math.sqrt(n),
                sum(map(eq, words, words[1:])) / n,
                sum(map(eq, words, words[2:])) / n,
                sum(map(len, words)) / n,
                len(set(lines)) / len(lines),
                n / len(lines),
                x.count(b"|") / n,
                x.count(b",") / n,
                ends / n,
                max(map(len, words), default=0),
            )
        )
    return np.column_stack([np.array(rows, np.float64).reshape(len(texts), 12), byte_rates(texts)[:, 1:]])


@dataclass
class QualityModel:
    steps: list[np.ndarray]
    weights: np.ndarray
    grid: np.ndarray
    levels: np.ndarray
    rate: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _stepped(x, self.steps) @ self.weights

    def scorer(self) -> Callable[[list[bytes]], np.ndarray]:
        return lambda texts: np.interp(self.raw(features(texts)), self.grid, self.levels) if len(self.weights) else np.full(len(texts), self.rate)


def _stepped(x: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([(c[:, None] > s).astype(np.float64) for c, s in zip(x.T, steps, strict=True)])


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int, ridge: float, seed: int, rounds: int = 8) -> np.ndarray:
    """Weights that make the preferred of each pair score higher: logistic loss on feature differences."""
    rng = np.random.default_rng(seed)
    d = x[rng.choice(np.flatnonzero(y == 1), pairs)] - x[rng.choice(np.flatnonzero(y == 0), pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ p - ridge * w)
    return w


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(features(as_bytes(batch.column("text"))).tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 12_000, pairs: int = 30_000, seed: int = 5) -> QualityModel:
    """Learns from labels.quality where crc32(doc_id) mod 4 is not 2."""
    sample = labelled_sample(docs, labels, "quality", crc_of_id() % 4 != 2, most)
    got = sorted(sample.select("doc_id", "text", "y").mapInArrow(_sampled, "doc_id long, y int, x array<double>").collect(), key=lambda r: (r.doc_id, r.x))
    y = np.array([r.y for r in got], int)
    if min((y == 1).sum(), (y == 0).sum()) < 5:
        return QualityModel([], np.empty(0), np.empty(0), np.empty(0), float(y.mean()) if len(y) else 0.0)
    x = np.array([r.x for r in got])
    steps = [np.unique(np.quantile(c, np.linspace(0, 1, 13)[1:-1])) for c in x.T]
    z = _stepped(x, steps)
    w = bradley_terry(z, y, pairs, 3.0, seed)
    order = np.argsort(z @ w, kind="stable")
    s, good = (z @ w)[order], y[order] == 1
    # rows under cut k are predicted 0: right are the bad ones below and the good ones from k on
    right = np.r_[0, np.cumsum(~good)] + np.r_[good.sum() - np.r_[0, np.cumsum(good)]]
    right[1:-1][s[1:] == s[:-1]] = -1
    best = np.flatnonzero(right == right.max())
    k = int(np.clip(best[len(best) // 2], 1, len(s) - 1))
    at, share = (s[k - 1] + s[k]) / 2, k / len(s)
    quantile = np.linspace(0, 1, 401)
    level = np.where(quantile < share, CUT * quantile / share, CUT + (1 - CUT) * (quantile - share) / (1 - share))
    grid, levels = np.r_[np.quantile(s, quantile), at], np.r_[level, CUT]
    order = np.lexsort((levels, grid))
    return QualityModel(steps, w, grid[order], np.maximum.accumulate(levels[order]), float(y.mean()))


def _scored(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in blocks(batches):
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score(as_bytes(batch.column("text"))))], names=["doc_id", "held_out", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.7 or more) of each row of docs."""
    model = fit_quality(docs, labels, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_of_id() % 4 == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))
