"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Fitting uses a bounded sample of labelled documents (``most`` rows, 12,000 unless told otherwise), whose size doesn't grow with the
corpus. The lexicon is learned there: whole words and word beginnings whose log-odds of standing in a toxic document are
high even two standard errors lower; it holds 4,000 entries at most. Two halves of the sample score each other with their
own lexicons, so that the trees see densities as they are on unseen text; a third part calibrates.
Scoring is one narrow pass over the whole texts: no shuffle. The model (some hundred kB) goes out with the task.

Defined results: null text counts as empty; an empty text gets the score of its features, all zero; a null doc_id is not held out;
without labels of both kinds every score is the share of label 1 (0 without any).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.boosting import BoostedTrees, Isotonic
from lodestar.llm.common import Hashes, as_bytes, blocks
from lodestar.llm.labelled import byte_rates, crc_of_id, labelled_sample

#: Words that address the reader.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine sie ihr ihnen usted ustedes ti tú tus vosotros su sus".split())
_EDGES = "!?.,;:\"'`´()[]{}<>*#$%&|~^_+-=/\\@…“”„«»¿¡"
#: Signs that stand in for letters.
_LOOKS = str.maketrans("013457@$!|", "oieastasil")
#: What a word is to the features; lexicon entries by weight: mild, strong from 2, sure from 3.5; hidden: strong once signs are read as letters.
_PLAIN, _SECOND, _MILD, _STRONG, _HIDDEN, _SURE = range(6)
_STEMS = (3, 4, 5, 6)


def _terms(word: str) -> list[str]:
    """The whole word (marked by a final $) and its beginnings."""
    return [word + "$", *(word[:k] for k in _STEMS if len(word) > k)]


class _Codes(dict):
    """What each word as it stands in a text means to the features; words of ``Hashes.longest`` bytes at most are remembered while there are fewer than ``most``."""

    def __init__(self, lexicon: dict[str, float], most: int = 150_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def _weight(self, word: str) -> float:
        return max(self.lexicon.get(t, 0.0) for t in _terms(word)) if word else 0.0

    def __missing__(self, chunk: bytes) -> int:
        word = chunk.decode("utf-8", "ignore").lower().strip(_EDGES)
        weight, code = self._weight(word), _PLAIN
        if weight:
            code = _SURE if weight >= 3.5 else _STRONG if weight >= 2 else _MILD
        elif word in SECOND_PERSON:
            code = _SECOND
        elif not word.isalpha() and word:
            bare = "".join(c for c in word.translate(_LOOKS) if c.isalpha())
            code = _HIDDEN if self._weight(bare) >= 2 else _PLAIN
        if len(chunk) <= Hashes.longest:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = code
        return code


class _Terms(dict):
    """The terms of each word as it stands in a text."""

    def __missing__(self, chunk: bytes) -> list[str]:
        word = chunk.decode("utf-8", "ignore").lower().strip(_EDGES)
        terms = _terms(word) if word else []
        if len(chunk) <= Hashes.longest:
            if len(self) >= 100_000:
                self.clear()
            self[chunk] = terms
        return terms


def features(texts: list[bytes], codes: _Codes) -> np.ndarray:
    rates, rows = byte_rates(texts), []
    for x in texts:
        words = x.split()
        c, n = bytes(map(codes.__getitem__, words)), max(1, len(words))
        sure, mild, hidden, second = c.count(_SURE), c.count(_MILD), c.count(_HIDDEN), c.count(_SECOND)
        strong = sure + c.count(_STRONG)
        kinds = len({w.lower() for w, k in zip(words, c, strict=True) if k >= _STRONG}) if strong + hidden else 0
        close, gap = 0.0, 0.0
        if second and strong + mild + hidden:
            a = np.frombuffer(c, np.uint8)
            hits, said = np.flatnonzero(a >= _MILD), np.flatnonzero(a == _SECOND)
            k = np.searchsorted(said, hits)
            far = np.minimum(np.abs(hits - said[np.minimum(k, len(said) - 1)]), np.abs(hits - said[np.maximum(k - 1, 0)]))
            close, gap = float((far <= 5).mean()), 1 / float(far.min())
        rows.append((math.log1p(sure), kinds, 100 * kinds / n, math.log1p(strong + hidden), 100 * (strong + hidden) / n, math.log1p(mild), 100 * mild / n, 100 * hidden / n, 100 * second / n, close, gap, math.log1p(n)))
    return np.column_stack([np.array(rows, np.float64).reshape(len(texts), 12), rates[:, 1:]])


@dataclass
class ToxicityModel:
    lexicon: dict[str, float] = field(default_factory=dict)
    trees: BoostedTrees | None = None
    scale: Isotonic | None = None
    rate: float = 0.0

    def scorer(self) -> Callable[[list[bytes]], np.ndarray]:
        codes = _Codes(self.lexicon)
        return lambda texts: np.clip(self.scale(self.trees.margin(features(texts, codes))), 0, 1) if self.trees else np.full(len(texts), self.rate)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of each half and label each term stands, summed while it fits."""
    found: list[Counter] = [Counter() for _ in range(4)]
    terms_of = _Terms()

    def out() -> pa.RecordBatch:
        terms = list(set().union(*found))
        return pa.record_batch([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in found)], names=["term", "c0", "c1", "c2", "c3"])

    for batch in blocks(batches):
        for x, y, part in zip(as_bytes(batch.column("text")), batch.column("y").to_pylist(), batch.column("part").to_pylist(), strict=True):
            found[2 * (part % 2) + y].update(set(chain.from_iterable(map(terms_of.__getitem__, set(x.split())))))
        if sum(map(len, found)) > 400_000:
            yield out()
            found = [Counter() for _ in range(4)]
    yield out()


def _lexicon(rows: list, which: tuple[int, ...], totals: list[int], most: int) -> dict[str, float]:
    p_all, n_all = (sum(totals[2 * k + y] for k in which) for y in (1, 0))
    out = {}
    for r in rows:
        p, n = sum(r[2 + 2 * k] for k in which), sum(r[1 + 2 * k] for k in which)
        z = math.log((p + 0.5) / (p_all + 1)) - math.log((n + 0.5) / (n_all + 1))
        low = z - 2 * math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
        if p >= 3 and low > 0.7:
            out[r[0]] = low
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:most])


def _sampled(lexicons: list[dict[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [_Codes(x) for x in lexicons]
        for batch in blocks(batches):
            part, texts = batch.column("part").to_pylist(), as_bytes(batch.column("text"))
            rows = [features([x], codes[1 - p % 2])[0] for x, p in zip(texts, part, strict=True)]
            yield pa.record_batch([batch.column("y"), batch.column("part"), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["y", "part", "x"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 12_000, terms: int = 4_000) -> ToxicityModel:
    """Learns from labels.toxic where crc32(doc_id) mod 5 is not 0. most: rows of the sample; terms: entries of the lexicon."""
    sample = labelled_sample(docs, labels, "toxic", crc_of_id() % 5 != 0, most)
    counts = {(r.h, r.y): r["count"] for r in sample.groupBy((F.col("part") % 2).alias("h"), "y").count().collect()}
    totals = [counts.get((h, y), 0) for h in (0, 1) for y in (0, 1)]
    yes, no = totals[1] + totals[3], totals[0] + totals[2]
    if min(yes, no) < 10:
        return ToxicityModel(rate=yes / max(1, yes + no))
    summed = sample.mapInArrow(_counted, "term string, c0 long, c1 long, c2 long, c3 long").groupBy("term").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(4)))
    # candidates by a bound that every lexicon entry meets; the sample bounds them
    odds = (F.col("c1") + F.col("c3") + 0.5) / (F.col("c0") + F.col("c2") + 0.5) * ((no + 1) / (yes + 1))
    rows = [tuple(r) for r in summed.where("c1 + c3 >= 3").orderBy(odds.desc(), "term").limit(4 * terms).collect()]
    halves = [_lexicon(rows, (k,), totals, terms) for k in (0, 1)]
    got = sample.select("text", "y", "part").mapInArrow(_sampled(halves), "y int, part int, x array<double>").collect()
    got.sort(key=lambda r: (r.part, r.y, r.x))
    x, y, part = np.array([r.x for r in got]), np.array([r.y for r in got], float), np.array([r.part for r in got])
    fitted = part < 70
    trees = BoostedTrees().fit(x[fitted], y[fitted])
    scale = Isotonic().fit(trees.margin(x[~fitted]), y[~fitted])
    return ToxicityModel(_lexicon(rows, (0, 1), totals, terms), trees, scale, yes / (yes + no))


def _scored(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in blocks(batches):
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score(as_bytes(batch.column("text"))))], names=["doc_id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.5 or more) of each row of docs."""
    model = fit_toxicity(docs, labels, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _clean(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in blocks(batches):
            yield batch.filter(pa.array(score(as_bytes(batch.column("text"))) < 0.5))

    return run


def drop_toxic(docs: DataFrame, train: DataFrame, labels: DataFrame, most: int = 12_000) -> DataFrame:
    """The rows of docs that score under 0.5, with all their columns, whatever these are named; the model is fitted on train. One narrow pass.

    Null text counts as empty and is scored like one; equal texts, long ones too, go or stay together; repeated rows are judged each; an empty
    table stays empty; without labels of both kinds nothing goes unless most known labels are 1.
    """
    return docs.mapInArrow(_clean(fit_toxicity(train, labels, most)), docs.schema)
