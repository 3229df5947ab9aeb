"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, word pairs and pairs that skip one word of a text. Training takes a bounded sample of
labelled documents: of those outside the held-out fold that have under `max_words` spaces, the `sample` first by a hash of the
id, as far as they have at most `max_features` features together (4 bytes each); only these numbers reach the driver. A fifth of
the sample isn't trained on but calibrates the cut at 0.5. L1 leaves a few hundred weights, which are broadcast; every whole text
is scored, very long ones too. `keep_clean` passes on all columns and rows that score under 0.5.

Nulls: a null text is empty and gets the bias alone; a null doc_id counts as '' in the fold; labels that are null are ignored,
several labels of a document count as their maximum. Without labels of both classes the score is a constant under 0.5.
Repeated rows each get a row. Only `text` enters a score. Empty tables give an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import normal_words
from .shared import durable, place_of, small_batches

BITS, SAMPLE, MAX_WORDS, MAX_FEATURES, PASSES = 20, 8000, 20_000, 20_000_000, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 5.0, 1.0
#: Odd multipliers of the multiply-shift hashes: words, pairs, pairs that skip a word.
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def features(text: str | None) -> np.ndarray:
    """Hashed words, pairs and skip-pairs, with repeats."""
    parts = normal_words((text or "").lower())
    w = np.fromiter(map(zlib.crc32, parts), np.uint64, len(parts)) + np.uint64(1)
    grams = [w * _M[0], w[:-1] * _M[1] + w[1:] * _M[2], w[:-2] * _M[3] + w[2:] * _M[4]]
    return (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2; the last coordinate is the bias, without L1."""

    def __init__(self, prior: float) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias, self.bias_n = math.log(prior / (1 - prior)), 0.0

    def weights(self, x: np.ndarray) -> np.ndarray:
        z = self.z[x]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[x])) / ALPHA + L2))

    def learn(self, x: np.ndarray, y: int) -> None:
        w = self.weights(x)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, self.bias + w.sum())))) - y
        n = self.n[x]
        self.z[x] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[x] = n + g * g
        self.bias_n += g * g
        self.bias -= 0.05 * g / (1 + math.sqrt(self.bias_n))

    def model(self) -> tuple[float, np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.abs(self.z) > L1)
        return self.bias, at, self.weights(at)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_words: int = MAX_WORDS, max_features: int = MAX_FEATURES) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, feature numbers, weights)."""
    small_batches(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # a few more than the sample, for those without a document or over max_words; at most 2 * sample rows of two numbers
    chosen = durable(known.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(2 * sample))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                if (text.as_py() or "").count(" ") < max_words:
                    x = np.unique(features(text.as_py())).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([x.tobytes()], pa.binary())], ["doc_id", "toxic", "x"])

    found = rows.select("doc_id", "text", "toxic").mapInArrow(numbers, "doc_id long, toxic int, x binary")
    order = F.xxhash64(F.lit("sample"), "doc_id")
    data = []
    found = durable(found)  # at most 2 * sample documents' numbers; ordered by their sizes alone, then fetched as far as they fit
    sizes = found.select(order.alias("o"), "doc_id", F.length("x").alias("n"), F.xxhash64("x").alias("h")).orderBy("o", "doc_id", "h").limit(sample).collect()
    fits = sum(total <= 4 * max_features for total in np.cumsum([r.n for r in sizes], dtype=np.int64))
    if fits:
        last = sizes[fits - 1]
        within = F.struct(order.alias("o"), F.col("doc_id"), F.xxhash64("x").alias("h")) <= F.struct(*(F.lit(last[k]).cast("long").alias(k) for k in ("o", "doc_id", "h")))
        data = [(r.toxic, np.frombuffer(r.x, np.int32)) for r in sorted(found.where(within).select("toxic", "x", order.alias("o"), "doc_id", F.xxhash64("x").alias("h")).toLocalIterator(), key=lambda r: (r.o, r.doc_id, r.h))]
    positive = sum(y for y, _ in data)
    model = Ftrl((positive + 0.5) / (len(data) + 2))
    if 0 < positive < len(data):
        # a feature of one document teaches nothing about others, and most skip-grams are such
        seen = np.zeros(1 << BITS, np.int32)
        for _, x in data:
            seen[x] += 1
        data = [(y, x[seen[x] > 1]) for y, x in data]
        for _ in range(PASSES):
            for i, (y, x) in enumerate(data):
                if i % 5 < 4:
                    model.learn(x, y)
        model.bias -= _best_cut([(model.bias + model.weights(x).sum(), y) for y, x in data[4::5]])
    return model.model()


def _best_cut(scored: list[tuple[float, int]]) -> float:
    """The logit that parts the calibration slice with the best F1: the middle of the gap that it lies in; 0 without positives."""
    scored = sorted(scored, reverse=True)
    total, hits, best, cut = sum(y for _, y in scored), 0, 0.0, 0.0
    for i, (s, y) in enumerate(scored):
        hits += y
        below = scored[i + 1][0] if i + 1 < len(scored) else s - 1
        if below < s and (f1 := 2 * hits / (i + 1 + total)) > best:
            best, cut = f1, (s + below) / 2
    return cut


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, over whole texts."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, weights = sent.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = weights
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                x = features(text.as_py())
                x = np.unique(x[dense[x] != 0])
                out[i] = bias + dense[x].sum(dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the model rejects. The texts aren't shuffled: rejected rows go where they are scored."""
    small_batches(docs.sparkSession)
    bias, at, weights = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((bias, at, weights))
    place = place_of(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, weights = sent.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = weights
        for batch in batches:
            keep = []
            for text in batch.column(place):
                x = features(text.as_py())
                x = np.unique(x[dense[x] != 0])
                keep.append(bias + dense[x].sum(dtype=float) < 0)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
