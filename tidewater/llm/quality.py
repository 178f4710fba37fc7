"""Quality classifier (operator 9): ordinal cumulative-link regression.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector is shared by all
grades and the thresholds are ordered. x are hashed features of the text: shapes of
its space-separated words (classes of letters, runs collapsed), pairs of neighbouring
shapes, and the lower-cased words, each as the root of its share. The model gives the
expected grade and the tail probability P(grade >= target); rows whose tail
probability reaches ``KEEP`` are selected.

It is fitted on ``MAX_FIT`` labelled rows at most (chosen by a hash of the id, never
held-out ones), gathered on the driver; everything else runs over all documents.

Defined results: null and empty texts have no features and get the thresholds' own
probabilities; repeated rows are scored each for itself; without labels, or with one
grade only, every row is kept; an empty table gives an empty result; texts are read
whole. Columns besides id and text (and the label's) are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import labelled
from tidewater.llm.common import SPACE, chunks, lowered, text_arrays, texts, word_hashes

#: Labelled rows of a fit at most, features of each kind (a power of two), tail probability that is kept.
MAX_FIT, BUCKETS, KEEP = 6_000, 4_096, 0.5
#: Weight of word features beside those of shapes.
WORD_WEIGHT = 0.3
STEPS, RATE, PULL = 200, 0.1, 1e-4

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


@dataclass
class Model:
    grades: list[int] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3 * BUCKETS))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    target: int = 0

    def tails(self, z: float) -> np.ndarray:
        """P(grade > k) for each grade but the last."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - z, -500, 500)))


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and values of each text."""
    data, offsets = text_arrays(column)
    mask = np.uint64(BUCKETS - 1)
    for lo, hi in chunks(offsets):
        raw = data[offsets[lo] : offsets[hi]]
        at = offsets[lo : hi + 1] - offsets[lo]
        words, first, _ = word_hashes(lowered(raw), at, SPACE)
        shape = _CLASS[raw]
        keep = np.ones(len(shape), bool)
        keep[1:] = shape[1:] != shape[:-1]
        keep[at[:-1][at[:-1] < len(shape)]] = True
        shapes, _, _ = word_hashes(shape[keep], np.concatenate(([0], np.cumsum(keep)))[at], SPACE)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if a == b:
                yield np.zeros(0, np.int64), np.zeros(0)
                continue
            own = shapes[a:b]
            pairs = own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:]
            parts = [(own & mask), ((pairs >> np.uint64(20)) & mask) + np.uint64(BUCKETS), (words[a:b] & mask) + np.uint64(2 * BUCKETS)]
            at_feature, count = np.unique(np.concatenate(parts).astype(np.int64), return_counts=True)
            value = np.sqrt(count / (b - a))
            value[at_feature >= 2 * BUCKETS] *= WORD_WEIGHT
            yield at_feature, value


def fit(at: np.ndarray, value: np.ndarray, row: np.ndarray, labels: np.ndarray, target: int | None = None) -> Model:
    """The model of rows with ``labels``, whose features are (row, at, value) entries, by
    full-batch Adam steps on the likelihood; thresholds are a first one and positive
    increments."""
    grades = sorted({int(g) for g in labels})
    model = Model(grades, target=grades[-1] if target is None and grades else target or 0)
    if len(grades) < 2:
        return model
    y = np.searchsorted(grades, labels)
    k, n = len(grades) - 1, len(labels)
    below = np.array([(y <= j).mean() for j in range(k)])
    theta = np.log(below / (1 - below))
    free = np.concatenate((theta[:1], np.log(np.expm1(np.maximum(np.diff(theta), 1e-3)))))
    weights, size = np.zeros(3 * BUCKETS), 3 * BUCKETS
    moment, square = np.zeros(size + k), np.zeros(size + k)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, STEPS + 1):
        theta = free[0] + np.concatenate(([0.0], np.cumsum(np.log1p(np.exp(free[1:])))))
        z = np.bincount(row, value * weights[at], n)
        bounds = np.concatenate(([-np.inf], theta, [np.inf]))
        up, down = sig(bounds[y + 1] - z), sig(bounds[y] - z)
        p = np.maximum(up - down, 1e-9)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
        grad_z = (d_up - d_down) / n  # of the negative log-likelihood
        grad_w = np.bincount(at, value * grad_z[row], size) + PULL * weights
        grad_t = -(np.bincount(y, d_up, k + 1)[:k] - np.bincount(y, d_down, k + 1)[1:]) / n
        grad_f = np.empty(k)
        grad_f[0] = grad_t.sum()
        for j in range(1, k):
            grad_f[j] = grad_t[j:].sum() * sig(free[j])
        grad = np.concatenate((grad_w, grad_f))
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, free = weights - move[:size], free - move[size:]
    model.weights = weights
    model.thresholds = free[0] + np.concatenate(([0.0], np.cumsum(np.log1p(np.exp(free[1:])))))
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", target: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    chosen = labelled.sample(labels, label_col, MAX_FIT, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(features(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32())), b.column(2)],
                ["id", "at", "value", "label"],
            )

    rows = labelled.labelled(docs, chosen, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    got = texts(rows).select("id", "text", "label").mapInArrow(run, f"id {kind}, at array<int>, value array<float>, label int").toArrow()  # MAX_FIT rows at most
    got = got.sort_by("id").combine_chunks()
    at, value, label = (pa.concat_arrays(got.column(c).chunks) if got.num_rows else pa.array([]) for c in ("at", "value", "label"))
    if not len(label):
        return fit(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), target)
    row = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
    return fit(at.flatten().to_numpy(), value.flatten().to_numpy(), row, label.to_numpy(), target)


def grade(docs: DataFrame, model: Model, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, expected_grade, tail_probability (of the target grade or better) and keep of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        steps = np.diff(np.array(m.grades, float)) if m.grades else np.zeros(0)
        spot = int(np.searchsorted(m.grades, m.target)) if m.grades else 0
        for b in batches:
            expected, tail = [], []
            for at, value in features(b.column(1)):
                above = m.tails(float(value @ m.weights[at])) if len(m.thresholds) else np.zeros(0)
                expected.append(float(m.grades[0] + above @ steps) if m.grades else math.nan)
                tail.append(float(above[spot - 1]) if 0 < spot <= len(above) else 1.0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array([t >= keep for t in tail], pa.bool_())],
                [id_col, "expected_grade", "tail_probability", "keep"],
            )

    return texts(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, expected_grade double, tail_probability double, keep boolean")


def select(docs: DataFrame, model: Model, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose tail probability reaches ``keep``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    spot = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        place = int(np.searchsorted(m.grades, m.target)) if m.grades else 0
        for b in batches:
            fine = []
            for at, value in features(b.column(spot)):
                above = m.tails(float(value @ m.weights[at])) if len(m.thresholds) else ()
                fine.append(not 0 < place <= len(above) or bool(above[place - 1] >= keep))
            yield b.filter(pa.array(fine, pa.bool_()))

    return texts(docs).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grade(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
