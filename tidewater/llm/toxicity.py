"""Toxicity by maximum-scoring segments (operator 2).

Every word has a score: its log-odds of toxic against other labelled documents with
a flat Dirichlet prior, less two standard errors (so that rare words count little),
less a drift that makes ordinary words negative. A linear-time scan finds all maximal
segments of a text (disjoint runs of words whose sum no longer or shorter run beats).
A segment of score S among n words has the extreme-value expectation
E = K n exp(-lambda S): lambda solves the scores' moment equation over non-toxic
words, K is fitted to the best segments of non-toxic labelled documents. Segments with
E below ``SIGNIFICANT`` are passages; their -ln E add up to the document's evidence,
which a logistic curve turns into a probability. Words are learned from two thirds of
the labelled documents, K and the curve from the rest.

Labels are learned only from rows that are not held out (``labelled.held_out``), from
``labelled.MAX_LABELS`` rows at most, whose words bound the table of scores (every word
with a score is in it, 16 bytes each: 7,572 words on the 0.1 GB of documents). A score depends on the text alone.

Defined results: null and empty texts are scored as texts of no words; repeated rows
are scored each for itself; without labels no word has a score and every text gets the
prior's probability, and so it does with labels of one class; an empty table gives an empty result. Whole texts are scanned.
Columns besides id and text (and the label's) are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import labelled
from tidewater.llm.common import NOT_ALNUM, chunks, lowered, text_arrays, texts, word_hashes

#: Prior count of every word in either class, drift of a word, expectation of a passage.
PRIOR, DRIFT, SIGNIFICANT = 0.5, 0.15, 0.01
#: From this probability on a document is predicted toxic.
THRESHOLD = 0.3
#: Evidence is counted in bins of 0.5 from LOW on, to fit the curve; the last one holds what is beyond.
LOW, BINS = -20.0, 400

@dataclass
class Model:
    """Sorted word hashes with their scores, and the calibration."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    bias: float = -3.0
    slope: float = 0.5


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n0, n1): in how many labelled documents of either class a word occurs,
    counted before rows are shuffled; word null holds the sums of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False) > 0
            words: list[list] = [[], []]
            for kind, own in zip(label, documents(b.column(0)), strict=True):
                words[int(kind)].append(np.unique(own))
            parts = [np.concatenate(w) if w else np.zeros(0, np.uint64) for w in words]
            both, at = np.unique(np.concatenate(parts), return_inverse=True)
            n0 = np.bincount(at[: len(parts[0])], minlength=len(both))
            n1 = np.bincount(at[len(parts[0]) :], minlength=len(both))
            yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), pa.array(n0.astype(np.int64)), pa.array(n1.astype(np.int64))], ["word", "n0", "n1"])

    sent = texts(rows).select("text", "label").mapInArrow(run, "word long, n0 long, n1 long")
    return sent.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def documents(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    data, offsets = text_arrays(column)
    for lo, hi in chunks(offsets):
        part = lowered(data[offsets[lo] : offsets[hi]])
        words, first, _ = word_hashes(part, offsets[lo : hi + 1] - offsets[lo], NOT_ALNUM)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield words[a:b]


def word_scores(counts: DataFrame) -> Model:
    """Scores of the words that stand out, and lambda."""
    counts = counts.persist()
    sums = counts.agg(F.coalesce(F.sum("n0"), F.lit(0)).alias("n0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("n1"), F.count("*").alias("v")).first()
    model = Model()
    if sums["n0"] and sums["n1"]:
        all0, all1 = sums["n0"] + PRIOR * sums["v"], sums["n1"] + PRIOR * sums["v"]
        n0, n1 = F.col("n0") + PRIOR, F.col("n1") + PRIOR
        odds = F.log(n1 / (all1 - n1)) - F.log(n0 / (all0 - n0))
        spread = F.sqrt(1 / n1 + 1 / n0)
        scored = counts.select("word", "n0", "n1", (F.signum(odds) * F.greatest(F.lit(0.0), F.abs(odds) - 2 * spread)).alias("score"))
        chosen = scored.where("score <> 0").toArrow().sort_by("word")  # words of the labelled rows
        words, n0, score = (chosen[c].to_numpy() for c in ("word", "n0", "score"))
        order = np.argsort(words.view(np.uint64))
        model.words = words.view(np.uint64)[order]
        model.scores = np.clip(score[order], -10, 10) - DRIFT
        share = (n0[order] + PRIOR) / all0
        model.rate = _rate(np.append(share, max(0.0, 1 - share.sum())), np.append(model.scores, -DRIFT))
    counts.unpersist()
    return model


def _rate(share: np.ndarray, score: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1."""
    low, high = 1e-6, 1.0
    value = lambda r: float((share * np.exp(np.minimum(r * score, 500))).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return max(low, 0.05)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time. Only words
    with positive scores start a step; between them the running sum falls. An entry
    knows the nearest earlier one whose sum before is lower (``lower``); the search goes
    from one to the next, so what it has passed over it never meets again."""
    places = np.flatnonzero(scores > 0)
    sums = np.cumsum(scores)
    starts, ends, before, after, lower = [], [], [], [], []
    for at, own, right in zip(places.tolist(), scores[places].tolist(), sums[places].tolist(), strict=True):
        start, left, j = at, right - own, len(starts) - 1
        while True:
            while j >= 0 and before[j] >= left:
                j = lower[j]
            if j < 0 or after[j] >= right:
                break
            # the entry, this one and what lies between are one segment
            start, left = starts[j], before[j]
            link = lower[j]
            for stack in (starts, ends, before, after, lower):
                del stack[j:]
            j = link
        starts.append(start)
        ends.append(at + 1)
        before.append(left)
        after.append(right)
        lower.append(j)
    return [(a, b, r - l) for a, b, l, r in zip(starts, ends, before, after, strict=True)]


def evidence(model: Model, words: np.ndarray) -> tuple[float, float, list[tuple[int, int, float]]]:
    """Evidence of a text, its best segment's score, and its passages (start, end, E)."""
    n = len(words)
    if not n:
        return LOW, 0.0, []
    scores = np.full(n, -DRIFT)
    if len(model.words):
        at = np.minimum(np.searchsorted(model.words, words), len(model.words) - 1)
        hit = model.words[at] == words
        scores[hit] = model.scores[at[hit]]
    found = segments(scores)
    best = max((s for _, _, s in found), default=0.0)
    log_e = lambda s: model.log_k + math.log(n) - model.rate * s
    passages = [(a, b, log_e(s)) for a, b, s in found if log_e(s) <= math.log(SIGNIFICANT)]
    total = sum(-e for _, _, e in passages)
    return max(LOW, total if passages else -log_e(best)), best, [(a, b, math.exp(max(e, -700))) for a, b, e in passages]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    chosen = labelled.sample(labels, label_col, id_col=id_col)
    rows = labelled.labelled(docs, chosen, id_col, text_col)
    # words are learned from two thirds, the calibration from the rest
    third = F.floor(F.crc32(F.col("id").cast("string").cast("binary")) / 4) % 3
    model = word_scores(word_counts(rows.where(third < 2)))
    rows = rows.where(third == 2)
    if not len(model.words):
        return model
    mean = _measured(rows, model).where("label <= 0").agg(F.avg("excess")).first()[0]
    if mean is not None:
        model.log_k = float(mean) - 0.5772156649  # mean of the extreme-value distribution
    spot = F.least(F.lit(BINS - 1), F.floor((F.col("x") - LOW) * 2)).alias("bin")
    bins = _measured(rows, model).groupBy(spot).agg(F.count("*").alias("n"), F.sum((F.col("label") > 0).cast("int")).alias("k")).collect()  # BINS rows at most
    model.bias, model.slope = _curve(np.array([LOW + r.bin / 2 + 0.25 for r in bins]), np.array([r.n for r in bins], float), np.array([r.k for r in bins], float))
    return model


def _measured(rows: DataFrame, model: Model) -> DataFrame:
    """(label, x, excess) of labelled texts: the evidence, and by how much the best
    segment exceeds what the number of words explains."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(evidence(held.value, w), len(w)) for w in documents(b.column(0))]
            excess = [held.value.rate * e[1] - math.log(max(n, 1)) for e, n in got]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([e[0] for e, _ in got], pa.float64()), pa.array(excess, pa.float64())], ["label", "x", "excess"])

    return texts(rows).select("text", "label").mapInArrow(run, "label int, x double, excess double")


def _curve(x: np.ndarray, n: np.ndarray, k: np.ndarray) -> tuple[float, float]:
    """Bias and slope of a logistic curve through k of n, by Newton's steps with a
    weak pull (the classes may be parted fully)."""
    prior, pull = np.array([-3.0, 0.5]), np.array([0.02, 0.5])
    design = np.stack([np.ones_like(x), x], 1)

    def loss(b):
        z = design @ b
        return float((n * np.logaddexp(0, z) - k * z).sum() + (pull * (b - prior) ** 2).sum() / 2)

    beta = prior
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (n * p - k) + pull * (beta - prior)
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(pull)
        step, size = np.linalg.solve(hess, grad), 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-9:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 1e-3))


def probability(model: Model, x: float) -> float:
    z = model.bias + model.slope * x
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


PASSAGE = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("expectation", pa.float64())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted and passages (words [first_word, end_word) and E) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, passages = [], []
            for words in documents(b.column(1)):
                x, _, found = evidence(held.value, words)
                scores.append(probability(held.value, x))
                passages.append([dict(zip(("first_word", "end_word", "expectation"), p, strict=True)) for p in found])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(passages, PASSAGE)],
                [id_col, "score", "predicted", "passages"],
            )

    out = f"`{id_col}` {kind}, score double, predicted int, passages array<struct<first_word:long,end_word:long,expectation:double>>"
    return texts(docs).select(id_col, text_col).mapInArrow(run, out)


def select(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    spot = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fine = [probability(held.value, evidence(held.value, w)[0]) < threshold for w in documents(b.column(spot))]
            yield b.filter(pa.array(fine, pa.bool_()))

    return texts(docs).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "passages")
