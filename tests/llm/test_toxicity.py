import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tidewater.llm import toxicity


def test_segments_are_the_maximal_ones():
    """Against the definition: take the best run, then split on either side."""

    def brute(scores, lo, hi):
        best = None
        for a in range(lo, hi):
            for b in range(a + 1, hi + 1):
                s = scores[a:b].sum()
                if s > 0 and (best is None or (s, -(b - a)) > (best[2], -(best[1] - best[0]))):
                    best = (a, b, s)
        if best is None:
            return []
        return brute(scores, lo, best[0]) + [best] + brute(scores, best[1], hi)

    rnd = np.random.default_rng(3)
    for _ in range(200):
        scores = rnd.normal(-0.3, 1, rnd.integers(0, 25))
        got = toxicity.segments(scores)
        want = brute(scores, 0, len(scores))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def corpus(n=1500):
    rnd = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words, toxic = rnd.choices(["alpha", "beta", "gamma", "delta", "x%d" % rnd.randrange(400)], k=rnd.randint(3, 80)), i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["scoundrel", "villain", "Rotter"]))
        docs.append((i, " ".join(words), 9.0))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(None, "scoundrel", 0.0), (-1, None, 0.0), (-2, "", 0.0), (-3, "word " * 50_000 + "villain rotter villain " + "word " * 50_000, 0.0), (5, docs[5][1], 0.0)]
    frame = spark.createDataFrame(docs + odd, "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels + [(None, 1), (77, None), (78, labels[78][1])], "doc_id long, toxic int")
    model = toxicity.train(frame, marks)
    rows = toxicity.score(frame, model).collect()
    assert len(rows) == len(docs) + len(odd)
    truth = dict(labels)
    held = [r for r in rows if r.doc_id is not None and r.doc_id >= 0 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    own = {r.doc_id: r for r in rows}
    assert own[-1].predicted == own[-2].predicted == 0
    assert [(p.first_word, p.end_word) for p in own[-3].passages] == [(50_000, 50_003)]
    alone = toxicity.score(frame.where("doc_id = 5").limit(1), model).first()
    assert alone.score == own[5].score


def test_no_labels_and_empty(spark):
    docs, _ = corpus(20)
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(frame, marks)
    assert {r.predicted for r in toxicity.score(frame, model).collect()} == {0}
    assert toxicity.score(frame.limit(0), model).count() == 0


def test_segments_take_linear_time():
    scores = np.where(np.arange(160_000) % 2, -1.01, 1.0)
    for s in (scores, scores[::-1], np.cumsum(scores) * 1e-9 + scores, np.where(np.arange(160_000) % 2, -0.99, 1.0)):
        began = time.perf_counter()
        found = toxicity.segments(s)
        assert time.perf_counter() - began < 1
        assert all(abs(s[a:b].sum() - x) < 1e-6 for a, b, x in found[:50])


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def test_scores_and_evidence_by_hand(spark):
    """Word scores, lambda, evidence and passages against their definitions, word by word."""
    docs, labels = corpus(600)
    frame = spark.createDataFrame([(t, int(y)) for (_, t, _), (_, y) in zip(docs, labels)], "text string, label int")
    model = toxicity.word_scores(toxicity.word_counts(frame))
    own = [Counter(), Counter()]
    for (_, t, _), (_, y) in zip(docs, labels):
        own[y].update(set(words_of(t)))
    vocab = sorted(set(own[0]) | set(own[1]))
    totals = [sum(c.values()) + toxicity.PRIOR * len(vocab) for c in own]
    want = {}
    for w in vocab:
        n = [c[w] + toxicity.PRIOR for c in own]
        odds = math.log(n[1] / (totals[1] - n[1])) - math.log(n[0] / (totals[0] - n[0]))
        size = abs(odds) - 2 * math.sqrt(1 / n[0] + 1 / n[1])
        if size > 0:
            want[w] = math.copysign(size, odds) - toxicity.DRIFT
    code = {w: next(toxicity.documents(pa.array([w])))[0] for w in vocab}
    got = dict(zip(model.words.tolist(), model.scores.tolist()))
    assert set(got) == {int(code[w]) for w in want} and {"scoundrel", "villain", "rotter"} <= set(want)
    assert all(abs(got[int(code[w])] - s) < 1e-9 for w, s in want.items())
    share = {w: (own[0][w] + toxicity.PRIOR) / totals[0] for w in want}
    moment = sum(share[w] * math.exp(model.rate * want[w]) for w in want) + max(0, 1 - sum(share.values())) * math.exp(-model.rate * toxicity.DRIFT)
    assert abs(moment - 1) < 1e-6
    model.log_k = -1.3
    for _, text, _ in docs[:60]:
        scores = [want.get(w, -toxicity.DRIFT) for w in words_of(text)]
        runs = sorted(((sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), key=lambda r: (-r[0], r[2] - r[1]))
        taken = []
        if runs and runs[0][0] > 0:
            spans = [(0, len(scores))]
            while spans:  # the best run, then those on either side of it
                lo, hi = spans.pop()
                inside = [r for r in runs if lo <= r[1] and r[2] <= hi and r[0] > 1e-12]
                if inside:
                    taken.append(inside[0])
                    spans += [(lo, inside[0][1]), (inside[0][2], hi)]
        log_e = sorted(-1.3 + math.log(len(scores)) - model.rate * s for s, _, _ in taken)
        passages = [e for e in log_e if e <= math.log(toxicity.SIGNIFICANT)]
        best = log_e[0] if log_e else -1.3 + math.log(len(scores))
        x, _, found = toxicity.evidence(model, next(toxicity.documents(pa.array([text]))))
        assert abs(x - max(toxicity.LOW, -sum(passages) if passages else -best)) < 1e-6
        assert len(found) == len(passages)


def test_curve_is_the_likeliest():
    rnd = np.random.default_rng(2)
    x = np.linspace(-10, 40, 60)
    n = rnd.integers(1, 50, 60).astype(float)
    k = rnd.binomial(n.astype(int), 1 / (1 + np.exp(2 - 0.4 * x))).astype(float)
    bias, slope = toxicity._curve(x, n, k)

    def loss(a, b):
        z = a + b * x
        return (n * np.logaddexp(0, z) - k * z).sum() + (0.02 * (a + 3) ** 2 + 0.5 * (b - 0.5) ** 2) / 2

    least = loss(bias, slope)
    assert all(loss(bias + da, slope + db) > least for da in (-0.05, 0, 0.05) for db in (-0.01, 0, 0.01) if da or db)


def test_labels_of_one_class(spark):
    docs, labels = corpus(40)
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double")
    for only in (0, 1):
        marks = spark.createDataFrame([(i, only) for i, _ in labels], "doc_id long, toxic int")
        rows = toxicity.score(frame, toxicity.train(frame, marks)).collect()
        assert len(rows) == 40 and {r.predicted for r in rows} == {0} and not any(r.passages for r in rows)
