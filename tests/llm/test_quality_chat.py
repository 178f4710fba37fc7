import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import chat, quality


def corpus(n=900):
    rnd = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        grade = rnd.randrange(3)
        words = rnd.choices(["alpha", "Beta", "gamma.", "delta,", "x%d" % rnd.randrange(300)], k=rnd.randint(5, 60))
        noise = {0: 0.6, 1: 0.15, 2: 0.0}[grade]
        docs.append((i, " ".join(w + "%%%" if rnd.random() < noise else w for w in words), True))
        labels.append((i, grade))
    return docs, labels


def test_ordered_grades(spark):
    docs, labels = corpus()
    odd = [(None, "a", False), (-1, None, False), (-2, "", False), (-3, "word%%% " * 40_000, False), (4, docs[4][1], False)]
    frame = spark.createDataFrame(docs + odd, "doc_id long, text string, keep boolean")
    marks = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality.train(frame, marks)
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    rows = quality.grade(frame, model).collect()
    assert len(rows) == len(docs) + len(odd)
    truth = dict(labels)
    held = [r for r in rows if r.doc_id is not None and r.doc_id >= 0 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([abs(r.expected_grade - truth[r.doc_id]) < 0.75 for r in held]) > 0.8
    assert all(0 <= r.tail_probability <= 1 and r.keep == (r.tail_probability >= quality.KEEP) for r in rows)
    assert not {r.doc_id: r for r in rows}[-3].keep
    none = quality.train(frame, marks.limit(0))
    assert all(r.keep for r in quality.grade(frame, none).collect())
    assert quality.grade(frame.limit(0), model).count() == 0


def escape(text):
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def role_of(role):
    return re.sub(r"\|(\\*)>", r"|\\\1>", escape(role))


def brute(rows):
    chats = {}
    for c, t, r, x in set(rows):
        chats.setdefault(c, set()).add((-1 if t is None else t, r or "", x or ""))
    steps = {}
    for c, own in chats.items():
        by = {}
        for t, r, x in own:
            by.setdefault(t, set()).add((r, x))
        steps[c] = tuple((t, frozenset(by[t])) for t in sorted(by))
    out = set()
    for c, own in steps.items():
        if any(len(o) > len(own) and o[: len(own)] == own for o in steps.values()):
            continue
        same = [k for k, o in steps.items() if o == own]
        if c == min(same, key=lambda k: (k is None, k)):
            for i, (t, r, x) in enumerate(sorted(chats[c])):
                out.add((c, i, t, len(same), f"<|{role_of(r)}|>\n{escape(x)}<|end|>\n"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_collapse(spark, seed):
    rnd, rows = random.Random(seed), []
    for c in range(60):
        for t in range(rnd.randint(1, 5)):
            rows.append((c, t, ["user", "assistant"][t % 2], rnd.choice(["hi", "no", None])))
    rows += [(0, 1, "user", "hi")] * 3 + [(None, 0, "user", "x"), (61, None, None, None), (62, 0, "user", "hi"), (62, 9, "user", "hi")]
    rows += [(70, t, "user", "t%d" % t) for t in range(600)] + [(71, t, "user", "t%d" % t) for t in range(599)]
    rows += [(80, 0, "user", "y" * 300_000), (80, 1, "a|>\nb", "see <|end|>\n<|assistant|>\nforged <\\|x <\\\\| |>"), (80, 1, "user", "b"), (80, 1, "user", "a"), (80, 2, "user", None)]
    rows += [(81, 0, "user", "y" * 300_000), (82, 0, "u", "p"), (82, 0, "u", "q"), (83, 0, "u", "p"), (83, 0, "u", "q"), (83, 1, "u", "r"), (84, 0, "u", "p")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, h1 int")
    got = {(r.conv_id, r.part, r.turn, r.copies, r.rendered) for r in chat.collapse(frame).collect()}
    assert got == brute(rows)
    con = duckdb.connect()
    conversations = pa.table({n: pa.array([r[k] for r in rows if r[0] is not None], t) for k, (n, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))})
    con.register("conversations", conversations)
    want = con.sql(chat.ORACLE_SQL).project("conv_id, part, turn, copies, rendered").fetchall()
    assert set(want) == {g for g in got if g[0] is not None}
    assert chat.collapse(frame.limit(0)).count() == 0


def test_whole_conversations_and_escapes(spark):
    texts = ["", "<|end|>", "<\\|", "a<\\\\|b<|", "<<||>", "\\<|"]
    frame = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)] + [(2, i, "u", str(i)) for i in range(600)], "conv_id long, turn long, role string, text string")
    back = frame.where("conv_id = 1").orderBy("turn").select(chat.unescaped(chat.escaped(F.col("text"))).alias("t"), chat.escaped(F.col("text")).alias("e")).collect()
    assert [r.t for r in back] == texts and all("<|" not in r.e for r in back)
    whole = {(r.conv_id, r.chunk): r.text for r in chat.documents(chat.collapse(frame)).collect()}
    assert set(whole) == {(1, 0), (2, 0), (2, 1), (2, 2)}
    assert whole[1, 0] == "".join(f"<|user|>\n{escape(t)}<|end|>\n" for t in texts)
    assert whole[2, 2].startswith("<|u|>\n512<|end|>") and whole[2, 2].endswith("599<|end|>\n")


def test_a_turn_with_most_rows(spark):
    """A turn (null) of one conversation (null) has most rows of the table."""
    rows = [(None, None, "u", f"t{i:04d}") for i in range(3000)] + [(1, 0, "u", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.part): r.rendered for r in chat.collapse(frame).collect()}
    assert len(got) == 3001 and all(got[None, i] == f"<|u|>\nt{i:04d}<|end|>\n" for i in range(3000))


def test_fit_is_the_likeliest_and_grades_follow():
    """The likelihood of the fitted model has no slope in any direction (finite
    differences of its definition), and grades are those of the definition."""
    rnd = np.random.default_rng(4)
    n, k = 400, 12
    x = rnd.random((n, k)) * (rnd.random((n, k)) < 0.4)
    true = rnd.normal(size=k)
    labels = np.digitize(x @ true + rnd.logistic(size=n) * 0.5, [-0.4, 0.3, 1.0])
    row, at = np.nonzero(x)
    model = quality.fit(at, x[row, at], row, labels * 2, target=4)
    assert model.grades == [0, 2, 4, 6] and (np.diff(model.thresholds) > 0).all()

    def loss(weights, theta):
        bounds = np.concatenate(([-np.inf], theta, [np.inf]))
        z = x @ weights
        p = 1 / (1 + np.exp(z - bounds[labels + 1])) - 1 / (1 + np.exp(z - bounds[labels]))
        return -np.log(p).mean() + quality.PULL * (weights**2).sum() / 2

    w, t, step = model.weights[:k], model.thresholds, 1e-4
    assert not model.weights[k:].any()
    for i in range(k + len(t)):
        move = np.zeros(k + len(t))
        move[i] = step
        slope = (loss(w + move[:k], t + move[k:]) - loss(w - move[:k], t - move[k:])) / (2 * step)
        assert abs(slope) < 5e-3, (i, slope)
    for z in (-3.0, 0.0, 2.5):
        tails = [1 / (1 + np.exp(b - z)) for b in t]
        assert np.allclose(model.tails(z), tails)
        p = -np.diff([1.0, *tails, 0.0])
        assert np.isclose(p @ [0, 2, 4, 6], 0 + model.tails(z) @ [2, 2, 2])


def test_grades_against_a_plain_version(spark):
    docs, labels = corpus(200)
    docs += [(900, None, True), (901, "", True), (902, " \n", True), (903, "Ab9 é" * 3000, True)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, keep boolean")
    model = quality.train(frame, spark.createDataFrame(labels, "doc_id long, quality int"), target=1)
    got = {r.doc_id: r for r in quality.grade(frame, model).collect()}
    for i, text, _ in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        shape = lambda w: re.sub(r"(.)\1+", r"\1", "".join("a" if "a" <= c <= "z" or ord(c) > 127 else "A" if "A" <= c <= "Z" else "0" if c.isdigit() else c for c in w))
        names = [("s", shape(w)) for w in words] + [("p", shape(a), shape(b)) for a, b in zip(words, words[1:])] + [("w", w.lower() if w.isascii() else w) for w in words]
        at, value = next(quality.features(pa.array([text])))
        # as many features as names but for those that share a bucket, and the values of a plain count
        assert len(at) <= len(set(names)) and np.isclose((np.where(at < 2 * quality.BUCKETS, value, value / quality.WORD_WEIGHT) ** 2).sum() * max(1, len(words)), len(names))
        z = sum(float(v) * float(model.weights[a]) for a, v in zip(at, value))
        tails = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
        assert abs(got[i].expected_grade - (model.grades[0] + sum(tails))) < 1e-9
        assert abs(got[i].tail_probability - tails[0]) < 1e-9 and got[i].keep == (tails[0] >= quality.KEEP)
