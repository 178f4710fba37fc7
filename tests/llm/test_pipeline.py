"""The pipeline on a small corpus, against a plain version of every stage."""

import random
import re

import corpus_pipeline
from tests.llm.test_jaccard import brute as brute_components


def corpus():
    rnd = random.Random(11)
    vocab = ["w%d" % i for i in range(400)]
    docs, labels = [], []
    for i in range(900):
        words = rnd.choices(vocab, k=rnd.randint(8, 60))
        kind = i % 6
        if kind == 0:
            words = [w + "%%%" for w in words]
        if kind == 1:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(["villain", "scoundrel"]))
        docs.append([i, " ".join(words), "en", "s", 1])
        if i < 700:
            labels.append((i, int(kind != 0), int(kind == 1)))
    for i in range(900, 960):
        base = docs[(i * 7) % 600][1]
        docs.append([i, base.replace(" ", "\n", 2) if i % 2 else base + " tail", "en", "s", 1])
    docs += [[1000, None, None, None, None], [1001, "", "en", "s", 0], [1002, "one two", "en", "s", 1], [5, docs[5][1], "en", "s", 1]]
    return docs, labels


def test_stages(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame([tuple(d) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        out.write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        left[name] = [tuple(r) for r in frame.collect()]
    kinds = {i: i % 6 for i in range(900)}
    assert sorted(r[0] for r in left["quality"] if r[0] < 900) == sorted([i for i in kinds if kinds[i] != 0] + [5])
    clean = [r for r in left["quality"] if not re.search("villain|scoundrel", r[1] or "")]
    assert sorted(map(str, left["toxicity"])) == sorted(map(str, clean))
    groups = {}
    for r in left["toxicity"]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    best = [min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values()]
    assert sorted(map(str, left["exact_dedup"])) == sorted(map(str, best))
    names = brute_components([(r[0], r[1]) for r in left["exact_dedup"]])
    assert sorted(r[0] for r in left["jaccard_join"]) == sorted(d for d, _, c in names if d == c)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in packed}) == sorted(r[0] for r in left["jaccard_join"])
    fill = {}
    for r in packed:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_odd_tables(spark, tmp_path):
    """An empty table, very long texts, null ids and columns with the names of results."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, keep boolean, sid long, h long, id long, digest string, piece int, length long"
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    long = " ".join(f"w{i}" for i in range(40_000))
    more = ("en", "s", 1, 0.5, 1, True, 3, 4, 5, "d", 6, 7)
    rows = [(1, long, *more), (2, long + " tail", *more), (3, long.replace(" ", "\n"), *more), (None, "a b c", *more), (None, "other text", *more), (7, None, *more), (7, "", *more)]
    for name, own in (("empty", []), ("odd", rows)):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(own, schema).write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        frame = spark.read.parquet(f"{at}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, frame, at)
            assert out.columns == frame.columns
            out.write.parquet(f"{at}/{k}")
            frame = spark.read.parquet(f"{at}/{k}")
        left = sorted((str(r.doc_id), len(r.text or "")) for r in frame.collect())
        # of each text and of each group of near copies one row; a null and an empty text are equal
        assert left == ([] if not own else sorted([("1", len(long)), ("None", 5), ("None", 10), ("7", 0)]))
        packed = corpus_pipeline.run(spark, at)
        assert (packed.count() > 0) == bool(own) and {"piece", "start", "length", "sequence_id", "offset"} <= set(packed.columns)
