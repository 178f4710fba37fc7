import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidewater.llm import common, exact_dedup

TEXTS = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " "), (7, "a\xa0b"), (8, "é" * 3), (9, "x" * 200_000), (10, "x " * 200_000), (None, "ab"), (1, "a b"), (11, " ab"), (12, "\x0b\x0cab\r "), (None, "solo")]


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((d, len(t or "")))
    out = []
    for text, own in groups.items():
        d, n = min(own, key=lambda r: (-r[1], r[0] is None, r[0]))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, d, len(own), i == d and k == n, sha) for i, k in own]
    return sorted(out, key=str)


def decided(df):
    rows = df.withColumn("sha", F.lower(F.hex("digest"))).collect()
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, r.sha) for r in rows), key=str)


def test_decisions(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in TEXTS], "doc_id long, text string, digest int, kept string")
    assert decided(exact_dedup.exact_dedup(docs)) == brute(TEXTS)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_index_remembers(spark):
    index = exact_dedup.new_index(spark)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a ")], "doc_id long, text string")
    assert {r.id: (r.keep_id, r.kept) for r in index.ingest(first).collect()} == {1: (3, False), 2: (2, True), 3: (3, True)}
    later = spark.createDataFrame([(4, "  b  "), (5, "c")], "doc_id long, text string")
    assert {r.id: (r.keep_id, r.kept) for r in index.ingest(later).collect()} == {4: (2, False), 5: (5, True)}
    assert index.rows().count() == 3
    plan = index.rows().join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_one_row_of_each_text(spark):
    docs = spark.createDataFrame([(*r, 1) for r in TEXTS], "doc_id long, text string, digest int")
    got = exact_dedup.distinct_texts(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, ((r.doc_id) for r in got.collect()))) == sorted(str(i) for i in {k[1] for k in brute(TEXTS)})


def test_a_row_of_the_group_with_the_same_id(spark):
    rows = [(1, "a b"), (1, "ab"), (None, "so lo"), (None, "solo"), (2, "c"), (3, "c "), (3, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.text for r in exact_dedup.distinct_texts(docs).collect())) == ["a b", "c ", "so lo"]


def test_batches_meet_the_index(spark):
    """Three batches and one that repeats: every text keeps its first row, and the join
    with the bucketed table is a sort-merge anti-join without an exchange of the index."""
    index = exact_dedup.new_index(spark)
    batches = [[(1, "a a"), (2, "bb")], [(3, "aa"), (4, "c"), (5, "c ")], [(1, "a a"), (2, "bb")], [(6, "d"), (7, " c")]]
    kept = []
    for rows in batches:
        got = index.ingest(spark.createDataFrame(rows, "doc_id long, text string"), batches=1)
        kept.append(sorted((r.id, r.keep_id, r.kept) for r in got.collect()))
    assert kept == [[(1, 1, True), (2, 2, True)], [(3, 1, False), (4, 5, False), (5, 5, True)], [(1, 1, True), (2, 2, True)], [(6, 6, True), (7, 5, False)]]
    assert sorted((r.keep_id, r.n_points) for r in index.rows().collect()) == [(1, 3), (2, 2), (5, 2), (6, 1)]
    fresh = spark.createDataFrame([(b"x",)], "digest binary").join(index.rows().hint("merge"), "digest", "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange") <= 1
    index.drop()
    assert not spark.catalog.tableExists(index.name)


def test_any_number_of_batches_gives_the_same(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    for batches in (1, 2, 9):
        assert decided(exact_dedup.exact_dedup(docs, batches=batches)) == brute(TEXTS)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_large_groups_and_keys_that_are_not_broadcast(spark, monkeypatch):
    rows = [(i, "same" + " " * (i % 3)) for i in range(400)] + [(1000 + i, f"t{i // 2}") for i in range(60)] + [(5, "same  "), (1000, "t0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert decided(exact_dedup.exact_dedup(docs)) == brute(rows)
    want = sorted({k[1] for k in brute(rows)})
    assert sorted(r.doc_id for r in exact_dedup.distinct_texts(docs).collect()) == want
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    assert sorted(r.doc_id for r in exact_dedup.distinct_texts(docs).collect()) == want


def test_an_ingest_that_ended_early_is_ingested_again(spark):
    """The index holds the first batches of a run that broke off; the same rows again give
    the decisions of a run that did not."""
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    index = exact_dedup.new_index(spark)
    calls, add = [], index.add

    def breaks(rows):
        if len(calls) == 2:
            raise RuntimeError("the driver is lost")
        calls.append(add(rows))

    index.add = breaks
    with pytest.raises(RuntimeError):
        index.ingest(docs)
    held = index.rows().count()
    index.add = add
    assert 0 < held < len({x[4] for x in brute(TEXTS)})
    assert decided(index.ingest(docs)) == brute(TEXTS)
    assert decided(index.ingest(docs)) == brute(TEXTS)
    index.drop()
