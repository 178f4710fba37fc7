"""Rules that the SQL oracle does not reach, and the streams' equality with batches."""

import os
import random
import subprocess
import sys
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewater.functions import predicates as P
from tidewater.operators import cache, kv, log, metrics, routing, subquery
from tidewater.operators.numbering import numbered, running, shared_dir
from tidewater.plans.shape import Shape, cache_control, canonical_text, handle
from tidewater.sources import changes as cdc
from tidewater.sources import paths, tables
from tidewater.streaming import live

SF = "/root/testdata/sf0.001"
ROWS = [(7, "Alice", None, 4.5, True, ["red", "blue"]), (-3, "bob", "bob@example.com", -0.5, False, []), (0, "%_odd", None, 0.0, None, ["green"]), (12, "ALICE", "a@b.c", 100.25, True, ["red", "green", None])]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, "id int, name string, email string, score double, active boolean, tags array<string>").cache()


CASES = [
    (lambda r: (P.lit(1) / r["id"]).is_null(), []),
    (lambda r: (r["score"] / 0.0 > 1) | (r["id"] == 7), []),
    (lambda r: (r["id"] / 2) == -1, [-3]),
    (lambda r: (r["id"] % 2) == -1, [-3]),
    (lambda r: r["id"].shift_left(r["id"]) > 0, [7, 12]),
    (lambda r: (r["id"] * 9223372036854775807).is_null(), []),
    (lambda r: r["email"] == None, []),  # noqa: E711
    (lambda r: ~(r["active"] == "yes"), [-3]),
    (lambda r: r["active"] == " ON ", [7, 12]),
    (lambda r: r["score"] == "4.5", [7]),
    (lambda r: r["score"] == " 4.5", []),
    (lambda r: r["name"] > 5, []),
    (lambda r: r["name"].like(r"\%\_odd"), [0]),
    (lambda r: r["name"].like("odd\\"), []),
    (lambda r: r["name"].ilike("alice"), [7, 12]),
    (lambda r: r["name"].like(r"a\\\\b") | r["name"].like(r"\\%"), []),
    (lambda r: r["name"].ilike(r"\a\l%"), [7, 12]),
    (lambda r: r["tags"].contains(["red"]), [7, 12]),
    (lambda r: r["tags"].contains([]), [7, -3, 0, 12]),
    (lambda r: ~r["tags"].contained_in(["red", "blue"]), [0, 12]),
    (lambda r: r["tags"].overlaps(["green", "x"]), [0, 12]),
    (lambda r: P.lit("blue").any_of(r["tags"]).is_unknown(), [12]),
    (lambda r: P.lit("x").all_of(r["tags"], lambda a, b: a != b), [7, -3, 0]),
    (lambda r: r["active"].is_unknown() | r["active"].is_false(), [-3, 0]),
    (lambda r: r["name"].is_true().is_false(), [7, -3, 0, 12]),
    (lambda r: P.greatest(r["id"], None) > 5, [7, 12]),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules(people, i):
    test, want = CASES[i]
    assert sorted(r.id for r in P.where(people, test).collect()) == sorted(want)


def test_rejections(people):
    for bad in (
        lambda r: r["nope"] == 1, lambda r: r["id"].shift_left(64) > 0, lambda r: r["id"].is_in(), lambda r: r["tags"].contains(r["tags"]),
        lambda r: r["tags"].overlaps(r["tags"]), lambda r: r["name"].like(5), lambda r: r["name"] == {"a": 1}, lambda r: r["id"] == 2**70,
        lambda r: r["id"] == 7 and r["name"] == "x", lambda r: not r["active"], lambda r: 1 < r["id"] < 9,
    ):
        with pytest.raises(P.UnsupportedPredicate):
            P.where(people, bad)
    for shape in (Shape("t", ("id",), columns=("name",)), Shape("t", ("id",), columns=("id", "x")), Shape("t", ("id",), replica="some")):
        with pytest.raises(P.UnsupportedPredicate):
            shape.check(people)


def test_random_predicates_against_sql(spark):
    """Conjunctions, negations and comparisons with nulls: the same rows as DuckDB."""
    rnd, con = random.Random(4), duckdb.connect()
    rows = [(i, rnd.choice([None, *range(5)]), rnd.choice([None, *range(5)])) for i in range(60)]
    con.execute("CREATE TABLE t (id INT, a BIGINT, b BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "id int, a long, b long").cache()
    ops = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, ">=": lambda x, y: x >= y}

    def make(r, depth):
        kind = rnd.random()
        if depth == 0 or kind < 0.3:
            op, (x, xs), (y, ys) = rnd.choice(list(ops)), *[rnd.choice([(r["a"], "a"), (r["b"] + 1, "(b + 1)"), (P.lit(2), "2"), (r["a"] * r["b"], "(a * b)")]) for _ in "xy"]
            return ops[op](x, y), f"({xs} {op} {ys})"
        (x, xs), (y, ys) = make(r, depth - 1), make(r, depth - 1)
        if kind < 0.55:
            return x & y, f"({xs} AND {ys})"
        if kind < 0.8:
            return x | y, f"({xs} OR {ys})"
        return (~x, f"(NOT {xs})") if kind < 0.9 else (x.is_unknown(), f"({xs} IS NULL)")

    made = [make(P.Row(df), 3) for _ in range(60)]
    flags = df.select("id", *[e.match().alias(f"p{i}") for i, (e, _) in enumerate(made)]).collect()
    for i, (_, sql) in enumerate(made):
        assert sorted(r.id for r in flags if r[f"p{i}"]) == [x for (x,) in con.execute(f"SELECT id FROM t WHERE {sql} ORDER BY 1").fetchall()], sql


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    plan = P.where(df, lambda r: (r["o_orderstatus"] == "F") & (r["o_totalprice"] > 1000.0)).select("o_orderkey")._jdf.queryExecution().toString()
    assert "o_orderstatus" in plan.split("PushedFilters")[1].split("]")[0] and "o_orderdate" not in plan.split("ReadSchema")[1]


def test_null_aware_not_in(spark):
    outer = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id int, v int")
    inner = spark.createDataFrame([(1,), (None,)], "v int")
    ids = lambda **k: sorted(r.id for r in subquery.member_of(outer, "v", inner, "v", negated=True, **k).collect())
    assert ids() == [2, 3] and ids(null_aware=True) == []


def test_membership_counts(spark):
    before = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    after = spark.createDataFrame([(1,), (3,)], "v int")
    assert sorted(tuple(r) for r in subquery.membership_changes(before, after, "v").collect()) == [(2, False), (3, True)]


def test_streamed_log_is_the_batch_log(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = cdc.from_events(events)
    rows.repartition(5, "lsn").write.parquet(f"{tmp_path}/in")
    shape = Shape("events", ("user_id",), lambda r: r["value"] > 50)
    stream = live.changes(spark, f"{tmp_path}/in", rows.schema, 2)
    live.write_log(stream, shape, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    got = live.read_log(spark, f"{tmp_path}/out").select("lsn", "pk", "operation", "value.value")
    want = routing.route(rows, shape).select("lsn", "pk", "operation", "value.value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    view = log.materialize(log.offsets(routing.route(rows, shape)), "pk")
    last = rows.groupBy("pk").agg(F.max_by("new", "lsn").alias("n")).where("n.value > 50")
    assert sorted((r.pk, r.value.value) for r in view.collect()) == sorted((r.pk, r.n.value) for r in last.collect())


def test_streamed_state(spark, tmp_path):
    data = [(i, i % 7, "set", str(i * 31 % 50)) for i in range(60)]
    frame = spark.createDataFrame(data, "seq long, key long, op string, value string")
    frame.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = live.last_values(live.changes(spark, f"{tmp_path}/in", frame.schema, 1))
    run = stream.writeStream.outputMode("update").format("memory").queryName("last").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(180)
    got = {}
    for r in spark.table("last").collect():
        got.setdefault(r.key, set()).add(r.value)
    want = {k: [v for _, kk, _, v in data if kk == k][-1] for k in range(7)}
    assert set(got) == set(want) and all(want[k] in got[k] for k in want)


def test_paths(spark):
    table = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    assert paths.resolve("/nation?n_nationkey=in.(1,2)&order=n_nationkey.desc&select=n_nationkey", table).collect()[0][0] == 2
    for bad in ("/a/b/c", "/nation?n_name=xx.1"):
        with pytest.raises(ValueError):
            paths.resolve(bad, table)


def test_copy_keeps_the_source(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    moves = spark.createDataFrame([("a", "b"), ("x", "y")], "src string, dst string")
    assert sorted(map(tuple, kv.renamed(state, moves, keep=True).collect())) == [("a", "1"), ("b", "1")]
    assert sorted(map(tuple, kv.renamed(state, moves).collect())) == [("b", "1")]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("any_case", [False, True])
def test_like_against_a_plain_matcher(spark, any_case):
    """Random patterns with escapes: the same rows as a matcher by definition."""
    rnd = random.Random(7)
    texts = ["".join(rnd.choices("aB\\%_", k=rnd.randint(0, 5))) for _ in range(80)]
    patterns = ["".join(rnd.choices("ab%_\\\\", k=rnd.randint(0, 6))) for _ in range(60)]

    def match(text, pattern):
        if not pattern:
            return not text
        if pattern[0] == "%":
            return any(match(text[k:], pattern[1:]) for k in range(len(text) + 1))
        one, rest = (pattern[1:2] or "\\", pattern[2:]) if pattern[0] == "\\" else (None if pattern[0] == "_" else pattern[0], pattern[1:])
        return bool(text) and (one is None or one == text[0]) and match(text[1:], rest)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").cache()
    got = df.select("id", *[P.Row(df)["t"].like(p, any_case).match().alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    low = (lambda x: x.lower()) if any_case else (lambda x: x)
    for i, p in enumerate(patterns):
        assert [r.id for r in got if r[f"p{i}"]] == [k for k, t in enumerate(texts) if match(low(t), low(p))], p


THINGS = "id long, org_id long, name string, tags array<string>, score double, open boolean"
CLAUSES = [
    lambda r: r["org_id"] == "5", lambda r: r["org_id"].is_in(1, 2, 3), lambda r: (r["org_id"] == 1) | (r["name"] == "a"), lambda r: (r["org_id"] == 2) & r["name"].like("a%"),
    lambda r: r["tags"].contains(["red", "blue"]), lambda r: P.lit("red").any_of(r["tags"]), lambda r: r["name"].like("a%"), lambda r: r["org_id"] > 2, lambda r: r["score"] == 2,
    lambda r: r["open"] == "yes", lambda r: P.lit("b") == r["things.name"], lambda r: (r["name"] == "a") & (r["score"] / 0 == 1), lambda r: ~(r["org_id"] == 1), lambda r: r["name"] == None, lambda r: r["name"] == 5,  # noqa: E711
    lambda r: P.lit("green").any_of(r["tags"]) | (r["open"] == True), lambda r: r["tags"].contains(["red"]), lambda r: (r["score"] == "2.0") | (r["org_id"] == 4.0),  # noqa: E712
]


def test_index_loses_no_match(spark):
    """Random rows, clauses of all kinds: routing by the index gives what testing all
    shapes gives, and candidates hold every shape that matches."""
    rnd = random.Random(9)
    image = lambda: (rnd.choice([None, 1, 2, 3, 4, 5]), rnd.choice([None, "a", "b", "ab", "5"]), rnd.choice([None, [], ["red"], ["red", "blue"], ["green", None]]), rnd.choice([None, 2.0, 2.5, -0.0]), rnd.choice([None, True, False]))
    rows = []
    for i in range(200):
        op = rnd.choice(["insert", "update", "delete"])
        rows.append((i // 4, i % 4, i, op, None if op == "delete" else (i, *image()), None if op == "insert" else (i, *image())))
    changes = spark.createDataFrame(rows, f"lsn long, seq long, pk long, op string, new struct<{THINGS.replace(' ', ':').replace(',:', ',')}>, old struct<{THINGS.replace(' ', ':').replace(',:', ',')}>").cache()
    shapes = {f"s{i}": Shape("things", ("id",), c) for i, c in enumerate(CLAUSES)} | {"all": Shape("things", ("id",))}
    index = routing.ShapeIndex(changes, shapes | {"bad": Shape("things", ("id",), lambda r: r["nope"] == 1), "worse": Shape("things", ("id",), lambda r: 1 / 0)})
    assert set(index.failed) == {"bad", "worse"} and "nope" in index.failed["bad"]
    assert set(index.of_kind("one")) == {"s0", "s5", "s8", "s9", "s10", "s16"}
    assert set(index.of_kind("exact")) == {"s1", "s2", "s15", "s17"} and set(index.of_kind("tested")) == {"s3", "s4", "s11"}
    want = routing.route_many(changes, shapes)
    get = lambda df: sorted((r.handle, r.lsn, r.seq, r.operation, str(r.value)) for r in df.collect())
    assert get(routing.route_indexed(changes, index)) == get(want)
    found = {(r.lsn, r.seq, r.handle) for r in routing.candidates(changes, index).collect()}
    assert {(r.lsn, r.seq, r.handle) for r in want.collect()} <= found
    assert len(found) < len(rows) * len(shapes)
    one = routing.ShapeIndex(changes, {"s0": shapes["s0"]})
    plan = routing.route_indexed(changes, one)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan  # images stay where they are


def test_index_keys_of_numbers_and_texts(spark):
    df = spark.createDataFrame([], THINGS)
    keys = lambda c: c(P.Row(df)).keys
    assert keys(lambda r: r["org_id"] == "5") == keys(lambda r: r["org_id"] == 5) == keys(lambda r: r["org_id"] == 5.0) == (P.Key("org_id", 5.0),)
    assert keys(lambda r: r["org_id"] == "x") is None and keys(lambda r: r["name"] == 5) is None
    assert keys(lambda r: r["open"] == "on") == (P.Key("open", True),)


CHANGE = "lsn long, seq long, pk long, op string, new struct<v:long>, old struct<v:long>"


def transactions(n=120):
    """Changes of ten rows, three in a transaction, at times two of them of one row."""
    rnd, state, rows = random.Random(12), {}, []
    for i in range(n):
        pk = rnd.randrange(10) if i % 3 != 2 else rows[-1][2]
        if pk in state and rnd.random() < 0.3:
            rows.append((i // 3, i % 3, pk, "delete", None, (state.pop(pk),)))
        else:
            was = state.get(pk)
            state[pk] = rnd.randrange(100)
            rows.append((i // 3, i % 3, pk, "update" if was is not None else "insert", (state[pk],), None if was is None else (was,)))
    return rows, state


@pytest.mark.parametrize("files", [1, 3])
def test_transactions_over_micro_batches(spark, tmp_path, files):
    """A log written in micro-batches that part transactions is the batch log: no offset
    twice, the order of changes kept, and folding it gives the table's last state."""
    rows, state = transactions()
    frame = spark.createDataFrame(rows, CHANGE)
    for k in range(0, 120, 8):  # transactions lie across files
        spark.createDataFrame(rows[k : k + 8], CHANGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    shape = Shape("t", ("pk",), lambda r: r["v"] >= 30)
    live.write_log(live.changes(spark, f"{tmp_path}/in", frame.schema, files), shape, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(180)
    got = live.read_log(spark, f"{tmp_path}/out")
    assert got.select("batch").distinct().count() == -(-15 // files)
    want = log.offsets(routing.route(frame, shape))
    plain = lambda df: sorted((r.lsn, r.op_offset, r.pk, r.operation, r.value.v) for r in df.collect())
    assert plain(got) == plain(want) and len({x[:2] for x in plain(got)}) == got.count()
    assert {r.pk: r.value.v for r in log.materialize(got, "pk").collect()} == {k: v for k, v in state.items() if v >= 30}
    assert max(x[1] for x in plain(got)) == 2


def test_replays_are_dropped_and_nothing_else(spark, tmp_path):
    rows, _ = transactions(60)
    at = datetime(2024, 1, 1)
    frame = spark.createDataFrame([(*r, at + timedelta(seconds=i)) for i, r in enumerate(rows)], CHANGE + ", ts timestamp")
    frame.where("lsn < 12").coalesce(1).write.parquet(f"{tmp_path}/in")
    frame.where("lsn >= 8").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # sent again from 8 on
    stream = live.without_replays(live.changes(spark, f"{tmp_path}/in", frame.schema, 1), "ts")
    stream.writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(180)
    assert sorted((r.lsn, r.seq, r.pk) for r in spark.table("once").collect()) == sorted(r[:3] for r in rows)


def test_windows_end_by_the_watermark(spark, tmp_path):
    """Hot keys come out when their window is over; an access later than the delay is left out."""
    at = datetime(2024, 1, 1)
    first = [("a", at + timedelta(seconds=s)) for s in (0, 1, 2, 3, 4)] + [("b", at + timedelta(seconds=s)) for s in (1, 2, 3, 4)]
    later = [("c", at + timedelta(minutes=5))]
    late = [("b", at + timedelta(seconds=5)), ("c", at + timedelta(minutes=10))]
    # rows are late by the watermark of the micro-batch before the last one
    for part in (first, later, [("c", at + timedelta(minutes=6))], late):
        spark.createDataFrame(part, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = live.changes(spark, f"{tmp_path}/in", spark.createDataFrame(first, "key string, ts timestamp").schema, 1)
    hot = live.hot_keys(stream, "ts", "key")
    hot.writeStream.outputMode("append").format("memory").queryName("hot").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(180)
    assert [(r.key, r.n) for r in spark.table("hot").collect()] == [("a", 5)]


def test_flips_over_micro_batches(spark, tmp_path):
    """Members kept by changes are the members of the table, after every micro-batch."""
    rows, state = transactions(90)
    for k in range(0, 90, 15):
        spark.createDataFrame(rows[k : k + 15], CHANGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = live.changes(spark, f"{tmp_path}/in", spark.createDataFrame(rows, CHANGE).schema, 1)
    matches, value = lambda side: F.col(f"{side}.v") > 20, lambda side: F.floor(F.col(f"{side}.v") / 10)
    empty = spark.createDataFrame([], "value long, n long")
    live.write_flips(stream, empty, f"{tmp_path}/out", f"{tmp_path}/c", matches, value).awaitTermination(300)
    counts = {}
    for v in state.values():
        if v > 20:
            counts[v // 10] = counts.get(v // 10, 0) + 1
    assert {r.value: r.n for r in spark.read.parquet(f"{tmp_path}/out/counts/batch=5").collect()} == counts
    members = set()
    for r in sorted(spark.read.parquet(f"{tmp_path}/out/flips").collect(), key=lambda r: r.batch):
        assert (r.value in members) != r.entered
        members ^= {r.value}
    assert members == set(counts)


def test_truncates_reach_shapes(spark):
    rows = [(1, 0, 1, "insert", (5,), None), (1, 1, 2, "insert", (50,), None), (2, 0, None, "truncate", None, None), (3, 0, 1, "insert", (60,), None), (4, 0, None, "truncate", None, None), (5, 0, None, "truncate", None, None)]
    frame = routing.without_truncates(spark.createDataFrame(rows, CHANGE))
    assert sorted((r.lsn, r.pk) for r in frame.where("op = 'delete'").collect()) == [(2, 1), (2, 2), (4, 1)]
    out = [(r.lsn, r.pk, r.operation, r.value.v) for r in routing.route(frame, Shape("t", ("pk",), lambda r: r["v"] > 20)).orderBy("lsn").collect()]
    assert out == [(1, 2, "insert", 50), (2, 2, "delete", 50), (3, 1, "insert", 60), (4, 1, "delete", 60)]
    assert routing.route(spark.createDataFrame(rows, CHANGE), Shape("t", ("pk",))).where("lsn in (2, 4)").count() == 0


def test_byte_cap_takes_the_next_that_fits(spark):
    rows = [(h, i, b) for h, sizes in {"h": (60, 5_000, 1, 940, 939), "g": (1_000, 1)}.items() for i, b in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "handle string, lsn long, size long")
    got = sorted((r.handle, r.lsn) for r in log.within_bytes(frame, 1_000, F.col("size")).collect())
    assert got == [("g", 0), ("h", 0), ("h", 2), ("h", 4)]


def test_refetch_by_the_whole_offset(spark):
    kept = spark.createDataFrame([("h", 5, 1), ("h", 5, 2), ("h", 9, 0)], "handle string, lsn long, op_offset long")
    readers = spark.createDataFrame([("h", 5, 0), ("h", 5, 1), ("h", 4, 9), ("h", 6, 0), ("x", 0, 0)], "handle string, lsn long, op_offset long")
    assert {(r.handle, r.lsn, r.op_offset) for r in log.must_refetch(readers, kept).where("must_refetch").collect()} == {("h", 5, 0), ("h", 4, 9)}


def test_running_sums_over_ranges(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, "hot", "hot", "hot", "x"]), i, rnd.randrange(9)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "g string, i long, n long").repartition(7)
    got = {(r.i): r.s for r in running(df, ["g"], ["i"], F.col("n"), "s").collect()}
    sums, want = {}, {}
    for g, i, n in rows:
        want[i] = sums[g] = sums.get(g, 0) + n
    assert got == want
    assert [r.number for r in numbered(df, "i").orderBy("i").collect()] == list(range(2_000))


def test_quantiles_against_sql(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), rnd.choice([None, 1.0, 2.5, 7.0, rnd.random()])) for _ in range(301)] + [("one", 4.0), ("none", None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g VARCHAR, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    got = {r.g: (r.a, r.b, r.c) for r in metrics.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()}
    for g, *want in con.execute("SELECT g, quantile_cont(v, 0), quantile_cont(v, 0.37), quantile_cont(v, 1) FROM t WHERE v IS NOT NULL GROUP BY g").fetchall():
        assert got.pop(g) == pytest.approx(want)
    assert not got


def test_schema_drift(spark):
    a = spark.createDataFrame([], "id long, name string")
    told = lambda **t: tables.fingerprints(tables.metadata(spark, t))
    before = told(kept=(a, ("id",)), typed=(a, ("id",)), keyed=(a, ("id",)), added=(a, ("id",)), gone=(a, ("id",)))
    after = told(kept=(a, ("id",)), typed=(spark.createDataFrame([], "id int, name string"), ("id",)), keyed=(a, ("name",)), added=(a.withColumn("x", F.lit(1)), ("id",)), new=(a, ("id",)))
    changed = tables.drifted(before, after)
    assert {r.table for r in changed.collect()} == {"typed", "keyed", "added"}
    shapes = spark.createDataFrame([("h1", "typed"), ("h2", "kept"), ("h3", "gone"), ("h4", "typed")], "handle string, table string")
    assert {r.handle for r in tables.ended(shapes, changed).collect()} == {"h1", "h4"}


def test_scan_over_jdbc(spark):
    url = "jdbc:derby:memory:tidewater;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(500).select((F.col("id") * 3 - 100).alias("id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), (F.col("id") % 7).alias("kind"))
    rows.coalesce(1).write.format("jdbc").options(url=url, dbtable="things", **driver).save()
    scan = tables.over_jdbc(spark, url, "things", "id", 0, 1_000, 4, ("id", "name"), **driver)
    assert scan.rdd.getNumPartitions() == 4 and scan.columns == ["id", "name"]
    assert sorted(map(tuple, scan.collect())) == sorted((r.id, r.name) for r in rows.collect())
    plan = tables.over_jdbc(spark, url, "things", "id", 0, 1_000, 4, **driver).where("kind = 3").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(KIND), *EqualTo(KIND,3)]" in plan or "EqualTo(kind,3)" in plan, plan


def test_handles_and_cache_classes(spark):
    shape = Shape("orders", ("id",), None, ("id", "name"), "id > 3", "full", "acme")
    row = spark.createDataFrame([("acme", "orders", ["id", "name"], "id > 3", "full")], "tenant string, table string, columns array<string>, text string, replica string")
    text = canonical_text(*[F.col(c) for c in row.columns])
    assert row.select(text).first()[0] == shape.canonical() and row.select(handle(text)).first()[0] == shape.handle()
    others = [Shape("orders", ("id",), None, ("id", "name"), "id > 3", "default", "acme"), Shape("orders", ("id",), None, ("id",), "id > 3", "full", "acme"), Shape("orders", ("id",), None, ("id", "name"), "id > 3", "full", "other")]
    assert len({s.handle() for s in [shape, *others]}) == 4
    assert [cache_control(*x) for x in ((True, True), (False, True), (False, False))] == ["public, max-age=5", "public, max-age=604800", "public, max-age=60"]


def test_members_by_counts(spark):
    """One of two rows with a value may go; a row whose value changes leaves one, enters another."""
    counts = subquery.member_counts(spark.createDataFrame([(1,), (1,), (2,), (None,)], "v long"), "v")
    rows = [(1, 0, 1, "delete", None, (1,)), (2, 0, 2, "update", (3,), (2,)), (3, 0, 3, "insert", (4,), None), (3, 1, 3, "delete", None, (4,)), (4, 0, 9, "insert", (None,), None)]
    after, flips = subquery.maintained(counts, spark.createDataFrame(rows, CHANGE), lambda side: F.lit(True), lambda side: F.col(f"{side}.v"))
    assert {r.value: r.n for r in after.collect()} == {1: 1, 3: 1}
    assert sorted((r.value, r.entered, r.lsn) for r in flips.collect()) == [(2, False, 2), (3, True, 2)]


def test_reverse_index_of_lists(spark):
    lists = spark.createDataFrame([("t", "k", True, [(1,), (2,)]), ("t", "e", True, [])], "table string, key string, is_list boolean, items array<struct<id:long>>")
    assert sorted((r.pk, r.key) for r in cache.reverse_index(lists, "items", "id").collect()) == [(1, "k"), (2, "k")]


def test_entry_without_the_optional_part():
    """Without the corpus part, or one of the packages that it needs, all else works."""
    code = "import sys\nfor name in {names!r}:\n    sys.modules[name] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'route_changes' in q and 'op1_bpe' not in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)\n"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for names in (["ahocorasick"], ["regex"], ["tidewater.llm"], ["corpus_pipeline"]):
        subprocess.run([sys.executable, "-W", "ignore", "-c", code.format(names=names)], cwd=root, check=True, timeout=120)


def test_the_shared_folder_has_to_be_named_on_a_cluster(spark):
    class Session:
        def __init__(self, master, at=None):
            self.conf, self.sparkContext, self.master, self.applicationId, self.at = self, self, master, f"app-{master}", at

        def get(self, name, default=None):
            return self.at or default

        def getConf(self):
            return self

    assert shared_dir(Session("spark://host", "hdfs://shared/")) == "hdfs://shared"
    assert shared_dir(Session("local[4]")) == shared_dir(Session("local[4]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session("spark://host"))
