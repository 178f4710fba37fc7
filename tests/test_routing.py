import random

from tidewater import catalog
from tidewater.operators import routing
from tidewater.plans.shape import Shape

IMAGE = "struct<a:long,b:string,score:double,tags:array<string>>"


def test_one_pass_without_grouping(spark):
    """Changes are made once and stay one row each: no task sorts their images by change and shape."""
    plan = catalog.QUERIES["filter_index_route"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Window [") == 1 and plan.count("hashpartitioning") == 1


def test_shapes_that_share_keys(spark):
    """Several keys of a shape on one side or both, equal numbers, many shapes of one key,
    more tests than a pass has, and members of arrays beside them."""
    rnd, nan = random.Random(4), float("nan")
    image = lambda: (rnd.choice([None, 1, 2, 3]), rnd.choice([None, "x", "y", "z"]), rnd.choice([None, nan, 0.0, -0.0, 1.5]), rnd.choice([None, [], ["r"], ["r", "g"]]))
    rows = []
    for i in range(150):
        op = rnd.choice(["insert", "update", "delete", "truncate"])
        rows.append((i, 0, i, op, image() if op in ("insert", "update") else None, image() if op in ("update", "delete") else None))
    changes = spark.createDataFrame(rows, f"lsn long, seq long, pk long, op string, new {IMAGE}, old {IMAGE}").cache()
    tests = {
        "nan": lambda r: r["score"] == nan, "nans": lambda r: r["score"].is_in(nan, nan, -0.0), "zero": lambda r: (r["score"] == 0) | (r["score"] == -0.0),
        "both": lambda r: (r["a"] == 1) | (r["b"] == "x") | (r["score"] == 1.5), "in": lambda r: r["a"].is_in(1, 2), "tags": lambda r: r["tags"].contains(["r"]) | r["tags"].contains(["g"]),
        "mixed": lambda r: r["tags"].contains(["g"]) | (r["a"] == 3), "tested": lambda r: r["a"].is_in(1, 2, 3) & (r["score"] > 1), "tagged": lambda r: r["tags"].contains(["r", "g"]),
        **{f"k{i}": lambda r: r["b"] == "y" for i in range(12)}, **{f"t{i}": lambda r, i=i: (r["a"] == i % 3) & (r["b"] != "z") for i in range(13)}, **{f"f{i}": lambda r, i=i: r["a"] > i % 4 for i in range(13)},
    }
    shapes = {n: Shape("things", ("a",), t) for n, t in tests.items()}
    index = routing.ShapeIndex(changes, shapes)
    get = lambda df: sorted((r.handle, r.lsn, r.operation, str(r.value)) for r in df.collect())
    want = get(routing.route_many(changes, shapes))
    assert get(routing.route_indexed(changes, index)) == want
    found = [(r.handle, r.lsn) for r in routing.candidates(changes.where("op <> 'truncate'"), index).collect()]
    assert len(found) == len(set(found)) and {w[:2] for w in want} <= set(found)
