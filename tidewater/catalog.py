"""The registered queries over the test tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import predicates as P
from tidewater.operators import cache, kv, log, metrics, replicate, routing, subquery
from tidewater.operators.numbering import numbered
from tidewater.plans.shape import Shape, canonical_text, handle, message_key
from tidewater.sources import changes as cdc
from tidewater.sources import paths, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "route_changes"


class Tables:
    """The tables of a folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return build

    return add


# ---------------------------------------------------------------- predicates


def predicate(name: str, table: str, key: str, test, sql: str) -> None:
    """Rows of ``table`` that match ``test``; ``sql``: the same condition for the oracle."""
    keys = key.split(", ")
    query(name, f"SELECT {key} FROM {table} WHERE {sql}")(lambda t: P.where(getattr(t, table), test).select(*keys))


O, L, C = ("orders", "o_orderkey"), ("lineitem", "l_orderkey, l_partkey, l_linenumber"), ("customer", "c_custkey")
PRIORITY = "array(o_orderstatus, o_orderpriority)"


def maybe(r: P.Row) -> P.Expr:
    """The order priority, null for the lowest."""
    return P.Expr(F.nullif("o_orderpriority", F.lit("5-LOW")), "text")


def tags(r: P.Row) -> P.Expr:
    return P.array(r["o_orderstatus"], maybe(r))


MAYBE = "nullif(o_orderpriority, '5-LOW')"
TAGS = f"[o_orderstatus, {MAYBE}]"

predicate("where_ident", *O, lambda r: r["public.orders.o_orderstatus"] == "F", "o_orderstatus = 'F'")
predicate("where_params", *O, lambda r: r["o_custkey"] == "17", "o_custkey = 17")
predicate("where_comparison", *O, lambda r: (r["o_totalprice"] > 100000) & (r["o_orderstatus"] != "P") & (r["o_custkey"] <= 900), "o_totalprice > 100000 AND o_orderstatus <> 'P' AND o_custkey <= 900")
predicate("where_logical", *O, lambda r: ~(maybe(r) == "1-URGENT") | (r["o_orderstatus"] == "P"), f"NOT ({MAYBE} = '1-URGENT') OR o_orderstatus = 'P'")
predicate("where_arith", *O, lambda r: r["o_custkey"] * 3 - r["o_orderkey"] + 7 > 0, "o_custkey * 3 - o_orderkey + 7 > 0")
predicate("where_div", *O, lambda r: r["o_orderkey"] / 7 / -3 < -300, "(o_orderkey // 7) // -3 < -300")
predicate("where_mod", *O, lambda r: (r["o_custkey"] - 500) % 7 == -3, "(o_custkey - 500) % 7 = -3")
predicate("where_bitwise", *L, lambda r: r["l_partkey"].bit_and(12).bit_or(1).bit_xor(r["l_linenumber"]) > 8, "xor((l_partkey & 12) | 1, l_linenumber) > 8")
predicate("where_shift", *L, lambda r: r["l_linenumber"].shift_left(3).shift_right(r["l_linenumber"]) > 4, "((l_linenumber::BIGINT << 3) >> l_linenumber) > 4")
predicate("where_unary", *O, lambda r: ~(-r["o_custkey"] > -100), "NOT (-o_custkey > -100)")
predicate("where_null_tests", *O, lambda r: maybe(r).is_null() & r["o_custkey"].is_not_null(), f"{MAYBE} IS NULL AND o_custkey IS NOT NULL")
predicate("where_bool_tests", *O, lambda r: (maybe(r) == "2-HIGH").is_unknown() | (maybe(r) == "2-HIGH").is_true(), f"({MAYBE} = '2-HIGH') IS NULL OR ({MAYBE} = '2-HIGH') IS TRUE")
predicate("where_in_list", *O, lambda r: ~maybe(r).is_in("1-URGENT", "3-MEDIUM"), f"{MAYBE} NOT IN ('1-URGENT', '3-MEDIUM')")
predicate("where_between", *O, lambda r: ~r["o_totalprice"].between(50000, 250000), "o_totalprice NOT BETWEEN 50000 AND 250000")
predicate("where_like", *C, lambda r: r["c_name"].like("Customer#%1_") & ~r["c_name"].like(r"%\_%"), r"c_name LIKE 'Customer#%1_' ESCAPE '\' AND c_name NOT LIKE '%\_%' ESCAPE '\'")
predicate("where_ilike", *C, lambda r: r["c_mktsegment"].ilike("%uIL%"), "c_mktsegment ILIKE '%uIL%'")
predicate("where_array_contains", *O, lambda r: tags(r).contains(["F"]) & P.lit(["F", "2-HIGH", "P", "1-URGENT"]).contains(tags(r)), f"list_has_all({TAGS}, ['F']) AND o_orderpriority IN ('2-HIGH', '1-URGENT') AND o_orderstatus IN ('F', 'P')")
predicate("where_array_overlap", *O, lambda r: tags(r).overlaps(["P", "2-HIGH"]), f"list_has_any({TAGS}, ['P', '2-HIGH'])")
predicate("where_any", *O, lambda r: P.lit("2-HIGH").any_of(tags(r)), f"o_orderstatus = '2-HIGH' OR {MAYBE} = '2-HIGH'")
predicate("where_all", *O, lambda r: P.lit("2").all_of(tags(r), lambda a, b: a < b), f"'2' < o_orderstatus AND '2' < {MAYBE}")
predicate("where_array_literal", *O, lambda r: P.array(r["o_custkey"], r["o_orderkey"]).contains([42]), "list_has_all([o_custkey, o_orderkey], [42::BIGINT])")
predicate("fn_lower_upper", *C, lambda r: (r["c_mktsegment"].lower() == "building") | (r["c_name"].upper() == "CUSTOMER#000000007"), "lower(c_mktsegment) = 'building' OR upper(c_name) = 'CUSTOMER#000000007'")
predicate("fn_coalesce", *O, lambda r: P.coalesce(maybe(r), r["o_orderstatus"]) == "F", f"coalesce({MAYBE}, o_orderstatus) = 'F'")
predicate("fn_greatest_least", *O, lambda r: (P.greatest(maybe(r), "3") > "4") | (P.least(r["o_custkey"], r["o_orderkey"]) < 20), f"greatest({MAYBE}, '3') > '4' OR least(o_custkey, o_orderkey) < 20")
predicate("where_true_only", *O, lambda r: maybe(r) > "2", f"{MAYBE} > '2'")
predicate("where_div_zero_guard", *O, lambda r: (P.lit(10) / (r["o_custkey"] % 5)).is_null() | (r["o_custkey"] % 5 < 3), "o_custkey % 5 <> 0 AND o_custkey % 5 < 3")

query("where_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")(
    lambda t: subquery.member_of(t.orders, "o_custkey", t.customer.where("c_mktsegment = 'BUILDING'"), "c_custkey").select("o_orderkey")
)
query("where_not_in_subquery", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")(
    lambda t: subquery.member_of(t.orders, "o_custkey", t.customer.where("c_mktsegment = 'BUILDING'"), "c_custkey", negated=True).select("o_orderkey")
)
query("where_subquery_and", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderstatus = 'F'")(
    lambda t: subquery.member_of(P.where(t.orders, lambda r: r["o_orderstatus"] == "F"), "o_custkey", t.customer.where("c_acctbal < 0"), "c_custkey").select("o_orderkey")
)
query("where_subquery_or", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR o_orderstatus = 'P'")(
    lambda t: subquery.is_member(t.orders, "o_custkey", t.customer.where("c_acctbal < 0"), "c_custkey").where("member or o_orderstatus = 'P'").select("o_orderkey")
)

# ---------------------------------------------------------------- shapes and snapshots

BIG = Shape("orders", ("o_orderkey",), lambda r: (r["o_orderstatus"] == "F") & (r["o_totalprice"] > 100000), ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), "o_orderstatus = 'F' AND o_totalprice > 100000")
TURNS = Shape("conversations", ("conv_id", "turn"), lambda r: r["role"] == "user")

query("scan_snapshot", "SELECT * FROM orders")(lambda t: t.orders)
query("shape_columns", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")(lambda t: BIG.selected(t.orders))
query("shape_keyed", "SELECT concat_ws(',', conv_id, turn) AS message_key, text FROM conversations WHERE role = 'user'")(
    lambda t: TURNS.selected(t.conversations).select(message_key("conv_id", "turn").alias("message_key"), "text")
)
query("snapshot_offsets", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS op_offset FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")(
    lambda t: BIG.snapshot(t.orders).select("o_orderkey", "op_offset")
)


@query("shape_handle", r"SELECT c_custkey, substring(sha256(concat_ws(chr(10), c_name, 'orders', 'o_orderkey,o_custkey', 'o_orderpriority = ' || c_mktsegment, 'full')), 1, 32) AS handle FROM customer")
def _(t):
    """Handles of shape definitions in a table: a shape of orders for each customer as tenant."""
    columns, test = F.array(F.lit("o_orderkey"), F.lit("o_custkey")), F.concat(F.lit("o_orderpriority = "), "c_mktsegment")
    return t.customer.select("c_custkey", handle(canonical_text(F.col("c_name"), F.lit("orders"), columns, test, F.lit("full"))).alias("handle"))


# ---------------------------------------------------------------- paths


def at_path(name: str, path: str, sql: str, **more) -> None:
    query(name, sql)(lambda t: paths.resolve(path, lambda n: getattr(t, n), **more))


at_path("pgrst_select", "/customer?select=c_custkey,c_name", "SELECT c_custkey, c_name FROM customer")
at_path("pgrst_eq", "/orders?o_orderstatus=eq.P&select=o_orderkey,o_custkey", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'")
at_path("pgrst_range_filter", "/orders?o_orderkey=gt.100&o_orderkey=lt.300&select=o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 AND o_orderkey < 300")
at_path("pgrst_order_limit", "/customer?order=c_mktsegment,c_custkey.desc&limit=25&select=c_custkey", "SELECT c_custkey FROM customer ORDER BY c_mktsegment, c_custkey DESC LIMIT 25")
at_path("pgrst_page", "/customer?order=c_custkey&limit=10&offset=20&select=c_custkey,c_name", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20")
at_path("range_page", "/customer?order=c_custkey&select=c_custkey", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 10", span=(10, 19))
at_path("pk_lookup", "/customer?c_custkey=eq.7&limit=1", "SELECT * FROM customer WHERE c_custkey = 7")
at_path("replica_filtered", "/orders?o_custkey=eq.7&select=o_orderkey", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'", extra="o_orderstatus=eq.F")
at_path("pgrst_rpc", "/rpc/segments?least=0", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
QUERIES["pgrst_rpc"] = lambda spark, d: paths.resolve("/rpc/segments?least=0", None, {"segments": lambda least: Tables(spark, d).customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")).where(F.col("n") >= int(least))})

# ---------------------------------------------------------------- changes and the log

CHANGES = """
WITH e AS (
  SELECT *, event_type = 'error' AS gone, lag(event_type = 'error') OVER w AS was_gone,
         lag(event_type) OVER w AS old_type, lag(value) OVER w AS old_value
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), ch AS (
  SELECT event_id // 3 AS lsn, event_id % 3 AS seq, user_id AS pk,
         CASE WHEN gone THEN 'delete' WHEN coalesce(was_gone, true) THEN 'insert' ELSE 'update' END AS op,
         CASE WHEN NOT gone THEN event_type END AS new_type, CASE WHEN NOT gone THEN value END AS new_value,
         CASE WHEN NOT coalesce(was_gone, true) THEN old_type END AS old_type,
         CASE WHEN NOT coalesce(was_gone, true) THEN old_value END AS old_value
  FROM e WHERE NOT (gone AND coalesce(was_gone, true))
), m AS (
  SELECT *, op <> 'insert' AND coalesce(old_value > 50, false) AS b, op <> 'delete' AND coalesce(new_value > 50, false) AS a FROM ch
), r AS (
  SELECT lsn, seq, pk, CASE WHEN a AND NOT b THEN 'insert' WHEN a THEN 'update' ELSE 'delete' END AS operation,
         CASE WHEN a THEN new_type ELSE old_type END AS event_type, CASE WHEN a THEN new_value ELSE old_value END AS value,
         CASE WHEN b THEN old_value END AS was, new_value
  FROM m WHERE a OR b
)
"""
OVER_50 = Shape("events", ("user_id",), lambda r: r["value"] > 50)


def change_log(t: Tables) -> DataFrame:
    """Three events are a transaction; some change one row twice."""
    return cdc.from_events(t.events, per_transaction=3)


def routed(t: Tables) -> DataFrame:
    """The log of OVER_50 as (handle, lsn, op_offset, operation, pk, value, event_type)."""
    rows = log.offsets(routing.route(change_log(t), OVER_50).withColumn("handle", F.lit("h")))
    return rows.withColumns({"event_type": F.col("value.event_type"), "value": F.col("value.value")})


query("change_stream", CHANGES + "SELECT lsn, seq, pk, op, new_value, old_value FROM ch")(
    lambda t: change_log(t).select("lsn", "seq", "pk", "op", F.col("new.value").alias("new_value"), F.col("old.value").alias("old_value"))
)
query("changes_only_boundary", CHANGES + "SELECT lsn, seq, (SELECT count(*) FROM ch) AS n FROM ch ORDER BY lsn DESC, seq DESC LIMIT 1")(lambda t: cdc.boundary(change_log(t)))
query("route_changes", CHANGES + "SELECT lsn, seq, pk, operation, event_type, value FROM r")(
    lambda t: routing.route(change_log(t), OVER_50).select("lsn", "seq", "pk", "operation", F.col("value.event_type").alias("event_type"), F.col("value.value").alias("value"))
)
query("route_replica_full", CHANGES + "SELECT lsn, seq, operation, value, CASE WHEN operation <> 'insert' THEN was END AS old_value FROM r")(
    lambda t: routing.route(change_log(t), Shape("events", ("user_id",), OVER_50.predicate, replica="full")).select("lsn", "seq", "operation", F.col("value.value").alias("value"), F.col("old_value.value").alias("old_value"))
)
query("route_projected", CHANGES + "SELECT lsn, seq, operation, '{\"value\":' || (value::DECIMAL(18,4))::VARCHAR || '}' AS body FROM r")(
    lambda t: routing.route(change_log(t), Shape("events", (), OVER_50.predicate, ("value",))).select("lsn", "seq", "operation", F.concat(F.lit('{"value":'), F.col("value.value").cast("decimal(18,4)").cast("string"), F.lit("}")).alias("body"))
)


@query("truncate_to_deletes", CHANGES + """, k(lsn) AS (VALUES (90), (91), (250)), x AS (
  SELECT ch.lsn, ch.seq, pk, op, (SELECT count(*) FROM k WHERE k.lsn < ch.lsn) AS epoch FROM ch
), last AS (
  SELECT pk, epoch, arg_max(op, lsn * 3 + seq) AS op FROM x GROUP BY pk, epoch
), n AS (
  SELECT lsn, row_number() OVER (ORDER BY lsn) - 1 AS epoch FROM k
)
SELECT lsn, seq, pk, op FROM x UNION ALL SELECT n.lsn, 9, pk, 'delete' FROM last JOIN n USING (epoch) WHERE op <> 'delete'""")
def _(t):
    """Truncates after the transactions 90, 91 and 250: deletes of all keys alive then."""
    rows = change_log(t)
    marks = t.spark.createDataFrame([(90,), (91,), (250,)], "lsn long")
    marks = marks.select("lsn", F.lit(9).cast("long").alias("seq"), F.lit(None).cast("long").alias("pk"), F.lit("truncate").alias("op"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("new", "old")])
    return routing.without_truncates(rows.unionByName(marks)).select("lsn", "seq", "pk", "op")


TYPES = ("click", "view", "purchase", "signup")


def by_type(kind: str) -> Shape:
    return Shape("events", ("user_id",), lambda r: r["event_type"] == kind)


def many(arms: dict[str, str]) -> str:
    """Oracle of the logs of several shapes; each condition has %s for the side's prefix."""
    rows = [f"SELECT '{name}' AS handle, lsn, seq, pk, op <> 'insert' AND coalesce({test.replace('%s', 'old')}, false) AS b, op <> 'delete' AND coalesce({test.replace('%s', 'new')}, false) AS a FROM ch" for name, test in arms.items()]
    return CHANGES + f"SELECT handle, lsn, seq, pk, CASE WHEN a AND b THEN 'update' WHEN a THEN 'insert' ELSE 'delete' END AS operation FROM ({' UNION ALL '.join(rows)}) WHERE a OR b"


query("route_multi_shape", many({k: f"%s_type = '{k}'" for k in TYPES}))(lambda t: routing.route_many(change_log(t), {k: by_type(k) for k in TYPES}).select("handle", "lsn", "seq", "pk", "operation"))

#: Shapes of all kinds: one key, several, keys and more, none; with the same condition in SQL.
MIXED: dict[str, tuple] = {
    **{k: (lambda r, k=k: r["event_type"] == k, f"%s_type = '{k}'") for k in TYPES},
    "in": (lambda r: r["event_type"].is_in("click", "signup"), "%s_type IN ('click', 'signup')"),
    "or": (lambda r: (r["event_type"] == "view") | (r["value"] == "0"), "(%s_type = 'view' OR %s_value = 0)"),
    "and": (lambda r: (r["value"] > 100) & (r["event_type"] == "purchase"), "(%s_value > 100 AND %s_type = 'purchase')"),
    "like": (lambda r: r["event_type"].like("%i%"), "%s_type LIKE '%i%'"),
    "range": (lambda r: r["value"].between(10, 40), "%s_value BETWEEN 10 AND 40"),
}


def mixed(t: Tables) -> tuple[DataFrame, routing.ShapeIndex]:
    rows = change_log(t)
    return rows, routing.ShapeIndex(rows, {name: Shape("events", ("user_id",), test) for name, (test, _) in MIXED.items()})


query("filter_index_route", many({name: sql for name, (_, sql) in MIXED.items()}))(lambda t: routing.route_indexed(*mixed(t)).select("handle", "lsn", "seq", "pk", "operation"))


@query("filter_index_candidates", CHANGES + "SELECT DISTINCT lsn, seq, pk, handle FROM (SELECT lsn, seq, pk, CASE WHEN op <> 'delete' THEN new_type END AS handle FROM ch UNION ALL SELECT lsn, seq, pk, CASE WHEN op <> 'insert' THEN old_type END FROM ch) WHERE handle IN ('click', 'view') UNION ALL SELECT lsn, seq, pk, 'like' FROM ch")
def _(t):
    rows = change_log(t)
    shapes = {k: by_type(k) for k in TYPES[:2]} | {"like": Shape("events", ("user_id",), lambda r: r["event_type"].like("%a%"))}
    return routing.candidates(rows, routing.ShapeIndex(rows, shapes))


OFFSETS = CHANGES + ", o AS (SELECT *, seq AS op_offset FROM r) "
query("log_offsets", OFFSETS + "SELECT lsn, op_offset, pk, operation FROM o")(lambda t: routed(t).select("lsn", "op_offset", "pk", "operation"))
query("offset_codec", OFFSETS + "SELECT lsn || '_' || op_offset AS text, lsn, op_offset AS op, 1 AS rank FROM o")(
    lambda t: routed(t).select(log.encode(F.col("lsn"), F.col("op_offset")).alias("text")).withColumn("d", log.decode(F.col("text"))).select("text", "d.lsn", "d.op", "d.rank")
)
query("log_resume", OFFSETS + "SELECT lsn, op_offset, operation FROM o WHERE (lsn, op_offset) > (166, 1)")(lambda t: log.after(routed(t), 166, 1).select("lsn", "op_offset", "operation"))
query("log_retention", OFFSETS + "SELECT lsn, op_offset, operation FROM o ORDER BY lsn DESC, op_offset DESC LIMIT 100")(lambda t: log.retained(routed(t), 100).select("lsn", "op_offset", "operation"))
query("log_tip", OFFSETS + "SELECT 'h' AS handle, lsn, op_offset FROM o ORDER BY lsn DESC, op_offset DESC LIMIT 1")(lambda t: log.tip(routed(t)))
query("must_refetch", OFFSETS + ", k AS (SELECT lsn * 3 + op_offset AS place FROM o ORDER BY 1 DESC LIMIT 100) SELECT lsn, op_offset, lsn * 3 + op_offset < (SELECT min(place) FROM k) AS must_refetch FROM o")(
    lambda t: log.must_refetch(routed(t).select("handle", "lsn", "op_offset"), log.retained(routed(t), 100)).select("lsn", "op_offset", "must_refetch")
)
VIEW = CHANGES + "SELECT pk, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY lsn DESC, seq DESC) AS n FROM ch) s, LATERAL (SELECT new_type AS event_type, new_value AS value) WHERE n = 1 AND op <> 'delete' AND new_value > 50"


def folded(t: Tables) -> DataFrame:
    rows = log.offsets(routing.route(change_log(t), OVER_50))
    return log.materialize(rows, "pk").select("pk", F.col("value.event_type").alias("event_type"), F.col("value.value").alias("value"))


query("materialize_log", VIEW)(folded)


@query("snapshot_plus_log", VIEW)
def _(t):
    """A snapshot taken in the middle and the whole log: changes seen twice do no harm."""
    rows = log.offsets(routing.route(change_log(t), OVER_50)).drop("old_value", "seq")
    middle = log.materialize(rows.where("lsn <= 233"), "pk")
    snapshot = middle.select(F.lit(-1).cast("long").alias("lsn"), "pk", F.lit("insert").alias("operation"), "value", F.lit(0).cast("long").alias("op_offset"))
    return log.materialize(snapshot.unionByName(rows), "pk").select("pk", F.col("value.event_type").alias("event_type"), F.col("value.value").alias("value"))


@query("log_from_beginning", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS op_offset, true AS settled FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def _(t):
    snapshot = BIG.snapshot(t.orders).select(F.lit("h").alias("handle"), "lsn", "op_offset", "o_orderkey")
    later = t.events.select(F.lit("h").alias("handle"), F.col("event_id") + 1, F.lit(0).cast("long"), F.lit(None).cast("long"))
    return log.from_beginning(snapshot.union(later)).select("o_orderkey", "op_offset", "settled")


BODY = """'{"lsn":' || lsn || ',"op_offset":' || op_offset || ',"operation":"' || operation || '","value":{"event_type":"' || event_type || '"}}'"""


def typed_log(t: Tables) -> DataFrame:
    rows = routing.route(change_log(t), Shape("events", ("user_id",), OVER_50.predicate, ("event_type",)))
    return log.offsets(rows).withColumn("handle", F.concat(F.lit("h"), (F.col("pk") % 3).cast("string")))


query("log_messages", OFFSETS + f"SELECT lsn, op_offset, {BODY} AS body, 'data: ' || {BODY} || chr(10) || chr(10) AS event FROM o")(lambda t: log.messages(typed_log(t)))
query("log_bytes", OFFSETS + f"SELECT 'h' || pk % 3 AS handle, sum(strlen({BODY}))::BIGINT AS bytes FROM o GROUP BY 1")(lambda t: log.total_bytes(typed_log(t), log.message_bytes()))
query("log_byte_cap", "WITH RECURSIVE " + OFFSETS.split("WITH ", 1)[1] + f""", b AS (
  SELECT handle, lsn, bytes, row_number() OVER (PARTITION BY handle ORDER BY lsn) AS i FROM (SELECT 'h' || pk % 3 AS handle, lsn, sum(strlen({BODY}))::BIGINT AS bytes FROM o GROUP BY 1, 2)
), f AS (
  SELECT handle, i, lsn, bytes <= 8000 AS fits, CASE WHEN bytes <= 8000 THEN bytes ELSE 0 END AS total FROM b WHERE i = 1
  UNION ALL SELECT b.handle, b.i, b.lsn, f.total + b.bytes <= 8000, CASE WHEN f.total + b.bytes <= 8000 THEN f.total + b.bytes ELSE f.total END FROM f JOIN b ON b.handle = f.handle AND b.i = f.i + 1
) SELECT o.lsn, op_offset, pk, operation FROM o JOIN f ON f.lsn = o.lsn AND f.handle = 'h' || pk % 3 WHERE fits""")(
    lambda t: log.within_bytes(typed_log(t), 8_000, log.message_bytes()).select("lsn", "op_offset", "pk", "operation")
)
query("shape_counts", "SELECT c_nationkey AS tenant, count(*) AS shapes FROM customer GROUP BY 1")(lambda t: metrics.counts(t.customer.withColumnRenamed("c_nationkey", "tenant"), "tenant", "shapes"))
query("lsn_checkpoint", CHANGES + "SELECT pk, max(lsn) AS lsn FROM ch GROUP BY pk")(lambda t: cdc.checkpoint(change_log(t), "pk"))
query("snapshot_visibility", "SELECT event_id, event_id < 300 OR (event_id < 900 AND event_id NOT IN (400, 555, 700)) AS visible FROM events")(
    lambda t: t.events.select("event_id", log.visible(F.col("event_id"), F.lit(300), F.lit(900), F.array(*map(F.lit, (400, 555, 700)))).alias("visible"))
)
query("snapshot_decide", "WITH x AS (SELECT event_id, user_id, (event_id * 7919) % 1000 AS xid FROM events) SELECT event_id, max(xid >= 900) OVER (PARTITION BY user_id ORDER BY event_id) OR NOT (xid < 300 OR (xid < 900 AND xid <> 555)) AS logged FROM x")(
    lambda t: log.decide(
        t.events.select(F.col("event_id").alias("lsn"), "user_id", (F.col("event_id") * 7919 % 1000).alias("xid")),
        900,
        log.visible(F.col("xid"), F.lit(300), F.lit(900), F.array(F.lit(555))),
        "user_id",
    ).select(F.col("lsn").alias("event_id"), "logged")
)


@query("subquery_delta", """
WITH v1 AS (SELECT c_custkey AS v FROM customer WHERE c_mktsegment = 'BUILDING'),
v2 AS (SELECT c_custkey AS v FROM customer WHERE (c_mktsegment = 'BUILDING') <> (c_custkey % 10 = 0)),
f AS (SELECT v, false AS entered FROM v1 WHERE v NOT IN (SELECT v FROM v2) UNION ALL SELECT v, true FROM v2 WHERE v NOT IN (SELECT v FROM v1))
SELECT o_orderkey, CASE WHEN entered THEN 'insert' ELSE 'delete' END AS operation FROM orders JOIN f ON o_custkey = v WHERE o_orderstatus = 'F'""")
def _(t):
    before = t.customer.where("c_mktsegment = 'BUILDING'")
    after = t.customer.where("(c_mktsegment = 'BUILDING') <> (c_custkey % 10 = 0)")
    flips = subquery.membership_changes(before, after, "c_custkey")
    return subquery.outer_delta(t.orders, "o_custkey", flips, F.col("o_orderstatus") == "F").select("o_orderkey", "operation")


@query("subquery_maintained", CHANGES + """, n AS (
  SELECT floor(new_value / 5)::BIGINT AS v, 1 AS d, lsn FROM ch WHERE new_value > 20 UNION ALL SELECT floor(old_value / 5)::BIGINT, -1, lsn FROM ch WHERE old_value > 20
), c AS (
  SELECT v, sum(CASE WHEN lsn < 250 THEN d ELSE 0 END) AS before, sum(d) AS now, max(CASE WHEN lsn >= 250 THEN lsn END) AS lsn FROM n GROUP BY v
)
SELECT o_orderkey, lsn, CASE WHEN now > 0 THEN 'insert' ELSE 'delete' END AS operation FROM orders JOIN c ON o_custkey = v WHERE (before > 0) <> (now > 0) AND o_orderstatus = 'F'""")
def _(t):
    """``o_custkey IN (SELECT floor(value / 5) FROM events WHERE value > 20) AND o_orderstatus
    = 'F'`` as the inner table changes: counts up to transaction 250, then the changes."""
    rows = change_log(t)
    matches, value = lambda side: F.col(f"{side}.value") > 20, lambda side: F.floor(F.col(f"{side}.value") / 5).cast("long")
    empty = t.spark.createDataFrame([], "value long, n long")
    counts, _ = subquery.maintained(empty, rows.where("lsn < 250"), matches, value)
    _, flips = subquery.maintained(counts, rows.where("lsn >= 250"), matches, value)
    return subquery.outer_delta(t.orders, "o_custkey", flips, F.col("o_orderstatus") == "F").select("o_orderkey", "lsn", "operation")


# ---------------------------------------------------------------- cache


def index_of(t: Tables) -> DataFrame:
    """Orders are cached as lists: one for each customer."""
    return cache.index_rows(t.orders, "orders", "o_orderkey", F.concat(F.lit("orders:cust="), F.col("o_custkey").cast("string")))


def lists_of(t: Tables) -> DataFrame:
    return index_of(t).where("is_list").select("table", "key").distinct()


def row_changes(t: Tables) -> DataFrame:
    return t.events.select(F.lit("orders").alias("table"), F.col("event_id").alias("pk"), F.when(F.col("event_type") == "signup", "insert").otherwise("update").alias("op"))


KEY = "'orders:cust=' || o_custkey"
query("reverse_index_build", f"SELECT 'orders' AS \"table\", o_orderkey AS pk, {KEY} AS key, true AS is_list FROM orders")(index_of)
query("index_rebuild", "SELECT 'orders' AS \"table\", count(*) AS pks, count(DISTINCT o_custkey) AS keys FROM orders")(lambda t: cache.index_size(index_of(t)))
query("invalidate_by_row", f"SELECT DISTINCT 'orders' AS \"table\", {KEY} AS key FROM orders WHERE o_orderkey IN (SELECT event_id FROM events WHERE event_type <> 'signup')")(
    lambda t: cache.keys_of_rows(row_changes(t).where("op = 'update'"), index_of(t))
)
query("invalidate_lists", f"SELECT DISTINCT 'orders' AS \"table\", {KEY} AS key FROM orders")(lambda t: cache.keys_of_lists(row_changes(t), lists_of(t)))
query("flush_table", f"SELECT DISTINCT 'orders' AS \"table\", {KEY} AS key FROM orders UNION ALL SELECT 'orders', 'orders:empty'")(
    lambda t: cache.keys_of_table(index_of(t), t.spark.createDataFrame([("orders", "orders:empty"), ("part", "part:x")], "table string, key string"), "orders")
)


@query("route_mode", """
WITH c AS (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS tbl,
  CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'truncate' WHEN 'purchase' THEN 'delete' ELSE 'update' END AS op FROM events)
SELECT event_id, CASE WHEN op = 'truncate' THEN 'flush_table' WHEN tbl = 'c' THEN 'ignore' WHEN tbl = 'b' THEN 'refresh' WHEN op = 'insert' THEN 'invalidate_lists' ELSE 'invalidate_row' END AS action FROM c""")
def _(t):
    config = t.spark.createDataFrame([("a", "ttl"), ("b", "replication")], "tbl string, mode string")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "truncate").when(F.col("event_type") == "purchase", "delete").otherwise("update")
    tbl = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("user_id") % 3 + 1).cast("int"))
    rows = t.events.select("event_id", op.alias("op"), tbl.alias("tbl")).join(F.broadcast(config), "tbl", "left")
    return rows.select("event_id", cache.action(F.col("mode"), F.col("op")).alias("action"))


NOW = 1_000
query("cache_ttl_live", f"SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 0 OR o_custkey * 2 > {NOW}")(
    lambda t: cache.live(t.orders.withColumn("expires_at", F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") * 2)), NOW).select("o_orderkey")
)
query("cache_ttl_remaining", f"SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -2 WHEN c_custkey % 4 = 0 THEN -1 WHEN c_custkey <= {NOW} THEN -2 ELSE c_custkey - {NOW} END AS ttl FROM customer")(
    lambda t: t.customer.select("c_custkey", cache.remaining(F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")), F.col("c_acctbal") >= 0, F.lit(NOW)).alias("ttl"))
)
query("hot_ttl", "SELECT c_custkey, least(c_custkey * 1000, 300000) AS ttl_ms FROM customer")(lambda t: t.customer.select("c_custkey", F.least(F.col("c_custkey") * 1000, F.lit(300000)).alias("ttl_ms")))
RUNNING = "sum({size}) OVER (PARTITION BY user_id ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
query("cache_lru_evict", f"SELECT event_id FROM (SELECT event_id, {RUNNING.format(size='length(props)', order='event_id DESC')} AS s FROM events) WHERE s <= 600")(
    lambda t: cache.kept_within(t.events.withColumn("bytes", F.length("props")), 600, "user_id", [F.desc("event_id")]).select("event_id")
)
query("disk_evict", f"SELECT event_id FROM (SELECT event_id, event_type, {RUNNING.format(size=chr(39).join(['CASE WHEN event_type = ', 'signup', ' THEN 0 ELSE (length(props) + 4095) // 4096 * 4096 END']), order='event_id DESC')} AS s FROM events) WHERE s <= 81920 OR event_type = 'signup'")(
    lambda t: cache.kept_within(t.events.withColumn("bytes", cache.blocks(F.length("props"))), 81920, "user_id", [F.desc("event_id")], exempt=F.col("event_type") == "signup").select("event_id")
)
query("persist_cap", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 20 AS accepted FROM events")(lambda t: cache.first_within(t.events, 20, "user_id", ["event_id"]).select("event_id", "accepted"))
query("read_ladder", "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'm' WHEN c_custkey % 3 = 1 THEN 'd' ELSE c_name END AS value, (c_custkey % 3)::INTEGER AS level FROM customer")(
    lambda t: cache.ladder(
        t.customer.select(F.col("c_custkey").alias("key")),
        t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.lit("m").alias("value")),
        t.customer.where("c_custkey % 3 = 1").select(F.col("c_custkey").alias("key"), F.lit("d").alias("value")),
        t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value")),
    )
)
query("cache_key", "SELECT c_custkey, 'table:customer:' || substring(sha256(CASE WHEN 'k=' || c_custkey < 'a=' || c_mktsegment THEN 'k=' || c_custkey || '&a=' || c_mktsegment ELSE 'a=' || c_mktsegment || '&k=' || c_custkey END), 1, 32) AS key FROM customer")(
    lambda t: t.customer.select(
        "c_custkey",
        cache.canonical_key(F.lit("table"), F.lit("customer"), F.array(F.struct(F.lit("k").alias("name"), F.col("c_custkey").cast("string").alias("value")), F.struct(F.lit("a").alias("name"), F.col("c_mktsegment").alias("value")))).alias("key"),
    )
)
query("cast_rows", "SELECT event_id, try_cast(t AS BIGINT) AS t, CASE WHEN try_cast(t AS BIGINT) IS NULL THEN t END AS t_text FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE user_id::VARCHAR END AS t FROM events)")(
    lambda t: cache.typed(t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string")).alias("t")), {"t": "bigint"})
)
query("rewarm_due", "SELECT user_id, max(event_id) + 50 AS next_due, max(event_id) + 50 <= 990 AS due FROM events GROUP BY user_id")(
    lambda t: t.events.groupBy("user_id").agg((F.max("event_id") + 50).alias("next_due")).withColumn("due", F.col("next_due") <= 990)
)
query("tombstone_filter", "SELECT event_id FROM events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.user_id = e.user_id AND x.ts <= e.ts AND e.ts < x.ts + INTERVAL 60 SECOND)")
def _(t):
    puts = t.events.where("event_type <> 'error'")
    dead = t.events.where("event_type = 'error'").select(F.col("user_id").alias("u"), F.col("ts").alias("at"))
    near = (F.col("user_id") == F.col("u")) & (F.col("at") <= F.col("ts")) & (F.col("ts") < F.col("at") + F.expr("INTERVAL 60 SECONDS"))
    return puts.join(dead, near, "left_anti").select("event_id")


# ---------------------------------------------------------------- replication and the control plane

query("replicate_kv", "SELECT 'nation:' || n_nationkey AS key, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation")(
    lambda t: replicate.as_kv(t.nation.select("n_nationkey", "n_name"), "nation", "n_nationkey")
)
query("replica_refresh", CHANGES + ", l AS (SELECT pk, arg_max(op, lsn) AS op FROM ch GROUP BY pk) SELECT pk, CASE WHEN op = 'delete' OR pk NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) THEN 'remove' ELSE 'put' END AS action FROM l")(
    lambda t: replicate.refresh(change_log(t), t.customer.where("c_custkey % 2 = 0"), "c_custkey")
)
query("reconcile_stale", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")(
    lambda t: replicate.stale(t.orders.select("o_orderkey"), t.orders.where("o_orderstatus <> 'P'"), "o_orderkey")
)
query("reconcile_schedule", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS start_s FROM customer")(
    lambda t: replicate.schedule(t.customer.withColumn("tenant", F.col("c_nationkey")), "c_custkey").select("c_custkey", F.col("start_s").cast("long").alias("start_s"))
)
RING = """
WITH ring AS (SELECT n_name AS node, ('0x' || substring(sha256(n_name || '#' || i), 1, 8))::BIGINT AS point FROM nation, range(128) r(i) WHERE n_nationkey < {nodes}),
ten AS (SELECT c_name AS tenant, ('0x' || substring(sha256(c_name), 1, 8))::BIGINT AS spot FROM customer),
own AS (SELECT tenant, coalesce((SELECT arg_min(node, point) FROM ring WHERE point >= spot), (SELECT arg_min(node, point) FROM ring)) AS node FROM ten)
"""


def owned(t: Tables, nodes: int) -> DataFrame:
    points = replicate.ring(t.nation.where(F.col("n_nationkey") < nodes).select(F.col("n_name").alias("node")))
    return replicate.owners(t.customer.select(F.col("c_name").alias("tenant")), points)


query("hash_ring_owner", RING.format(nodes=5) + "SELECT tenant, node FROM own")(lambda t: owned(t, 5))
query("ring_rebalance", RING.format(nodes=5) + ", ring6 AS (SELECT n_name AS node, ('0x' || substring(sha256(n_name || '#' || i), 1, 8))::BIGINT AS point FROM nation, range(128) r(i) WHERE n_nationkey < 6), own6 AS (SELECT tenant, coalesce((SELECT arg_min(node, point) FROM ring6 WHERE point >= spot), (SELECT arg_min(node, point) FROM ring6)) AS node FROM ten) SELECT tenant, own.node AS source, own6.node AS target FROM own JOIN own6 USING (tenant) WHERE own.node <> own6.node")(
    lambda t: owned(t, 5).withColumnRenamed("node", "source").join(owned(t, 6).withColumnRenamed("node", "target"), "tenant").where("source <> target")
)
query("tenant_resolve", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), n_name) AS credential FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")(
    lambda t: tables.resolved(t.customer.select("c_custkey", F.col("c_nationkey").alias("k"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("credential")), t.nation.select(F.col("n_nationkey").alias("k"), "n_name"), "k", {"credential": "n_name"}).drop("k")
)
DEFINED = {"nation": ("n_nationkey",), "customer": ("c_custkey",), "conversations": ("conv_id", "turn")}
query("table_metadata", "SELECT * FROM (VALUES ('nation', 'n_nationkey', 0, 'int', true, true), ('nation', 'n_name', 1, 'string', true, false), ('nation', 'n_regionkey', 2, 'int', true, false)) v(\"table\", \"column\", position, type, nullable, is_key)")(
    lambda t: tables.metadata(t.spark, {"nation": (t.nation, DEFINED["nation"])})
)


@query("schema_drift", "SELECT c_custkey AS handle, 'customer' AS \"table\" FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'conversations' FROM customer WHERE c_custkey % 3 = 1")
def _(t):
    """Shapes of three tables, of which one gets another type, one another key, one nothing."""
    before = {n: (getattr(t, n), k) for n, k in DEFINED.items()}
    after = before | {"customer": (t.customer.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)")), ("c_custkey",)), "conversations": (t.conversations, ("conv_id",)), "new": (t.region, ())}
    changed = tables.drifted(*[tables.fingerprints(tables.metadata(t.spark, d)) for d in (before, after)])
    name = F.element_at(F.array(F.lit("customer"), F.lit("conversations"), F.lit("nation")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return tables.ended(t.customer.select(F.col("c_custkey").alias("handle"), name.alias("table")), changed).select("handle", "table")


# ---------------------------------------------------------------- metrics

#: The test events are sparse: in a day as many keys are hot as in ten seconds of a busy cache.
query("hot_keys_window", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 5")(lambda t: metrics.hot(metrics.per_window(t.events, "ts", "1 day", "user_id"), 5))
query("coalesce_overflow", "SELECT event_type, time_bucket(INTERVAL 3600 SECOND, ts) AS start, greatest(count(*) - 5, 0) AS overflow FROM events GROUP BY 1, 2")(
    lambda t: metrics.per_window(t.events, "ts", "1 hour", "event_type").select("event_type", "start", F.greatest(F.col("n") - 5, F.lit(0)).alias("overflow"))
)
EDGES = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]
query("latency_histogram", "SELECT event_type, " + ", ".join(f"sum(CASE WHEN value <= {e} THEN 1 ELSE 0 END)::BIGINT AS le_{i}" for i, e in enumerate(EDGES)) + ", count(*) AS total FROM events GROUP BY 1")(
    lambda t: metrics.histogram(t.events, "value", EDGES, "event_type")
)
query("metrics_rollup", "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, arg_max(value, event_id) AS last FROM events GROUP BY 1")(
    lambda t: metrics.rollup(t.events, "event_type", "value", "event_id").withColumn("total", F.round("total", 3))
)
query("latency_quantiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")(
    lambda t: metrics.quantiles(t.events, "event_type", "value", {f"p{q}": q / 100 for q in (50, 95, 99)}).select("event_type", *[F.round(f"p{q}", 6).alias(f"p{q}") for q in (50, 95, 99)])
)
query("hit_ratio", "SELECT user_id, round(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM events GROUP BY 1")(lambda t: t.events.groupBy("user_id").agg(F.round(metrics.ratio(F.col("event_type") == "view"), 6).alias("ratio")))
query("set_ops_keys", "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")(
    lambda t: metrics.in_all_but(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), t.orders.where("o_orderstatus = 'F'").select("o_custkey"), but=t.customer.where("c_acctbal < 0").select("c_custkey"))
)

# ---------------------------------------------------------------- key/value commands

COMMANDS = "SELECT event_id AS seq, user_id AS key, CASE event_type WHEN 'error' THEN 'DEL' WHEN 'signup' THEN 'SETNX' ELSE 'SET' END AS cmd, props AS arg FROM events"


def commands(t: Tables) -> DataFrame:
    cmd = F.when(F.col("event_type") == "error", "DEL").when(F.col("event_type") == "signup", "SETNX").otherwise("SET")
    return t.events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), cmd.alias("cmd"), F.col("props").alias("arg"))


KV = f"""
WITH l AS ({COMMANDS}), d AS (SELECT *, sum(CASE WHEN cmd = 'DEL' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS life FROM l),
f AS (SELECT *, coalesce(arg_max(arg, seq) FILTER (cmd = 'SET') OVER w, arg_min(arg, seq) FILTER (cmd = 'SETNX') OVER w) AS "after"
FROM d WINDOW w AS (PARTITION BY key, life ORDER BY seq ROWS UNBOUNDED PRECEDING)) """
query("kv_set_get", KV + 'SELECT seq, key, "after", lag("after") OVER (PARTITION BY key ORDER BY seq) AS before FROM f')(lambda t: kv.fold_sets(commands(t)).select("seq", "key", "after", "before"))
query("kv_dbsize", KV + 'SELECT count(*) AS n FROM (SELECT key, arg_max(coalesce("after", chr(0)), seq) AS v FROM f GROUP BY key) WHERE v <> chr(0)')(
    lambda t: kv.fold_sets(commands(t)).groupBy("key").agg(F.max_by("after", "seq").alias("v")).where("v is not null").agg(F.count("*").alias("n"))
)
query("kv_counters", "SELECT event_id AS seq, sum(CASE WHEN event_type = 'error' THEN -event_id ELSE event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS \"after\" FROM events")(
    lambda t: kv.counters(t.events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "DECRBY").otherwise("INCRBY").alias("cmd"), F.col("event_id").alias("arg"))).select("seq", "after")
)
query("kv_strlen", "SELECT user_id AS key, sum(strlen(props))::BIGINT AS strlen FROM events GROUP BY 1")(lambda t: kv.appended(t.events.select(F.col("user_id").alias("key"), F.col("props").alias("arg"))))
query("kv_ttl", "SELECT key, CASE WHEN e IS NULL OR e <= 5000 THEN -2 ELSE e - 5000 END AS ttl FROM (SELECT user_id AS key, arg_max(CASE WHEN event_type = 'signup' THEN event_id + 9000 WHEN event_id % 40 - 3 > 0 THEN event_id + (event_id % 40 - 3) * 300 ELSE -1 END, event_id) AS e FROM events GROUP BY 1)")(
    lambda t: kv.time_to_live(t.events.select(F.col("event_id").alias("seq"), F.col("event_id").alias("at"), F.col("user_id").alias("key"), F.when(F.col("event_type") == "signup", "PERSIST").otherwise("EXPIRE").alias("cmd"), F.when(F.col("event_id") % 40 - 3 > 0, (F.col("event_id") % 40 - 3) * 300).otherwise(0).alias("arg")), F.lit(5000), 9000)
)
query("kv_rename", "SELECT CASE WHEN n_nationkey < 5 THEN 'new' || n_nationkey ELSE 'n' || n_nationkey END AS key, n_name AS value FROM nation")(
    lambda t: kv.renamed(t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value")), t.nation.where("n_nationkey < 5").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("new"), F.col("n_nationkey").cast("string")).alias("dst")))
)
query("row_numbers", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS number FROM events")(lambda t: numbered(t.events.select("event_id"), "event_id"))

# ---------------------------------------------------------------- sources that stream


@query("cdc_stream", CHANGES + "SELECT lsn, seq AS op_offset, pk, operation, value FROM r")
def _(t):
    """The flagship as a stream: change files in, the shape's log out."""
    from tidewater.operators.numbering import shared_path
    from tidewater.streaming import live

    rows = change_log(t)
    at = shared_path(rows, "cdc")
    rows.write.parquet(f"{at}/in")
    live.write_log(live.changes(t.spark, f"{at}/in", rows.schema), OVER_50, f"{at}/out", f"{at}/state").awaitTermination()
    return live.read_log(t.spark, f"{at}/out").select("lsn", "op_offset", "pk", "operation", "value.value")


@query("pgoutput_decode", """SELECT o_orderkey // 3 AS lsn, 'insert' AS op, o_orderkey::VARCHAR AS pk, CASE WHEN o_orderkey % 1000 < 500 THEN o_orderstatus ELSE o_orderpriority END AS value FROM orders
UNION ALL SELECT o_orderkey // 3, 'truncate', NULL, NULL FROM orders WHERE o_orderkey % 300 = 2""")
def _(t):
    """Frames of inserts into orders, three in a transaction, made from the table, decoded
    again; the table is described anew, with other columns, every 500 orders."""
    from tidewater.sources import pgoutput

    def number(column, width):
        return F.to_binary(F.lpad(F.hex(column), 2 * width, "0"), F.lit("hex"))

    def cell(text):
        return F.concat(F.lit(b"t"), number(F.octet_length(text), 4), F.encode(text, "UTF-8"))

    def told(*columns):
        return b"R\0\0\0\x07public\0orders\0d" + len(columns).to_bytes(2, "big") + b"".join((b"\0" if i else b"\x01") + c.encode() + bytes(9) for i, c in enumerate(columns))

    key = F.col("o_orderkey")
    rows, first = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), key % 1000 < 500
    forms = [told("o_orderkey", "o_orderstatus"), told("o_orderkey", "clerk", "o_orderpriority")]
    short = F.concat(F.lit(b"I\0\0\0\x07N\0\x02"), cell(key.cast("string")), cell(F.col("o_orderstatus")))
    long = F.concat(F.lit(b"I\0\0\0\x07N\0\x03"), cell(key.cast("string")), F.lit(b"n"), cell(F.col("o_orderpriority")))
    begin = rows.where(key % 3 == 0).select((key * 10 + 1).alias("seq"), F.concat(F.lit(b"B"), number(F.floor(key / 3), 8), F.lit(bytes(12))).alias("data"))
    describe = rows.where(key % 500 == 0).select(key * 10, F.when(first, F.lit(forms[0])).otherwise(F.lit(forms[1])))
    put = rows.select(key * 10 + 2, F.when(first, short).otherwise(long))
    gone = rows.where(key % 300 == 2).select(key * 10 + 3, F.lit(b"T\0\0\0\x01\0\0\0\0\x07"))
    frames = begin.union(put).union(describe).union(gone).withColumn("stream", F.lit(0).cast("long"))
    value = F.coalesce(F.col("new.o_orderstatus"), F.col("new.o_orderpriority"))
    return pgoutput.changes(frames).select("lsn", "op", "pk", value.alias("value"))
