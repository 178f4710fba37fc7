"""Chat formatting (operator 8, DataFrame functions only).

Chats are logged as cumulative snapshots: many logged conversations are the first
turns of a longer one. Every turn has a hash of its number, role and text; the rolling
hash of a prefix is the exclusive or of its turns' hashes, which Spark computes as a
running aggregate (two hashes of 64 bits are kept). A conversation whose whole hash is
the rolling hash of a proper prefix of another one leaves by an anti-join; of equal
conversations the one with the smallest id stays. What is left is rendered.

All of this works on (conversation, turn, hashes); texts are hashed where they are read
and meet the decisions at the end, in one join (by broadcast if those are few). A part's
number is its turn's, counted before the join; only where a turn has several rows are
their texts compared. Long conversations are worked on in blocks of ``BLOCK`` turn
numbers (hashes of blocks, then of turns inside a block), and a rendered conversation is
a row for each turn, in order of ``part``; so no task holds a whole conversation.
``documents`` joins the parts, up to ``BLOCK`` of them to a row.

Text cannot forge a turn: in texts and roles a backslash goes between the "<" and "|" (in
roles also "|" and ">") of a control string, and one more where there are some already,
so that ``unescaped`` gives back what was there.

Defined results: a null role or text is empty, a null turn counts as -1, rows with a
null conv_id belong to one conversation; rows that repeat conversation, turn, role and
text count once; several texts of one turn are one step of the rolling hash and are
rendered in order of role and text; an empty table gives an empty result; texts are
rendered whole, whatever their length. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import small, stored
from tidewater.operators.numbering import running

BLOCK = 256
#: What a turn is rendered as.
TEMPLATE = "<|%s|>\n%s<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(escaped(role), r"\|(\\*)>", r"|\\$1>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def turns(chats: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls, but for those of conv_id."""
    return chats.select(
        "conv_id",
        F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def steps(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2, n, rows): a row for each turn number, with its hashes, how
    many different rows it has and how many rows."""
    hashes = rows.select(
        "conv_id",
        "turn",
        F.xxhash64("turn", "role", "text").alias("h1"),
        F.xxhash64(F.lit(7), "text", "turn", "role", F.length("text")).alias("h2"),
    )
    once = hashes.groupBy("conv_id", "turn", "h1", "h2").agg(F.count("*").alias("rows"))
    return once.groupBy("conv_id", "turn").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count("*").alias("n"), F.sum("rows").alias("rows"))


def rolling(step: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2, start, n, rows, last): the rolling hash after each turn
    number, the number of the turn's first part, and whether it is the last turn."""
    step = step.withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = step.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.sum("n").alias("parts"), F.max("turn").alias("end"))
    order = Window.partitionBy("conv_id").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("k"),
        F.coalesce(F.bit_xor("b1").over(before), F.lit(0)).alias("p1"),
        F.coalesce(F.bit_xor("b2").over(before), F.lit(0)).alias("p2"),
        F.coalesce(F.sum("parts").over(before), F.lit(0)).alias("first"),
        F.when(F.lead("block").over(order).isNull(), F.col("end")).alias("end"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    step = step.withColumns({"h1": F.bit_xor("h1").over(inside), "h2": F.bit_xor("h2").over(inside), "upto": F.sum("n").over(inside)})
    both = step.join(blocks, step["conv_id"].eqNullSafe(F.col("c")) & (step["block"] == F.col("k")))
    return both.select(
        "conv_id",
        "turn",
        F.col("h1").bitwiseXOR(F.col("p1")).alias("h1"),
        F.col("h2").bitwiseXOR(F.col("p2")).alias("h2"),
        (F.col("first") + F.col("upto") - F.col("n")).alias("start"),
        "n",
        "rows",
        F.coalesce(F.col("turn") == F.col("end"), F.lit(False)).alias("last"),
    )


def maximal(hashes: DataFrame) -> DataFrame:
    """(conv_id, copies) of the conversations that prefix no other one; copies: how
    many equal conversations stand behind it."""
    whole = hashes.where("last").groupBy("h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    prefixes = hashes.where("not last").select("h1", "h2").distinct()
    return whole.join(prefixes, ["h1", "h2"], "left_anti").select("conv_id", "copies")


def render(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(conv_id, part, turn, copies, rendered) of the turns that have a place (c, t,
    start, n, rows, copies)."""
    found = small(places)
    if found is None:
        found = places
    told = rows.join(found, rows["conv_id"].eqNullSafe(found["c"]) & (rows["turn"] == found["t"]))
    out = [F.col("turn"), F.col("copies"), F.format_string(TEMPLATE, escaped_role(F.col("role")), escaped(F.col("text"))).alias("rendered")]
    single = told.where("rows = 1").select("conv_id", F.col("start").alias("part"), *out)
    if not places.where("rows > 1").limit(1).count():
        return single
    # turns of several rows: numbered in order of role and text, wherever most of them are
    several = told.where("rows > 1").dropDuplicates(["conv_id", "turn", "role", "text"])
    several = running(several, ["conv_id", "turn"], ["role", "text"], F.lit(1).cast("long"), "rank")
    return single.unionByName(several.select("conv_id", (F.col("start") + F.col("rank") - 1).alias("part"), *out))


def collapse(chats: DataFrame) -> DataFrame:
    rows = turns(chats)
    hashes = stored(rolling(stored(steps(rows), "steps")), "rolling")
    kept = stored(maximal(hashes), "maximal")
    places = hashes.join(kept.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    return render(rows, stored(places.select("c", F.col("turn").alias("t"), "start", "n", "rows", "copies"), "places"))


def documents(parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, chunk, text): the parts in order, up to ``block`` of them to a row; most
    conversations are one row."""
    inside = F.sort_array(F.collect_list(F.struct("part", "rendered")))
    rows = parts.groupBy("conv_id", F.floor(F.col("part") / block).alias("chunk")).agg(inside.alias("own"))
    return rows.select("conv_id", "chunk", F.array_join(F.transform("own", lambda p: p["rendered"]), "").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), s AS (
  SELECT conv_id, turn, list(role || chr(1) || text ORDER BY role, text) AS step FROM t GROUP BY conv_id, turn
), c AS (
  SELECT conv_id, list({'turn': turn, 'step': step} ORDER BY turn) AS l FROM s GROUP BY conv_id
), e AS (
  SELECT l, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY l
), kept AS (
  SELECT a.conv_id, a.copies FROM e a
  WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.l[1] = a.l[1] AND len(b.l) > len(a.l) AND b.l[1:len(a.l)] = a.l)
)
SELECT t.conv_id, row_number() OVER (PARTITION BY t.conv_id ORDER BY turn, role, text) - 1 AS part, turn, copies,
       '<|' || regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') || '|>' || chr(10)
       || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS rendered
FROM t JOIN kept USING (conv_id)
"""
