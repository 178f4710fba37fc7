"""A log of key/value commands (seq, key, cmd, arg), folded by running aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order():
    return Window.partitionBy("key").orderBy("seq")


def so_far():
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def fold_sets(log: DataFrame) -> DataFrame:
    """SET, SETNX and DEL: each command with the key's value after it and before it.
    SETNX writes when no value is left since the last DEL."""
    life = F.sum(F.when(F.col("cmd") == "DEL", 1).otherwise(0)).over(so_far())
    rows = log.withColumn("life", life)
    inside = Window.partitionBy("key", "life").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last_set = F.max(F.when(F.col("cmd") == "SET", F.col("seq"))).over(inside)
    first_nx = F.min(F.when(F.col("cmd") == "SETNX", F.col("seq"))).over(inside)
    set_value = F.max_by("arg", F.when(F.col("cmd") == "SET", F.col("seq"))).over(inside)
    nx_value = F.min_by("arg", F.when(F.col("cmd") == "SETNX", F.col("seq"))).over(inside)
    rows = rows.withColumn("after", F.when(last_set.isNotNull(), set_value).when(first_nx.isNotNull(), nx_value))
    return rows.withColumn("before", F.lag("after").over(in_order())).drop("life")


def counters(log: DataFrame) -> DataFrame:
    """INCRBY and DECRBY: the counter after each command."""
    step = F.when(F.col("cmd").startswith("DECR"), -F.col("arg")).otherwise(F.col("arg"))
    return log.withColumn("after", F.sum(step).over(so_far()))


def appended(log: DataFrame) -> DataFrame:
    """APPEND: the bytes of each value, and their number after all commands."""
    return log.groupBy("key").agg(F.sum(F.octet_length("arg")).alias("strlen"))


def time_to_live(log: DataFrame, now: Column, longest: int) -> DataFrame:
    """EXPIRE (arg seconds; none or less deletes) and PERSIST (sets the longest time):
    the state after the last command of each key."""
    end = F.when(F.col("cmd") == "PERSIST", F.col("at") + longest).when(F.col("arg") > 0, F.col("at") + F.col("arg"))
    last = log.withColumn("end", end).groupBy("key").agg(F.max_by(F.struct("end"), "seq").alias("x"))
    left = F.when(F.col("x.end").isNull() | (F.col("x.end") <= now), -2).otherwise(F.col("x.end") - now)
    return last.select("key", left.alias("ttl"))


def renamed(state: DataFrame, moves: DataFrame, keep: bool = False) -> DataFrame:
    """RENAME (or, with ``keep``, COPY) of distinct keys: moves (src, dst) of existing keys."""
    moved = state.join(moves, state["key"] == moves["src"]).select(F.col("dst").alias("key"), "value")
    gone = moved.select("key") if keep else moved.select("key").union(moves.join(state, moves["src"] == state["key"], "left_semi").select("src"))
    return state.join(gone, "key", "left_anti").select("key", "value").union(moved)
