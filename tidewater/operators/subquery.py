"""Views filtered by membership in another table, and their changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_member(outer: DataFrame, column: str, inner: DataFrame, inner_column: str, name: str = "member") -> DataFrame:
    """``outer`` with whether ``column`` is among the inner values (a null never is)."""
    values = inner.select(F.col(inner_column).alias("__v")).where("__v is not null").distinct().withColumn(name, F.lit(True))
    rows = outer.join(values, outer[column] == values["__v"], "left").drop("__v")
    return rows.withColumn(name, F.coalesce(name, F.lit(False)))


def member_of(outer: DataFrame, column: str, inner: DataFrame, inner_column: str, negated: bool = False, null_aware: bool = False) -> DataFrame:
    """``column [NOT] IN (SELECT inner_column ...)``. Without ``null_aware`` a null is no
    member, so NOT IN keeps it; with it NOT IN follows SQL and drops undecided rows."""
    values = inner.select(F.col(inner_column).alias("__v"))
    same = outer[column] == values["__v"]
    if not negated:
        return outer.join(values, same, "left_semi")
    rows = outer.join(values.where("__v is not null"), outer[column] == F.col("__v"), "left_anti")
    if null_aware:
        # one row of counts decides for all rows
        some = values.agg(F.lit(1).alias("__one"), F.count("*").alias("__n"), F.count("__v").alias("__k"))
        rows = rows.withColumn("__one", F.lit(1)).join(F.broadcast(some), "__one")
        rows = rows.where("__n = 0 or __n = __k and " + f"`{column}` is not null").drop("__one", "__n", "__k")
    return rows


def membership_changes(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """(value, entered) of values whose membership differs: counts of rows by value on
    either side, so one of two rows with a value may go without effect."""
    counts = before.select(F.col(column).alias("value"), F.lit(1).alias("b"), F.lit(0).alias("a"))
    counts = counts.union(after.select(column, F.lit(0), F.lit(1))).groupBy("value").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    return counts.where("value is not null and (b > 0) <> (a > 0)").select("value", (F.col("a") > 0).alias("entered"))


def outer_delta(outer: DataFrame, column: str, flips: DataFrame, rest: Column | None = None, either: bool = False) -> DataFrame:
    """``outer`` rows that enter or leave the view (operation) as memberships flip. With
    ``rest``: the view is membership AND rest, or (``either``) membership OR rest."""
    rows = outer.join(flips, outer[column] == flips["value"]).drop("value")
    if rest is not None:
        fine = F.coalesce(rest, F.lit(False))
        rows = rows.where(~fine if either else fine)
    return rows.withColumn("operation", F.when(F.col("entered"), "insert").otherwise("delete")).drop("entered")


def member_counts(inner: DataFrame, column: str) -> DataFrame:
    """(value, n): how many inner rows have a value; nulls are no members."""
    return inner.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def maintained(counts: DataFrame, changes: DataFrame, matches: Callable[[str], Column], value: Callable[[str], Column]) -> tuple[DataFrame, DataFrame]:
    """Member counts after a batch of changes of the inner table, and the flips (value,
    entered, lsn): values that are members now and were not, or the other way, with the
    batch's last transaction that touched them. ``matches`` and ``value`` give the inner
    condition and the value from an image ("old" or "new"). A change adds one for its new
    image and takes one for its old one, so one of two rows with a value may go without
    effect, and a row whose value changes leaves one and enters another; only what changed
    is read, and counts of values that it touches."""
    sides = [
        changes.where(F.col(side).isNotNull() & F.coalesce(matches(side), F.lit(False))).select(value(side).alias("value"), F.lit(step).cast("long").alias("d"), "lsn")
        for side, step in (("new", 1), ("old", -1))
    ]
    delta = sides[0].union(sides[1]).where("value is not null").groupBy("value").agg(F.sum("d").alias("d"), F.max("lsn").alias("lsn"))
    after = delta.where("d <> 0").join(counts, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    flips = after.where("(n > 0) <> (n + d > 0)").select("value", (F.col("n") + F.col("d") > 0).alias("entered"), "lsn")
    both = counts.union(delta.select("value", "d")).groupBy("value").agg(F.sum("n").alias("n")).where("n > 0")
    return both, flips
