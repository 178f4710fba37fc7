"""Counters, histograms and rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.numbering import running


def histogram(df: DataFrame, value: str, edges: list[float], *by: str) -> DataFrame:
    """Cumulative counts for each edge, as a monitoring system reads them."""
    return df.groupBy(*by).agg(*[F.sum(F.when(F.col(value) <= e, 1).otherwise(0)).alias(f"le_{i}") for i, e in enumerate(edges)], F.count("*").alias("total"))


def per_window(df: DataFrame, ts: str, width: str, *by: str) -> DataFrame:
    """Counts by tumbling window, on tables and streams alike."""
    w = F.window(ts, width)
    return df.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def ratio(hit: Column) -> Column:
    return F.sum(F.when(hit, 1).otherwise(0)) / F.count("*")


def counts(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias(name))


def rollup(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """Count, sum and last value of each tag."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max_by(value, order).alias("last"))


def hot(windows: DataFrame, least: int = 5) -> DataFrame:
    """Windows of keys with ``least`` accesses or more."""
    return windows.where(F.col("n") >= least)


def quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, interpolated between neighbours. Equal values are
    counted first, the counts are summed up in order over ranges, and the values at the two
    places are minima; so no task holds a group's values."""
    seen = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("__n"))
    upto = running(seen, [by], [value], F.col("__n"), "__upto")
    totals = upto.groupBy(by).agg(F.max("__upto").alias("__all"))
    spot = {n: (F.col("__all") - 1) * q for n, q in shares.items()}
    at = lambda place: F.min(F.when(F.col("__upto") > place, F.col(value)))
    ends = [c for n, s in spot.items() for c in (at(F.floor(s)).alias(f"__low_{n}"), at(F.ceil(s)).alias(f"__high_{n}"))]
    found = upto.join(totals, by).groupBy(by, "__all").agg(*ends)
    part = {n: F.col(f"__low_{n}") + (s - F.floor(s)) * (F.col(f"__high_{n}") - F.col(f"__low_{n}")) for n, s in spot.items()}
    return found.select(by, *[c.alias(n) for n, c in part.items()])


def in_all_but(first: DataFrame, *others: DataFrame, but: DataFrame) -> DataFrame:
    """Distinct keys that are in all of several tables and not in another one."""
    return reduce(DataFrame.intersect, others, first).subtract(but)
