"""Tables mirrored as key/value rows, and where tenants live on a ring of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIRTUAL = 128


def as_kv(df: DataFrame, table: str, pk: str) -> DataFrame:
    return df.select(F.concat(F.lit(f"{table}:"), F.col(pk).cast("string")).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def refresh(changes: DataFrame, origin: DataFrame, pk: str) -> DataFrame:
    """What changed keys mean to a mirror: put the origin's row, or remove."""
    last = changes.groupBy("pk").agg(F.max_by("op", "lsn").alias("op"))
    there = origin.select(F.col(pk).alias("pk"), F.lit(True).alias("__there"))
    rows = last.join(there, "pk", "left")
    gone = (F.col("op") == "delete") | F.col("__there").isNull()
    return rows.select("pk", F.when(gone, "remove").otherwise("put").alias("action"))


def stale(mirror: DataFrame, fresh: DataFrame, pk: str) -> DataFrame:
    """Mirrored keys that the origin has no more."""
    return mirror.join(fresh.select(pk), pk, "left_anti")


def point(text: Column) -> Column:
    """A place on the ring: 32 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def ring(nodes: DataFrame, virtual: int = VIRTUAL) -> DataFrame:
    """(node, point): ``virtual`` points of each node."""
    points = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("i"))
    return points.select("node", point(F.concat_ws("#", "node", "i")).alias("point"))


def owners(tenants: DataFrame, ring_points: DataFrame) -> DataFrame:
    """(tenant, node): the first point at or after the tenant's, or the ring's first. The
    ring (a few points for each node of a cluster) is one sorted array on every row's task."""
    points = ring_points.groupBy(F.lit(1).alias("__one")).agg(F.array_sort(F.collect_list(F.struct("point", "node"))).alias("ring"))
    rows = tenants.withColumns({"__at": point(F.col("tenant")), "__one": F.lit(1)}).join(F.broadcast(points), "__one")
    after = F.filter("ring", lambda p: p["point"] >= F.col("__at"))
    return rows.select("tenant", F.coalesce(F.get(after, F.lit(0))["node"], F.get("ring", F.lit(0))["node"]).alias("node"))


def schedule(datasets: DataFrame, order: str, stagger_s: int = 1) -> DataFrame:
    """Reconciliation start of each tenant's datasets, staggered."""
    n = F.row_number().over(Window.partitionBy("tenant").orderBy(order)) - 1
    return datasets.withColumn("start_s", n * stagger_s)
