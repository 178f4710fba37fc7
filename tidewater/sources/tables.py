"""Tables: what they look like, when that changes, and scans of a database's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def metadata(spark: SparkSession, tables: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """(table, column, position, type, nullable, is_key) of tables given with their keys."""
    rows = [
        (name, f.name, k, f.dataType.simpleString(), f.nullable, f.name in key)
        for name, (df, key) in tables.items()
        for k, f in enumerate(df.schema)
    ]
    return spark.createDataFrame(rows, "table string, column string, position int, type string, nullable boolean, is_key boolean")


def fingerprints(columns: DataFrame) -> DataFrame:
    """(table, fingerprint) of ``metadata``: equal for equal columns, types and keys in
    equal order; whether a column may be null is no part of it."""
    column = F.struct("position", "column", "type", "is_key")
    text = F.to_json(F.sort_array(F.collect_list(column)))  # the columns of one table
    return columns.groupBy("table").agg(F.sha2(text, 256).alias("fingerprint"))


def drifted(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables (table) whose fingerprint is another one; tables that are new or gone are none
    of them (a dropped table's shapes end by its drop)."""
    now = after.select("table", F.col("fingerprint").alias("now"))
    return before.join(now, "table").where("fingerprint <> now").select("table")


def ended(shapes: DataFrame, changed: DataFrame) -> DataFrame:
    """The shapes (handle, table) of changed tables: their logs no longer fit."""
    return shapes.join(changed, "table", "left_semi")


def resolved(tenants: DataFrame, defaults: DataFrame, on: str, columns: dict[str, str]) -> DataFrame:
    """Tenants with each of ``columns`` from themselves or, where it is null, from the named
    column of their ``defaults`` row."""
    rows = tenants.join(defaults, on, "left")
    return rows.select(*[c for c in tenants.columns if c not in columns], *[F.coalesce(F.col(own), F.col(other)).alias(own) for own, other in columns.items()])


def over_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, columns: tuple[str, ...] = (), fetch: int = 1_000, **options: str) -> DataFrame:
    """A table read from a database: ``parts`` queries over ranges of the integer ``key``
    (rows outside of low to high go to the first and last one), ``fetch`` rows at a time.
    Filters and columns chosen later reach the database. For one state of the table while
    it changes, read a snapshot of it or write what was read once."""
    rows = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), fetchsize=str(fetch), **options
    )
    df = rows.load()
    return df.select(*columns) if columns else df
