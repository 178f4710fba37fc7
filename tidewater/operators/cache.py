"""Rules of a result cache over tables: lifetime, size, and what a change invalidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def live(entries: DataFrame, now) -> DataFrame:
    return entries.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))


def remaining(expires_at: Column, exists: Column, now: Column) -> Column:
    """Seconds to live; -1 without an end, -2 when missing or past."""
    return F.when(~exists, -2).when(expires_at.isNull(), -1).when(expires_at <= now, -2).otherwise(expires_at - now)


def blocks(size: Column) -> Column:
    return F.ceil(size / BLOCK) * BLOCK


def kept_within(entries: DataFrame, cap: int, by: str, order: list, size: str = "bytes", exempt: Column | None = None) -> DataFrame:
    """The entries of each tenant that stay when the oldest by ``order`` leave until the
    sizes are within ``cap``; ``exempt`` ones stay and do not count."""
    mine = F.coalesce(exempt, F.lit(False)) if exempt is not None else F.lit(False)
    running = F.sum(F.when(mine, 0).otherwise(F.col(size))).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return entries.withColumn("__sum", running).where((F.col("__sum") <= cap) | mine).drop("__sum")


def reverse_index(entries: DataFrame, items: str, pk: str) -> DataFrame:
    """(table, pk, key, is_list) from entries (table, key, is_list, items: array of structs)."""
    return entries.select("table", "key", "is_list", F.explode(items).alias("i")).select("table", F.col(f"i.{pk}").alias("pk"), "key", "is_list")


def index_rows(rows: DataFrame, table: str, pk: str, key: Column, is_list: bool = True) -> DataFrame:
    """The same from rows that are cached one by one or as lists by ``key``: no list is
    gathered, so nothing is shuffled."""
    return rows.select(F.lit(table).alias("table"), F.col(pk).alias("pk"), key.alias("key"), F.lit(is_list).alias("is_list"))


def index_size(index: DataFrame) -> DataFrame:
    return index.groupBy("table").agg(F.count("*").alias("pks"), F.countDistinct("key").alias("keys"))


def keys_of_rows(changes: DataFrame, index: DataFrame) -> DataFrame:
    """(table, key) that changed rows invalidate."""
    return changes.join(index, ["table", "pk"]).select("table", "key").distinct()


def keys_of_lists(changes: DataFrame, lists: DataFrame) -> DataFrame:
    """(table, key) of lists of tables with inserts."""
    return lists.join(changes.where("op = 'insert'").select("table").distinct(), "table", "left_semi").select("table", "key").distinct()


def keys_of_table(index: DataFrame, lists: DataFrame, table: str) -> DataFrame:
    """All keys of a table, empty lists too."""
    return index.select("table", "key").union(lists.select("table", "key")).where(F.col("table") == table).distinct()


def action(mode: Column, op: Column) -> Column:
    """What a change asks of the cache, by the table's mode."""
    return (
        F.when(op.isin("truncate", "drop"), "flush_table")
        .when(mode.isNull(), "ignore")
        .when(mode == "replication", "refresh")
        .when(op == "insert", "invalidate_lists")
        .otherwise("invalidate_row")
    )


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Texts of a change as typed columns; <name>_text keeps what does not parse."""
    out = {}
    for name, kind in types.items():
        text = F.col(name)
        value = F.when(text == "t", True).when(text == "f", False) if kind == "boolean" else text.try_cast(kind)
        out[name] = value
        out[f"{name}_text"] = F.when(value.isNull(), text)
    return df.withColumns(out)


def ladder(keys: DataFrame, *levels: DataFrame) -> DataFrame:
    """(key, value, level) from the first level (key, value) that has the key."""
    out, found, level = keys, F.lit(None), F.lit(None)
    for i, table in enumerate(levels):
        out = out.join(table.select("key", F.col("value").alias(f"__v{i}")), "key", "left")
    found = F.coalesce(*[F.col(f"__v{i}") for i in range(len(levels))])
    level = F.coalesce(*[F.when(F.col(f"__v{i}").isNotNull(), i) for i in range(len(levels))])
    return out.select("key", found.alias("value"), level.alias("level"))


def first_within(entries: DataFrame, cap: int, by: str, order: list) -> DataFrame:
    """Entries with whether they still get a place: ``cap`` for each tenant, first come."""
    return entries.withColumn("accepted", F.row_number().over(Window.partitionBy(by).orderBy(*order)) <= cap)


def canonical_key(scope: Column, name: Column, pairs: Column) -> Column:
    """The key of a query: its pairs sorted, duplicates kept, hashed to 128 bits."""
    joined = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")
    return F.concat_ws(":", scope, name, F.substring(F.sha2(joined, 256), 1, 32))
