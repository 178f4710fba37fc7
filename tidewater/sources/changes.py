"""Change streams: rows (lsn, seq, pk, op, new, old) with full images on either side.

A transaction is an lsn; seq orders the changes inside it, so (lsn, seq) is the place of
a change whichever batch brings it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_events(events: DataFrame, key: str = "user_id", order: str = "event_id", gone: Column | None = None, per_transaction: int = 1) -> DataFrame:
    """An event table as the change log of a table keyed by ``key``: each event sets the
    row of its key, an event for which ``gone`` holds deletes it; ``per_transaction``
    numbers of ``order`` make a transaction. A delete of a row that does not exist is
    dropped. One shuffle, by the key."""
    gone = F.col("event_type") == "error" if gone is None else gone
    image = F.struct(*[c for c in events.columns if c not in (key, order)])
    lsn, seq = F.floor(F.col(order) / per_transaction).cast("long"), F.pmod(F.col(order), F.lit(per_transaction)).cast("long")
    rows = events.select(lsn.alias("lsn"), seq.alias("seq"), F.col(key).alias("pk"), gone.alias("gone"), image.alias("image"))
    by = Window.partitionBy("pk").orderBy("lsn", "seq")
    rows = rows.withColumns({"was_gone": F.coalesce(F.lag("gone").over(by), F.lit(True)), "was": F.lag("image").over(by)})
    op = F.when(F.col("gone"), "delete").when(F.col("was_gone"), "insert").otherwise("update")
    rows = rows.where(~(F.col("gone") & F.col("was_gone")))
    return rows.select("lsn", "seq", "pk", op.alias("op"), F.when(~F.col("gone"), F.col("image")).alias("new"), F.when(~F.col("was_gone"), F.col("was")).alias("old"))


def boundary(changes: DataFrame) -> DataFrame:
    """The place of the last change and how many there are: where a reader of changes
    alone starts. One row."""
    return changes.agg(F.max(F.struct("lsn", "seq")).alias("m"), F.count("*").alias("n")).select("m.lsn", "m.seq", "n")


def checkpoint(changes: DataFrame, by: str) -> DataFrame:
    """The last transaction of each group."""
    return changes.groupBy(by).agg(F.max("lsn").alias("lsn"))
