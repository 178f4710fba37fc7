"""The log of a shape: offsets, reading on, retention, and folding it into its view."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

INFINITE = (1 << 63) - 1


def offsets(log: DataFrame) -> DataFrame:
    """The log with op_offset: the place of the change inside its transaction. It is the
    change's own seq, so a transaction that two micro-batches bring has no offset twice,
    and a shape's messages keep their order whatever other changes it leaves out."""
    return log.withColumn("op_offset", F.col("seq"))


def encode(lsn: Column, op: Column) -> Column:
    return F.concat_ws("_", lsn.cast("string"), F.when(op == INFINITE, "inf").otherwise(op.cast("string")))


def decode(text: Column) -> Column:
    """(rank, lsn, op): -1 is before and now after all positions; inf the end of an lsn."""
    op = F.split_part(text, F.lit("_"), F.lit(2))
    return F.struct(
        F.when(text == "-1", 0).when(text == "now", 2).otherwise(1).alias("rank"),
        F.when(text.contains("_"), F.split_part(text, F.lit("_"), F.lit(1)).try_cast("long")).alias("lsn"),
        F.when(op == "inf", INFINITE).otherwise(op.try_cast("long")).alias("op"),
    )


def after(log: DataFrame, lsn: int, op: int) -> DataFrame:
    """What comes strictly after an offset."""
    return log.where((F.col("lsn") > lsn) | ((F.col("lsn") == lsn) & (F.col("op_offset") > op)))


def from_beginning(log: DataFrame) -> DataFrame:
    """The snapshot part, each row with whether later changes exist (settled)."""
    later = log.where("lsn > 0").groupBy("handle").agg(F.lit(True).alias("settled"))
    rows = log.where("lsn = 0").join(later, "handle", "left")
    return rows.withColumn("settled", F.coalesce("settled", F.lit(False)))


def retained(log: DataFrame, keep: int, by: str = "handle") -> DataFrame:
    """The last ``keep`` messages of each log, by offset."""
    newest = Window.partitionBy(by).orderBy(F.desc("lsn"), F.desc("op_offset"))
    return log.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= keep).drop("__n")


def must_refetch(readers: DataFrame, kept: DataFrame) -> DataFrame:
    """Readers (handle, lsn, op_offset) whose place was dropped: strictly before the first
    message that is kept, by the whole offset."""
    first = kept.groupBy("handle").agg(F.min(F.struct("lsn", "op_offset")).alias("first"))
    late = F.struct("lsn", "op_offset") < F.col("first")
    return readers.join(first, "handle", "left").withColumn("must_refetch", F.coalesce(late, F.lit(False))).drop("first")


BODY = ("lsn", "op_offset", "operation", "value")


def message_bytes() -> Column:
    """Bytes of a message's JSON body."""
    return F.octet_length(F.to_json(F.struct(*BODY)))


def total_bytes(log: DataFrame, size: Column, by: str = "handle") -> DataFrame:
    return log.groupBy(by).agg(F.sum(size).cast("long").alias("bytes"))


def within_bytes(log: DataFrame, cap: int, size: Column, by: str = "handle", batch: str = "lsn") -> DataFrame:
    """What a log of at most ``cap`` bytes takes: batches come in order and whole; one that
    does not fit is left out, and the next that fits is taken. That is a rule about one
    batch after the other: the sizes (a row for each batch) are sorted by log, and each
    task keeps one running total."""
    sizes = log.groupBy(by, batch).agg(F.sum(size).cast("long").alias("bytes"))
    ordered = sizes.repartition(by).sortWithinPartitions(by, batch).select(by, batch, "bytes")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, 0
        for b in batches:
            fits = []
            for handle, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if handle != now:
                    now, total = handle, 0
                fits.append(total + (n or 0) <= cap)
                total += (n or 0) * fits[-1]
            yield b.filter(pa.array(fits, pa.bool_())).select([0, 1])

    fits = ordered.mapInArrow(take, StructType([ordered.schema[by], ordered.schema[batch]]))
    return log.join(fits, [by, batch], "left_semi")


def materialize(log: DataFrame, *key: str) -> DataFrame:
    """The view that a log gives: the last message of each key, unless it is a delete.
    Partial aggregation, so one key with most messages is no hot spot."""
    last = F.max_by(F.struct("operation", "value"), F.struct("lsn", "op_offset")).alias("m")
    return log.groupBy(*key).agg(last).where("m.operation <> 'delete'").select(*key, "m.value")


def tip(log: DataFrame, by: str = "handle") -> DataFrame:
    return log.groupBy(by).agg(F.max(F.struct("lsn", "op_offset")).alias("t")).select(by, "t.lsn", "t.op_offset")


def messages(log: DataFrame) -> DataFrame:
    """The log as JSON bodies (body) and as server-sent events (event)."""
    body = F.to_json(F.struct(*BODY))
    return log.select("lsn", "op_offset", body.alias("body"), F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("event"))


def visible(xid: Column, xmin: Column, xmax: Column, running: Column) -> Column:
    """Whether a snapshot sees a transaction."""
    return (xid < xmin) | ((xid < xmax) & ~F.coalesce(F.array_contains(running, xid), F.lit(False)))


def decide(changes: DataFrame, xmax: int, seen: Column, by: str) -> DataFrame:
    """Whether a change goes to the log: unless the snapshot has it; from the first
    transaction at or after ``xmax`` on, always."""
    past = F.max(F.col("xid") >= xmax).over(Window.partitionBy(by).orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0))
    return changes.withColumn("logged", past | ~seen)
