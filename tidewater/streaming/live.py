"""Streams of changes to logs of shapes.

Routing has no state, so the batch functions run on a stream as they are, and the place
of a message, (lsn, op_offset), is that of its change, whichever micro-batch brings it.
Change streams come from any source that Spark reads; exactly-once output is that of the
stream's checkpoint and of sinks that write a micro-batch once: its number is part of the
path, so that a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.operators import log, metrics, routing, subquery
from tidewater.plans.shape import Shape


def changes(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A folder of change files, read as they arrive, ``files_per_batch`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def without_replays(stream: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Changes that a restarted source sends again are dropped while their watermark lasts.
    A change is its place: two changes of one row in a transaction are two."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["lsn", "seq"])


def _each(stream: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, once: bool):
    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_log(stream: DataFrame, shape: Shape, path: str, checkpoint: str, once: bool = True):
    """Append the shape's log to ``path``, a folder for each micro-batch."""

    def put(batch: DataFrame, number: int) -> None:
        rows = log.offsets(routing.route(batch, shape).drop("old_value"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _each(stream, put, checkpoint, once)


def write_logs(stream: DataFrame, index: routing.ShapeIndex, path: str, checkpoint: str, once: bool = True):
    """Append the logs of all shapes of an index to ``path``, with their handles."""

    def put(batch: DataFrame, number: int) -> None:
        rows = log.offsets(routing.route_indexed(batch, index))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _each(stream, put, checkpoint, once)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_flips(stream: DataFrame, counts: DataFrame, path: str, checkpoint: str, matches: Callable[[str], Column], value: Callable[[str], Column], once: bool = True):
    """Keep the members of a subquery while its inner table changes: the flips of each
    micro-batch go to ``path``/flips, the counts after it to ``path``/counts, a folder for
    each. A repeated batch starts from the counts before it again, so it changes nothing."""
    spark = counts.sparkSession
    schema = counts.schema

    def put(batch: DataFrame, number: int) -> None:
        before = counts if number == 0 else spark.read.schema(schema).parquet(f"{path}/counts/batch={number - 1}")
        batch.persist()
        after, flips = subquery.maintained(before, batch, matches, value)
        flips.write.mode("overwrite").parquet(f"{path}/flips/batch={number}")
        after.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        batch.unpersist()

    return _each(stream, put, checkpoint, once)


def last_values(stream: DataFrame) -> DataFrame:
    """(key, op, value): the last command of each key by seq, whatever the order in which
    commands arrive; in update mode, keys that a micro-batch touches. The state is a row
    for each key, kept and merged by Spark's own aggregation."""
    last = F.max_by(F.struct("op", "value"), "seq").alias("m")
    return stream.groupBy("key").agg(last).select("key", "m.op", "m.value")


def hot_keys(stream: DataFrame, ts: str, key: str, width: str = "10 seconds", least: int = 5, delay: str = "1 minute") -> DataFrame:
    """Keys with ``least`` accesses or more in a window, when the window is over; accesses
    that come later than ``delay`` behind the latest one may be left out."""
    return metrics.hot(metrics.per_window(stream.withWatermark(ts, delay), ts, width, key), least)
