"""Numbers rows in a global order, and inside groups, without gathering them in one task.

These functions write their sorted input to the shared folder when they are called, that
is, while a plan is built: which rows a range holds has to stay the same until all ranges
are counted, whatever is computed again after an executor is lost.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: ``latest`` cuts ranges into pieces of 2 to the power of this rows: a range may be large.
PIECE = 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``. Where it is unset and
    all work runs in this process (tests), a temporary one; on a cluster it has to be set,
    as a folder of one machine's own is seen by no other."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        at = _own[app] if app in _own else _own.setdefault(app, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return at.rstrip("/")


def shared_path(df: DataFrame, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _dealt(df: DataFrame, order: list) -> DataFrame:
    """``df`` dealt out in ranges of ``order``, sorted and stored, with __range and __row."""
    spot = F.monotonically_increasing_id()
    rows = df.orderBy(*order).withColumns({"__range": F.shiftright(spot, 33), "__row": spot.bitwiseAND(F.lit((1 << 33) - 1))})
    path = shared_path(df, "numbered")
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def same(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """All pairs of columns are equal; nulls are equal to each other."""
    return reduce(lambda x, y: x & y, [a[x].eqNullSafe(b[y]) for x, y in pairs])


def running(df: DataFrame, by: list[str], order: list[str], amount: Column, name: str = "running") -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of its group before and including
    each row. A group may hold most rows: it is spread over ranges, summed in each, and
    the ranges' sums (a row for each group and range) say where each range starts."""
    rows = _dealt(df.withColumn("__amount", amount), [*by, *order])
    inside = Window.partitionBy("__range", *by).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("__range", *by).agg(F.sum("__amount").alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__{c}") for c in by], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    out = rows.withColumn("__local", F.sum("__amount").over(inside))
    out = out.join(starts, same(out, starts, [("__range", "__r"), *[(c, f"__{c}") for c in by]]))
    return out.select(*df.columns, (F.col("__start") + F.col("__local")).alias(name))


def latest(df: DataFrame, by: list[str], order: list[str], values: dict[str, list[str]]) -> DataFrame:
    """``df`` in which each column of ``values`` holds its last value that is not null, at
    the row or before it, among the rows of its group: ``by`` and the columns named there.
    A group may hold most rows: it is spread over pieces of ranges, and what holds when a
    piece begins (a row for each group and piece) goes before the piece's own rows."""
    rows = _dealt(df, [*by, *order])
    rows = rows.withColumn("__range", F.shiftleft("__range", 33 - PIECE).bitwiseOR(F.shiftright("__row", PIECE)))
    out = rows
    for name, more in values.items():
        group = [*by, *more]
        ends = rows.where(F.col(name).isNotNull()).groupBy("__range", *group).agg(F.max_by(name, "__row").alias("__end"))
        ends = ends.select(F.col("__range").alias("__r"), *[F.col(c).alias(f"__{c}") for c in group], "__end")
        here = rows.select("__range", *group).distinct()
        here = here.join(ends, same(here, ends, [("__range", "__r"), *[(c, f"__{c}") for c in group]]), "left")
        before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        starts = here.select("__range", *group, F.last("__end", ignorenulls=True).over(before).alias(name), F.lit(-1).cast("long").alias("__row"))
        out = out.unionByName(starts.where(F.col(name).isNotNull()), allowMissingColumns=True)
    for name, more in values.items():
        inside = Window.partitionBy("__range", *by, *more).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(name, F.last(name, ignorenulls=True).over(inside))
    return out.where("__row >= 0").select(*df.columns)


def numbered(df: DataFrame, *order, name: str = "number") -> DataFrame:
    """``df`` with 0, 1, 2, ... in ``order``: rows are dealt out in ranges and sorted
    there; the ranges' sizes (a row for each) give where each one starts."""
    rows = _dealt(df, list(order))
    sizes, starts, at = rows.groupBy("__range").agg(F.max("__row").alias("last")).orderBy("__range").collect(), [], 0
    for r in sizes:  # one for each range
        starts.append((r["__range"], at))
        at += r["last"] + 1
    starts = df.sparkSession.createDataFrame(starts, "__range long, __start long")
    rows = rows.join(F.broadcast(starts), "__range")
    return rows.select(*df.columns, (F.col("__start") + F.col("__row")).alias(name))
