"""What the operators of this subpackage share: tables, stored steps, text as arrays.

Every operator reads only the columns that it names, so further columns of an
input, whatever their names, pass it by.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.numbering import shared_dir

#: Bytes of text that a task turns into arrays at a time.
CHUNK_BYTES = 1 << 20
#: A table of keys is broadcast up to so many bytes of its rows.
BROADCAST_BYTES = 32 << 20
#: A group with more than one row in so many is large.
HOT_SHARE = 1_000
#: Rows that go to a Python worker at a time; Spark's default of 10,000 long texts is
#: held several times over, in the JVM and in the worker.
BATCH_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts(df: DataFrame) -> DataFrame:
    """``df``, whose texts Python workers will read: in batches of BATCH_ROWS at most."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS, "10000")) <= BATCH_ROWS:
        conf.set(_ROWS, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: what follows needs no
    recomputation when an executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(keys: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame | None:
    """``keys``, a stored table: marked for broadcast if its rows have at most ``limit``
    bytes, as it is if they have more, None if there are none."""
    texts_of = [f.name for f in keys.schema if f.dataType.typeName() in ("string", "binary")]
    width = reduce(lambda a, c: a + F.coalesce(F.octet_length(c), F.lit(0)), texts_of, F.lit(8 * (1 + len(keys.columns))))
    size = keys.agg(F.sum(width)).first()[0]
    return None if size is None else F.broadcast(keys) if size <= limit else keys


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with their groups (stored, a row for each ``key``, ``size`` rows of
    ``total`` in each). Groups with more than one row in HOT_SHARE, fewer than HOT_SHARE
    whatever the input, are broadcast, so no task gets all rows of a large group."""
    large = F.col(size) * HOT_SHARE > total
    hot = F.broadcast(groups.where(large))
    if not hot.limit(1).count():
        return rows.join(groups, key, how)
    rest = rows.join(hot.select(key), key, "left_anti").join(groups.where(~large), key, how)
    return rows.join(hot, key).unionByName(rest)


def without(docs: DataFrame, keys: dict[str, Column], gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those whose keys are in ``gone``; of rows whose keys are in
    ``repeated``, one. ``keys`` names the columns of both tables (stored, distinct, apart)
    and gives their values from ``docs``. Texts pass no exchange while a table can be
    broadcast; a larger one is joined by a shuffle."""
    named = {f"__{name}": value for name, value in keys.items()}
    rows = docs.withColumns(named)

    def match(table: DataFrame):
        return reduce(lambda a, b: a & b, [rows[f"__{name}"].eqNullSafe(table[name]) for name in keys])

    gone, repeated = small(gone), small(repeated)
    out = rows if gone is None else rows.join(gone, match(gone), "left_anti")
    if repeated is not None:
        once = out.join(repeated, match(repeated), "left_semi").dropDuplicates(list(named))
        out = out.join(repeated, match(repeated), "left_anti").union(once)
    return out.select(*docs.columns)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 places where its values start; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows with about ``limit`` bytes of text; one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = end


#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that part words: for ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[48:58] = False
NOT_ALNUM[97:123] = False

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_power = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        grown = np.full(max(n, 64), _STEP, np.uint64)
        grown[0] = 1
        _power = np.multiply.accumulate(grown)
    return _power


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of lower-cased ``data``, where words of each value
    start in them, and the byte at which each word starts. ``sep``: the bytes between words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    word = ~sep[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] = word[edges]
    first = np.flatnonzero(start)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), first
    at = np.arange(len(data))
    inside = at - np.maximum.accumulate(np.where(start, at, 0))
    inside[: first[0]] = 0
    inside[~word] = 0
    value = _BYTE[data] * _powers(int(inside.max()) + 1)[inside]
    value[~word] = 0
    return mix(np.add.reduceat(value, first)), np.searchsorted(first, offsets), first


def lowered(data: np.ndarray) -> np.ndarray:
    return LOWER[data]
