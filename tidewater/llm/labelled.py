"""Labelled rows for training: a bounded sample, and the split that is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most; which ones, a hash of the id tells.
MAX_LABELS = 200_000


def held_out(id_col: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(labels: DataFrame, label_col: str, limit: int = MAX_LABELS, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of labelled rows that are not held out, ``limit`` at most; of rows
    that repeat an id the largest label counts; null ids and labels are left out."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(limit)


def labelled(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, label) of the documents in ``chosen``, whose size is bounded."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "id")
