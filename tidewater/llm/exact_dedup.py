"""Exact dedup (operator 6, DataFrame functions only).

A digest index is a Parquet table bucketed and sorted by the digest of the
normalised text. New rows come in batches of falling length, so that the first row of a
text that the index meets is the one that stays: a batch is reduced to one row per
digest, rows whose digest the index holds already leave by a sort-merge anti-join (the
index side is read in bucket order, without an exchange), and the rest is appended.

Rows learn their group's decision by a join on the digest. Groups with more than a
thousandth of all rows, fewer than a thousand whatever the input, are broadcast; so no
task gets the rows of a very large group together.

An append is one Spark write, which shows all of its rows or none. If a run ends between
two batches, the index holds the first ones whole; ingesting the same rows again adds
what is missing and gives the same decisions, as a text's first batch stays its first.

Texts are equal when they are identical after deleting space and the control
characters 9 to 13. Defined results: a null text is empty; of equal texts the one
with the most code points stays, then the smallest id, where a null id comes
last; rows that repeat an id and a text count as rows of the group and share its
decision; an empty table gives an empty result. Columns besides id and text are
not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, BinaryType, DataType, StructField, StructType

from tidewater.llm.common import stored, with_groups, without

#: What is deleted before texts are compared.
BLANKS = " \t\n\x0b\x0c\r"
#: Batches of one ingest, cut at quantiles of the texts' lengths.
BATCHES = 4


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, ""), 256))


def points(text: Column) -> Column:
    return F.char_length(F.coalesce(text, F.lit("")))


class DigestIndex:
    """The persistent index: one row (digest, keep_id, n_points) for each text seen."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 16):
        self.spark, self.name, self.buckets = spark, name, buckets

    def create(self, id_type: DataType) -> None:
        """Make the table, empty, unless it is there."""
        if not self.spark.catalog.tableExists(self.name):
            schema = StructType([StructField("digest", BinaryType()), StructField("keep_id", id_type), StructField("n_points", LongType())])
            self.append(self.spark.createDataFrame([], schema))

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, first: DataFrame) -> None:
        (
            first.repartition(self.buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, rows: DataFrame) -> None:
        """Append what is new in one batch of rows (id, digest, n_points)."""
        order = F.struct((-F.col("n_points")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))
        best = rows.groupBy("digest").agg(F.min(order).alias("first"))
        best = best.select("digest", F.col("first.id").alias("keep_id"), (-F.col("first.n")).alias("n_points"))
        self.append(best.join(self.rows().hint("merge"), "digest", "left_anti"))

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
        """Add what is new in ``docs`` and decide on each of its rows: id, digest,
        keep_id (the row of the index that stands for the text), group_size (rows of
        this ingest with the text), kept (the row is the one that stays) and n_points.
        The result is stored; it does not need the index."""
        self.create(docs.schema[id_col].dataType)
        rows = docs.select(
            F.col(id_col).alias("id"),
            digest(F.col(text_col)).alias("digest"),
            points(F.col(text_col)).cast("long").alias("n_points"),
        )
        rows = stored(rows, "digests")  # the texts are read and hashed once
        shares = F.array(*(F.lit(k / batches) for k in range(1, batches)))
        cuts = rows.agg(F.percentile_approx("n_points", shares, 1_000)).first()[0] if batches > 1 else None
        cuts = sorted(set(cuts or ()), reverse=True)  # a few numbers
        for high, low in zip([None, *cuts], [*cuts, None], strict=True):
            inside = F.lit(True) if high is None else F.col("n_points") <= high
            self.add(rows.where(inside if low is None else inside & (F.col("n_points") > low)))

        groups = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
        stands = self.rows().withColumnRenamed("n_points", "keep_points")
        decided = stored(groups.join(stands.hint("merge"), "digest"), "decided")
        told = with_groups(rows, decided, "digest", "group_size", rows.count())
        return told.select(
            "id",
            "digest",
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))).alias("kept"),
            "n_points",
        )


def new_index(spark: SparkSession, buckets: int = 16) -> DigestIndex:
    """An index under a name of its own in the warehouse."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets)


def index_buckets(spark: SparkSession) -> int:
    """As many buckets as the session has shuffle partitions, 16 at least."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """Decisions on ``docs`` alone, through an index that is dropped afterwards."""
    spark = docs.sparkSession
    index = new_index(spark, index_buckets(spark))
    try:
        return index.ingest(docs, id_col, text_col, batches)
    finally:
        index.drop()


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each text. Rows
    are told apart by id, digest and length: the row that stays may share its id with
    others of its group. Of rows that repeat all three, one stays."""
    told = exact_dedup(docs, id_col, text_col).where("group_size > 1")
    told = told.groupBy("id", "digest", "n_points", "kept").agg(F.count("*").alias("rows"))
    told = stored(told.where("not kept or rows > 1"), "told")
    keys = {"id": F.col(id_col), "digest": digest(F.col(text_col)), "n_points": points(F.col(text_col))}
    return without(docs, keys, told.where("not kept"), told.where("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
