import pytest
from pyspark.sql import functions as F

from tidewater.operators import numbering
from tidewater.operators.numbering import latest


@pytest.mark.parametrize("piece", [4, 18])
def test_latest_over_ranges(spark, monkeypatch, piece):
    """What holds is carried over many ranges, into groups (a null one too) that begin late."""
    monkeypatch.setattr(numbering, "PIECE", piece)
    df = spark.range(3_000).select(
        F.col("id").alias("i"),
        (F.col("id") % 2).alias("s"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 700 == 31, F.col("id")).alias("a"),
        F.when(F.col("id") % 11 == 4, F.col("id").cast("string")).alias("b"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.i: (r.a, r.b) for r in latest(df.repartition(7), ["s"], ["i"], {"a": [], "b": ["g"]}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    a, b, want = {}, {}, {}
    for r in df.orderBy("i").collect():
        a[r.s] = r.a if r.a is not None else a.get(r.s)
        b[r.s, r.g] = r.b if r.b is not None else b.get((r.s, r.g))
        want[r.i] = (a[r.s], b[r.s, r.g])
    assert got == want
