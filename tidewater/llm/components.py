"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import stored, with_groups


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of
    its component. Rounds alternate two star steps: every node's larger neighbours,
    then its smaller ones, are linked to its smallest neighbour. Each round is stored;
    minima are taken before rows are shuffled, and nodes with a large share of all edges
    meet them by broadcast, so no task gets the edges of such a node together."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = stored(links, name)
    while True:
        both = links.union(links.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("rows"))
        large = with_groups(both.where("v > u"), stored(least, name), "u", "rows", 2 * links.count())
        large = stored(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")), name)
        small = with_groups(large, low, "u", "rows", large.count()).where("v <> m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        after = stored(small, name)
        # stars are what no step changes: compare the two rounds
        moved = after.exceptAll(links).limit(1).count() or links.exceptAll(after).limit(1).count()
        links = after
        if not moved:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
