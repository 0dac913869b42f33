"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumbre.sources.store import materialize


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component), component the smallest node of it; nodes without an edge to another give no row.

    The table of edges stays as large as at the start, no group of neighbours is collected, and the number of rounds
    grows with the logarithm of the diameter. Nulls, loops and repeated edges are ignored.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = materialize(small)
        if after.exceptAll(e).isEmpty() and after.count() == e.count():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        e = after
