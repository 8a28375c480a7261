"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges stay in tables: each round is staged in the shared folder, and only two
totals a round come to the driver.  A node's neighbours are never gathered; a
hub is one key of an aggregation (combined before the shuffle) and of a join
that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a long, b long)``; root: its component's least node."""
    now = common.stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v")
        new = common.stage(small.distinct(), "edges")
        # two order-free digests of the edge set tell whether it changed
        state = new.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        common.unstage(now)
        now = new
        if (state.n, state.x) == last:
            break
        last = (state.n, state.x)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
