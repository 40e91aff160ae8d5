"""Connected components of a large graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _least(edges: DataFrame) -> DataFrame:
    """For each u the least of u and its neighbours v (pre-aggregated, so hubs are cheap)."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one edge and no v is another's u: nothing is left to do."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("inward")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("inward")))
    bad = F.count_if((F.col("out") > 1) | ((F.col("out") == 1) & (F.col("inward") == 1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("inward").alias("inward")).agg(bad.alias("n")).first()["n"] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for each node of an edge; component is the least node of its component. Loops and repeated
    edges do no harm; nulls are left out; no edges give no rows. Each step is written to the shared folder."""
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(_least(both).select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        small = large.join(_least(large), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(_least(large).select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        old, now = now, stored(small)
        forget(old)
    # Stable: each node above the least of its component has one edge, to that least node.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
