"""Connected components of an edge table, in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): for each node of edges (a, b), the smallest node it is connected with.

    Alternates large-star and small-star steps: each node hands its larger, then its smaller neighbours to the
    smallest node it knows. That halves paths, so rounds grow with the logarithm of the longest one, and no step
    gathers a node's neighbours: they only meet a minimum, which combines on the map side. Edges that are stars already
    take no step.
    """
    now = edges.where("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "edges")
    while True:
        # Done when all edges lead from a node that has no other one to a centre that has none of its own.
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("x").agg((F.sum("up") + F.max("down")).alias("n")).agg(F.coalesce(F.max("n") > 1, F.lit(False))).first()[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "edges")
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("id"), "component").unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
