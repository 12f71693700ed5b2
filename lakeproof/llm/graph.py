"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeproof.llm.tables import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``v, component`` (the smallest id reachable) for every end of an edge, by alternating large and small stars.

    Each step aggregates a minimum per vertex, in parts before the shuffle, and joins it back: there the edges of a hub, three columns wide, meet
    in one partition, which adaptive execution splits. The number of steps grows with the logarithm of the largest component.
    """
    stars = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    state = None
    while True:
        print_of = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_of == state:
            return stars.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(stars.select(F.col("v"), F.col("v").alias("component")).distinct())
        state = print_of
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        stars = cut(small.where("u > v").distinct(), "stars")
