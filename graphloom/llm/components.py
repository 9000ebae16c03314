"""Connected components of a links table by alternating stars, with each round written to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """node, label of every node of links (a, b); the label is the smallest node of its component.

    A round sends each node's larger neighbours, then its smaller ones, to the least node that it
    knows; both are a partial minimum and a join. Rounds grow with the logarithm of a component's
    diameter. Links of a node to itself are left out.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = checkpointed(e)
    state = None
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        own = least.select("u", F.col("m").alias("v"))
        e = checkpointed(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        state = now
