"""Connected components of a large graph, by stars that shrink to one centre each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywell.llm.staging import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for each node of the edges ``a``, ``b`` (long).

    In turns every node points its larger, then its smaller neighbours to the smallest node it knows.
    The number of edges never grows, and the number of turns does so only with the logarithm of a
    component. Each turn is written to the shared folder, so the plan stays short and a lost
    executor costs one turn at most.
    """
    links = staged(edges.where("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    centres = links.select(F.col("v").alias("u"), "v").distinct()
    return links.unionByName(centres).select(F.col("u").alias("node"), F.col("v").alias("component"))
