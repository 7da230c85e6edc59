"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is a pair of aggregations over the links; links stay in Spark, each round is written to the
shared folder (which cuts the lineage), and a node with very many links is reduced by its partial minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.session import keep


def components(links: DataFrame) -> DataFrame:
    """node and component_id (the smallest node reachable) for every node that has a link (a, b)."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = keep(edges, "component-links")
    state = None
    while True:
        # Large star: every larger neighbour of a node points to the smallest node of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every smaller neighbour, and the node itself, points to the smallest neighbour.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(low.select("u", F.col("m").alias("v")).unionByName(small).distinct(), "component-links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    flat = edges.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "node")
    return flat.unionByName(flat.select(F.col("component_id").alias("node"), "component_id").distinct())
