"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import in_shared_folder


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in ``links`` (a, b: bigint).

    Alternates the large-star and small-star steps of Kiveris et al. (2014), which keep the
    components and turn each into a star at its smallest node in a few rounds. A step takes
    minima (partial ones first) and joins them back, so a node with very many links is split
    by adaptive execution; nothing is gathered per component.
    """
    edges = in_shared_folder(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = in_shared_folder(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = in_shared_folder(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = in_shared_folder(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = in_shared_folder(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
