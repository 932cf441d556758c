"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegauge.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``links`` (a, b; longs).

    Large-star and small-star steps in turn (Kiveris et al.): each points a node's neighbours at the
    smallest one, until every link points at the smallest node of its component. Minima are summed up
    within tasks, and no node's neighbours are gathered in one place.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(down.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = nodes.select("component").distinct().select(F.col("component").alias("node"), "component")
    return nodes.union(roots)
