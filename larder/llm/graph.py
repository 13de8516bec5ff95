"""Connected components of links, by alternating large and small stars.

Each round lets every node hang its neighbours on the least node it knows.  Only
minima are gathered per node, so a node with a third of all links costs one
number; rounds go to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v): the least neighbour or itself of each u becomes the partner of its greater (large) or lesser neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.join(least, "u")
    if large:
        return moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its least node."""
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    state = checkpointed(links)
    before = None
    while True:
        # a forest of stars has each greater node once, and no partner that is a greater node itself
        seen = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == before or not seen[0]:
            break
        before = tuple(seen)
        state = _star(state, large=True).filter("u > v").distinct()
        state = checkpointed(_star(state, large=False).filter("u > v").distinct())
    nodes = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
