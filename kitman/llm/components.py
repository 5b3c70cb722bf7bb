"""Connected components of an edge table by alternating star contraction.

Each round is two groupings with map-side minimum and two joins; the edge count
never grows, and a node with very many neighbours only ever sends its minimum.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _star(pairs: DataFrame) -> DataFrame:
    """pairs(u, v): for every u, m = min(u, its v); emits (v, m) and (u, m), m smaller."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionAll(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs → (node, root): root is the smallest node reachable.
    Nodes that no edge names are absent; self loops, repeats and nulls are dropped."""
    cur = save(edges.where("u is not null and v is not null and u != v")
               .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        # large star: link larger neighbours to the least neighbour
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u > v").distinct())
        # small star: link smaller neighbours and the node itself to the least one
        nxt = save(_star(large), "edges")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return nxt.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                nxt.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state, cur = tuple(now), nxt
