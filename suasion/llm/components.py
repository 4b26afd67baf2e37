"""Connected components of an edge table by alternating large and small stars.

Each round points every neighbour at its smallest neighbour; rounds end when the edges
no longer change.  Nothing is collected: a node's minimum is a map-side combined
aggregate, and the join back has a written table on one side, so adaptive execution may
split a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suasion.llm.shared import drop_written, written


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    pairs = edges.unionByName(turned) if large else \
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = written(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "star")
    joined = pairs.join(low, F.col("u") == F.col("_u"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where(F.col("u") != F.col("v")).distinct(), low


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) longs → (node, component): the smallest node reachable, for every node on an edge
    that isn't its own component's smallest."""
    edges = written(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _sign(edges)
    while seen[0]:
        large, low = _star(edges, True)
        small, lower = _star(large, False)
        before, edges = edges, written(small, "edges")
        drop_written(before, low, lower)
        now = _sign(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
