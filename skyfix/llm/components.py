"""Connected components by alternating star contractions, each round written to the shared folder.

A round maps every edge to the smallest label that one of its ends can see (large star, then small
star). Minima are combined before their shuffle and joined back with sort-merge joins whose skewed
partitions Spark can split, so a hub with a third of all edges is no hot task. Rounds end when every
component is a star; their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import discard, materialise

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, as rows of one scan."""
    return edges.select(F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    around = _both(edges)
    low = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return around.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges run from the larger end u to the smaller end v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(low.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether every component is a star around its smallest node: no node has two lower ends, or a lower and a higher one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n")).filter("ups > 1 or ups = 1 and n > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every end of an edge (columns u and v)."""
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            break
        spread = materialise(_large_star(edges), "large-star")
        joined = materialise(_small_star(spread).filter("u <> v").distinct(), "small-star")
        discard(spread, edges)
        edges = joined
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
