"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indemna.llm.common import join_in_parts, settle


def _state(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): each node that has an edge, with the smallest node reachable from it.

    Large-star links every larger neighbour of a node to the node's smallest neighbour; small-star
    links every smaller one, and the node itself. Both are an aggregate with partial sums and an
    equi join in which the edges of a node with very many neighbours are dealt to several parts.
    Rounds go on until nothing changes, about the logarithm of the longest chain. Loops and nulls in the
    edges are ignored, repeated edges count once; no edges give no rows.
    """
    pair = edges.select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo"), (F.col(u) == F.col(v)).alias("same"))
    stars = settle(pair.where(~F.col("same")).select("hi", "lo").distinct())
    state = _state(stars)
    before = None
    while state != before:
        both = stars.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionAll(stars.select("lo", "hi"))
        least = both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).select("x", F.least("x", "m").alias("m"), "n")
        large = join_in_parts(both.where("y > x"), least.drop("n"), ["x"], ["y"], least, 2 * state[0]).select(F.col("y").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        stars, before = settle(small), state
        state = _state(stars)
    roots = stars.select(F.col("lo").alias("node")).distinct()
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
