"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014), on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b); the component is its smallest node.

    No node's neighbours are gathered: each step joins the edges with one minimum for each node. The rounds grow with the
    logarithm of the longest path. Self-loops are allowed and name a node without partners."""
    edges = written(edges.select("a", "b"), "edges")
    loops = edges.where("a = b").select("a").distinct()
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: every node hands its larger neighbours to its smallest one
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node joins its smaller neighbours, and itself, to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        old, now = now, written(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        discard(old)
        sign = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct()).union(loops.select("a", "a")).groupBy("node").agg(F.min("component").alias("component"))
