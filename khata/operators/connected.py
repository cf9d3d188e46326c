"""Connected components of an undirected graph, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

MOST_ROUNDS = 64


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); a component is named by its smallest node.

    In each round every node hands its larger neighbours, then its smaller ones, to the smallest node it knows. That keeps
    components together and flattens them; rounds grow with the logarithm of the longest path. No neighbours are gathered.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = None
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least("hi", F.min("lo")).alias("to"))
        up = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("to").alias("lo")).where("hi <> lo").distinct()
        lowest = up.groupBy("hi").agg(F.min("lo").alias("to"))
        joined = up.join(lowest, "hi")
        down = joined.select(F.col("lo").alias("hi"), F.col("to").alias("lo")).unionByName(joined.select("hi", F.col("to").alias("lo")))
        now = cut_lineage(down.where("hi <> lo").distinct())
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    named = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    alone = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return alone.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
