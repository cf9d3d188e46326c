"""One-to-one assignment in arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .connected import components

MOST_PAIRS = 200_000
"""Pairs of a group that one task goes through in order; larger groups are taken apart."""
ROUNDS = 3
"""How often pairs that nobody comes before are served at once, before a large group is split into components."""


def assign_in_order(pairs: DataFrame, left: str, right: str, within: tuple[str, ...] = ()) -> DataFrame:
    """First come, first served: each left row takes the first right row still free.

    ``left`` and ``right`` are sortable columns that identify the two sides, and their order is
    the order of arrival. ``within`` names columns that both sides of a pair share. Who is served depends on all who came
    before in a group, so each group is gone through in order by one task, as a stream of sorted pairs of which
    only the right rows already taken are held. Where groups may be very large, ``assign_in_parts`` gives the same.
    """
    return _in_order(_grouped(pairs, left, right, within), left, right)


def assign_in_parts(pairs: DataFrame, left: str, right: str, within: tuple[str, ...], most_pairs: int = MOST_PAIRS) -> DataFrame:
    """The assignment of ``assign_in_order``, with no group of more than about ``most_pairs`` pairs in one task.

    Who is served depends only on pairs that are linked through rows they share. In a group of more pairs, those that nobody
    comes before on either side are served first, all at once, and with them go all pairs of their rows: so
    rows with very many pairs lose them. What is left falls into connected components, which are groups of their own; a component is
    larger only where it is one chain of rows that wait for each other. The pairs are read more than once and may repeat.
    """
    shown = _grouped(pairs, left, right, within)
    large = shown.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_pairs).select("_g")
    if not large.collect():  # one number at most for every most_pairs pairs
        return _in_order(shown, left, right)
    large = cut_lineage(large)
    open_pairs, served = cut_lineage(shown.join(large, "_g", "left_semi").distinct()), []
    for _ in range(ROUNDS):
        open_pairs, first = _first_served(open_pairs, left, right)
        served.append(first.select(left, right))
    small = shown.join(large, "_g", "left_anti")
    out = _in_order(small.unionByName(_by_component(open_pairs)), left, right)
    for rows in served:
        out = out.unionByName(rows)
    return out


def _grouped(pairs: DataFrame, left: str, right: str, within: tuple[str, ...]) -> DataFrame:
    """(_g, _l, _r, left, right): the hash of the group, and names of the two rows."""
    # the sides may be structs, which Python can't look up; their JSON can be, and names them over all groups
    names = [F.to_json(F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(within)], c)).alias(f"_{k}") for k, c in (("l", left), ("r", right))]
    # a group only says who is gone through together, so groups whose hashes agree may as well be one
    shared = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in within]) if within else F.lit(0).cast("long")
    return pairs.select(shared.alias("_g"), *names, left, right)


def _first_served(pairs: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """(pairs of rows that are still open, pairs that are the first of both their rows)."""
    of_left = pairs.groupBy("_l").agg(F.min(right).alias("_first_right"))
    of_right = pairs.groupBy("_r").agg(F.min(left).alias("_first_left"))
    first = cut_lineage(
        pairs.join(of_left, "_l").where(F.col(right) == F.col("_first_right"))
        .join(of_right, "_r").where(F.col(left) == F.col("_first_left")).select(*pairs.columns))
    rest = pairs.join(first.select("_l"), "_l", "left_anti").join(first.select("_r"), "_r", "left_anti")
    return cut_lineage(rest.select(*pairs.columns)), first


def _by_component(pairs: DataFrame) -> DataFrame:
    """The pairs with the component of their rows as their group."""
    def node(side: str, name: str) -> Column:
        return F.xxhash64(F.lit(side), F.col(name))  # rows whose hashes agree share a component, which changes nothing

    edges = pairs.select(*pairs.columns, node("left", "_l").alias("a"), node("right", "_r").alias("b"))
    named = components(edges.select("a", "b")).withColumnsRenamed({"node": "a", "component": "_c"})
    return edges.join(named, "a").select(F.col("_c").alias("_g"), *[c for c in pairs.columns if c != "_g"])


def _in_order(shown: DataFrame, left: str, right: str) -> DataFrame:
    schema = shown.select(left, right).schema

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, served, taken = None, None, set()
        for batch in batches:
            keep = []
            for now, left_name, right_name, left_row, right_row in batch.itertuples(index=False, name=None):
                if now != group:
                    group, served, taken = now, None, set()
                if left_name != served and right_name not in taken:
                    served = left_name
                    taken.add(right_name)
                    keep.append((left_row, right_row))
            yield pd.DataFrame(keep, columns=[left, right])

    dealt = shown.select("_g", "_l", "_r", left, right).repartition("_g")
    return dealt.sortWithinPartitions("_g", left, right).mapInPandas(serve, schema)
