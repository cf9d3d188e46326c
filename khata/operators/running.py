"""Running totals that do not put a whole key into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import join_null_safe

CHUNK_ROWS = 4096


def chunk_of(position: Column, rows: int = CHUNK_ROWS) -> Column:
    return F.floor(position / rows)


def running_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column,
    values: Mapping[str, Column],
) -> DataFrame:
    """Add, per value, its sum over the earlier rows of the key.

    ``chunk`` must not decrease along ``order``. Each chunk is summed on its own, the few chunk
    totals of a key are accumulated, and both are added: a key with very many rows is spread over
    as many tasks as it has chunks.
    """
    marked = df.select("*", chunk.alias("_chunk"), *[v.alias(f"_v_{n}") for n, v in values.items()])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    local = marked.select(
        "*", *[F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_l_{n}") for n in values])
    totals = marked.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_o_{n}") for n in values])
    joined = join_null_safe(local, offsets, [*keys, "_chunk"])
    return joined.select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in values])
