from __future__ import annotations

from pyspark.sql import Column, functions as F


def d(names: str) -> list[Column]:
    """Money columns as doubles, at the edge of a query."""
    return [F.col(n).cast("double").alias(n) for n in names.split()]
