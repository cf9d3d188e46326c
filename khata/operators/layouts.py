"""Memory of document layouts: what was accepted for a table of given headers and coordinates is found again by its fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.texts import layout_fingerprint

REMEMBERED = ["vendor", "headers", "coordinates", "semantic_mapping", "accepted_path"]


def remember(layouts: DataFrame) -> DataFrame:
    """The memory: fingerprint and REMEMBERED, the last stored one (by ``seq``) of each fingerprint."""
    keyed = layouts.withColumn("fingerprint", layout_fingerprint(F.col("headers"), F.col("coordinates")))
    return keyed.groupBy("fingerprint").agg(F.max_by(F.struct(*REMEMBERED), "seq").alias("m")).select("fingerprint", "m.*")


def look_up(documents: DataFrame, memory: DataFrame) -> DataFrame:
    """Documents (headers, coordinates) with the vendor, mapping and path of their layout; NULL for one never seen."""
    keyed = documents.withColumn("fingerprint", layout_fingerprint(F.col("headers"), F.col("coordinates")))
    found = memory.select("fingerprint", "vendor", "semantic_mapping", "accepted_path")
    return keyed.join(found, "fingerprint", "left").withColumn("known", F.col("accepted_path").isNotNull())
