"""Event-time views of the pipeline log. Every function also works on a batch frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EVENT_TIME = "timestamp_utc"
DOCUMENT_KEY = ["invoice_no", "party_gstin", "voucher_date"]


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """Watermark on the event time; a stream needs it as TIMESTAMP (sessions run in UTC)."""
    if rows.isStreaming:
        rows = rows.withColumn(EVENT_TIME, F.col(EVENT_TIME).cast("timestamp"))
    return rows.withWatermark(EVENT_TIME, late)


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling counts per event type, severity and flag; events later than ``late`` are let go."""
    return (
        _timed(events, late)
        .groupBy(F.window(EVENT_TIME, every).alias("w"), "event_type", "severity", "flag_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "event_type", "severity", "flag_id", "n"))


def notification_rate(events: DataFrame, span: str = "24 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Flags per tenant over a sliding day."""
    return (
        _timed(events.filter("event_type = 'system_flag'"), late)
        .groupBy(F.window(EVENT_TIME, span, step).alias("w"), "tenant_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "tenant_id", "n"))


def batch_progress(files: DataFrame) -> DataFrame:
    """Running counters per batch, for update mode."""
    def n(state: str):
        return F.count(F.when(F.col("status") == state, 1)).alias(state)

    return files.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("seen"), n("ok"), n("failed"),
        F.sum("total_ms").alias("total_ms"), F.sum("cost_inr").alias("cost_inr"))


def without_replaced(events: DataFrame, replayed: DataFrame) -> DataFrame:
    """Originals of replayed files drop out; ``replayed`` is static and names them by file_id."""
    return events.join(replayed.select("file_id"), "file_id", "left_anti")


def first_sightings(documents: DataFrame, late: str = "1 day") -> DataFrame:
    """One arrival of each document; re-uploads within the watermark drop out of a stream, all of them out of a table."""
    normal = documents.withColumns({c: F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in DOCUMENT_KEY})
    if not documents.isStreaming:
        return normal.dropDuplicates(DOCUMENT_KEY)
    return _timed(normal, late).dropDuplicatesWithinWatermark(DOCUMENT_KEY)
