"""Pipeline events: batch and file metrics, alerts, quality flags, workspace figures, review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import flags_array, money, zero_if_null
from ..functions.score import priority_score

# Thresholds of the file flags and batch alerts.
LOW_SCORE, HIGH_CORRECTION_RATE, LOW_CONFIDENCE = 0.6, 0.30, 0.6
FILE_COST_LIMIT, FILE_COST_FACTOR = 20, 3
BATCH_COST_LIMIT, BATCH_FAILURE_PCT, BATCH_WALL_MS, BATCH_UNALLOCATED_PCT = 500, 10, 300_000, 20


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): an event without a batch cannot be correlated."""
    ok = F.coalesce(F.col("batch_id"), F.lit("")) != ""
    return events.filter(ok), events.filter(~ok)


def of_tenant(rows: DataFrame, tenant: str | None) -> DataFrame:
    """Rows of one tenant; no tenant means rows without one, never all rows."""
    return rows.filter(F.col("tenant_id").eqNullSafe(F.lit(tenant).cast("string")))


def payload(path: str, kind: str = "string") -> Column:
    value = F.get_json_object("payload_json", f"$.{path}")
    return value if kind == "string" else value.try_cast(kind)


def trace(events: DataFrame, file_id: str) -> DataFrame:
    return events.filter(F.col("file_id") == file_id).orderBy("timestamp_utc")


def _pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(part * 100.0 / F.greatest(whole, F.lit(1)), digits)


def batch_metrics(files: DataFrame) -> DataFrame:
    """Per batch from one row per file (status, total_ms, cost_inr, corrections, …)."""
    n = F.count(F.lit(1))
    ok, failed = (F.count(F.when(F.col("status") == s, 1)) for s in ("ok", "failed"))

    def top(by: str) -> Column:
        return F.min_by("file_id", F.struct(-zero_if_null(F.col(by)), F.col("seq")))

    return files.groupBy("batch_id").agg(
        n.alias("submitted"), ok.alias("completed_ok"), failed.alias("failed"),
        _pct(ok, n).alias("success_rate_pct"), _pct(failed, n).alias("error_rate_pct"),
        F.sum(zero_if_null(F.col("total_ms"))).alias("wall_ms"),
        F.round(F.sum(zero_if_null(F.col("total_ms"))) * 1.0 / n, 1).alias("avg_ms"),
        top("total_ms").alias("slowest_file"), F.max(zero_if_null(F.col("total_ms"))).alias("slowest_ms"),
        top("cost_inr").alias("priciest_file"),
        money(F.sum(zero_if_null(F.col("cost_inr")))).alias("total_cost"),
        F.sum(zero_if_null(F.col("corrections"))).alias("total_corrections"),
        F.count(F.when(F.col("corrections") > 0, 1)).alias("files_corrected"),
        F.count(F.when(F.col("unallocated"), 1)).alias("files_unallocated"),
        F.count(F.when(~F.coalesce("json_ok", F.lit(True)), 1)).alias("json_failures"),
        F.round(F.sum(zero_if_null(F.col("composite_score"))) / n, 3).alias("composite_avg"),
    )


def _flag(flag_id: str, severity: str) -> Column:
    return F.struct(F.lit(flag_id).alias("flag_id"), F.lit(severity).alias("severity"))


def batch_alerts(metrics: DataFrame) -> DataFrame:
    cost = F.round(F.col("total_cost").cast("double") / F.greatest(F.col("submitted"), F.lit(1)), 2) * F.col("submitted")
    unallocated = F.col("files_unallocated") * 100.0 / F.greatest(F.col("submitted"), F.lit(1))
    found = flags_array(
        (cost > BATCH_COST_LIMIT, _flag("HIGH_BATCH_COST", "HIGH")),
        (F.col("error_rate_pct") > BATCH_FAILURE_PCT, _flag("BATCH_FAILURE_RATE", "CRITICAL")),
        (F.col("wall_ms") > BATCH_WALL_MS, _flag("SLOW_BATCH", "MEDIUM")),
        (unallocated > BATCH_UNALLOCATED_PCT, _flag("UNALLOCATED_ROW_SPIKE", "MEDIUM")),
    )
    return metrics.select("batch_id", F.explode(found).alias("a")).select("batch_id", "a.*")


def file_metrics(files: DataFrame) -> DataFrame:
    """Tokens and cost per page, and corrections per raw line."""
    pages = F.greatest(zero_if_null(F.col("page_count")), F.lit(1))
    raw = F.coalesce(F.nullif(F.col("raw_items"), F.lit(0)), F.lit(1))
    return files.withColumns({
        "tokens_per_page": F.round((F.col("prompt_tokens") + F.col("completion_tokens")) / pages, 1),
        "cost_per_page": F.round(F.col("cost_inr").cast("double") / pages, 4),
        "correction_rate": F.round(F.col("corrections") / raw, 3),
    })


def file_flags(files: DataFrame) -> DataFrame:
    """All flag rules per file; the batch average comes from an aggregation joined back."""
    averages = files.groupBy("batch_id").agg(F.avg(F.col("cost_inr").cast("double")).alias("batch_avg_cost"))
    rows = files.join(averages, "batch_id")
    cost = F.col("cost_inr").cast("double")
    rate = F.col("corrections") / F.greatest(zero_if_null(F.col("raw_items")), F.lit(1))
    found = flags_array(
        (F.col("composite_score") < LOW_SCORE, _flag("NUMBER_HALLUCINATION_SUSPECTED", "CRITICAL")),
        (~F.col("math_balanced"), _flag("MATH_IMBALANCE_AFTER_CORRECTION", "CRITICAL")),
        (~F.col("gstin_valid"), _flag("GSTIN_INVALID_FORMAT", "CRITICAL")),
        (~F.col("no_tax_conflict"), _flag("IGST_CGST_CONFLICT", "HIGH")),
        (rate > HIGH_CORRECTION_RATE, _flag("HIGH_CORRECTION_RATE", "HIGH")),
        (F.col("unallocated"), _flag("UNALLOCATED_ROW_INJECTED", "HIGH")),
        ((cost > FILE_COST_LIMIT) | ((F.col("batch_avg_cost") > 0) & (cost > FILE_COST_FACTOR * F.col("batch_avg_cost"))),
         _flag("COST_SPIKE_PER_FILE", "HIGH")),
        (F.col("subtotals_dropped") > 0, _flag("SUBTOTAL_DOUBLE_COUNT_RISK", "MEDIUM")),
        (~F.col("json_ok"), _flag("JSON_PARSE_FAILURE", "HIGH")),
        (F.col("stage_failed").isNotNull(), _flag("PARTIAL_TRACE", "LOW")),
        (F.col("recon_status") == "BLOCKED", _flag("RECONCILIATION_BLOCKED", "CRITICAL")),
        (F.col("recon_confidence") < LOW_CONFIDENCE, _flag("RECONCILIATION_LOW_CONFIDENCE", "HIGH")),
    )
    return rows.select("batch_id", "file_id", F.explode(found).alias("f")).select("batch_id", "file_id", "f.*")


def file_scores(events: DataFrame) -> DataFrame:
    """Latest quality score per file."""
    score = payload("composite_score", "double")
    rows = events.filter((F.col("event_type") == "extraction_quality_score") & F.col("file_id").isNotNull())
    return rows.groupBy("batch_id", "file_id").agg(
        F.max_by(score, "timestamp_utc").alias("composite_score"))


def workspace_stats(events: DataFrame) -> DataFrame:
    """Totals over the event log in one aggregation; an empty workspace scores 1.0."""
    kind = F.col("event_type")
    scores = F.when((kind == "extraction_quality_score") & F.col("file_id").isNotNull(),
                    payload("composite_score", "decimal(10,4)"))
    cost = F.when(kind == "file_metrics", payload("model_cost.total_cost_inr", "decimal(18,4)"))
    return events.agg(
        F.countDistinct("batch_id").alias("total_batches"),
        F.countDistinct("file_id").alias("total_files"),
        F.coalesce(F.round(F.avg(scores).cast("double"), 3), F.lit(1.0)).alias("average_quality_score"),
        F.round(F.coalesce(F.sum(cost), F.lit(0)), 2).cast("double").alias("total_cost_inr"),
        F.count(F.when(kind == "system_flag", 1)).alias("total_flags"),
    )


def batch_overview(events: DataFrame) -> DataFrame:
    """Per batch the average score and the number of flags: one grouped pass, not a query per batch."""
    kind = F.col("event_type")
    score = F.when((kind == "extraction_quality_score") & F.col("file_id").isNotNull(),
                   payload("composite_score", "decimal(10,4)"))
    return events.groupBy("batch_id").agg(
        F.min("timestamp_utc").alias("created_at"),
        F.round(F.avg(score).cast("double"), 3).alias("average_quality_score"),
        F.count(F.when(kind == "system_flag", 1)).alias("flags_count"))


def recent(rows: DataFrame, when: str, n: int, *tie: str) -> DataFrame:
    """The newest ``n`` rows: a top-n report."""
    return rows.orderBy(F.col(when).desc(), *tie).limit(n)


def task_status_counts(tasks: DataFrame) -> DataFrame:
    states = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")
    return tasks.groupBy("batch_id").agg(
        *[F.count(F.when(F.col("status") == s, 1)).alias(s.lower()) for s in states],
        F.count(F.lit(1)).alias("total"))


def review_queue(
    tasks: DataFrame, scores: DataFrame, flags: DataFrame, corrections: DataFrame, duplicates: DataFrame,
    values: DataFrame,
) -> DataFrame:
    """Tasks with every review signal and their priority, most urgent first.

    ``tasks`` has task_id, recon_status, validation_status and seq; the others are keyed by task_id.
    """
    counted = corrections.groupBy("task_id").agg(F.count(F.lit(1)).alias("manual_flag_count"))
    flagged = flags.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_flags"))
    doubled = duplicates.select("task_id").distinct().withColumn("is_duplicate", F.lit(True))
    joined = (
        tasks.join(scores.select("task_id", "composite_score"), "task_id", "left")
        .join(flagged, "task_id", "left").join(counted, "task_id", "left")
        .join(doubled, "task_id", "left").join(values.select("task_id", "total_invoice_value"), "task_id", "left"))
    filled = joined.withColumns({
        "n_flags": zero_if_null(F.col("n_flags")),
        "manual_flag_count": zero_if_null(F.col("manual_flag_count")),
        "is_duplicate": F.coalesce("is_duplicate", F.lit(False)),
        "total_invoice_value": money(zero_if_null(F.col("total_invoice_value")))})
    scored = filled.withColumn("priority_score", priority_score(
        F.col("composite_score"), F.col("recon_status"), F.col("validation_status"), F.col("is_duplicate"),
        F.col("manual_flag_count"), F.col("total_invoice_value")))
    return scored.orderBy(F.col("priority_score").desc(), "seq")
