"""Duplicate invoices within and across batches, and GSTINs inherited by notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.common import first_filled
from ..functions.ids import duplicate_key, original_invoice
from .joins import join_null_safe


def keyed(lines: DataFrame) -> DataFrame:
    """Lines with trimmed, upper-cased number, GSTIN and date; unnumbered lines drop out."""
    return lines.select(
        *[c for c in lines.columns if c not in ("invoice_no", "party_gstin", "voucher_date")],
        *[duplicate_key(F.col(c)).alias(c) for c in ("invoice_no", "party_gstin", "voucher_date")],
    ).filter(F.col("invoice_no") != "")


def both_registers(sales: DataFrame, purchases: DataFrame) -> DataFrame:
    columns = ["seq", "task_id", "batch_id", "invoice_no", "party_gstin", "voucher_date",
               "total_invoice_value"]
    return sales.select(*columns).unionByName(purchases.select(*columns))


def within_batch(lines: DataFrame) -> DataFrame:
    """Groups of lines that share number, GSTIN and date inside one batch."""
    keys = ["batch_id", "invoice_no", "party_gstin", "voucher_date"]
    return (
        keyed(lines).groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("count"), F.countDistinct("task_id").alias("n_tasks"),
             F.min("task_id").alias("first_task"))
        .filter(F.col("count") > 1)
        .select("*", F.lit("within_batch").alias("scope"), F.lit("high").alias("risk"))
    )


def cross_batch(lines: DataFrame, current: DataFrame) -> DataFrame:
    """Documents of the ``current`` batches (a frame of batch_id) that other batches hold too.

    The date is left out on purpose. Both sides are reduced to distinct keys first, so the join
    emits at most one row per key and other batch.
    """
    seen = keyed(lines).groupBy("invoice_no", "party_gstin", "batch_id").agg(
        F.count(F.lit(1)).alias("n_lines"))
    ids = current.select("batch_id").distinct()
    mine = seen.join(ids, "batch_id", "left_semi").groupBy("invoice_no", "party_gstin").agg(
        F.sum("n_lines").alias("n_current"))
    others = seen.join(ids, "batch_id", "left_anti")
    return others.join(mine, ["invoice_no", "party_gstin"]).select(
        "invoice_no", "party_gstin", F.col("batch_id").alias("other_batch_id"),
        (F.col("n_current") + 1).alias("count"),
        F.lit("cross_batch").alias("scope"), F.lit("critical").alias("risk"),
    )


def shared_documents(lines: DataFrame) -> DataFrame:
    """Every document held by more than one batch, as one row with the number of batches."""
    return (
        keyed(lines).groupBy("invoice_no", "party_gstin")
        .agg(F.countDistinct("batch_id").alias("n_batches"), F.min("batch_id").alias("first_batch"),
             F.max("batch_id").alias("last_batch"), F.count(F.lit(1)).alias("n_lines"))
        .filter("n_batches > 1")
    )


def report(within: DataFrame, across: DataFrame) -> DataFrame:
    both = within.select("risk").unionByName(across.select("risk"))
    return both.agg(
        F.count(F.lit(1)).alias("total_duplicates"),
        F.count(F.when(F.col("risk") == "critical", 1)).alias("critical_count"),
        F.count(F.when(F.col("risk") == "high", 1)).alias("high_count"),
    ).withColumn("has_duplicates", F.col("total_duplicates") > 0)


def already_processed(lines: DataFrame) -> DataFrame:
    """Lines whose (number, GSTIN, date) also belongs to another task of the tenant."""
    keys = ["tenant_id", "invoice_no", "party_gstin", "voucher_date"]
    rows = keyed(lines)
    shared = rows.groupBy(*keys).agg(
        F.min("task_id").alias("first_task"), F.max("task_id").alias("last_task")
    ).filter("first_task <> last_task")
    return join_null_safe(rows, shared.select(*keys, "first_task"), keys)


def inherit_gstin(notes: DataFrame, invoices: DataFrame) -> DataFrame:
    """Notes take the GSTIN of the invoice they correct, within the tenant; NULL otherwise."""
    found = (
        invoices.filter(F.col("party_gstin").isNotNull())
        .groupBy("tenant_id", F.col("invoice_no").alias("original_invoice_no"))
        .agg(F.min_by("party_gstin", "seq").alias("resolved_gstin"))
    )
    numbered = notes.withColumn(
        "original_invoice_no", first_filled(original_invoice(F.col("particulars")))
    )
    return numbered.join(found, ["tenant_id", "original_invoice_no"], "left")
