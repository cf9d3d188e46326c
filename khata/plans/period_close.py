"""Monthly close of sales: match with the client, check totals, file per registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.common import money, text
from ..operators import filing, sales_recon


def documents_of(lines: DataFrame, granularity: str = "document") -> DataFrame:
    """Lines summed per document; ``granularity='line'`` keeps one row per line instead."""
    kind = F.when(F.lower("voucher_type").rlike("credit|debit"), F.col("voucher_type")).otherwise("Invoice")
    rows = lines.select(
        text(F.col("invoice_no")).alias("doc_no"), kind.alias("doc_type"), "party_gstin", "seq",
        *[money(F.col(c)).alias(n) for c, n in (
            ("taxable_value", "taxable"), ("igst_amount", "igst"), ("cgst_amount", "cgst"),
            ("sgst_amount", "sgst"), ("total_invoice_value", "total"))])
    if granularity == "line":
        return rows
    return rows.groupBy("doc_no").agg(
        F.min_by("doc_type", "seq").alias("doc_type"), F.min_by("party_gstin", "seq").alias("party_gstin"),
        *[money(F.sum(c)).alias(c) for c in sales_recon.AMOUNTS], F.min("seq").alias("seq"))


def close_period(
    lines: DataFrame, client: DataFrame, registrations: dict[str, str], period: str | None = None,
    granularity: str = "document",
) -> dict[str, DataFrame]:
    current = filing.period_lines(lines, period) if period else lines
    documents = documents_of(current, granularity)
    entries = sales_recon.reconcile_documents(documents, client)
    filed, flagged, skipped = filing.gate(current, entries)
    totals = sales_recon.totals_check(
        documents, client, filed.select(F.col("voucher_type").alias("doc_type"), F.col("taxable_value").alias("taxable")))
    return {
        "entries": entries, "histogram": sales_recon.status_histogram(entries), "flagged": flagged, "skipped": skipped,
        "os_duplicates": sales_recon.duplicate_numbers(documents),
        "client_duplicates": sales_recon.duplicate_numbers(client), "totals": totals,
        "filings": filing.filings_summary(current, entries, registrations)}
