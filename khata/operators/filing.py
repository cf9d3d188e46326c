"""What goes into a filing, and under which registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import money, text, zero_if_null
from ..functions.dates import in_period
from ..functions.ids import document_sign, routing_prefix
from ..functions.tax import filing_category
from . import gstr1

EXCLUDED = ("MISSING_SOURCE_PDF", "UNVERIFIABLE_NO_GSTIN")
FLAGGED = ("UNRESOLVED_CONFLICT",)
UNKNOWN_REGISTRATION = "UNKNOWN_REGISTRATION"
HELD_BACK = ("BLOCKED", "DUPLICATE")


def export_gate(tasks: DataFrame) -> DataFrame:
    """Tasks fit for export: status unknown, or neither blocked nor duplicate."""
    status = F.col("recon_status")
    return tasks.filter(status.isNull() | ~status.isin(*HELD_BACK))


def period_lines(lines: DataFrame, period: str, date: str = "voucher_date") -> DataFrame:
    return lines.filter(in_period(F.col(date), period))


def with_recon_status(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Each line with its document's reconciliation status and filing outcome."""
    statuses = entries.select(F.col("doc_no").alias("_doc"), F.col("status").alias("doc_status"))
    joined = lines.join(statuses, text(F.col("invoice_no")) == F.col("_doc"), "left").drop("_doc")
    outcome = (
        F.when(F.col("doc_status").isin(*EXCLUDED), "skipped")
        .when(F.col("doc_status").isin(*FLAGGED), "flagged").otherwise("included")
    )
    return joined.withColumn("filing_outcome", outcome)


def gate(lines: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines to file, flagged document numbers, skipped documents)."""
    marked = with_recon_status(lines, entries)
    filed = marked.filter("filing_outcome <> 'skipped'")
    doc_no = text(F.col("invoice_no")).alias("doc_no")
    flagged = marked.filter("filing_outcome = 'flagged'").select(doc_no).distinct()
    skipped = (
        marked.filter("filing_outcome = 'skipped'").select(doc_no, F.col("doc_status").alias("status"))
        .distinct()
    )
    return filed, flagged, skipped


def registration_of(number: Column, particulars: Column, registrations: dict[str, str]) -> Column:
    """Filing GSTIN by number prefix; an unknown prefix keeps its rows under a name of its own."""
    pairs = [F.lit(x) for item in registrations.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), routing_prefix(number, particulars))
    return F.coalesce(found, F.lit(UNKNOWN_REGISTRATION))


def with_registration(lines: DataFrame, registrations: dict[str, str]) -> DataFrame:
    return lines.withColumn(
        "registration", registration_of(F.col("invoice_no"), F.col("particulars"), registrations)
    )


def filings_summary(lines: DataFrame, entries: DataFrame, registrations: dict[str, str]) -> DataFrame:
    """One row per registration: totals, invoices, sections and flagged documents.

    Lines are added up to invoices, in one shuffle, before these meet their documents' outcomes; nothing is written in between.
    """
    sign = document_sign(F.col("voucher_type"))
    amounts = {n: sign * zero_if_null(F.col(c)) for c, n in (
        ("taxable_value", "taxable"), ("igst_amount", "igst"), ("cgst_amount", "cgst"), ("sgst_amount", "sgst"))}
    category = filing_category(F.col("voucher_type"), F.col("party_gstin"), F.col("gstr1_category"))
    invoices = with_registration(lines, registrations).select(
        "registration", text(F.col("invoice_no")).alias("invoice_no"), text(F.col("party_gstin")).alias("party_gstin"),
        category.alias("category"), *[v.alias(n) for n, v in amounts.items()],
    ).groupBy("registration", "invoice_no", "party_gstin", "category").agg(
        F.count(F.lit(1)).alias("n_lines"), *[F.sum(n).alias(n) for n in amounts])
    filed = with_recon_status(invoices, entries).filter("filing_outcome <> 'skipped'")
    known = F.col("registration") != UNKNOWN_REGISTRATION
    sums = filed.groupBy("registration").agg(
        F.sum("n_lines").alias("n_lines"), F.count(F.lit(1)).alias("invoices"), *[money(F.sum(n)).alias(n) for n in amounts],
        *[F.count(F.when(F.col("category") == s, 1)).alias(f"n_{s}") for s in gstr1.SECTIONS],
        F.countDistinct(F.when(F.col("filing_outcome") == "flagged", F.col("invoice_no"))).alias("flagged_documents"))

    def of_known(value: Column) -> Column:
        return F.when(known, value).otherwise(F.lit(0))

    listed = F.array_compact(F.array(*[F.when(F.col(f"n_{s}") > 0, F.lit(s.lower())) for s in gstr1.SECTIONS]))
    return sums.select(
        "registration", known.alias("has_data"), "n_lines", money(of_known(F.col("taxable"))).alias("total_taxable"),
        money(of_known(F.col("igst") + F.col("cgst") + F.col("sgst"))).alias("total_tax"),
        of_known(F.col("invoices")).alias("total_invoices"),
        F.when(known, listed).otherwise(F.array().cast("array<string>")).alias("sections_with_data"), "flagged_documents")
