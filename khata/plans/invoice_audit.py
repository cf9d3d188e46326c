"""Extracted lines to audited invoices: clean, reconcile, validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tax import interstate_decision
from ..operators import cleaning, recon_engine, registers, validation


def clean_lines(lines: DataFrame, doc: str, position: str, tie: list[str] | None = None) -> DataFrame:
    """Subtotals out, discounts applied, HSN filled, taxes rebuilt on the side the document is on."""
    kept = cleaning.remove_subtotals(lines, [doc], position, tie or [])
    fixed = cleaning.quality_control(cleaning.fix_discounts(kept))
    whole, unknown = Window.partitionBy(doc), F.lit(None).cast("string")
    decided = fixed.select(
        "*", *[F.sum(f"{s}_amount").over(whole).alias(f"_{s}") for s in ("cgst", "sgst", "igst")],
        F.max("party_gstin").over(whole).alias("_buyer"),
    ).withColumn("_across", interstate_decision(F.col("_cgst"), F.col("_sgst"), F.col("_igst"), unknown, F.col("_buyer")))
    return cleaning.recompute_taxes(decided, F.col("_across")).select(*lines.columns)


def audit(lines: DataFrame, summary: DataFrame, invoices: DataFrame, as_of: Column, key: str = "task_id") -> DataFrame:
    """One row per invoice: engine status and confidence, verdict, and validation outcome."""
    engine = recon_engine.reconcile(lines, summary, key).select(
        key, F.col("status").alias("recon_status"), F.col("overall_confidence").alias("recon_confidence"))
    verdict = validation.document_verdict(lines, summary, key)
    rated = invoices.join(validation.line_rates_ok(lines, key), key, "left")
    scored = validation.scores(rated, validation.standard_rules(as_of), key)
    return engine.join(verdict, key).join(scored, key)


def workbook(lines: DataFrame) -> dict[str, DataFrame]:
    register = registers.sales_register(lines)
    return {"Sales Register": register, "Tax & TDS Workings": registers.tds_workings(register),
            "Matching Sheet": registers.matching_sheet(register), "Particulars": registers.register_names(lines)}
