"""Three-level invoice reconciliation: lines, summary, GST logic, and the master equation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import flags_array, money, text, zero_if_null
from ..functions.score import evidence_score
from ..functions.tax import TOL_ENGINE, dec, tax_paths, taxable_basis

# Rates that, found in the unit-price column, are a GST percentage.
SLABS = (5.0, 12.0, 18.0, 28.0)
SUMMARY = ("taxable_value", "cgst_amount", "sgst_amount", "igst_amount", "cess_amount", "round_off", "grand_total")
# Which source is authoritative per field, and the rank of the two sources.
AUTHORITY = {
    "taxable_value": "LINE_ITEM_CALCULATION", "cgst_amount": "INVOICE_TAX_SUMMARY",
    "sgst_amount": "INVOICE_TAX_SUMMARY", "igst_amount": "INVOICE_TAX_SUMMARY",
    "grand_total": "LINE_ITEM_CALCULATION",
}
RANKS = {"LINE_ITEM_CALCULATION": 100.0, "INVOICE_TAX_SUMMARY": 95.0}


def _n(name: str) -> Column:
    return zero_if_null(F.col(name))


def line_flags(lines: DataFrame) -> DataFrame:
    """Each line with its two checks: quantity times price, and taxable plus taxes."""
    priced = (
        F.col("qty").isNotNull() & F.col("rate").isNotNull() & (F.col("qty") > 0) & (F.col("rate") > 0)
        & ~F.col("rate").isin(*SLABS)
    )
    expected = F.greatest(F.lit(0.0), F.col("qty") * F.col("rate") - _n("discount").cast("double"))
    price_ok = ~priced | (F.abs(expected - _n("taxable_value").cast("double")) <= TOL_ENGINE)
    built = _n("taxable_value") + _n("cgst_amount") + _n("sgst_amount") + _n("igst_amount")
    total_ok = F.abs(built - _n("total_invoice_value")) <= TOL_ENGINE
    return lines.withColumns({
        "price_ok": F.coalesce(price_ok, F.lit(True)), "total_ok": total_ok,
    }).withColumn("line_ok", F.col("price_ok") & F.col("total_ok"))


def reconcile(lines: DataFrame, summary: DataFrame, key: str = "task_id") -> DataFrame:
    """One row per invoice with all level outcomes, status and confidences.

    ``summary`` has the printed amounts plus supplier_gstin and buyer_gstin. Everything the levels
    need from the lines comes out of one aggregation.
    """
    taxes = _n("cgst_amount") + _n("sgst_amount") + _n("igst_amount")
    if "cess_amount" in lines.columns:
        taxes = taxes + _n("cess_amount")
    evidence = line_flags(lines).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.bool_and("line_ok").alias("lines_ok"),
        F.count(F.when(~F.col("line_ok"), 1)).alias("bad_lines"),
        money(F.sum(_n("taxable_value"))).alias("sum_taxable"),
        money(F.sum(taxes)).alias("sum_taxes"),
        money(F.sum(_n("discount"))).alias("sum_discount"),
        money(F.sum(_n("advances"))).alias("sum_advances"),
    )
    printed = summary.select(
        key, *[money(_n(c)).alias(c) for c in SUMMARY],
        text(F.col("supplier_gstin")).alias("supplier_gstin"), text(F.col("buyer_gstin")).alias("buyer_gstin"),
    )
    inv = printed.join(evidence, key, "left").withColumns({
        "n_lines": _n("n_lines"), "lines_ok": F.coalesce("lines_ok", F.lit(True)), "bad_lines": _n("bad_lines"),
        **{c: money(_n(c)) for c in ("sum_taxable", "sum_taxes", "sum_discount", "sum_advances")},
    })
    calculated = sum((F.col(c) for c in SUMMARY[1:6]), F.col("taxable_value"))
    master = F.col("sum_taxable") + F.col("sum_taxes") - F.col("sum_discount") - F.col("sum_advances")
    s_state, b_state = F.substring("supplier_gstin", 1, 2), F.substring("buyer_gstin", 1, 2)
    both = (F.length(s_state) == 2) & (F.length(b_state) == 2)
    sides, igst = (F.col("cgst_amount") > 0) | (F.col("sgst_amount") > 0), F.col("igst_amount") > 0
    across = both & (s_state != b_state)
    gst_errors = flags_array(
        (sides & igst, F.lit("both CGST/SGST and IGST")),
        (across & sides, F.lit("interstate with CGST/SGST")),
        (both & ~across & igst, F.lit("intrastate with IGST")),
    )
    staged = inv.withColumns({
        "calculated_total": money(calculated), "master_total": money(master),
        "variance_taxable": money(F.abs(F.col("taxable_value") - F.col("sum_taxable"))),
        "taxable_basis": taxable_basis(F.col("taxable_value"), F.col("sum_taxable"), F.col("sum_discount")),
        "gst_errors": gst_errors,
    }).withColumn("variance_total", money(F.abs(F.col("calculated_total") - F.col("grand_total"))))
    levels = staged.withColumns({
        "taxable_ok": (F.col("variance_taxable") <= TOL_ENGINE) | (F.col("taxable_basis") != "UNKNOWN"),
        "totals_ok": F.col("variance_total") <= TOL_ENGINE,
        "gst_ok": F.size("gst_errors") == 0,
        "master_ok": F.abs(F.col("master_total") - F.col("grand_total")) <= TOL_ENGINE,
    })
    anchored = (F.col("taxable_ok") & F.col("totals_ok")) | F.col("master_ok")
    failed = (
        F.when(F.col("taxable_ok"), 0).otherwise(1) + F.when(F.col("totals_ok"), 0).otherwise(1)
        + F.when(F.col("gst_ok"), 0).otherwise(3)
    )
    path = tax_paths(*[F.col(c) for c in
                       ("taxable_value", "cgst_amount", "sgst_amount", "igst_amount", "grand_total")])
    return levels.withColumns({
        "status": F.when(~anchored, "BLOCKED")
        .when(~(F.col("lines_ok") & F.col("gst_ok")), "NEEDS_REVIEW").otherwise("ERP_READY"),
        "overall_confidence": F.round((dec("4.95") - failed * dec("0.49")) * dec("0.2"), 2).cast("double"),
        "tax_path": path,
    })


def canonical_values(report: DataFrame, key: str = "task_id") -> DataFrame:
    """Per field the value to book: line evidence replaces a printed amount it contradicts."""
    calculated = {"taxable_value": F.col("sum_taxable"), "grand_total": F.col("master_total")}
    rows = []
    for field, source in AUTHORITY.items():
        printed = F.col(field)
        if field in calculated:
            value = calculated[field]
            corrected = (F.col("n_lines") > 0) & F.col("lines_ok") & (F.abs(printed - value) > TOL_ENGINE)
        else:
            value, corrected = printed, F.lit(False)
        rows.append(F.struct(
            F.lit(field).alias("field"), money(F.when(corrected, value).otherwise(printed)).alias("value"),
            F.lit(source).alias("source"), corrected.alias("corrected")))
    return report.select(key, F.inline(F.array(*rows)))


def evidence_rows(report: DataFrame, key: str = "task_id") -> DataFrame:
    """Taxable value and grand total: printed, calculated, verdict and suggested correction."""
    def row(field: str, calculated: str, ok: str) -> Column:
        passed, value, calc = F.col(ok), F.col(field), F.col(calculated)
        variance = F.abs(value - calc)
        return F.struct(
            F.lit(field).alias("field"), value.alias("extracted"), calc.alias("calculated"),
            money(variance).alias("variance"), passed.alias("verified"),
            F.when(passed, 0.99).otherwise(0.50).alias("confidence"),
            F.lit(RANKS[AUTHORITY[field]]).alias("evidence_rank"),
            evidence_score(F.when(passed, 0.2).otherwise(0.0), F.when(passed, 0.0).otherwise(0.3)).alias("score"),
            F.when(~passed, calc).alias("suggested"),
            F.when(~passed, F.when(variance <= dec("1.5"), "ROUND_OFF").otherwise("COLUMN_SHIFT"))
            .alias("correction_category"),
        )

    rows = F.array(row("taxable_value", "sum_taxable", "taxable_ok"),
                   row("grand_total", "calculated_total", "totals_ok"))
    return report.select(key, F.inline(rows))


def review_items(report: DataFrame, key: str = "task_id") -> DataFrame:
    severity = F.when(F.col("field") == "grand_total", "BLOCKER").otherwise("ERROR")
    return evidence_rows(report, key).filter(~F.col("verified")).select(
        key, "field", "extracted", F.col("calculated").alias("expected"), "variance",
        severity.alias("severity"), F.lit("MATH_ERROR").alias("failure_category"))
