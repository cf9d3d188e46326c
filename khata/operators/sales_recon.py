"""Our sales documents against the client's register, and totals across all sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import money, text, zero_if_null
from ..functions.ids import document_sign
from ..functions.tax import TOL_SALES_RECON, active_tax, dec

AMOUNTS = ("taxable", "igst", "cgst", "sgst", "total")
STATUSES = (
    "PASS", "CLIENT_SHEET_ERROR", "UNRESOLVED_CONFLICT", "MISSING_SOURCE_PDF", "CLIENT_MISSING",
    "UNVERIFIABLE_NO_GSTIN",
)
# Supplier location to the state code of that registration.
LOCATION_STATES = {"MH": "27", "HR": "06"}


def last_per_document(rows: DataFrame) -> DataFrame:
    """One row per document number; a later row replaces an earlier one."""
    rest = [c for c in rows.columns if c != "doc_no"]
    return rows.groupBy("doc_no").agg(F.max_by(F.struct(*rest), "seq").alias("row"))


def known_inversion(location: Column, state: Column, flag: Column) -> Column:
    """The client's interstate flag says the opposite of its own location and state columns."""
    home = F.when(F.lit(False), F.lit(""))
    for name, code in LOCATION_STATES.items():
        home = home.when(location == name, code)
    opposite = F.when(state == home, "Interstate").otherwise("Intrastate")
    given = (text(location) != "") & (text(state) != "") & (text(flag) != "") & home.isNotNull()
    return F.coalesce(given & (flag == opposite), F.lit(False))


def reconcile_documents(ours: DataFrame, client: DataFrame, tolerance=TOL_SALES_RECON) -> DataFrame:
    """Full outer match by number; verdicts in order of precedence, with the five deltas."""
    pairs = (
        last_per_document(ours).withColumnRenamed("row", "os")
        .join(last_per_document(client).withColumnRenamed("row", "cl"), "doc_no", "full_outer")
    )
    delta = {
        a: money(F.round(zero_if_null(F.col(f"os.{a}")) - zero_if_null(F.col(f"cl.{a}")), 2))
        for a in AMOUNTS
    }
    within = F.lit(True)
    for value in delta.values():
        within = within & (F.abs(value) <= dec(tolerance))
    our_tax = active_tax(F.col("os.igst"), F.col("os.cgst"), F.col("os.sgst"))
    their_tax = active_tax(F.col("cl.igst"), F.col("cl.cgst"), F.col("cl.sgst"))
    status = (
        F.when(F.col("os").isNull(), "MISSING_SOURCE_PDF")
        .when(F.col("cl").isNull(), "CLIENT_MISSING")
        .when(text(F.col("os.party_gstin")) == "", "UNVERIFIABLE_NO_GSTIN")
        .when(within, "PASS")
        .when(F.coalesce(our_tax != their_tax, F.lit(False)), "CLIENT_SHEET_ERROR")
        .otherwise("UNRESOLVED_CONFLICT")
    )
    compared = F.col("status").isin("PASS", "CLIENT_SHEET_ERROR", "UNRESOLVED_CONFLICT")
    has = [c for c in ("supplier_location", "state_of_supply", "interstate_or_intrastate")
           if c in client.columns]
    inverted = (
        known_inversion(*[F.col(f"cl.{c}") for c in has]) if len(has) == 3 else F.lit(False)
    )
    out = pairs.select(
        "doc_no",
        F.coalesce(F.col("os.doc_type"), F.col("cl.doc_type"), F.lit("Invoice")).alias("doc_type"),
        status.alias("status"), our_tax.alias("os_tax_type"), their_tax.alias("client_tax_type"),
        inverted.alias("inverted"), *[v.alias(f"d_{a}") for a, v in delta.items()],
        F.col("os.taxable").alias("os_taxable"), F.col("cl.taxable").alias("client_taxable"),
    )
    return out.select(
        "doc_no", "doc_type", "status",
        *[F.when(compared, F.col(f"d_{a}")).alias(f"delta_{a}") for a in AMOUNTS],
        ((F.col("status") == "CLIENT_SHEET_ERROR") & F.col("inverted")).alias("known_inversion"),
        _note().alias("note"), "os_taxable", "client_taxable",
    )


def _note() -> Column:
    sides = F.concat(F.lit("ours "), "os_tax_type", F.lit(", client "), "client_tax_type")
    return (
        F.when(F.col("status") == "PASS", "within tolerance")
        .when(F.col("status") == "MISSING_SOURCE_PDF", "in the client register only")
        .when(F.col("status") == "CLIENT_MISSING", "not in the client register")
        .when(F.col("status") == "UNVERIFIABLE_NO_GSTIN", "buyer GSTIN unresolved")
        .when(F.col("status") == "CLIENT_SHEET_ERROR",
              F.concat(F.lit("tax types contradict: "), sides,
                       F.when(F.col("inverted"), "; flag inverted against location").otherwise("")))
        .otherwise(F.concat(F.lit("amounts differ: taxable "), F.col("d_taxable").cast("string"),
                            F.lit(", total "), F.col("d_total").cast("string")))
    )


def status_histogram(entries: DataFrame) -> DataFrame:
    return entries.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("status") != "PASS", 1)).alias("needs_attention"),
    )


def duplicate_numbers(rows: DataFrame) -> DataFrame:
    """Numbers carried by more than one row of the same side."""
    return (
        rows.filter(text(F.col("doc_no")) != "").groupBy("doc_no")
        .agg(F.count(F.lit(1)).alias("n"), money(F.sum("taxable")).alias("taxable"))
        .filter("n > 1")
    )


def net_taxable(rows: DataFrame, doc_type: str = "doc_type", value: str = "taxable") -> DataFrame:
    sign = document_sign(F.col(doc_type))
    return rows.agg(money(F.round(F.coalesce(F.sum(sign * F.col(value)), F.lit(0)), 2)).alias("net_taxable"))


def totals_check(
    ours: DataFrame, client: DataFrame, filed: DataFrame | None = None, tolerance=TOL_SALES_RECON
) -> DataFrame:
    """Net taxable of two or three sheets, their deltas and the verdict.

    The sheets are tagged, stacked and summed in one aggregation; each arrives as
    (doc_type, taxable).
    """
    sides = {"os": ours, "client": client, **({"gstr1": filed} if filed is not None else {})}
    stacked = None
    for tag, rows in sides.items():
        part = rows.select(
            F.lit(tag).alias("side"),
            (document_sign(F.col("doc_type")) * F.col("taxable")).alias("signed"),
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    out = stacked.agg(*[
        money(F.coalesce(F.sum(F.when(F.col("side") == tag, F.col("signed"))), F.lit(0)))
        .alias(f"{tag}_net_taxable") for tag in sides
    ])
    others = [tag for tag in sides if tag != "os"]
    deltas = {tag: F.col("os_net_taxable") - F.col(f"{tag}_net_taxable") for tag in others}
    ok = F.lit(True)
    for value in deltas.values():
        ok = ok & (F.abs(value) <= dec(tolerance))
    return out.select(
        "*", *[money(v).alias(f"os_vs_{t}") for t, v in deltas.items()], ok.alias("matches")
    )
