"""GSTR-1 sections from sales lines.

Every builder takes ``by``, extra grouping columns such as the filing registration, so that one
job produces the returns of all registrations. All sections hang off one grouped frame
(:func:`invoice_groups`), which callers may persist when they need several of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.common import first_nonzero, money, text, zero_if_null
from ..functions.dates import gst_date, month_bucket, parse_date
from ..functions.ids import document_sign, resolve_pos, state_of_gstin
from ..functions.tax import filing_category, invoice_total, rate_of

B2B_HSN_CATEGORIES = ("B2B", "CDNR")
NIL_CATEGORIES = ("NIL", "EXEMPT", "NIL_EXEMPT")
SECTIONS = ("B2B", "B2CL", "B2CS", "EXP", "CDNR", "CDNUR")
DESCRIPTION_LENGTH = 30
INVOICES_PER_DOCUMENT = 1000


def _round2(name: str) -> Column:
    return money(F.round(zero_if_null(F.col(name)), 2))


def invoice_groups(lines: DataFrame, firm_state: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per (number, GSTIN, resolved category) with totals, rate, place and date."""
    keyed = lines.select(
        *by,
        text(F.col("invoice_no")).alias("invoice_no"),
        text(F.col("party_gstin")).alias("party_gstin"),
        filing_category(F.col("voucher_type"), F.col("party_gstin"), F.col("gstr1_category"))
        .alias("category"),
        "seq",
        F.struct("party_ledger_name", "place_of_supply", "voucher_date", "voucher_type").alias("head"),
        *[_round2(c).alias(c) for c in
          ("taxable_value", "cgst_amount", "sgst_amount", "igst_amount", "total_invoice_value")],
    )
    # numbers come first, as what is sorted by differs in its first bytes then
    grouped = keyed.groupBy("invoice_no", "party_gstin", "category", *by).agg(
        money(F.sum("taxable_value")).alias("taxable"),
        money(F.sum("cgst_amount")).alias("cgst"),
        money(F.sum("sgst_amount")).alias("sgst"),
        money(F.sum("igst_amount")).alias("igst"),
        money(F.sum("total_invoice_value")).alias("printed_total"),
        F.count(F.lit(1)).alias("n_lines"),
        F.min_by("head", "seq").alias("head"),
        F.min("seq").alias("first_seq"),
    )
    amounts = [F.col(c) for c in ("taxable", "cgst", "sgst", "igst")]
    pos = resolve_pos(F.col("head.place_of_supply"), F.col("party_gstin"), firm_state)
    gstin_state = F.nullif(state_of_gstin(F.col("party_gstin")), F.lit(""))
    return grouped.select(
        *by, "invoice_no", "party_gstin", "category", *["taxable", "cgst", "sgst", "igst"],
        money(invoice_total(F.col("printed_total"), *amounts)).alias("total"),
        rate_of(*amounts).alias("rate"),
        F.when(F.col("category") == "B2B", F.coalesce(gstin_state, pos))
        .when(F.col("category") == "CDNR", F.coalesce(gstin_state, F.lit(firm_state)))
        .otherwise(pos).alias("pos"),
        gst_date(F.col("head.voucher_date")).alias("doc_date"),
        F.coalesce(F.col("head.party_ledger_name"), F.lit("")).alias("party_name"),
        F.lower(F.coalesce(F.col("head.voucher_type"), F.lit(""))).alias("voucher_type"),
        "n_lines", "first_seq",
    )


def _amounts(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def b2b_rows(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return groups.filter(F.col("category") == "B2B").select(
        *by,
        F.col("party_gstin").alias("gstin"), F.col("party_name").alias("receiver_name"),
        F.col("invoice_no").alias("invoice_number"), F.col("doc_date").alias("invoice_date"),
        F.col("total").alias("invoice_value"), F.col("pos").alias("place_of_supply"),
        F.lit("N").alias("reverse_charge"), F.lit("Regular").alias("invoice_type"),
        "rate", F.col("taxable").alias("taxable_value"), "cgst", "sgst", "igst",
        money(F.lit(0)).alias("cess"),
    )


def b2cl_rows(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Detail carries IGST only; the rate comes from all taxes."""
    return groups.filter(F.col("category") == "B2CL").select(
        *by, F.col("pos").alias("place_of_supply"), F.col("invoice_no").alias("invoice_number"),
        F.col("doc_date").alias("invoice_date"), F.col("total").alias("invoice_value"),
        "rate", F.col("taxable").alias("taxable_value"), "igst",
        money(F.lit(0)).alias("cgst"), money(F.lit(0)).alias("sgst"),
    )


def b2cs_rows(groups: DataFrame, firm_state: str, by: Sequence[str] = ()) -> DataFrame:
    """Consolidated by supply type, place and rate: invoices first, then buckets."""
    supply = F.when(F.col("pos") != firm_state, "INTER").otherwise("INTRA")
    return (
        groups.filter(F.col("category") == "B2CS")
        .groupBy(*by, supply.alias("sply_tp"), "pos", "rate")
        .agg(*[money(F.sum(c)).alias(c) for c in ("taxable", "igst", "cgst", "sgst")],
             F.count(F.lit(1)).alias("n_invoices"))
    )


def exp_rows(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return groups.filter(F.col("category") == "EXP").select(
        *by, F.when(F.col("igst") == 0, "WOPAY").otherwise("WPAY").alias("exp_typ"),
        F.col("invoice_no").alias("invoice_number"), F.col("doc_date").alias("invoice_date"),
        F.col("total").alias("invoice_value"), "rate",
        F.col("taxable").alias("taxable_value"), "igst",
    )


def note_rows(groups: DataFrame, firm_state: str, by: Sequence[str] = ()) -> DataFrame:
    """CDNR and CDNUR: credit and debit notes of registered and unregistered parties."""
    registered = F.col("category") == "CDNR"
    return groups.filter(F.col("category").isin("CDNR", "CDNUR")).select(
        *by, F.col("category").alias("section"), F.col("party_gstin").alias("gstin"),
        F.col("party_name").alias("receiver_name"),
        F.when(F.col("voucher_type").contains("debit"), "D").otherwise("C").alias("ntty"),
        F.col("invoice_no").alias("note_number"), F.col("doc_date").alias("note_date"),
        F.col("total").alias("note_value"), F.col("pos").alias("place_of_supply"),
        F.when(registered, F.lit(None)).when(F.col("pos") != firm_state, "INTER")
        .otherwise("INTRA").alias("supply_type"),
        "rate", F.col("taxable").alias("taxable_value"), "cgst", "sgst", "igst",
    )


def nil_rows(lines: DataFrame, home_state: str, by: Sequence[str] = ()) -> DataFrame:
    """Two fixed buckets per return, home state and elsewhere, present even when empty."""
    pos = resolve_pos(F.col("place_of_supply"), F.col("party_gstin"), home_state)
    is_nil = F.upper(text(F.col("gstr1_category"))).isin(*NIL_CATEGORIES)
    value = F.when(is_nil, _round2("taxable_value"))
    sums = lines.groupBy(*by).agg(
        money(zero_if_null(F.sum(F.when(pos == home_state, value)))).alias("home"),
        money(zero_if_null(F.sum(F.when(pos != home_state, value)))).alias("away"),
    )
    return sums.select(
        *by,
        F.inline(F.array(
            F.struct(F.lit("INTRB2B").alias("sply_ty"), F.col("home").alias("expt_amt")),
            F.struct(F.lit("INTRB2C").alias("sply_ty"), F.col("away").alias("expt_amt")),
        )),
    ).select("*", money(F.lit(0)).alias("nil_amt"), money(F.lit(0)).alias("ngsup_amt"))


def hsn_summary(lines: DataFrame, by: Sequence[str] = (), split_b2b: bool = False) -> DataFrame:
    """Signed sums per (HSN, rate); ``split_b2b`` separates registered from other supplies."""
    sign = document_sign(F.col("voucher_type"))
    taxable, cgst, sgst, igst = (
        _round2(c) for c in ("taxable_value", "cgst_amount", "sgst_amount", "igst_amount")
    )
    magnitudes = [F.abs(c) for c in (taxable, cgst, sgst, igst)]
    total = F.coalesce(first_nonzero(_round2("total_invoice_value")), sum(magnitudes[1:], magnitudes[0]))
    category = filing_category(F.col("voucher_type"), F.col("party_gstin"), F.col("gstr1_category"))
    split = [category.isin(*B2B_HSN_CATEGORIES).alias("is_b2b")] if split_b2b else []
    description = F.substring(F.coalesce(F.col("particulars"), F.lit("")), 1, DESCRIPTION_LENGTH)
    rows = lines.filter(text(F.col("hsn")) != "").select(
        *by, *split, text(F.col("hsn")).alias("hsn_sc"), rate_of(*magnitudes).alias("rt"),
        "seq", description.alias("desc"),
        (sign * zero_if_null(F.col("qty"))).alias("qty"),
        *[(sign * c).alias(n) for c, n in
          zip((taxable, cgst, sgst, igst, total), ("txval", "camt", "samt", "iamt", "val"))],
    )
    keys = [*by, *(["is_b2b"] if split_b2b else []), "hsn_sc", "rt"]
    return rows.groupBy(*keys).agg(
        F.coalesce(F.min_by("desc", F.when(F.col("desc") != "", F.col("seq"))), F.lit("")).alias("desc"),
        F.round(F.sum("qty"), 2).alias("qty"),
        *[money(F.sum(c)).alias(c) for c in ("val", "txval", "iamt", "camt", "samt")],
        F.min("seq").alias("first_seq"),
    ).withColumn("uqc", F.lit("NOS"))


def numbered(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running number of an already aggregated section, in order of first appearance."""
    order = Window.partitionBy(*by).orderBy("first_seq")
    return summary.withColumn("num", F.row_number().over(order).cast("long"))


def docs_issued(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    vtype = F.lower(F.coalesce(F.col("voucher_type"), F.lit("")))
    nature = (
        F.when(vtype.contains("debit"), "Debit Note").when(vtype.contains("credit"), "Credit Note")
        .otherwise("Invoices for outward supply")
    )
    return (
        lines.select(*by, nature.alias("nature_of_document"), text(F.col("invoice_no")).alias("doc_no"))
        .filter(F.col("doc_no") != "")
        .groupBy(*by, "nature_of_document")
        .agg(F.min("doc_no").alias("sr_no_from"), F.max("doc_no").alias("sr_no_to"),
             F.countDistinct("doc_no").alias("total_number"))
        .select("*", F.lit(0).cast("long").alias("cancelled"),
                F.col("total_number").alias("net_issued"))
    )


def doc_summary(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Documents per type; one B2CS bucket counts as one document."""
    category = F.col("category")
    counts = groups.groupBy(*by).agg(
        F.count(F.when(category.isin("B2B", "B2CL", "EXP"), 1)).alias("inv"),
        F.countDistinct(F.when(category == "B2CS", F.struct("pos", "rate"))).alias("buckets"),
        F.count(F.when(category.isin("CDNR", "CDNUR"), 1)).alias("cdn"),
    )
    return counts.select(*by, F.inline(F.array(
        F.struct(F.lit(1).cast("long").alias("doc_num"),
                 F.lit("Invoices for outward supply").alias("doc_typ"),
                 (F.col("inv") + F.col("buckets")).alias("totnum")),
        F.struct(F.lit(2).cast("long").alias("doc_num"), F.lit("Credit Note").alias("doc_typ"),
                 F.col("cdn").alias("totnum")),
    )))


def filing_period(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent month as MMYYYY; of equally frequent months the one seen first."""
    months = (
        lines.select(*by, "seq", month_bucket(parse_date(F.col("voucher_date"))).alias("fp"))
        .filter(F.col("fp").isNotNull())
        .groupBy(*by, "fp").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    )
    return months.groupBy(*by).agg(
        F.min_by(F.struct("fp", "n"), F.struct(-F.col("n"), F.col("first_seq"))).alias("top")
    ).select(*by, F.col("top.fp").alias("fp"), F.col("top.n").alias("n_lines"))


def return_envelope(
    lines: DataFrame, groups: DataFrame, registration: str = "registration"
) -> DataFrame:
    """Totals per registration: net of notes, except ``gt`` which adds every line unsigned."""
    sign = document_sign(F.col("voucher_type"))
    totals = lines.groupBy(registration).agg(
        money(F.sum(zero_if_null(F.col("total_invoice_value")))).alias("gt"),
        *[money(F.sum(sign * zero_if_null(F.col(c)))).alias(n) for c, n in (
            ("taxable_value", "total_taxable"), ("igst_amount", "total_igst"),
            ("cgst_amount", "total_cgst"), ("sgst_amount", "total_sgst"))],
    )
    sections = groups.groupBy(registration).agg(
        F.count(F.lit(1)).alias("total_invoices"),
        *[F.count(F.when(F.col("category") == s, 1)).alias(f"n_{s.lower()}") for s in SECTIONS],
    )
    listed = F.array_compact(
        F.array(*[F.when(F.col(f"n_{s.lower()}") > 0, F.lit(s.lower())) for s in SECTIONS])
    )
    return (
        totals.join(sections, registration).join(filing_period(lines, [registration]), registration, "left")
        .select(
            registration, "fp", "gt", "total_invoices", "total_taxable", "total_igst",
            "total_cgst", "total_sgst",
            money(F.col("total_igst") + F.col("total_cgst") + F.col("total_sgst")).alias("total_tax"),
            listed.alias("sections_with_data"),
        )
    )


def nested_section(
    groups: DataFrame, category: str, key: str, by: Sequence[str] = (),
    per_document: int = INVOICES_PER_DOCUMENT,
) -> DataFrame:
    """Documents nested under their counterparty (``party_gstin``) or place (``pos``).

    A counterparty with more than ``per_document`` documents is written as several parts, so that
    no task ever builds one unbounded array; the parts together hold every document.
    """
    keys = [*by, key]
    rows = groups.filter(F.col("category") == category)
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / per_document).alias("parts"))
    item = F.struct(
        F.col("taxable").alias("txval"), F.col("rate").alias("rt"), F.col("igst").alias("iamt"),
        F.col("cgst").alias("camt"), F.col("sgst").alias("samt"), money(F.lit(0)).alias("csamt"),
    )
    document = F.struct(
        F.col("first_seq").alias("ord"), F.col("invoice_no").alias("inum"),
        F.col("doc_date").alias("idt"), F.col("total").alias("val"), F.col("pos").alias("pos"),
        F.lit("N").alias("rchrg"), F.lit("R").alias("inv_typ"),
        F.array(F.struct(F.lit(1).alias("num"), item.alias("itm_det"))).alias("itms"),
    )
    part = F.pmod(F.xxhash64("invoice_no", "party_gstin"), F.col("parts"))
    return (
        rows.join(sizes, keys)
        .groupBy(*keys, part.alias("part"))
        .agg(F.array_sort(F.collect_list(document)).alias("docs"))
        .select(*keys, "part", F.transform("docs", lambda d: d.dropFields("ord")).alias("inv"))
    )


def nested_json(section: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """One JSON text per nested document part, ready for ``write.text``."""
    label = "ctin" if key == "party_gstin" else key
    return section.select(
        *by, F.to_json(F.struct(F.col(key).alias(label), F.col("inv"))).alias("value")
    )


def flat_sheets(lines: DataFrame, firm_state: str, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The six sheets of the offline utility, all from the same grouped frame."""
    groups = invoice_groups(lines, firm_state, by)
    hsn = hsn_summary(lines, by, split_b2b=True)
    return {
        "b2b": b2b_rows(groups, by),
        "cdnr": note_rows(groups, firm_state, by).filter(F.col("section") == "CDNR"),
        "b2cs": b2cs_rows(groups, firm_state, by),
        "hsn_b2b": hsn.filter("is_b2b"),
        "hsn_b2c": hsn.filter("NOT is_b2b"),
        "docs": docs_issued(lines, by),
    }
