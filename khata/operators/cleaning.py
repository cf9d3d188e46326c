"""Line cleaning: subtotals, discounts, advances, tax recomputation and apportionment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.common import any_contains, blank_to_null, first_filled, money, text, zero_if_null
from ..functions.ids import is_note, state_of_gstin
from ..functions.tax import SLAB_RATES, dec, rate_of
from .running import chunk_of, running_before

# Words that mark a subtotal row, and HSN codes by description in search order.
SUBTOTAL_WORDS = (
    "sub total", "sub-total", "subtotal",
    "grand total", "total amount", "net amount", "net cost",
    "total cost", "amount payable", "balance due", "total payable",
)
HSN_BY_WORD = {
    "saas": "9971", "mobile application": "9971", "upi qr": "9971", "additional users": "9971",
    "soundbox": "997319", "transactional messages": "998599", "app notifications": "998599",
    "promotional messages": "998599", "pan verification": "998529", "aadhaar verification": "998529",
    "gst verification": "998529", "cin verification": "998529", "late fees charges": "998311",
    "unallocated": "9971", "missing lines": "9971",
}
DEFAULT_HSN = "9971"
NARRATED_WORDS = ("saas", "mobile application", "soundbox", "sms", "whatsapp", "additional users", "messaging")
NARRATION = (
    "Being entry for book application charges and trasactional & promotional messaging charges "
    "for the month specifed in the data"
)
NOT_SPECIFIED_HSN = "NOT SPECIFIED ON INVOICE"
SECTION_HSN = {
    "saas_net": "9971", "transactional_net": "998599", "kyc_net": "998529",
    "promotional_net": "998599", "late_charges": None, "soundbox_net": "997319",
}
UNTAXED = ("EXPORT", "SEZ", "NIL_EXEMPT")
SUBTOTAL_TOLERANCE = 2


def is_subtotal(particulars: Column) -> Column:
    return any_contains(F.lower(F.coalesce(particulars, F.lit(""))), SUBTOTAL_WORDS)


def mark_subtotals(lines: DataFrame, doc: Sequence[str], position: str, tie: Sequence[str] = (),
                   chunk_rows: int | None = None) -> DataFrame:
    """Add ``grp`` (open groups closed by subtotal rows) and ``drop_row``.

    A subtotal row is dropped when the rows since the previous one add up to it. A document's lines are shuffled once and sorted in
    one task, which spills; with ``chunk_rows`` its groups are counted in chunks of so many positions, each in a task of its own.
    """
    flagged = lines.withColumn("is_sub", is_subtotal(F.col("particulars")))
    order, opened = [F.col(position), *map(F.col, tie)], F.col("is_sub").cast("long")
    if chunk_rows:
        grouped = running_before(flagged, doc, order, chunk_of(F.col(position), chunk_rows), {"grp": opened})
    else:
        earlier = Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        grouped = flagged.withColumn("grp", zero_if_null(F.sum(opened).over(earlier)))
    grp_sum = F.sum(F.when(~F.col("is_sub"), zero_if_null(F.col("taxable_value")))).over(Window.partitionBy(*doc, "grp"))
    gap = F.abs(F.col("grp_sum") - zero_if_null(F.col("taxable_value")))
    return grouped.withColumn("grp_sum", grp_sum).withColumn(
        "drop_row", F.col("is_sub") & F.coalesce(gap <= SUBTOTAL_TOLERANCE, F.lit(False))).drop("grp_sum")


def remove_subtotals(lines: DataFrame, doc: Sequence[str], position: str, tie: Sequence[str] = ()) -> DataFrame:
    return mark_subtotals(lines, doc, position, tie).filter(~F.col("drop_row")).select(*lines.columns)


def discounted_taxable(qty: Column, rate: Column, discount: Column, taxable: Column, total: Column) -> Column:
    """Taxable value net of discount where the gross was stored instead."""
    q, r, off = zero_if_null(qty), zero_if_null(rate), zero_if_null(discount)
    base, whole = zero_if_null(taxable), zero_if_null(total)
    gross = q * r
    priced = (gross > 0) & (F.abs(base.cast("double") - gross) < 1)
    unpriced = (q == 0) & (r == 0) & (off <= base) & ((whole == 0) | (F.abs(whole - base) < 1))
    return money(
        F.when(off <= 0, taxable).when(priced, F.round(money(gross) - off, 2))
        .when(unpriced, base - off).otherwise(taxable)
    )


def fix_discounts(lines: DataFrame) -> DataFrame:
    return lines.withColumn("taxable_value", discounted_taxable(
        *[F.col(c) for c in ("qty", "rate", "discount", "taxable_value", "total_invoice_value")]))


def positive_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("taxable_value") > 0)


def hsn_or_default(hsn: Column, particulars: Column) -> Column:
    """A missing code is filled by the first matching word of the description."""
    words = F.lower(F.coalesce(particulars, F.lit("")))
    chain = F.when(~F.lower(text(hsn)).isin("nan", "none", ""), hsn)
    for word, code in HSN_BY_WORD.items():
        chain = chain.when(words.contains(word), code)
    return chain.otherwise(DEFAULT_HSN)


def narration_or_given(narration: Column, particulars: Column) -> Column:
    words = F.lower(F.coalesce(particulars, F.lit("")))
    return F.when(any_contains(words, NARRATED_WORDS), NARRATION).otherwise(narration)


def quality_control(lines: DataFrame) -> DataFrame:
    """Positive lines with HSN and narration filled."""
    return positive_lines(lines).withColumns({
        "hsn": hsn_or_default(F.col("hsn"), F.col("particulars")),
        "narration": narration_or_given(F.col("narration"), F.col("particulars")),
    })


def recompute_taxes(lines: DataFrame, interstate: Column | None = None) -> DataFrame:
    """Taxes rebuilt from the nearest slab; service codes without tax go to 18%, exports to zero.

    ``interstate`` is decided per document; without it each line follows its larger side.
    """
    taxable = zero_if_null(F.col("taxable_value"))
    cgst, sgst, igst = (zero_if_null(F.col(c)) for c in ("cgst_amount", "sgst_amount", "igst_amount"))
    untaxed = F.upper(text(F.col("gstr1_category"))).isin(*UNTAXED)
    nearest = rate_of(taxable, cgst, sgst, igst, rates=SLAB_RATES)
    service = text(F.col("hsn")).startswith("99")
    pct = F.when(untaxed, 0.0).when((nearest == 0) & service, 18.0).otherwise(nearest)
    line_side = igst > cgst + sgst
    across = line_side if interstate is None else F.coalesce(interstate, line_side)
    staged = lines.withColumns({
        "_pct": pct.cast("decimal(4,0)"), "_across": across, "_touch": taxable > 0,
    })
    full = F.round(F.col("taxable_value") * F.col("_pct") * dec("0.01"), 2)
    half = F.round(F.col("taxable_value") * F.col("_pct") * dec("0.005"), 2)

    def put(value: Column, old: str) -> Column:
        return money(F.when(F.col("_touch"), value).otherwise(F.col(old)))

    zero = F.lit(0)
    taxed = staged.select(
        *[c for c in staged.columns if c not in ("cgst_amount", "sgst_amount", "igst_amount", "rate")],
        put(F.when(F.col("_across"), zero).otherwise(half), "cgst_amount").alias("cgst_amount"),
        put(F.when(F.col("_across"), zero).otherwise(half), "sgst_amount").alias("sgst_amount"),
        put(F.when(F.col("_across"), full).otherwise(zero), "igst_amount").alias("igst_amount"),
        F.when(F.col("_touch"), F.col("_pct").cast("double")).otherwise(F.col("rate")).alias("rate"),
    )
    rebuilt = F.col("taxable_value") + F.col("cgst_amount") + F.col("sgst_amount") + F.col("igst_amount")
    return taxed.withColumn(
        "total_invoice_value", money(F.when(F.col("_touch"), rebuilt).otherwise(F.col("total_invoice_value")))
    ).select(*lines.columns)


def cascade_advance(sections: DataFrame, doc: Sequence[str], position: str) -> DataFrame:
    """Take the gap between sections and net taxable from the largest section downwards.

    Needs ``taxable`` per section and ``net_taxable`` per document. Emptied sections go; a document
    emptied altogether keeps one nil line.
    """
    whole = Window.partitionBy(*doc)
    earlier = whole.orderBy(F.col("taxable").desc(), F.col(position)).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sections.select(
        "*", F.sum("taxable").over(whole).alias("_sum"), F.min("net_taxable").over(whole).alias("_net"),
        F.min(position).over(whole).alias("_first"), zero_if_null(F.sum("taxable").over(earlier)).alias("_before"),
    ).withColumn("_gap", F.round(F.col("_sum") - F.col("_net"), 2))
    open_gap = F.greatest(F.lit(0), F.col("_gap") - F.col("_before"))
    take = F.when(
        (F.abs("_gap") > dec("0.01")) & (open_gap > dec("0.005")), F.least(F.col("taxable"), open_gap)
    ).otherwise(0)
    left = ranked.select(
        *[c for c in sections.columns if c != "taxable"], money(F.col("taxable") - take).alias("taxable"),
        "_gap", "_sum", (F.col(position) == F.col("_first")).alias("_is_first"),
    )
    emptied = (F.abs("_gap") > dec("0.01")) & (F.col("_gap") >= F.col("_sum") - dec("0.005"))
    return left.filter((F.col("taxable") > dec("0.005")) | (F.abs("_gap") <= dec("0.01"))
                       | (emptied & F.col("_is_first"))).select(*sections.columns)


def apportion_taxes(sections: DataFrame, doc: Sequence[str], position: str) -> DataFrame:
    """Tax per section at the document's rates; the last section takes what rounding left over.

    Needs ``taxable``, ``net_taxable`` and ``cgst_rate``/``sgst_rate``/``igst_rate``.
    """
    sides = ("cgst", "sgst", "igst")

    def tax(base: str, side: str) -> Column:
        return F.round(F.col(base) * F.col(f"{side}_rate").cast("decimal(6,2)") * dec("0.01"), 2)

    rounded = sections.select("*", *[money(tax("taxable", s)).alias(f"_{s}") for s in sides])
    whole = Window.partitionBy(*doc)
    joined = rounded.select(
        "*", F.max(position).over(whole).alias("_last"), *[F.sum(f"_{s}").over(whole).alias(f"_sum_{s}") for s in sides])
    last = F.col(position) == F.col("_last")
    out = joined.select(*sections.columns, *[
        money(F.when(last, tax("net_taxable", s) - (F.col(f"_sum_{s}") - F.col(f"_{s}")))
              .otherwise(F.col(f"_{s}"))).alias(s) for s in sides])
    return out.withColumn("total", money(F.col("taxable") + F.col("cgst") + F.col("sgst") + F.col("igst")))


def sections_to_lines(rows: DataFrame) -> DataFrame:
    """Client-sheet sections as lines: taxes by share of the section sum, remainder to the last.

    ``items`` is NULL for notes and empty where every section is zero.
    """
    names = list(SECTION_HSN)
    buckets = F.filter(
        F.array(*[
            F.struct(F.lit(n).alias("section"), F.lit(SECTION_HSN[n] or NOT_SPECIFIED_HSN).alias("hsn"),
                     F.col(n).alias("taxable")) for n in names]),
        lambda b: b["taxable"] > dec("0.005"),
    )
    staged = rows.withColumn("_b", buckets).withColumn(
        "_sum", F.aggregate("_b", F.lit(0).cast("decimal(20,2)"),
                            lambda acc, b: (acc + b["taxable"]).cast("decimal(20,2)")))

    def share(side: str, b: Column) -> Column:
        return money(F.round(F.col(side) * b["taxable"] / F.col("_sum"), 2))

    shared = F.transform("_b", lambda b: F.struct(
        b["section"].alias("section"), b["hsn"].alias("hsn"), b["taxable"].alias("taxable"),
        *[share(s, b).alias(s) for s in ("cgst", "sgst", "igst")]))
    staged = staged.withColumn("_s", shared)

    def others(side: str) -> Column:
        return F.aggregate(
            F.slice("_s", F.lit(1), F.size("_s") - 1), F.lit(0).cast("decimal(20,2)"),
            lambda acc, b: (acc + b[side]).cast("decimal(20,2)"))

    def final(b: Column, i: Column) -> Column:
        last = i == F.size("_s") - 1
        taxes = {s: money(F.when(last, F.col(s) - others(s)).otherwise(b[s])) for s in ("cgst", "sgst", "igst")}
        return F.struct(
            b["section"].alias("section"), b["hsn"].alias("hsn"), b["taxable"].alias("taxable"),
            *[v.alias(k) for k, v in taxes.items()])

    items = F.when(F.size("_s") > 0, F.transform("_s", final)).otherwise(F.col("_s"))
    note = is_note(F.col("doc_type"))
    return staged.withColumn("items", F.when(~note, items)).select(*rows.columns, "items")


def explode_sections(rows: DataFrame) -> DataFrame:
    lines = rows.select("doc_no", F.posexplode("items").alias("pos", "item")).select("doc_no", "pos", "item.*")
    return lines.withColumn("total", money(F.col("taxable") + F.col("cgst") + F.col("sgst") + F.col("igst")))


HEADER_FIELDS = ("voucher_date", "voucher_type", "invoice_no", "party_ledger_name", "party_gstin")


def fill_from_header(lines: DataFrame, headers: DataFrame, key: str, default_type: str) -> DataFrame:
    """Blank line fields take the header's; a missing place of supply comes from the GSTIN."""
    fields = [*HEADER_FIELDS, "place_of_supply"]
    known = headers.select(key, *[F.col(f).alias(f"_h_{f}") for f in fields])
    joined = lines.join(known, key, "left")
    filled = {f: first_filled(F.col(f), F.col(f"_h_{f}")) for f in HEADER_FIELDS}
    filled["voucher_type"] = F.coalesce(first_filled(F.col("voucher_type")), F.lit(default_type))
    gstin = filled["party_gstin"]
    filled["place_of_supply"] = F.coalesce(
        first_filled(F.col("place_of_supply"), F.col("_h_place_of_supply")), blank_to_null(state_of_gstin(gstin)))
    return joined.withColumns(filled).select(*lines.columns)


def line_tax_sums(lines: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """Document totals from its lines; the extracted totals only where there is no line."""
    columns = ("taxable_value", "cgst_amount", "sgst_amount", "igst_amount")
    sums = lines.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_lines"),
        *[money(F.sum(zero_if_null(F.col(c)))).alias(f"_l_{c}") for c in columns])
    joined = extracted.join(sums, key, "full_outer")
    has_lines = zero_if_null(F.col("n_lines")) > 0
    return joined.select(
        key, zero_if_null(F.col("n_lines")).alias("n_lines"),
        *[money(F.when(has_lines, F.col(f"_l_{c}")).otherwise(zero_if_null(F.col(c)))).alias(f"overall_{c}")
          for c in columns])
