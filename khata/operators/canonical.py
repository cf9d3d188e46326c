"""Invoice lines as canonical invoices, whose every value says where it came from, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import money, zero_if_null

PART_LINES = 1000
"""Lines that one nested row holds about; longer documents have several rows, each with the whole head and totals."""
SALES, PURCHASE = "Sales", "Purchase"
OWN_NAME = "Client Company"
HEAD = ["voucher_date", "invoice_no", "party_ledger_name", "party_gstin", "place_of_supply"]
# Canonical name of each amount and the line column it is read from.
AMOUNTS = {
    "quantity": "qty", "rate": "rate", "discount": "discount", "taxable_value": "taxable_value", "cgst_amount": "cgst_amount",
    "sgst_amount": "sgst_amount", "igst_amount": "igst_amount", "total": "total_invoice_value",
}
TOTALS = {"taxable_value": "taxable_value", "cgst_amount": "cgst_amount", "sgst_amount": "sgst_amount", "igst_amount": "igst_amount", "grand_total": "total_invoice_value"}
CLASS_OF = {SALES: "gstr1_category", PURCHASE: "itc_eligibility"}


def sourced(value: Column) -> Column:
    """A value with the confidence of one that is stored."""
    # How stored values are described.
    confidence = F.struct(
        F.lit(1.0).alias("score"), F.lit("Database").alias("source"), F.lit("SQL Load").alias("method"), F.lit(True).alias("verified"),
        F.lit("Loaded directly from the verified database records").alias("reason"))
    return F.struct(value.alias("value"), confidence.alias("confidence"))


def to_canonical(lines: DataFrame, kind: str, key: Sequence[str] = ("task_id",), part_lines: int = PART_LINES) -> DataFrame:
    """One row per document and part: key, part, n_parts and the invoice as nested columns.

    The head is that of the document's first line by ``seq``; sums are those of all its lines, missing amounts counting 0. Lines are
    dealt to parts by a hash of their ``seq``, so a document with very many lines, such as all those without a key,
    is never in one cell; line items are in order within a part and carry ``seq``. Nulls stay nulls.
    """
    def column(name: str) -> Column:
        return F.col(name) if name in lines.columns else F.lit(None).cast("decimal(18,2)")

    category = CLASS_OF[kind]
    head = F.struct(*HEAD, F.col(category).alias("category"))
    # the key as a struct is never null itself: its parts meet where they are null too, and what is joined by it stays dealt by it
    whole_key = F.struct(*key).alias("_key")
    heads = lines.groupBy(whole_key).agg(
        F.min_by(head, "seq").alias("head"), F.count(F.lit(1)).alias("n_lines"),
        *[money(F.sum(zero_if_null(F.col(c)))).alias(f"sum_{n}") for n, c in TOTALS.items()])
    heads = heads.withColumn("n_parts", F.ceil(F.col("n_lines") / part_lines).cast("int"))
    raw = {"description": F.col("particulars"), "hsn_sac": F.col("hsn"), **{n: column(c) for n, c in AMOUNTS.items()}}
    keyed = lines.select(whole_key, F.xxhash64("seq").alias("_h"), F.struct("seq", *[v.alias(n) for n, v in raw.items()]).alias("item"))
    dealt = keyed.join(heads, "_key").withColumn("part", F.pmod("_h", "n_parts").cast("int"))
    # one head and one set of sums for all rows of a document, so taking any of them is enough
    grouped = dealt.groupBy("_key", "part").agg(
        F.first("n_parts").alias("n_parts"), F.first("head").alias("head"), *[F.first(f"sum_{n}").alias(f"sum_{n}") for n in TOTALS],
        F.array_sort(F.collect_list("item")).alias("items"))
    # where values come from is said last, so that it isn't shuffled with every line
    items = F.transform("items", lambda x: F.struct(x["seq"].alias("seq"), *[sourced(x[n]).alias(n) for n in raw]))
    nested = grouped.select("_key.*", "part", "n_parts", "head", *[f"sum_{n}" for n in TOTALS], items.alias("line_items"))
    name, gstin = F.col("head.party_ledger_name"), F.col("head.party_gstin")
    nobody, own = F.lit(None).cast("string"), F.lit(OWN_NAME)
    sold = kind == SALES
    return nested.select(
        *key, "part", "n_parts",
        F.struct(sourced(own if sold else name).alias("legal_name"), sourced(nobody if sold else gstin).alias("gstin")).alias("supplier"),
        F.struct(sourced(name if sold else own).alias("name"), sourced(gstin if sold else nobody).alias("gstin")).alias("buyer"),
        F.struct(
            sourced(F.col("head.invoice_no")).alias("invoice_number"), sourced(F.col("head.voucher_date")).alias("invoice_date"),
            sourced(F.lit(kind)).alias("invoice_type"), sourced(F.col("head.place_of_supply")).alias("place_of_supply")).alias("invoice_metadata"),
        "line_items", F.struct(*[sourced(F.col(f"sum_{n}")).alias(n) for n in TOTALS]).alias("tax_summary"),
        F.struct(F.col("head.category").alias("gstr1_category")).alias("classification"))


def to_lines(invoices: DataFrame, kind: str, key: Sequence[str] = ("task_id",), blanks: bool = False) -> DataFrame:
    """The lines of canonical invoices, with the document's head on each.

    With ``blanks``, as stores without nulls want it, missing texts become empty and missing amounts 0; otherwise they stay missing.
    """
    party = ("buyer.name", "buyer.gstin") if kind == SALES else ("supplier.legal_name", "supplier.gstin")
    head = {
        "voucher_date": "invoice_metadata.invoice_date", "invoice_no": "invoice_metadata.invoice_number", "party_ledger_name": party[0],
        "party_gstin": party[1], "place_of_supply": "invoice_metadata.place_of_supply"}
    rows = invoices.select(
        *key, *[F.col(f"{v}.value").alias(f"_{k}") for k, v in head.items()], F.col("classification.gstr1_category").alias("_category"),
        F.explode("line_items").alias("item"))

    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) if blanks else c

    def amount(name: str) -> Column:
        value = F.col(f"item.{name}.value")
        # quantity and rate may be missing; money may not
        return zero_if_null(value) if blanks and name not in ("quantity", "rate") else value

    kept = {n: c for n, c in AMOUNTS.items() if kind == SALES or n != "discount"}
    return rows.select(
        *[c for c in key if c not in head], "item.seq", F.lit(kind).alias("voucher_type"), *[text(F.col(f"_{c}")).alias(c) for c in head],
        text(F.col("item.description.value")).alias("particulars"), text(F.col("item.hsn_sac.value")).alias("hsn"),
        *[amount(n).alias(c) for n, c in kept.items()], text(F.col("_category")).alias(CLASS_OF[kind]))
