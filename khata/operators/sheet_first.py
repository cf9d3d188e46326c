"""Line items taken from the client's register first, with documents filling what it lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.common import first_filled, money, zero_if_null
from ..functions.ids import is_note
from .cleaning import NOT_SPECIFIED_HSN, sections_to_lines
from .text_extract import credit_notes, document_numbers

TYPES = ("invoice", "credit_note")
AMOUNTS = ("taxable_value", "cgst_amount", "sgst_amount", "igst_amount", "total_invoice_value")


def gap_documents(documents: DataFrame, sheet: DataFrame) -> DataFrame:
    """Invoices and notes whose number is unknown or missing from the register."""
    typed = documents.filter(F.col("document_type").isin(*TYPES))
    numbered = typed.select("doc_id", "document_type").join(document_numbers(typed), "doc_id")
    known = sheet.select(F.col("doc_no")).filter(F.coalesce("doc_no", F.lit("")) != "")
    return numbered.join(known, "doc_no", "left_anti").select("doc_id", "document_type", "doc_no")


def note_documents(sheet: DataFrame, documents: DataFrame) -> DataFrame:
    """Register notes with the fields of their own document, the first one of that number."""
    texts = documents.filter("document_type = 'credit_note'")
    fields = credit_notes(texts)
    rest = [c for c in fields.columns if c != "credit_note_no"]
    first = fields.filter(F.col("credit_note_no").isNotNull()).groupBy(
        F.col("credit_note_no").alias("doc_no")).agg(F.min_by(F.struct(*rest), "doc_id").alias("cn"))
    return sheet.filter(is_note(F.col("doc_type"))).join(first, "doc_no", "left")


def plan(sheet: DataFrame, documents: DataFrame) -> DataFrame:
    """Lines to store for every register row, with the source of each."""
    with_cn = sheet.join(
        note_documents(sheet, documents).select("doc_no", "cn").dropDuplicates(["doc_no"]), "doc_no", "left")
    rows = sections_to_lines(with_cn)
    note = is_note(F.col("doc_type"))
    zero = money(F.lit(0))

    def line(source, particulars, hsn, number, date, party, *amounts):
        return F.struct(
            F.lit(source).alias("source"), particulars.alias("particulars"), hsn.alias("hsn"),
            number.alias("invoice_no"), date.alias("voucher_date"), party.alias("party_ledger_name"),
            *[money(a).alias(n) for n, a in zip(AMOUNTS, amounts)])

    number, date, party = F.col("doc_no"), F.col("doc_date"), F.col("party_name")
    whole = F.array(line(
        "sheet_totals", F.concat(F.coalesce(F.col("doc_type"), F.lit("Invoice")), F.lit(" (from client sheet, no bucket breakdown)")),
        F.lit(NOT_SPECIFIED_HSN), number, date, party,
        *[zero_if_null(F.col(c)) for c in ("taxable", "cgst", "sgst", "igst", "total")]))
    parts = F.transform("items", lambda b: line(
        "sheet_sections", F.concat(F.lit("From client sheet - HSN "), b["hsn"]), b["hsn"], number, date, party,
        b["taxable"], b["cgst"], b["sgst"], b["igst"], b["taxable"] + b["cgst"] + b["sgst"] + b["igst"]))
    own = F.array(line(
        "own_document", F.concat(F.lit("Credit Note - "), F.coalesce("cn.reason", F.lit("None")), F.lit(" (against "),
                                 F.coalesce("cn.original_invoice_no", F.lit("None")), F.lit(")")),
        F.col("cn.hsn"), number, F.col("cn.note_date"), F.coalesce(first_filled(F.col("cn.party_name")), party),
        *[F.coalesce(F.col(f"cn.{c}"), zero) for c in ("taxable", "cgst", "sgst", "igst", "total")]))
    chosen = (
        F.when(note & F.col("cn").isNotNull(), own).when(~note & (F.size("items") > 0), parts).otherwise(whole))
    return rows.select(F.col("doc_no").alias("source_doc_no"), "doc_type", F.posexplode(chosen).alias("line_no", "l")).select(
        "source_doc_no", "doc_type", "line_no", "l.*")
