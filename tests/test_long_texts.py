"""Texts without bounds: long tables, long headers, and long texts that hold no template."""

import time

import pytest
from pyspark.sql import functions as F

from khata.operators import state
from khata.operators import text_extract as tx

from .conftest import rows


def document(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_summary_of_sixty_rows_behind_a_long_header(spark):
    table = "\n".join("100.00 9% 9.00 9% 9.00 0% 0.00 note " + "x" * 40 for _ in range(60))
    text = "Taxable Value" + " heading" * 200 + " Central Tax " + "y" * 900 + "\n" + table
    got = tx.gst_summary(document(spark, text)).select(F.col("taxable_value").cast("double"), F.col("cgst_amount").cast("double")).first()
    assert tuple(got) == (6000.0, 540.0)


def test_single_line_template(spark):
    text = "A\nAnnual maintenance of 3 servers\n9971 charge 1,234.50\nB\nFinal Total 1,234.50"
    got = rows(tx.sections_of(document(spark, text, text.replace("Final Total", "Sum"))), "doc_id", "particulars", "hsn", F.col("taxable").cast("double"))
    assert got == [(0, "Annual maintenance of 3 servers", "9971", 1234.5)]


@pytest.mark.parametrize("piece", ["A item 9971 charge 12.50 ", "A SAAS / Mobile Application B Soundbox Charges ", "Customer Name: x GSTIN: y "])
def test_long_text_without_the_template(spark, piece):
    text = piece * (200_000 // len(piece))
    tx.sections_of(document(spark, "warm up")).collect()
    started = time.time()
    assert tx.sections_of(document(spark, text)).count() == 0
    tx.invoice_header(document(spark, text)).collect()
    assert time.time() - started < 5


def test_narration_and_numbers_are_whole(spark):
    line = "01-02-2024 " + "word " * 200 + "10.00 20.00"
    assert len(tx.bank_transactions(document(spark, line)).first()["narration"]) == 999
    assert tx.fast_extract(document(spark, "Invoice No: ABC/2024/0123456789/LONG-1 ")).first()["supplier_inv"] == "ABC/2024/0123456789/LONG-1"


def test_certificate_type_far_from_its_label(spark):
    got = tx.certificates(document(spark, "A large firm. Enterprise Type" + " ." * 300 + " micro")).first()
    assert got["enterprise_type"] == "MICRO"


def test_gaps_in_a_long_document_and_with_an_odd_gstin(spark):
    gaps = spark.createDataFrame([("07AABCF0001A1Z5", "INV/77", "03-01-2024"), ("ODD-1", "INV/78", "03-01-2024"), ("ODD-2", "INV/78", "03-01-2024")], "gst_no string, supplier_inv string, invoice_date string")
    filler = " ".join(f"W{i}" for i in range(18_000))
    docs = spark.createDataFrame([(1, "2024-01-01", f"{filler} 07AABCF0001A1Z5 {filler[:5000]} INV-77"), (2, "2024-02-01", "odd 1 here, inv 78")], "doc_id long, month string, text string").withColumn("month", F.to_date("month"))
    got = state.verify_gaps(gaps, docs)
    assert rows(got, "gst_no", "in_drive") == [("07AABCF0001A1Z5", "Yes"), ("ODD-1", "Yes"), ("ODD-2", "No")]
