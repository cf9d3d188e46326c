"""What a query does with each row, read from its plan: how often a text is searched, how often rows are shuffled."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.operators import canonical, cleaning, filing, return_document, text_extract as tx
from khata.plans import invoice_audit, period_close
from suite import q_ops, q_sales, tables


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark):
    return spark.createDataFrame([(1, "TAX INVOICE\nA SAAS / Mobile Application 9971 Sub Total 10.00\nFinal Total (A) 10.00")], "doc_id long, text string").repartition(1)


def test_template_lines_read_a_text_once_for_each_step(spark):
    plan = optimized(tx.template_lines(texts(spark)))
    assert plan.count("regexp_replace(text") == 1
    assert plan.count("split(text") == 1


def test_audit_fields_blank_out_a_text_once(spark):
    plan = optimized(tx.audit_fields(texts(spark)).select("doc_id", "narration"))
    assert plan.count("regexp_replace(text") == 1


def test_audit_fields_look_for_a_section_once(spark):
    out = tx.audit_fields(texts(spark)).select("doc_id", "narration")
    assert optimized(out).count("Soundbox Charges)") == 1
    assert [r.narration for r in out.collect()] == ["SaaS/UPI Platform Charges"]


def test_cleaning_shuffles_a_documents_lines_once(spark):
    lines = spark.createDataFrame(
        [("d", 1, "item", 10.0, "27AABCF0001A1Z5"), ("d", 2, "sub total", 10.0, None), ("e", 1, "grand total", 5.0, None)],
        "doc string, pos long, particulars string, taxable double, party_gstin string").repartition(1)
    zero, none = F.lit(0).cast("decimal(18,2)"), F.lit(None).cast("string")
    lines = lines.select("*", F.col("taxable").cast("decimal(18,2)").alias("taxable_value"), zero.alias("discount"), zero.alias("total_invoice_value"),
                         *[zero.alias(f"{s}_amount") for s in ("cgst", "sgst", "igst")], F.lit(1.0).alias("qty"), F.lit(0.0).alias("rate"),
                         none.alias("hsn"), none.alias("narration"), none.alias("gstr1_category"))
    out = invoice_audit.clean_lines(lines, "doc", "pos")
    assert sorted((r.doc, r.particulars) for r in out.collect()) == [("d", "item"), ("e", "grand total")]
    assert optimized(out).count("Join") == 0


def test_apportioning_shuffles_a_documents_sections_once(spark):
    rows = spark.createDataFrame([("d", 1, 10, 15), ("d", 2, 20, 15)], "doc string, pos int, taxable int, net_taxable int").repartition(1)
    sections = rows.select("doc", "pos", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("taxable", "net_taxable")],
                           *[F.lit(r).alias(f"{s}_rate") for s, r in (("cgst", 9.0), ("sgst", 9.0), ("igst", 0.0))])
    out = cleaning.apportion_taxes(cleaning.cascade_advance(sections, ["doc"], "pos"), ["doc"], "pos")
    assert sorted((r.pos, float(r.taxable), float(r.cgst)) for r in out.collect()) == [(1, 10.0, 0.9), (2, 5.0, 0.45)]
    assert optimized(out).count("Join") == 0


SMALL = "/root/testdata/sf0.001"


def test_closing_a_period_writes_nothing_by_itself(spark):
    out = period_close.close_period(tables.sales_lines(spark, SMALL), tables.client_rows(tables.sales_documents(spark, SMALL)), tables.REGISTRATIONS)
    assert "LogicalRDD" not in optimized(out["filings"])


def test_filings_shuffle_only_the_columns_they_sum(spark):
    lines = tables.sales_lines(spark, SMALL)
    entries = lines.select(F.col("invoice_no").alias("doc_no"), F.lit("PASS").alias("status")).distinct()
    plan = optimized(filing.filings_summary(lines, entries, tables.REGISTRATIONS))
    assert "LogicalRDD" not in plan and "party_ledger_name" not in plan


def test_filings_sum_the_documents_of_both_sides_once(spark):
    out = q_sales.filings_by_registration(spark, SMALL)
    assert out.count() == 3
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet [l_orderkey") == 2


def test_taxes_of_lines_stay_within_18_digits(spark):
    plan = optimized(tables.sales_lines(spark, SMALL, part=False).select("cgst_amount", "igst_amount", "total_invoice_value"))
    assert "decimal(19" not in plan and "decimal(2" not in plan.replace("decimal(2,0)", "")


def test_canonical_lines_are_shuffled_without_their_confidence(spark):
    plan = optimized(canonical.to_canonical(tables.sales_lines(spark, SMALL), canonical.SALES, ("task_id", "invoice_no")))
    assert "SQL Load" not in plan[plan.index("Join"):] and "<=>" not in plan


def test_entries_of_a_return_meet_the_first_of_their_group_evenly(spark):
    rows = return_document.return_rows(tables.sales_lines(spark, SMALL).withColumn("registration", F.lit("07X")), "07")
    plan = optimized(rows.filter((F.col("step") == return_document.ENTRY) & (F.col("section") == return_document.B2CL)))
    # of the sums, which have other sections, nothing is worked out, so lines aren't read again
    assert plan.count("Join LeftOuter") == 1 and "xxhash64(value" in plan and "parquet" not in plan


def test_vouchers_are_parsed_in_many_tasks(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert q_ops._vouchers(spark, SMALL).rdd.getNumPartitions() == parts


def test_votes_join_a_state_that_is_worked_out_once(spark):
    merged, decided = q_ops._votes(spark, SMALL)
    assert "parquet" not in optimized(decided).lower() and optimized(merged).count("Join") == 0
