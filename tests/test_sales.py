from decimal import Decimal as D

from pyspark.sql import functions as F

from khata.operators import duplicates, filing, gstr1, registers, sales_recon

from .conftest import rows

BUYER = "27AABCM0001A1Z5"
LINE = ("seq int, invoice_no string, party_gstin string, voucher_type string, gstr1_category string, place_of_supply string, voucher_date string, "
        "party_ledger_name string, particulars string, hsn string, qty double, taxable_value decimal(18,2), cgst_amount decimal(18,2), "
        "sgst_amount decimal(18,2), igst_amount decimal(18,2), total_invoice_value decimal(18,2)")


def line(seq, no, gstin, vtype, cat, taxable, igst=0, cgst=0, total=None, pos="27", date="05-01-2024", hsn="9971", text="x"):
    total = taxable + igst + 2 * cgst if total is None else total
    return (seq, no, gstin, vtype, cat, pos, date, "P", text, hsn, 1.0, *[D(str(x)) for x in (taxable, cgst, cgst, igst, total)])


def test_notes_never_reduce_b2cs(spark):
    df = spark.createDataFrame([line(1, "MH1", None, "Sales", "B2CS", 5000, igst=900), line(2, "CR1", None, "Credit Note", None, 7246.77)], LINE)
    groups = gstr1.invoice_groups(df, "06")
    assert rows(gstr1.b2cs_rows(groups, "06"), "sply_tp", "pos", F.col("taxable").cast("double")) == [("INTER", "27", 5000.0)]
    assert rows(gstr1.note_rows(groups, "06"), "section", "ntty", F.col("taxable_value").cast("double"), "supply_type") == [("CDNUR", "C", 7246.77, "INTER")]
    hsn = gstr1.hsn_summary(df)
    assert rows(hsn, "rt", F.col("txval").cast("double")) == [(0.0, -7246.77), (18.0, 5000.0)]


def test_groups_totals_and_nested_parts(spark):
    data = [line(i, f"I{i}", BUYER, "Sales", "B2B", 100, igst=18, total=0) for i in range(25)]
    df = spark.createDataFrame(data, LINE)
    groups = gstr1.invoice_groups(df, "06")
    assert {r.total for r in groups.select("total").collect()} == {D("118.00")}
    parts = gstr1.nested_section(groups, "B2B", "party_gstin", per_document=10).collect()
    assert 1 < len(parts) <= 3 and sorted(i.inum for p in parts for i in p.inv) == sorted(f"I{i}" for i in range(25))


def test_filing_period_tie_goes_to_first_seen(spark):
    df = spark.createDataFrame([line(2, "A", None, "Sales", None, 1, date="01-02-2024"), line(1, "B", None, "Sales", None, 1, date="01/03/2024"), line(3, "C", None, "Sales", None, 1, date="bad")], LINE)
    assert rows(gstr1.filing_period(df), "fp") == [("032024",)]


def test_doc_summary_counts_buckets(spark):
    df = spark.createDataFrame([line(1, "A", None, "Sales", "B2CS", 10), line(2, "B", None, "Sales", "B2CS", 10), line(3, "C", BUYER, "Sales", "B2B", 10), line(4, "D", BUYER, "Debit Note", None, 10)], LINE)
    assert rows(gstr1.doc_summary(gstr1.invoice_groups(df, "06")), "doc_num", "totnum") == [(1, 2), (2, 1)]


def side(spark, data, client=False):
    schema = "seq int, doc_no string, doc_type string, party_gstin string, taxable decimal(18,2), igst decimal(18,2), cgst decimal(18,2), sgst decimal(18,2), total decimal(18,2)"
    if client:
        schema += ", supplier_location string, state_of_supply string, interstate_or_intrastate string"
    return spark.createDataFrame(data, schema)


def doc(seq, no, gstin, taxable, igst, cgst, *rest):
    t = [D(str(x)) for x in (taxable, igst, cgst, cgst, taxable + igst + 2 * cgst)]
    return (seq, no, "Invoice", gstin, *t, *rest)


def test_three_way_verdicts(spark):
    ours = side(spark, [doc(1, "A", BUYER, 100, 18, 0), doc(2, "B", BUYER, 100, 18, 0), doc(3, "C", None, 100, 0, 0), doc(4, "D", BUYER, 100, 18, 0),
                        doc(5, "E", BUYER, 5, 0, 0), doc(6, "E", BUYER, 100, 18, 0), doc(7, "G", BUYER, 100, 18, 0)])
    client = side(spark, [doc(1, "A", None, 102.5, 18, 0, "MH", "27", "Intrastate"), doc(2, "B", None, 100, 0, 9, "MH", "29", "Intrastate"), doc(3, "C", None, 1, 0, 0, "", "", ""),
                          doc(4, "D", None, 200, 36, 0, "MH", "27", "Intrastate"), doc(5, "E", None, 100, 18, 0, "MH", "27", "x"), doc(6, "F", None, 1, 0, 0, "MH", "27", "x")], client=True)
    out = sales_recon.reconcile_documents(ours, client)
    assert rows(out, "doc_no", "status", "known_inversion") == [
        ("A", "PASS", False), ("B", "CLIENT_SHEET_ERROR", True), ("C", "UNVERIFIABLE_NO_GSTIN", False), ("D", "UNRESOLVED_CONFLICT", False),
        ("E", "PASS", False), ("F", "MISSING_SOURCE_PDF", False), ("G", "CLIENT_MISSING", False)]
    assert rows(sales_recon.duplicate_numbers(ours), "doc_no", "n") == [("E", 2)]


def test_totals_check_nets_notes(spark):
    df = spark.createDataFrame([("Invoice", D("100")), ("Credit Note", D("30"))], "doc_type string, taxable decimal(18,2)")
    other = spark.createDataFrame([("Invoice", D("72.50"))], "doc_type string, taxable decimal(18,2)")
    got = sales_recon.totals_check(df, other).first()
    assert (got.os_net_taxable, got.os_vs_client, got.matches) == (D("70.00"), D("-2.50"), True)


def test_gate_and_routing(spark):
    df = spark.createDataFrame([line(1, "MH1", BUYER, "Sales", "B2B", 10), line(2, "MH2", None, "Sales", None, 10), line(3, "CR9", BUYER, "Credit Note", None, 5, text="r (against HR7)"),
                                line(4, "ZZ1", BUYER, "Sales", "B2B", 10), line(5, "MH3", BUYER, "Sales", "B2B", 1)], LINE)
    entries = spark.createDataFrame([("MH1", "PASS"), ("MH2", "UNVERIFIABLE_NO_GSTIN"), ("MH3", "UNRESOLVED_CONFLICT")], "doc_no string, status string")
    filed, flagged, skipped = filing.gate(df, entries)
    assert rows(filed, "invoice_no") == [("CR9",), ("MH1",), ("MH3",), ("ZZ1",)]
    assert rows(flagged) == [("MH3",)] and rows(skipped) == [("MH2", "UNVERIFIABLE_NO_GSTIN")]
    reg = {"MH": BUYER, "HR": "06AABCH0001A1Z5"}
    out = filing.filings_summary(df, entries, reg)
    assert rows(out, "registration", "has_data", F.col("total_taxable").cast("double"), "flagged_documents") == [
        ("06AABCH0001A1Z5", True, -5.0, 0), (BUYER, True, 11.0, 1), ("UNKNOWN_REGISTRATION", False, 0.0, 0)]


def test_duplicates_ignore_case_and_space_but_not_date(spark):
    df = spark.createDataFrame([("b1", "t1", "T", 1, " a1", BUYER.lower(), "d1"), ("b1", "t2", "T", 2, "A1 ", BUYER, "D1"), ("b1", "t3", "T", 3, "A1", BUYER, "d2"), ("b2", "t4", "T", 4, "A1", BUYER, "d9")],
                               "batch_id string, task_id string, tenant_id string, seq int, invoice_no string, party_gstin string, voucher_date string")
    assert rows(duplicates.within_batch(df), "invoice_no", "voucher_date", "count", "n_tasks") == [("A1", "D1", 2, 2)]
    assert rows(duplicates.cross_batch(df, spark.createDataFrame([("b1",)], "batch_id string")), "other_batch_id", "count") == [("b2", 4)]
    assert rows(duplicates.already_processed(df), "task_id", "first_task") == [("t1", "t1"), ("t2", "t1")]


def test_register_keeps_null_groups_and_joins_names(spark):
    base = spark.createDataFrame([line(1, "A", None, "Sales", "B2CS", 10, text="one"), line(2, "A", None, "Sales", "B2CS", 10, text="one"), line(3, "A", None, "Sales", "B2CS", 20, text="two", hsn="8471"),
                                  line(4, "A", None, "Sales", "B2CS", 10, text="one")], LINE)
    df = base.withColumns({"discount": F.lit(0).cast("decimal(18,2)"), "advances": F.lit(0).cast("decimal(18,2)"), "narration": F.when(F.col("seq") == 3, "Audit fee")})
    reg = registers.sales_register(df)
    assert rows(reg, F.col("taxable_value").cast("double"), "particulars", "hsn", "nature") == [(30.0, "one | two", None, "Audit fee")]
    assert rows(registers.matching_sheet(reg), "match_status") == [("PASS – Export LUT",)]
    assert rows(registers.tds_workings(reg), "tds_applicable", "gst_type") == [("No", "Export LUT")]


def test_register_keeps_many_names_in_parts(spark):
    names = [f"name {i % 500:03d} of many" for i in range(1000)]
    many = [line(i, "A" if i % 2 else None, None, "Sales", "B2CS" if i % 3 else "EXP", 10, text=x) for i, x in enumerate(names)]
    few = [line(2000 + i, "B", None, "Sales", "B2CS", 10, text=x) for i, x in enumerate(["two", "one", "two"])]
    df = spark.createDataFrame(many + few, LINE).withColumns({c: F.lit(0).cast("decimal(18,2)") for c in ("discount", "advances")}).withColumn("narration", F.lit(None).cast("string"))
    reg = registers.sales_register(df, size=300)
    assert rows(reg, "invoice_no", "gstr1_category", "particulars", "names_apart") == rows(spark.createDataFrame(
        [(n, c, None, True) for n in ("A", None) for c in ("B2CS", "EXP")] + [("B", "B2CS", "two | one", False)], "n string, c string, p string, a boolean"))
    parts = registers.register_names(df, 300).orderBy("part_no").collect()
    assert max(len(r["particulars"]) for r in parts) <= 300 + len(names[0])
    for key, want in (("A", names[1:500:2]), (None, names[0:500:2]), ("B", ["two", "one"])):
        assert [x for r in parts if r["invoice_no"] == key for x in r["particulars"].split(" | ")] == want
    assert rows(registers.sales_register(df).where("invoice_no = 'A'"), "particulars") == [(" | ".join(names[1:500:2]),)] * 2


def test_register_reads_and_shuffles_its_lines_once(spark):
    zero = {c: F.lit(0).cast("decimal(18,2)") for c in ("discount", "advances")}
    df = spark.createDataFrame([line(1, "A", None, "Sales", "B2CS", 10, text="one")], LINE).withColumns(zero).withColumn("narration", F.lit("x"))
    plan = registers.sales_register(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan ExistingRDD") == 1, plan


def test_itc_summary_always_has_six_rows(spark):
    df = spark.createDataFrame([("ITC_ELIGIBLE", D("10")), ("ITC_BLOCKED", D("5"))], "itc_status string, taxable_value decimal(18,2)")
    got = rows(registers.itc_summary(df), "category", F.col("taxable_amount").cast("double"), "line_items", F.col("itc_at_risk").cast("double"))
    assert len(got) == 6 and ("TOTAL", 15.0, 2, 5.0) in got and ("ITC_EXEMPT", 0.0, 0, 0.0) in got
