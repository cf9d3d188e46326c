from decimal import Decimal as D

from pyspark.sql import functions as F

from khata import schemas
from khata.operators import golden, ledger, metrics, sheet_first, state, text_extract as tx
from khata.sources import inventory, tables
from khata.streaming import events as ev, sinks

from .conftest import rows

NOW = "2024-02-01 00:00:00"


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def gaps(spark, data):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "seq int, counterparty_gstin string, invoice_no string, bucket string, amount decimal(18,2)")
    return df.select("*", F.lit("T").alias("tenant_id"), F.lit("R").alias("registration_gstin"))


def scope(spark, review=True):
    return spark.createDataFrame([("T", "R", "2024-01", review)], "tenant_id string, registration_gstin string, period string, require_review boolean")


def test_trigger_life_cycle(spark):
    empty = spark.createDataFrame([], schemas.GAP_TRIGGERS)
    first = gaps(spark, [("G1", "A", "not_in_books", D("5")), ("G2", "B", "missing_in_2b", D("6"))])
    s1 = state.merge_triggers(empty, first, scope(spark), ts(NOW))
    assert rows(s1, "invoice_no", "status", "trigger_count") == [("A", "pending_review", 0), ("B", "queued", 0)]
    assert rows(state.merge_triggers(s1, first, scope(spark), ts(NOW))) == rows(s1)  # merging twice changes nothing
    s2 = state.merge_triggers(s1, gaps(spark, [("G1", "A", "not_in_books", D("7"))]), scope(spark), ts(NOW))
    assert rows(s2, "invoice_no", "status", F.col("amount").cast("double")) == [("A", "pending_review", 7.0), ("B", "resolved", 6.0)]
    s3 = state.merge_triggers(s2, first, scope(spark, review=False), ts(NOW))
    assert rows(s3, "invoice_no", "status", "resolved_at") == [("A", "pending_review", None), ("B", "queued", None)]
    elsewhere = spark.createDataFrame([("X", "R", "2024-01", True)], "tenant_id string, registration_gstin string, period string, require_review boolean")
    assert rows(state.merge_triggers(s1, first.limit(0), elsewhere, ts(NOW)), "status") == rows(s1, "status")
    votes = spark.createDataFrame([("T", "R", "G1", "A", "not_in_books", "approve"), ("T", "R", "G2", "B", "missing_in_2b", "approve"), ("T", "R", "G9", "Z", "not_in_books", "reject")],
                                  "tenant_id string, registration_gstin string, counterparty_gstin string, invoice_no string, bucket string, action string")
    decided = state.decide_triggers(s1, votes)
    assert rows(decided, "invoice_no", "accepted", "reason") == [("A", True, None), ("B", False, "needs no approval"), ("Z", False, "no such trigger")]
    s4 = state.apply_decisions(s1, decided)
    policy = spark.createDataFrame([("T", False)], "tenant_id string, auto_vendor_followup boolean")
    s5 = state.run_due(s4, policy, ts(NOW))
    assert rows(s5, "invoice_no", "status", "trigger_count") == [("A", "sent", 1), ("B", "queued", 0)]
    soon = state.due_outcome(s5, policy, ts("2024-02-20 00:00:00"))
    assert rows(soon, "invoice_no", "outcome", "reason") == [("A", "skipped", "not due (sent within last 30 days)"), ("B", "skipped", "auto_vendor_followup disabled")]
    assert rows(state.run_due(s5, policy, ts("2024-03-02 00:00:00")), "invoice_no", "trigger_count") == [("A", 2), ("B", 0)]


def test_gap_verification_needs_both_identifiers_and_the_right_month(spark):
    g, odd = "29AABCM0001A1Z5", "SHORT9"
    extra = spark.createDataFrame([(g, "INV/2024/0001", "05-01-2024"), (g, "INV/2024/0002", "05-01-2024"), (g, "A1", "05-01-2024"), (odd, "ODD-77", "05-01-2024"), (g, "LATE-0009", "05-01-2024"), ("", "X", "05-01-2024"), (g, "INV/2024/0001", "bad")],
                                  "gst_no string, supplier_inv string, invoice_date string")
    docs = spark.createDataFrame([("2024-02-01", f"from 29-aabcm-0001a1z5 number inv 2024 0001 {'x' * 3000} a-1"), ("2024-01-01", "INV20240002 but no id"), ("2024-01-01", "short9 odd77"), ("2024-03-01", f"{g} LATE0009")],
                                 "month string, text string").select(F.monotonically_increasing_id().alias("doc_id"), F.to_date("month").alias("month"), "text")
    got = rows(state.verify_gaps(extra, docs), "supplier_inv", "invoice_date", "in_drive")
    assert got == [("A1", "05-01-2024", "Yes"), ("INV/2024/0001", "05-01-2024", "Yes"), ("INV/2024/0001", "bad", "No"), ("INV/2024/0002", "05-01-2024", "No"), ("LATE-0009", "05-01-2024", "No"), ("ODD-77", "05-01-2024", "Yes"), ("X", "05-01-2024", "No")]


def test_reviews_are_final_once_decided(spark):
    reviews = spark.createDataFrame([(1, "T", "p", "PENDING_REVIEW", 1), (2, "T", "p", "APPROVED", 2), (3, "T", "q", "PENDING_REVIEW", 1)], "review_id int, tenant string, period string, status string, created_at int")
    votes = spark.createDataFrame([(1, "reject", " "), (1, "approve", None), (2, "reject", "n"), (9, "approve", "")], "review_id int, action string, notes string")
    assert rows(state.decide_reviews(reviews, votes), "review_id", "action", "new_status", "reason") == [
        (1, "approve", "APPROVED", None), (1, "reject", "PENDING_REVIEW", "a rejection needs notes"), (2, "reject", "APPROVED", "already APPROVED"), (9, "approve", None, "no such review")]
    assert rows(state.latest_review(reviews, ["tenant", "period"]), "period", "review_id") == [("p", 2), ("q", 3)]
    new = spark.createDataFrame([(4, "T", "p", "PENDING_REVIEW", 3), (5, "T", "q", "PENDING_REVIEW", 3)], reviews.schema)
    assert state.append_reviews(reviews, new, ["tenant", "period"], skip_pending=True).count() == 4


def test_ledger(spark):
    df = spark.createDataFrame([(1, "Sales", "Acme", "2024-01-05", D("100"), D("9"), D("9"), D("0"), D("0")), (2, "Credit Note", "Acme", "2024-01-05", D("10"), D("0"), D("0"), D("0"), D("10")),
                                (3, "Debit Note", "Acme", "2024-01-05", D("1"), D("0"), D("0"), D("0"), D("1")), (4, "Purchase", "Acme", "2024-01-05", D("1"), D("0"), D("0"), D("0"), D("1")),
                                (5, "Sales", "", "2024-01-05", D("1"), D("0"), D("0"), D("0"), D("1")), (6, "Sales", "Acme", "bad", D("1"), D("0"), D("0"), D("0"), D("1"))],
                               "id int, voucher_type string, party_ledger_name string, voucher_date string, taxable_value decimal(18,2), cgst_amount decimal(18,2), sgst_amount decimal(18,2), igst_amount decimal(18,2), total_invoice_value decimal(18,2)")
    legs = ledger.journal_legs(df)
    sides = {r.id: r.side for r in legs.filter("is_party").collect()}
    assert sides == {1: "Dr", 2: "Cr", 3: "Dr", 4: "Cr"} and legs.filter("id = 1").count() == 4
    per_doc = legs.groupBy("id").agg(F.sum(F.when(F.col("side") == "Dr", F.col("amount")).otherwise(-F.col("amount"))).alias("b"))
    assert {r.b for r in per_doc.collect()} == {D("0.00")}
    master = spark.createDataFrame([(" ACME ",)], "name string")
    assert ledger.missing_parties(df.withColumn("party_gstin", F.lit("g")), master).count() == 0
    tries = spark.createDataFrame([("f", 1, "BLOCKED", 5.0), ("f", 2, "ERP_READY", 9.0), ("f", 3, "ERP_READY", 0.0), ("g", 1, "BLOCKED", 5.0), ("g", 2, "NEEDS_REVIEW", 2.0)], "file string, attempt int, recon_status string, variance_total double")
    assert rows(ledger.best_attempt(tries, "file"), "file", "attempt") == [("f", 2), ("g", 2)]


def test_inventory(spark):
    df = spark.createDataFrame([("Sales Invoice/a.pdf",), ("Credit Note/x/Sale Analysis/b.pdf",), ("Sale Analysis/c.pdf",), ("HR/d.pdf",), ("e.XLSX",), ("f.pdf",), ("g.txt",)], "path string")
    assert rows(inventory.classify(df), "name", "document_type") == [("a.pdf", "invoice"), ("b.pdf", "credit_note"), ("d.pdf", "unknown"), ("e.XLSX", "client_sheet"), ("f.pdf", "invoice"), ("g.txt", "unknown")]
    assert rows(inventory.classify(df, purchase=True).filter("name IN ('d.pdf','e.XLSX')"), "name", "document_type") == [("d.pdf", "invoice"), ("e.XLSX", "unknown")]


def test_xml_vouchers(spark, tmp_path):
    (tmp_path / "v.xml").write_text("""<ENVELOPE><VOUCHER><DATE>20240105</DATE><VOUCHERTYPENAME>Purchase</VOUCHERTYPENAME><VOUCHERNUMBER>7</VOUCHERNUMBER><REFERENCE>PI/1</REFERENCE>
    <PARTYLEDGERNAME>Acme</PARTYLEDGERNAME><PARTYGSTIN>URP</PARTYGSTIN><ALLINVENTORYENTRIES.LIST><STOCKITEMNAME>Nut</STOCKITEMNAME><BILLEDQTY>-2</BILLEDQTY><RATE>50</RATE><AMOUNT>-1,000.00</AMOUNT>
    <ACCOUNTINGALLOCATIONS.LIST><LEDGERNAME>Input CGST</LEDGERNAME><AMOUNT>-90</AMOUNT></ACCOUNTINGALLOCATIONS.LIST><ACCOUNTINGALLOCATIONS.LIST><LEDGERNAME>utgst</LEDGERNAME><AMOUNT>-90</AMOUNT></ACCOUNTINGALLOCATIONS.LIST>
    </ALLINVENTORYENTRIES.LIST></VOUCHER><VOUCHER><DATE>20240106</DATE><VOUCHERNUMBER>8</VOUCHERNUMBER></VOUCHER><LEDGER NAME="Acme"><PARENT>Sundry Creditors</PARENT></LEDGER></ENVELOPE>""")
    out = tables.voucher_lines(tables.read_vouchers(spark, str(tmp_path)), "sales")
    assert rows(out, "voucher_date", "invoice_no", "qty", F.col("total_invoice_value").cast("double"), "gstr1_category") == [
        ("2024-01-05", "PI/1", 2.0, 1180.0, "B2C (Small)"), ("2024-01-06", "8", 0.0, 0.0, "B2C (Small)")]
    assert rows(tables.read_ledgers(spark, str(tmp_path)), "name", "parent") == [("Acme", "Sundry Creditors")]


INVOICE = """Supplier: 27AABCM0001A1Z5
Customer Name: Acme
 Ltd Billing Month: June GSTIN: 29AABCM0001A1Z5 Invoice Number: MH001 PAN: AABCM0001A Date of Invoice: 30-06-2026
Buyer 29AABCM0001A1Z5 BBBBB1111B due 15/07/2026
Particulars HSN
A SAAS / Mobile Application x Sub Total 1,000.00
C CBS (Core Banking Solution) 500.00
Grand Total 1,400.00
Taxable Value Central Tax
1,200.00 9% 108.00 9% 108.00 % 0.00
200.00 % 0.00 % 0.00 18% 36.00
Net Cost 1,500.00
Total Cost incl Taxes 1,652.00
Rounding off -0.40
Bank Name ICICI A/C 123456789012"""
NOTE = """Credit Note Number: CR7 Date:
05-06-26
Bill To:
Acme  Ltd Original Invoice Number: MH001
Reason for Credit Note: returned
Total A Soundbox Charges 997319 50 999 2,033.00 998599
Subtotal: 2,033.00
CGST @ 9% -
SGST @ 9%
-
IGST @ 18% 365.94
Rounding off: 0.06
2,399.00
Indian Rupees"""


def docs(spark):
    return spark.createDataFrame([(1, INVOICE, "invoice"), (2, NOTE, "credit_note"), (3, "nothing here", "invoice")], "doc_id int, text string, document_type string")


def test_invoice_text(spark):
    d = docs(spark)
    assert rows(tx.invoice_header(d).filter("doc_id = 1").drop("doc_id")) == [("Acme Ltd", "29AABCM0001A1Z5", "MH001", "30-06-2026", "KARNATAKA")]
    s = tx.gst_summary(d).filter("doc_id = 1").first()
    assert (s.taxable_value, s.cgst_amount, s.igst_amount, s.cgst_rate, s.advance_amount, s.round_off) == (D("1400.00"), D("108.00"), D("36.00"), 9.0, D("100.00"), D("-0.40"))
    lines = tx.template_lines(d)
    assert rows(lines, "particulars", F.col("taxable").cast("double"), F.col("cgst").cast("double")) == [("Core Banking Solution Charges", 500.0, 45.0), ("SaaS/UPI Platform Charges", 900.0, 81.0)]
    found = tx.candidates(d)
    assert rows(tx.resolve_gstins(found), "doc_id", "supplier_gstin", "buyer_gstin") == [(1, "27AABCM0001A1Z5", "29AABCM0001A1Z5")]
    assert rows(found.filter("field = 'pan'"), "value") == [("BBBBB1111B",)]
    assert rows(tx.resolve_dates(found.filter("doc_id = 1")), "invoice_date", "due_date") == [("30-06-2026", "15/07/2026")]
    regions = {r.line_no: r.region for r in tx.line_regions(d).filter("doc_id = 1").collect()}
    assert [regions[i] for i in (0, 4, 6, 7, 14)] == ["metadata", "items_table", "items_table", "totals", "payment"]


def test_single_line_invoice_and_full_advance(spark):
    d = spark.createDataFrame([(1, "A\nOne-off  box 997319 x 250.00\nB\nFinal Total (A) 250.00 Taxable Value Central Tax 250.00 9% 22.50 9% 22.50 % 0.00"),
                               (2, "B Soundbox Charges Sub Total 90.00 Taxable Value Central Tax 0.00 9% 0.00 9% 0.00 % 0.00")], "doc_id int, text string")
    assert rows(tx.template_lines(d), "doc_id", "particulars", "hsn", F.col("taxable").cast("double")) == [(1, "One-off box", "997319", 250.0), (2, "SaaS/UPI Platform Charges", "9971", 0.0)]


def test_credit_note_text(spark):
    d = docs(spark)
    n = tx.credit_notes(d).first()
    assert (n.credit_note_no, n.note_date, n.party_name, n.original_invoice_no, n.hsn, n.igst_rate) == ("CR7", "05-06-26", "Acme Ltd", "MH001", "997319", 18.0)
    assert (n.taxable, n.cgst, n.igst, n.total) == (D("2033.00"), D("0.00"), D("365.94"), D("2399.00"))
    assert rows(tx.document_numbers(d), "doc_id", "doc_no") == [(1, "MH001"), (2, "CR7"), (3, None)]


def test_sheet_first(spark):
    z = D("0")
    cols = "doc_no string, doc_type string, doc_date string, party_name string, saas_net decimal(18,2), transactional_net decimal(18,2), kyc_net decimal(18,2), promotional_net decimal(18,2), late_charges decimal(18,2), soundbox_net decimal(18,2), taxable decimal(18,2), cgst decimal(18,2), sgst decimal(18,2), igst decimal(18,2), total decimal(18,2)"
    sheet = spark.createDataFrame([("CR7", "Credit Note", "d", "P", D("5"), z, z, z, z, z, D("5"), z, z, z, D("5")), ("CR8", "Credit Note", "d", "P", D("5"), z, z, z, z, z, D("6"), z, z, z, D("6")),
                                   ("S1", "Invoice", "d", "P", D("1"), D("2"), z, z, z, z, D("3"), z, z, z, D("3"))], cols)
    got = rows(sheet_first.plan(sheet, docs(spark)), "source_doc_no", "source", "hsn", F.col("taxable_value").cast("double"))
    assert got == [("CR7", "own_document", "997319", 2033.0), ("CR8", "sheet_totals", "NOT SPECIFIED ON INVOICE", 6.0), ("S1", "sheet_sections", "9971", 1.0), ("S1", "sheet_sections", "998599", 2.0)]
    assert rows(sheet_first.gap_documents(docs(spark), sheet), "doc_id", "doc_no") == [(1, "MH001"), (3, None)]


def test_bank_lines(spark):
    d = spark.createDataFrame([(1, "HDFC Bank Account Statement\n01/02/24 UPI 9 pay 1,200.00 5,000.00Cr\n02 Feb 2024 100 x 50.00\n2024-02-03 nothing\nno date 5.00\n04-02-2024 9.00")], "doc_id int, text string")
    assert rows(tx.bank_transactions(d), "line_no", "narration", "debit", "credit", "balance", "confidence", "bank") == [
        (1, "UPI 9 pay", "1200.00", "", "", "SURE", "HDFC"), (2, "100 x", "", "", "50.00", "SURE", "HDFC"), (3, "nothing", "", "", "", "UNCERTAIN", "HDFC"), (5, "BANK TRANSACTION", "", "", "9.00", "SURE", "HDFC")]


def test_bank_line_with_a_marked_amount_has_an_amount(spark):
    d = spark.createDataFrame([(1, "01/02/2024 a 0.00 1,000.00Cr\n02/02/2024 b 0.00\n03/02/2024 c 0.00 0.00Dr\n04/02/2024 d 7.00Dr")], "doc_id int, text string")
    assert rows(tx.bank_transactions(d), "narration", "debit", "balance", "confidence") == [
        ("a", "0.00", "", "SURE"), ("b", "", "0.00", "UNCERTAIN"), ("c", "0.00", "", "UNCERTAIN"), ("d", "", "", "SURE")]
    assert rows(tx.bank_transactions(d, "SURE"), "narration") == [("a",), ("d",)]


def test_candidates_of_some_fields_and_one_reading(spark):
    text = "Supplier 27AABCM0001A1Z5 PAN AABCM0001A\nInvoice No: A-12 date 01-02-2024 due 03-04-2024\nDue 05-06-2024\nto 07AABCF0001A1Z5\nTotal 1,180.00 CGST 90.00"
    d = spark.createDataFrame([(1, text), (2, "from nobody"), (3, "x 29AABCM0001A1Z5\ndate 09-02-2024")], "doc_id int, text string")
    found = tx.candidates(d)
    columns = ("doc_id", "line_no", "field", "value", "keyword", "confidence", "context")
    for fields in (("gstin",), ("pan",), ("invoice_date", "due_date"), ("grand_total", "cgst"), ("invoice_number",)):
        assert rows(tx.candidates(d, fields).filter(F.col("field").isin(*fields)), *columns) == rows(found.filter(F.col("field").isin(*fields)), *columns)
    assert rows(tx.resolve_gstins(found)) == [(1, "27AABCM0001A1Z5", "07AABCF0001A1Z5"), (3, "29AABCM0001A1Z5", None)]
    for out in (tx.resolve_gstins(found), tx.resolve_dates(found)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Scan ExistingRDD") == 1, plan


def test_golden_cases_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"case_id":"p1","document_type":"purchase_invoice","source":"synthetic","fields":{"taxable_value":{"extracted":1000.0,"expected":1000.005,"confidence":0.9},"hsn":{"extracted":"8471","expected":"8517"},"note":{"extracted":null,"expected":null}}}')
    (tmp_path / "b.json").write_text('{"case_id":"p2","fields":{}}')
    cases = spark.read.schema(golden.CASE_SCHEMA).json(str(tmp_path))
    scores = golden.case_scores(golden.graded(golden.fields_of(cases)))
    assert rows(scores, "case_id", "total_fields", "correct_fields", "field_accuracy", "exact_match") == [("p1", 3, 2, 0.6667, False), ("p2", 0, 0, 1.0, True)]
    assert rows(golden.set_score(scores), "total_cases", "document_level_accuracy", "field_level_accuracy") == [(2, 0.5, 0.6667)]


def test_absent_reconciliation_fires_no_flag(spark):
    f = spark.createDataFrame([("b", "f1", 0.9, D("1"), 0, 0, 10), ("b", "f2", 0.5, D("30"), 5, 1, 10)], "batch_id string, file_id string, composite_score double, cost_inr decimal(18,2), corrections int, subtotals_dropped int, raw_items int")
    t = F.lit(True)
    rowset = f.withColumns({"math_balanced": t, "gstin_valid": t, "no_tax_conflict": t, "json_ok": t, "unallocated": F.lit(False), "stage_failed": F.lit(None).cast("string"), "recon_status": F.lit(None).cast("string"), "recon_confidence": F.lit(None).cast("double")})
    assert rows(metrics.file_flags(rowset), "file_id", "flag_id") == [("f2", "COST_SPIKE_PER_FILE"), ("f2", "HIGH_CORRECTION_RATE"), ("f2", "NUMBER_HALLUCINATION_SUSPECTED"), ("f2", "SUBTOTAL_DOUBLE_COUNT_RISK")]
    tenants = spark.createDataFrame([("A",), (None,)], "tenant_id string")
    assert rows(metrics.of_tenant(tenants, None)) == [(None,)] and rows(metrics.of_tenant(tenants, "A")) == [("A",)]


def run(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_streams(spark, tmp_path):
    src = tmp_path / "ev"
    log = spark.createDataFrame([("F1", "system_flag", "HIGH", "X", "2024-01-01 00:10:00"), ("F2", "system_flag", "HIGH", "X", "2024-01-01 00:50:00"), ("F3", "file_done", None, None, "2024-01-01 05:00:00")],
                                "file_id string, event_type string, severity string, flag_id string, t string").select("*", F.col("t").cast("timestamp_ntz").alias("timestamp_utc"))
    log.write.parquet(str(src))
    stream = spark.readStream.schema(log.schema).parquet(str(src))
    counts = run(ev.event_counts(stream), tmp_path, "counts")
    assert rows(counts, F.date_format("window_start", "HH:mm"), "event_type", "n") == [("00:00", "system_flag", 2)]
    replay = spark.createDataFrame([("F2",)], "file_id string")
    assert rows(run(ev.without_replaced(stream, replay), tmp_path, "kept"), "file_id") == [("F1",), ("F3",)]
    docs_src = tmp_path / "docs"
    seen = spark.createDataFrame([("a1", "g", "d"), (" A1", "G", "D "), ("a2", None, "d")], "invoice_no string, party_gstin string, voucher_date string").withColumn("timestamp_utc", ts(NOW))
    seen.write.parquet(str(docs_src))
    first = run(ev.first_sightings(spark.readStream.schema(seen.schema).parquet(str(docs_src))), tmp_path, "first")
    assert rows(first, "invoice_no") == [("A1",), ("A2",)]


def test_sinks_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "triggers")
    sink = sinks.trigger_sink(path, scope(spark), ts(NOW))
    one = gaps(spark, [("G2", "B", "missing_in_2b", D("6"))])
    sink(one, 0)
    sink(gaps(spark, [("G2", "C", "missing_in_2b", D("6"))]), 1)
    sink(gaps(spark, [("G2", "C", "missing_in_2b", D("6"))]), 1)
    last = sinks.read_version(spark, path, sinks.newest_version(spark, path), schemas.GAP_TRIGGERS)
    assert sinks.newest_version(spark, path) == 1 and rows(last, "invoice_no", "status") == [("B", "resolved"), ("C", "queued")]
    # a batch of another epoch, as of a query that starts anew, goes on from the stored state
    sink(gaps(spark, [("G3", "D", "missing_in_2b", D("6"))]), 0)
    last = sinks.read_version(spark, path, sinks.newest_version(spark, path), schemas.GAP_TRIGGERS)
    assert rows(last, "invoice_no", "status") == [("B", "resolved"), ("C", "resolved"), ("D", "queued")]
    got = []
    files = sinks.file_sink(str(tmp_path / "files"), lambda df: got.append(rows(df, "file_id", "change")))
    files(spark.createDataFrame([("f", "m1", 1)], "file_id string, md5 string, seq int"), 0)
    files(spark.createDataFrame([("f", "m1", 1), ("g", "m", 2)], "file_id string, md5 string, seq int"), 1)
    files(spark.createDataFrame([("f", "m2", 1)], "file_id string, md5 string, seq int"), 2)
    assert got == [[("f", "new")], [("g", "new")], [("f", "updated")]]
    push = sinks.push_sink(str(tmp_path / "push"), lambda df: df.select("item_type", "item_id", "company", F.lit("success").alias("status")))
    items = spark.createDataFrame([("s", "1", "C", "ERP_READY"), ("s", "2", "C", "BLOCKED")], "item_type string, item_id string, company string, recon_status string")
    push(items, 0)
    push(items, 1)
    push(items, 0)
    assert sinks.push_log(spark, str(tmp_path / "push")).count() == 1


def test_file_sink_keeps_outcomes_and_streams_restart(spark, tmp_path):
    given = []

    def handle(todo):
        given.append(rows(todo, "file_id", "change"))
        return todo.select("file_id", F.when(F.col("file_id") == "bad", "failed").otherwise("completed").alias("status")).filter("file_id <> 'lost'")

    def run(checkpoint):
        stream = spark.readStream.schema("file_id string, md5 string, seq int").parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(sinks.file_sink(str(tmp_path / "state"), handle)).option("checkpointLocation", str(tmp_path / checkpoint)).start()
        query.processAllAvailable()
        query.stop()

    spark.createDataFrame([("ok", "m", 1), ("bad", "m", 2), ("lost", "m", 3)], "file_id string, md5 string, seq int").write.parquet(str(tmp_path / "in"))
    run("first")
    run("second")  # a new checkpoint: what is completed stays so, the rest comes again
    assert given == [[("bad", "new"), ("lost", "new"), ("ok", "new")], [("bad", "updated"), ("lost", "updated")]]
