import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from khata.operators import cleaning, recon_engine, running, validation

from .conftest import rows

MONEY = "decimal(18,2)"


def test_running_sum_equals_a_plain_window_across_chunks(spark):
    rnd = random.Random(3)
    data = [(k, p, rnd.randint(0, 9)) for k in ("a", None) for p in range(50)]
    df = spark.createDataFrame(data, "k string, p int, v int")
    out = running.running_before(df, ["k"], [F.col("p")], running.chunk_of(F.col("p"), 7), {"before": F.col("v")})
    want = {(k, p): sum(v for kk, pp, v in data if kk == k and pp < p) for k, p, _ in data}
    assert {(r.k, r.p): r.before for r in out.collect()} == want


def trace_subtotals(items):
    out, group = [], []
    for name, value in items:
        if any(w in name.lower() for w in cleaning.SUBTOTAL_WORDS):
            out += group
            if not (group and abs(sum(v for _, v in group) - value) <= 2):
                out.append((name, value))
            group = []
        else:
            group.append((name, value))
    return out + group


def test_subtotals_follow_the_trace(spark):
    rnd = random.Random(11)
    docs = {}
    for d in range(12):
        items, acc = [], 0
        for _ in range(30):
            if rnd.random() < 0.3:
                items.append((rnd.choice(["Sub Total", "GRAND TOTAL", "net amount"]), acc + rnd.choice([0, 2, 3, -2])))
                acc = 0
            else:
                v = rnd.randint(1, 50)
                acc += v
                items.append((f"item{len(items)}", v))
        docs[d] = items
    df = spark.createDataFrame([(d, i, n, D(v)) for d, its in docs.items() for i, (n, v) in enumerate(its)],
                               f"doc int, pos int, particulars string, taxable_value {MONEY}")
    marked = cleaning.mark_subtotals(df, ["doc"], "pos", chunk_rows=4)
    kept = {d: [(r.particulars, int(r.taxable_value)) for r in sorted(marked.filter(f"doc = {d} AND NOT drop_row").collect(), key=lambda r: r.pos)] for d in (0, 5, 11)}
    assert all(kept[d] == trace_subtotals(docs[d]) for d in kept)


def sections(spark, docs):
    data = [(d, p, D(str(t)), D(str(net)), 9.0, 9.0, 0.0) for d, (net, amounts) in docs.items() for p, t in enumerate(amounts)]
    return spark.createDataFrame(data, f"doc int, pos int, taxable {MONEY}, net_taxable {MONEY}, cgst_rate double, sgst_rate double, igst_rate double")


def test_advance_cascades_and_taxes_add_up(spark):
    df = sections(spark, {1: (50, [100, 80, 20]), 2: (200, [100, 80, 20]), 3: (0, [60, 40]), 4: (250, [100, 100]), 5: (99.99, [33.33, 33.33, 33.33])})
    kept = cleaning.cascade_advance(df, ["doc"], "pos")
    got = rows(kept, "doc", "pos", F.col("taxable").cast("double"))
    assert [r for r in got if r[0] == 1] == [(1, 1, 30.0), (1, 2, 20.0)]
    assert [r for r in got if r[0] == 2] == [(2, 0, 100.0), (2, 1, 80.0), (2, 2, 20.0)]
    assert [r for r in got if r[0] == 3] == [(3, 0, 0.0)]
    assert [r for r in got if r[0] == 4] == [(4, 0, 100.0), (4, 1, 100.0)]  # a negative gap takes nothing
    taxed = cleaning.apportion_taxes(kept, ["doc"], "pos").groupBy("doc").agg(F.sum("cgst").alias("c")).collect()
    assert {r.doc: r.c for r in taxed} == {1: D("4.50"), 2: D("18.00"), 3: D("0.00"), 4: D("22.50"), 5: D("9.00")}


def test_sheet_sections(spark):
    names = ", ".join(f"{n} {MONEY}" for n in cleaning.SECTION_HSN)
    z = D("0")
    df = spark.createDataFrame([("A", "Invoice", D("33.33"), D("33.33"), D("33.34"), z, z, z, D("9.00"), D("9.00"), z), ("N", "Credit Note", D("5"), z, z, z, z, z, z, z, z), ("Z", "Invoice", z, z, z, z, z, z, z, z, z)],
                               f"doc_no string, doc_type string, {names}, cgst {MONEY}, sgst {MONEY}, igst {MONEY}")
    out = cleaning.sections_to_lines(df)
    sizes = {r.doc_no: (None if r["items"] is None else len(r["items"])) for r in out.collect()}
    assert sizes == {"A": 3, "N": None, "Z": 0}
    assert cleaning.explode_sections(out).agg(F.sum("cgst")).first()[0] == D("9.00")


def test_tax_recompute(spark):
    cols = f"id int, hsn string, gstr1_category string, taxable_value {MONEY}, cgst_amount {MONEY}, sgst_amount {MONEY}, igst_amount {MONEY}, rate double, total_invoice_value {MONEY}"
    d = D
    df = spark.createDataFrame([(1, "9971", "B2B", d("100"), d("0"), d("0"), d("17"), 0.0, d("0")), (2, "9971", "B2B", d("100"), d("0"), d("0"), d("0"), 0.0, d("0")),
                                (3, "9971", "EXPORT", d("100"), d("5"), d("5"), d("0"), 1.0, d("1")), (4, "8471", "B2B", d("100"), d("0"), d("0"), d("0"), 0.0, d("0")),
                                (5, "8471", "B2B", d("-5"), d("1"), d("1"), d("0"), 7.0, d("9"))], cols)
    got = rows(cleaning.recompute_taxes(df), "id", "rate", *[F.col(c).cast("double") for c in ("cgst_amount", "igst_amount", "total_invoice_value")])
    assert got == [(1, 18.0, 0.0, 18.0, 118.0), (2, 18.0, 9.0, 0.0, 118.0), (3, 0.0, 0.0, 0.0, 100.0), (4, 0.0, 0.0, 0.0, 100.0), (5, 7.0, 1.0, 0.0, 9.0)]


def test_line_sums_prefer_lines(spark):
    cols = f"doc int, taxable_value {MONEY}, cgst_amount {MONEY}, sgst_amount {MONEY}, igst_amount {MONEY}"
    lines = spark.createDataFrame([(1, D("10"), None, None, D("1")), (1, D("5"), D("2"), None, None)], cols)
    ext = spark.createDataFrame([(1, D("99"), D("9"), D("9"), D("9")), (2, D("7"), None, None, None)], cols)
    got = rows(cleaning.line_tax_sums(lines, ext, "doc"), "doc", *[F.col(f"overall_{c}").cast("double") for c in ("taxable_value", "cgst_amount", "igst_amount")])
    assert got == [(1, 15.0, 2.0, 1.0), (2, 7.0, 0.0, 0.0)]


def invoice(spark, lines, printed):
    ls = spark.createDataFrame(lines, f"task_id string, qty double, rate double, discount {MONEY}, advances {MONEY}, taxable_value {MONEY}, cgst_amount {MONEY}, sgst_amount {MONEY}, igst_amount {MONEY}, total_invoice_value {MONEY}")
    sm = spark.createDataFrame(printed, f"task_id string, supplier_gstin string, buyer_gstin string, taxable_value {MONEY}, cgst_amount {MONEY}, sgst_amount {MONEY}, igst_amount {MONEY}, cess_amount {MONEY}, round_off {MONEY}, grand_total {MONEY}")
    return recon_engine.reconcile(ls, sm)


def test_engine_levels(spark):
    d = D
    z = d("0")
    line = lambda t: (t, 1.0, 100.0, z, z, d("100"), d("9"), d("9"), z, d("118"))
    head = ("27AAA", "27BBB")
    rep = invoice(spark, [line(t) for t in "abcd"] + [("e", 2.0, 100.0, z, z, d("100"), d("9"), d("9"), z, d("118")), ("f", 7.0, 18.0, z, z, d("100"), d("9"), d("9"), z, d("118"))], [
        ("a", *head, d("100"), d("9"), d("9"), z, z, z, d("118")),
        ("b", *head, d("100"), d("9"), d("9"), z, z, z, d("200")),
        ("c", *head, d("150"), d("9"), d("9"), z, z, z, d("118")),
        ("d", "27AAA", "29BBB", d("100"), d("9"), d("9"), z, z, z, d("118")),
        ("e", *head, d("100"), d("9"), d("9"), z, z, z, d("118")),
        ("f", *head, d("100"), d("9"), d("9"), z, z, z, d("118"))])
    assert rows(rep, "task_id", "status", "overall_confidence") == [
        ("a", "ERP_READY", 0.99), ("b", "BLOCKED", 0.89), ("c", "ERP_READY", 0.79), ("d", "NEEDS_REVIEW", 0.7), ("e", "NEEDS_REVIEW", 0.99), ("f", "ERP_READY", 0.99)]
    canon = rows(recon_engine.canonical_values(rep).filter("corrected"), "task_id", "field", F.col("value").cast("double"))
    assert canon == [("b", "grand_total", 118.0), ("c", "taxable_value", 100.0)]
    assert rows(recon_engine.review_items(rep), "task_id", "field", "severity") == [("b", "grand_total", "BLOCKER"), ("c", "grand_total", "BLOCKER"), ("c", "taxable_value", "ERROR")]


def base_invoice(spark, **over):
    good = dict(task_id="t", invoice_no="A1", invoice_date="05-01-2024", due_date=None, supplier_gstin="27AABCM0001A1Z5", buyer_gstin="29AABCM0001A1Z5", supplier_state="27",
                buyer_state="29", place_of_supply="29", gstr1_category="B2B", supplier_name="S", buyer_name="B", reg_status=None, reg_changed=None, reg_state=None,
                taxable_value=100.0, cgst_amount=0.0, sgst_amount=0.0, igst_amount=18.0, cess_amount=0.0, round_off=0.0, grand_total=118.0, rates_ok=True)
    good.update(over)
    types = {"task_id": "string", "rates_ok": "boolean", "reg_changed": "string"}
    schema = ", ".join(f"{k} {types.get(k, 'double' if isinstance(v, float) else 'string')}" for k, v in good.items())
    df = spark.createDataFrame([tuple(good.values())], schema).withColumn("reg_changed", F.to_date("reg_changed"))
    rules = validation.standard_rules(F.lit("2024-06-01").cast("date"))
    return validation.scores(df, rules).first(), {r.rule_id: r for r in validation.rule_results(df, rules).collect()}


def test_rules(spark):
    s, r = base_invoice(spark)
    assert (s.score, s.overall_status, len(r)) == (100.0, "ERP_READY", 17) and r["GST_005"].status == "SKIPPED"
    s, r = base_invoice(spark, supplier_gstin="bad")
    assert s.overall_status == "BLOCKED" and r["GST_002"].skipped_by_dependency and not r["GST_002"].passed
    assert s.failed_rules == ["GST_001", "GST_002", "GST_003"] and s.score == 100 - 15 - 8 - 8
    s, _ = base_invoice(spark, invoice_date="2025/01/01")
    assert s.failed_rules == ["INV_003"] and s.overall_status == "NEEDS_REVIEW"
    s, _ = base_invoice(spark, due_date="01 Jan 2024")
    assert s.failed_rules == ["INV_004"]
    s, r = base_invoice(spark, reg_status="Cancelled")
    assert (r["GST_005"].status, s.score, s.overall_status, s.gst_status) == ("NEEDS_REVIEW", 97.0, "ERP_READY", "FAILED")
    assert base_invoice(spark, reg_status="Cancelled", reg_changed="2024-02-01")[1]["GST_005"].status == "PASS"
    assert base_invoice(spark, reg_status="Cancelled", reg_changed="2023-12-01")[1]["GST_005"].status == "FAIL"
    assert base_invoice(spark, reg_status="Active", reg_state="07")[1]["GST_005"].status == "FAIL"
    s, _ = base_invoice(spark, grand_total=121.0)
    assert s.failed_rules == ["MATH_001"] and s.math_status == "FAILED"
    s, _ = base_invoice(spark, gstr1_category="B2CL")
    assert s.failed_rules == ["CLASS_003"]
    s, _ = base_invoice(spark, place_of_supply=None)
    assert s.failed_rules == []


def test_registry_with_a_gstin_twice(spark):
    g = "27AABCM0001A1Z5"
    inv = spark.createDataFrame([(1, 10, g), (2, 20, g), (3, 30, g), (4, 10, None)], "id int, party int, buyer_gstin string")
    reg = spark.createDataFrame([(10, g, "Active", None, "27"), (20, g, "Cancelled", "1997-06-30", "06")], "party int, gstin string, status string, d string, state_code string")
    reg = reg.select("*", F.col("d").cast("date").alias("status_change_date"))
    assert rows(validation.with_registry(inv, reg, "party"), "id", "reg_status", "reg_state") == [
        (1, "Active", "27"), (2, "Cancelled", "06"), (3, None, None), (4, None, None)]
    assert rows(validation.with_registry(inv, reg), "id", "reg_status") == [(1, "Active"), (2, "Active"), (3, "Active"), (4, None)]


def test_slab_rule(spark):
    df = spark.createDataFrame([("a", D("100"), D("18.54")), ("b", D("100"), D("18.56")), ("c", D("0"), D("5"))], f"t string, taxable_value {MONEY}, igst_amount {MONEY}")
    lines = df.withColumns({c: F.lit(0).cast(MONEY) for c in ("cgst_amount", "sgst_amount")})
    assert rows(validation.line_rates_ok(lines, "t")) == [("a", True), ("b", False), ("c", True)]
