import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from khata import schemas
from khata.operators import gstr2b
from khata.operators.assign import assign_in_order

from .conftest import rows

G = "29AAAAA0000A1Z5"


def books(spark, data):
    return gstr2b.normalise_books(spark.createDataFrame(
        [(i, g, n, D(str(t))) for i, (g, n, t) in enumerate(data)],
        "seq int, party_gstin string, invoice_no string, taxable_value decimal(18,2)"))


def statement(spark, data):
    df = spark.createDataFrame([(i, g, n, D(str(t))) for i, (g, n, t) in enumerate(data)],
                               "seq int, gstin string, inv_no string, total_val decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    key = F.concat_ws("||", "gstin", F.regexp_replace(F.upper("inv_no"), "[^A-Z0-9]", ""))
    return df.select("*", F.lit("01-01-2024").alias("inv_date"), F.col("total_val").alias("taxable_val"),
                     zero.alias("igst"), zero.alias("cgst"), zero.alias("sgst"), key.alias("norm_key"))


def test_exact_tolerance_and_statuses(spark):
    b = books(spark, [(G, "INV/1", 100), (G, "inv-1", 50), (G, "I2", 100), (G, "I3", 100), (G, "LONE9", 7)])
    s = statement(spark, [(G, "INV1", 152.0), (G, "I2", 102.01), (G, "I3", 100), (G, "EXTRA", 5), (G, "I3", 999)])
    r = gstr2b.Reconciliation(b, s)
    got = rows(r.rows, "supplier_inv", "recon_status", F.col("diff_amount").cast("double"))
    assert got == [("I2", "mismatch", -2.01), ("I3", "matched", 0.0), ("INV/1", "matched", -2.0), ("LONE9", "missing_in_2b", None), ("inv-1", "matched", -2.0)]
    # the later copy of an exactly matched key is not left over
    assert rows(r.extra, "supplier_inv") == [("EXTRA",)]
    summary = r.summary.first()
    assert (summary.n_matched, summary.n_mismatch, summary.n_missing_in_2b, summary.n_not_in_books, summary.total_rows) == (3, 1, 1, 1, 6)
    cap = gstr2b.rule_36_4(r.summary).first()
    assert (cap.cap, cap.total_claimed, cap.excess, cap.breached) == (D("262.50"), D("357.00"), D("94.50"), True)


def test_fuzzy_truncation_zeros_and_copies(spark):
    b = books(spark, [(G, "SI2024001", 100), (G, "0007", 20), (G, "ABC", 30)])
    s = statement(spark, [(G, "2024001", 101), (G, "2024001", 101), (G, "7", 21), (G, "ABCD", 30)])
    r = gstr2b.Reconciliation(b, s)
    got = rows(r.rows, "supplier_inv", "recon_status", "fuzzy_matched")
    assert got == [("0007", "matched", True), ("ABC", "missing_in_2b", False), ("SI2024001", "matched", True)]
    # only the used record leaves; its copy stays
    assert rows(r.extra, "supplier_inv") == [("2024001",), ("ABCD",)]


def test_blank_identifiers_still_match(spark):
    r = gstr2b.Reconciliation(books(spark, [(None, "X1", 10), (None, None, 3)]), statement(spark, [("", "X1", 10)]))
    assert rows(r.rows, "supplier_inv", "recon_status") == [("", "missing_in_2b"), ("X1", "matched")]


def greedy(invoices, records):
    def fuzzy(a, b):
        if not a or not b or a == b:
            return False
        if len(a) >= 4 and len(b) >= 4 and (a in b or b in a):
            return True
        return bool(a.lstrip("0")) and a.lstrip("0") == b.lstrip("0")

    free, out = list(range(len(records))), {}
    for i, (n, t) in enumerate(invoices):
        for j in free:
            if fuzzy(n, records[j][0]) and abs(t - records[j][1]) <= 2:
                out[i] = j
                free.remove(j)
                break
    return out


def test_fuzzy_equals_going_through_the_list(spark):
    rnd = random.Random(7)
    stems = ["1234", "12345", "2345", "012345", "0012345", "91234", "1234567", "23456"]
    inv = list(dict.fromkeys((rnd.choice(["A", "B", ""]) + rnd.choice(stems) + rnd.choice(["", "0", "9"])) for _ in range(40)))
    invoices = [(n, rnd.randint(100, 104)) for n in inv]
    records = [(rnd.choice(["", "Z", "A"]) + rnd.choice(stems), rnd.randint(100, 104)) for _ in range(40)]
    taken = {n for n, _ in invoices}
    records = [r for r in records if r[0] not in taken]
    b = books(spark, [(G, n, t) for n, t in invoices])
    s = statement(spark, [(G, n, t) for n, t in records])
    r = gstr2b.Reconciliation(b, s)
    got = {x.first_seq: x.rec_seq for x in r.fuzzy.select("first_seq", "rec_seq").collect()}
    assert got == greedy(invoices, records) and len(got) > 5
    # nothing is lost: every books line and every record has exactly one outcome
    assert r.rows.count() == len(invoices) and r.extra.count() == len(records) - len(got)


def test_assignment_follows_arrival(spark):
    pairs = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (4, 1)], "l int, r int")
    assert rows(assign_in_order(pairs, "l", "r"), "l", "r") == [(1, 1), (2, 2), (3, 3)]


def test_assignment_of_cliques_and_chains(spark):
    """No rounds: a block in which all are related, and one where each waits for the one before."""
    clique = [("c", i, j) for i in range(200) for j in range(200)]
    chain = [("d", i, j) for i in range(200) for j in (i, i + 1)]
    pairs = spark.createDataFrame(clique + chain + [(None, 5, 5), (None, 6, 5)], "g string, l int, r int").repartition(7)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    got = assign_in_order(pairs, "l", "r", within=("g",)).collect()
    assert sorted(map(tuple, got)) == sorted([(i, i) for i in range(200)] * 2 + [(5, 5)])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) <= 4


def test_statement_shapes(spark, tmp_path):
    docs = [
        '{"gstin":"short","data":{"gstin":" 29bbbbb0000b1z5 ","docdata":{"b2b":[{"ctin":"29-aaa","inv":[{"inum":"A/1","dt":"01-04-2024","val":118,"itms":[{"itm_det":{"txval":60,"iamt":10.8}},{"itm_det":{"taxable_val":40,"igst":7.2}}]},{"inum":" ","val":5}]}]}}}',
        '{"docdata":{"b2b":[{"gstin":"G2","invoices":[{"inv_no":"B1","total_val":50}]}]}}',
        '{"b2b":[{"ctin":"G3","inv":[{"invNo":"C1","items":[{"txval":10,"cgst":0.9,"sgst":0.9}]}]}]}']
    for i, text in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(text)
    from khata.sources.tables import read_statements
    raw = read_statements(spark, str(tmp_path))
    got = rows(gstr2b.parse_statement(raw).select("gstin", "inv_no", *[F.col(c).cast("double") for c in ("taxable_val", "igst", "total_val")], "norm_key"))
    assert got == [("29AAA", "A/1", 100.0, 18.0, 118.0, "29AAA||A1"), ("G2", "B1", 50.0, 0.0, 50.0, "G2||B1"), ("G3", "C1", 10.0, 0.0, 11.8, "G3||C1")]
    assert rows(gstr2b.recipient_gstin(raw), "recipient_gstin") == [("29BBBBB0000B1Z5",), (None,), (None,)]
    assert "statement_id string" in schemas.GSTR2B_STATEMENT


def test_missing_lines_are_the_missing_part_of_all_rows(spark):
    """From slim books too, and with lines of one key that are spelled differently."""
    b = books(spark, [(G, "A/100", 10), (G, "a-100", 20), (G, "SI2024001", 100), (G, "B7", 5), (None, None, 3), (G, "B 7", 6)])
    s = statement(spark, [(G, "2024001", 101), (G, "B7", 500)])
    columns = ("supplier_inv", "gst_no", "recon_status", "seq", F.col("total_amount").cast("double"))
    slim = b.select("seq", "norm_key", "gst_no", "supplier_inv", "amount", "total_amount")
    wanted = rows(gstr2b.Reconciliation(b, s).rows.where("recon_status = 'missing_in_2b'"), *columns)
    assert [w[0] for w in wanted] == ["", "A/100", "a-100"]
    for given in (b, slim):
        r = gstr2b.Reconciliation(given, s)
        assert rows(r.missing_lines, *columns) == wanted
        assert rows(r.extra, "supplier_inv") == []
    assert gstr2b.books_by_invoice(slim).columns == ["norm_key", "amount", "total_amount", "n_lines", "supplier_inv", "gst_no", "first_seq"]


def test_only_pieces_that_can_meet_are_made(spark):
    number, lengths = F.lit("PI0000123456"), F.array(F.lit(11))
    made = spark.range(1).select(gstr2b._tokens(number, "w", "p", lengths).alias("t")).first().t
    assert sorted(made) == ["0:PI0000123456", "p:I0000123456", "p:PI000012345", "w:PI0000123456"]


def test_trigger_gaps_do_not_read_the_books_again(spark):
    from suite import q_ops

    gaps = q_ops._gaps(spark, "/root/testdata/sf0.001")
    assert not [f for f in gaps.inputFiles() if "lineitem" in f or "orders" in f]
