"""Invoices as nested documents: the canonical form and the text of the return."""

import json
import os
from decimal import Decimal as D

from pyspark.sql import functions as F

from khata import schemas
from khata.operators import canonical, gstr1, layouts, return_document
from khata.sources import tables

from .conftest import rows

G1, G2 = "27AAAAA0000A1Z5", "06BBBBB0000B1Z5"


def line(seq, number, **more):
    base = {
        "task_id": "t", "batch_id": "b", "tenant_id": "x", "seq": seq, "voucher_date": "05-04-2024", "voucher_type": "Sales", "invoice_no": number,
        "party_ledger_name": "P", "party_gstin": G1, "place_of_supply": "27-MH", "particulars": "item", "hsn": "8471", "qty": 1.0, "rate": 18.0,
        "taxable_value": D("100.00"), "discount": None, "advances": None, "cgst_amount": D("0"), "sgst_amount": D("0"), "igst_amount": D("18.00"),
        "total_invoice_value": D("118.00"), "gstr1_category": "B2B", "narration": None}
    return base | more


def sales(spark, lines):
    return spark.createDataFrame(lines, schemas.SALES_LINES)


LINES = [
    line(1, "A1"), line(2, "A1", taxable_value=D("50.00"), igst_amount=D("9.00"), total_invoice_value=D("59.00")),
    line(3, "A2", party_gstin=G2, party_ledger_name='Q "quoted"'), *[line(10 + i, f"M{i:03}") for i in range(40)],
    line(60, "C1", voucher_type="Credit Note", total_invoice_value=D("11.80"), taxable_value=D("10.00"), igst_amount=D("1.80")),
    line(61, "N1", voucher_type="Debit Note", party_gstin=None), line(62, "U1", party_gstin=None, gstr1_category="B2CS", place_of_supply="07"),
    line(63, "U2", party_gstin=None, gstr1_category="B2CS", place_of_supply="07"), line(64, "L1", party_gstin=None, gstr1_category="B2CL", total_invoice_value=D("300000")),
    line(65, "E1", party_gstin=None, gstr1_category="EXP", igst_amount=D("0"), total_invoice_value=D("0")),
    line(66, "E2", party_gstin=None, gstr1_category="EXP", hsn=""), line(67, "Z1", gstr1_category="NIL_EXEMPT", party_gstin=None, igst_amount=D("0")),
]


def read_back(spark, path):
    """The JSON document of each registration: its files joined in order of their names."""
    out = {}
    for folder in sorted(os.listdir(path)):
        if "=" in folder:
            files = sorted(f for f in os.listdir(f"{path}/{folder}") if f.startswith("part-"))
            out[folder.split("=")[1]] = json.loads("".join(open(f"{path}/{folder}/{f}", encoding="utf-8").read() for f in files)), len(files)
    return out


def test_return_is_one_json_document(spark, tmp_path):
    lines = sales(spark, LINES).withColumn("registration", F.lit("07X")).unionByName(sales(spark, LINES[:2]).withColumn("registration", F.lit("08Y")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return_document.write_returns(return_document.return_rows(lines, "07"), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    docs = read_back(spark, str(tmp_path / "out"))
    doc, n_files = docs["07X"]
    assert n_files > 1 and list(doc) == ["gstin", "fp", "gt", "cur_gt", "b2b", "b2cl", "b2cs", "exp", "cdnr", "cdnur", "nil", "hsn", "doc", "_summary"]
    assert doc["gstin"] == "07X" and doc["fp"] == "042024" and doc["gt"] == doc["cur_gt"]
    assert {c["ctin"]: [i["inum"] for i in c["inv"]] for c in doc["b2b"]} == {G1: ["A1", *(f"M{i:03}" for i in range(40))], G2: ["A2"]}
    first = [c for c in doc["b2b"] if c["ctin"] == G1][0]["inv"][0]
    assert first == {"inum": "A1", "idt": "05-04-2024", "val": 177.0, "pos": "27", "rchrg": "N", "inv_typ": "R",
                     "itms": [{"num": 1, "itm_det": {"txval": 150.0, "rt": 18.0, "iamt": 27.0, "camt": 0.0, "samt": 0.0, "csamt": 0.0}}]}
    assert doc["b2cl"][0]["pos"] == "27" and [i["inum"] for i in doc["b2cl"][0]["inv"]] == ["L1"]
    assert doc["b2cs"] == [{"sply_tp": "INTRA", "pos": "07", "typ": "OE", "rt": 18.0, "txval": 200.0, "iamt": 36.0, "camt": 0.0, "samt": 0.0, "csamt": 0.0}]
    assert {e["exp_typ"]: [i["inum"] for i in e["inv"]] for e in doc["exp"]} == {"WOPAY": ["E1"], "WPAY": ["E2"]}
    assert [(n["ntty"], n["nt_num"]) for n in doc["cdnr"][0]["nt"]] == [("C", "C1")] and [(n["ntty"], n["nt_num"], n["typ"]) for n in doc["cdnur"]] == [("D", "N1", "INTER")]
    assert [n["sply_ty"] for n in doc["nil"]["inv"]] == ["INTRB2B", "INTRB2C"] and doc["nil"]["inv"][1]["expt_amt"] == 100.0
    assert [h["num"] for h in doc["hsn"]["data"]] == [1, 2] or [h["num"] for h in doc["hsn"]["data"]] == [1]
    assert [x["docs"][0]["totnum"] for x in doc["doc"]["docdet"]] == [42 + 1 + 1 + 2, 2]
    assert doc["_summary"]["sections_with_data"] == ["b2b", "b2cl", "b2cs", "exp", "cdnr", "cdnur"]
    small, _ = docs["08Y"]
    assert small["b2cs"] == [] and small["cdnr"] == [] and [i["inum"] for i in small["b2b"][0]["inv"]] == ["A1"]


def test_canonical_there_and_back(spark):
    nulls = dict(party_ledger_name=None, party_gstin=None, place_of_supply=None, voucher_date=None, invoice_no=None, hsn=None, particulars=None, qty=None, rate=None, gstr1_category=None)
    lines = [*LINES[:4], line(70, "X", task_id="n", **{k: v for k, v in nulls.items() if k != "invoice_no"}), line(71, None, task_id=None, taxable_value=None, igst_amount=None)]
    data = sales(spark, lines)
    key = ("task_id", "invoice_no")
    nested = canonical.to_canonical(data, canonical.SALES, key, part_lines=1)
    assert nested.groupBy(*key).agg(F.max("n_parts").alias("n"), F.count("*").alias("rows")).where("rows > n").count() == 0
    columns = ["task_id", "invoice_no", "seq", *[c for c in canonical.HEAD if c != "invoice_no"], "particulars", "hsn", "qty", "rate", "discount", "taxable_value", "igst_amount", "gstr1_category"]
    back = canonical.to_lines(nested, canonical.SALES, key)
    assert rows(back, *columns) == rows(data, *columns)
    blank = canonical.to_lines(nested, canonical.SALES, key, blanks=True).where("seq = 70").first()
    assert (blank["party_gstin"], blank["hsn"], blank["qty"], blank["discount"], blank["voucher_type"]) == ("", "", None, D("0.00"), "Sales")


def test_canonical_head_totals_and_provenance(spark):
    data = sales(spark, [line(2, "B", party_ledger_name="later", taxable_value=D("5.00")), line(1, "A", taxable_value=None), line(3, "C", task_id=None)])
    got = {r["task_id"]: r for r in canonical.to_canonical(data.withColumn("itc_eligibility", F.lit("YES")), canonical.PURCHASE).collect()}
    doc = got["t"]
    assert doc["invoice_metadata"]["invoice_number"]["value"] == "A" and doc["supplier"]["legal_name"]["value"] == "P" and doc["buyer"]["name"]["value"] == canonical.OWN_NAME
    assert doc["tax_summary"]["taxable_value"]["value"] == D("5.00") and [i["seq"] for i in doc["line_items"]] == [1, 2]
    said = doc["line_items"][0]["hsn_sac"]["confidence"]
    assert (said["score"], said["source"], said["verified"]) == (1.0, "Database", True)
    assert got[None]["invoice_metadata"]["invoice_number"]["value"] == "C" and doc["classification"]["gstr1_category"] == "YES"


def test_layout_memory(spark):
    stored = spark.createDataFrame([(1, "V", ["Qty", "Rate "], [1.0, 2.0], {"a": "b"}, "p1"), (2, "W", ["rate", "qty"], [2.0, 1.0], {"a": "c"}, "p2")],
                                   "seq int, vendor string, headers array<string>, coordinates array<double>, semantic_mapping map<string,string>, accepted_path string")
    probes = spark.createDataFrame([(1, ["QTY", "rate"], [1.0, 2.0]), (2, ["qty"], [1.0])], "n int, headers array<string>, coordinates array<double>")
    got = layouts.look_up(probes, layouts.remember(stored))
    assert rows(got, "n", "vendor", "accepted_path", "known") == [(1, "W", "p2", True), (2, None, None, False)]


def test_ledger_fields(spark, tmp_path):
    (tmp_path / "l.xml").write_text(
        '<E><LEDGER NAME="Acme"><PARENT>Sundry</PARENT><LEDGERGSTREGISTRATIONNUMBER>27X</LEDGERGSTREGISTRATIONNUMBER><OPENINGBALANCE>-1,200.50</OPENINGBALANCE></LEDGER>'
        '<LEDGER NAME="ignored"><NAME>Own</NAME><PARTYGSTIN>06Y</PARTYGSTIN><OPENINGBALANCE>none</OPENINGBALANCE></LEDGER></E>')
    assert rows(tables.read_ledgers(spark, str(tmp_path)), "name", "parent", "gstin", F.col("opening_balance").cast("double")) == [("Acme", "Sundry", "27X", -1200.5), ("Own", "", "06Y", 0.0)]
    assert gstr1.SECTIONS[0] == "B2B"
