"""Text extraction over invoice texts written from the driver tables, and over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.functions.common import money
from khata.functions.dates import first_date_in
from khata.functions.ids import amount_rejected_as_hsn, normalize_id
from khata.functions.score import evidence_score
from khata.functions.tax import dec, simple_audit_category
from khata.functions.texts import export_marker, header_label, layout_fingerprint, sanitize_amount, sanitize_text, usable_text_layer
from khata.operators import sheet_first, state, text_extract as tx

from .registry import query
from .tables import FIRM_GSTIN, read, sales_lines
from .util import d


def _orders(spark, sf):
    """Figures of one order as its printed invoice shows them."""
    lines = sales_lines(spark, sf, part=False)
    slot = F.col("line") % 3
    return lines.groupBy("okey", "ckey", "original_no", "party_ledger_name", "party_gstin", "o_orderdate", "party_state").agg(
        *[money(F.sum(F.when(slot == i, F.col("taxable_value")).otherwise(0))).alias(n) for i, n in ((1, "a"), (2, "b"), (0, "c"))],
        *[money(F.sum(f"{s}_amount")).alias(s) for s in ("cgst", "sgst", "igst")],
        money(F.sum("taxable_value")).alias("whole"))


def _fmt(c):
    return F.format_number(c, 2)


def _net():
    """Net taxable: orders divisible by four paid 12.34 in advance."""
    return F.when((F.col("okey") % 4 == 0) & (F.col("whole") > 20), F.col("whole") - dec("12.34")).otherwise(F.col("whole"))


def invoice_texts(spark, sf):
    o = _orders(spark, sf)
    home = F.col("party_state") == "07"
    net = money(_net())
    half, full = F.round(net * dec("0.09"), 2), F.round(net * dec("0.18"), 2)
    zero = F.lit("0.00")
    tax_row = F.concat(
        _fmt(net), F.when(home, " 9% ").otherwise(" % "), F.when(home, _fmt(half)).otherwise(zero),
        F.when(home, " 9% ").otherwise(" % "), F.when(home, _fmt(half)).otherwise(zero),
        F.when(home, " % ").otherwise(" 18% "), F.when(home, zero).otherwise(_fmt(full)))
    date = F.date_format("o_orderdate", "dd-MM-yyyy")
    text = F.concat(
        F.lit("TAX INVOICE\nSupplier "), F.lit(FIRM_GSTIN), F.lit(" PAN AABCF0001A\nCustomer Name: "), "party_ledger_name",
        F.lit(" Billing Month: "), F.date_format("o_orderdate", "MMM yyyy"), F.lit("\nGSTIN: "),
        F.coalesce(F.nullif(normalize_id(F.col("party_gstin")), F.lit("")), F.lit("NA")), F.lit(" Invoice Number: "), "original_no",
        F.lit(" PAN: ZZZZZ9999Z Date of Invoice: "), date, F.lit("\nDue date 31-12-2002\nParticulars HSN Qty Amount\n"),
        F.when(F.col("a") > 0, F.concat(F.lit("A SAAS / Mobile Application 9971 Sub Total "), _fmt("a"), F.lit("\n"))).otherwise(""),
        F.when(F.col("b") > 0, F.concat(F.lit("B Soundbox Charges 997319\nSub Total "), _fmt("b"), F.lit("\n"))).otherwise(""),
        F.when(F.col("c") > 0, F.concat(F.lit("D Transactional Messages 998599 Sub Total 10 5 0 "), _fmt("c"), F.lit("\n"))).otherwise(""),
        F.lit("Grand Total "), _fmt(net), F.lit("\nTaxable Value Rate Central Tax Rate State Tax Rate Integrated Tax\n"), tax_row,
        F.lit("\nFinal Total (A+B+D) "), _fmt(net), F.lit("\nNet Cost "), _fmt("whole"), F.lit("\nTotal Cost incl Taxes "),
        _fmt(net + F.when(home, half + half).otherwise(full)), F.lit("\nRounding off 0.00\nBank Name: State Bank A/C 123456789012 IFSC SBIN0123456"))
    return o.select(F.col("okey").alias("doc_id"), text.alias("text"))


_TX = """ox AS (SELECT okey, min(original_no) AS no, min(party_ledger_name) AS nm, min(party_gstin) AS pg, min(o_orderdate) AS od,
   min(party_state) AS ps, coalesce(upper(replace(min(party_gstin),'-','')),'NA') AS gst,
   sum(CASE WHEN line%3=1 THEN taxable_value ELSE 0 END) AS a, sum(CASE WHEN line%3=2 THEN taxable_value ELSE 0 END) AS b,
   sum(CASE WHEN line%3=0 THEN taxable_value ELSE 0 END) AS c, sum(taxable_value) AS whole FROM sales GROUP BY 1),
 ot AS (SELECT *, CASE WHEN okey%4=0 AND whole>20 THEN whole-12.34 ELSE whole END AS net FROM ox),
 oy AS (SELECT *, CASE WHEN ps='07' THEN round(net*0.09,2) ELSE 0 END AS cg, CASE WHEN ps='07' THEN 0 ELSE round(net*0.18,2) END AS ig FROM ot)"""


@query(f"""WITH {_TX} SELECT okey AS doc_id, CASE WHEN gst<>'NA' THEN nm END AS party_name, nullif(gst,'NA') AS party_gstin,
  CASE WHEN gst<>'NA' THEN no END AS invoice_no, CASE WHEN gst<>'NA' THEN strftime(od,'%d-%m-%Y') END AS voucher_date FROM oy""", "sales")
def invoice_headers(spark, sf):
    return tx.invoice_header(invoice_texts(spark, sf)).drop("place_of_supply")


@query(f"""WITH {_TX} SELECT okey AS doc_id, net::DOUBLE AS taxable_value, cg::DOUBLE AS cgst_amount, ig::DOUBLE AS igst_amount,
  CASE WHEN ps='07' THEN 9 ELSE 0 END::DOUBLE AS cgst_rate, CASE WHEN ps='07' THEN 0 ELSE 18 END::DOUBLE AS igst_rate,
  net::DOUBLE AS final_total, whole::DOUBLE AS net_cost, (net+2*cg+ig)::DOUBLE AS total_invoice_value,
  CASE WHEN whole-net>0.5 THEN whole-net END::DOUBLE AS advance_amount FROM oy""", "sales")
def gst_summaries(spark, sf):
    out = tx.gst_summary(invoice_texts(spark, sf))
    return out.select("doc_id", *d("taxable_value cgst_amount igst_amount"), "cgst_rate", "igst_rate",
                      *d("final_total net_cost total_invoice_value advance_amount"))


@query(f"""WITH {_TX}, s AS (SELECT okey, ps, net, whole, 0 AS pos, a AS t, '9971' AS hsn FROM oy WHERE a>0
   UNION ALL SELECT okey, ps, net, whole, 1, b, '997319' FROM oy WHERE b>0
   UNION ALL SELECT okey, ps, net, whole, 3, c, '998599' FROM oy WHERE c>0),
 k AS (SELECT *, t - CASE WHEN row_number() OVER (PARTITION BY okey ORDER BY t DESC, pos)=1 THEN least(t, whole-net) ELSE 0 END AS left_t
   FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY okey ORDER BY pos DESC) AS back, round(left_t*CASE WHEN ps='07' THEN 0 ELSE 18 END*0.01,2) AS i
   FROM k WHERE left_t>0.005)
 SELECT okey AS doc_id, pos::BIGINT AS pos, hsn, left_t::DOUBLE AS taxable,
  (CASE WHEN back=1 THEN round(net*CASE WHEN ps='07' THEN 0 ELSE 18 END*0.01,2)-(sum(i) OVER (PARTITION BY okey)-i) ELSE i END)::DOUBLE AS igst
 FROM r""", "sales")
def template_lines(spark, sf):
    out = tx.template_lines(invoice_texts(spark, sf))
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "hsn", *d("taxable igst"))


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _matches(pattern: str) -> str:
    """All whole matches of a pattern in a line, which its \\b keep apart from ASCII letters."""
    return f"regexp_extract_all(line, '{pattern}')"


def _detected(lines: str) -> str:
    """All detectors over ``lines`` (doc_id, i, line), as CTEs that end in ``found``: seq is (detector, i, word, n)."""
    def per_word(name: str, words: dict[str, str]) -> str:
        values = ", ".join(f"({k}, '{w}', '{f}')" for k, (w, f) in enumerate(words.items()))
        return f"{name}(word_no, word, field) AS (VALUES {values})"

    def numbers(detector: int, table: str, pattern: str, drop: str, confidence: float) -> str:
        return f"""SELECT doc_id, i, field, replace(x.v, '{drop}', '') AS value, word AS keyword, {confidence}::DOUBLE AS confidence, {detector} AS detector, word_no, x.n
   FROM (SELECT *, unnest(list_transform({_matches(pattern)}, lambda v, n: {{'v': v, 'n': n}})) AS x FROM low JOIN {table} ON contains(low, word))"""

    def all_of(detector: int, order: int, pattern: str, field: str, keyword: str, confidence: str) -> str:
        return f"""SELECT doc_id, i, {field} AS field, x.v AS value, {keyword} AS keyword, {confidence}::DOUBLE AS confidence, {detector} AS detector, {order} AS word_no, x.n AS n
   FROM (SELECT *, unnest(list_transform({_matches(pattern)}, lambda v, n: {{'v': v, 'n': n}})) AS x FROM low)"""

    seller, buyer = _any("low", tx.SELLER_WORDS), _any("low", tx.BUYER_WORDS)
    due = "contains(low, 'due')"
    return f"""low AS (SELECT doc_id, i, line, lower(line) AS low FROM {lines}),
 {per_word("tax_words", tx.TAX_FIELDS)}, {per_word("total_words", tx.TOTAL_FIELDS)}, {per_word("invoice_words", dict.fromkeys(tx.INVOICE_WORDS, "invoice_number"))},
 owned AS (SELECT doc_id, substr(unnest({_matches(tx.GSTIN_IN_LINE)}), 3, 10) AS pan, i FROM low),
 first_owned AS (SELECT doc_id, pan, min(i) AS since FROM owned GROUP BY 1, 2),
 found AS (
  {all_of(0, 0, tx.GSTIN_IN_LINE, "'gstin'", f"CASE WHEN {seller} THEN 'supplier' WHEN {buyer} THEN 'buyer' END", f"(CASE WHEN {seller} THEN 0.95 WHEN {buyer} THEN 0.9 ELSE 0.8 END)")}
  UNION ALL SELECT p.* FROM ({all_of(0, 1, tx.PAN_IN_LINE, "'pan'", "NULL", "0.7")}) p
   LEFT JOIN first_owned o ON o.doc_id=p.doc_id AND o.pan=p.value AND o.since<=p.i WHERE o.pan IS NULL
  UNION ALL SELECT doc_id, i, field, v, word, 0.85, 1, word_no, 1 FROM (SELECT *,
    regexp_extract(substr(line, instr(low, word) + length(word)), '^[:\\-\\s#]*([a-zA-Z0-9/\\-_]+)', 1) AS v FROM low JOIN invoice_words ON contains(low, word)) WHERE length(v) >= 3
  UNION ALL {numbers(2, "tax_words", tx.TAX_NUMBER, "%", 0.75)}
  UNION ALL {numbers(3, "total_words", tx.TOTAL_NUMBER, ",", 0.8)}
  UNION ALL {all_of(4, 0, tx.IFSC_IN_LINE, "'ifsc'", "NULL", "0.9")}
  UNION ALL {all_of(4, 1, tx.DATE_IN_LINE, f"CASE WHEN {due} THEN 'due_date' ELSE 'invoice_date' END", f"CASE WHEN {due} THEN 'due date' ELSE 'date' END", "0.8")}
  UNION ALL SELECT doc_id, i, 'bank_account', v, 'account', 0.7, 4, 2, 1 FROM (SELECT *, regexp_extract(line, '\\b\\d{{9,18}}\\b') AS v FROM low
    WHERE {_any("low", ("a/c", "account", "bank"))}) WHERE v<>'')"""


_MONEY = "format('{{:,.2f}}', ({0})::DOUBLE)"
_PRINTED = f"""oz AS (SELECT *, ps='07' AS home, CASE WHEN ps='07' THEN {_MONEY.format("round(net*0.09,2)")} ELSE '0.00' END AS half_text,
   CASE WHEN ps='07' THEN '0.00' ELSE {_MONEY.format("round(net*0.18,2)")} END AS full_text FROM oy),
 printed AS (SELECT okey AS doc_id, unnest(t) AS line, unnest(range(len(t))) AS i FROM (SELECT okey, list_filter([
   'TAX INVOICE', 'Supplier {FIRM_GSTIN} PAN AABCF0001A', 'Customer Name: '||nm||' Billing Month: '||strftime(od,'%b %Y'),
   'GSTIN: '||gst||' Invoice Number: '||no||' PAN: ZZZZZ9999Z Date of Invoice: '||strftime(od,'%d-%m-%Y'), 'Due date 31-12-2002', 'Particulars HSN Qty Amount',
   CASE WHEN a>0 THEN 'A SAAS / Mobile Application 9971 Sub Total '||{_MONEY.format("a")} END, CASE WHEN b>0 THEN 'B Soundbox Charges 997319' END,
   CASE WHEN b>0 THEN 'Sub Total '||{_MONEY.format("b")} END, CASE WHEN c>0 THEN 'D Transactional Messages 998599 Sub Total 10 5 0 '||{_MONEY.format("c")} END,
   'Grand Total '||{_MONEY.format("net")}, 'Taxable Value Rate Central Tax Rate State Tax Rate Integrated Tax',
   {_MONEY.format("net")}||CASE WHEN home THEN ' 9% ' ELSE ' % ' END||half_text||CASE WHEN home THEN ' 9% ' ELSE ' % ' END||half_text||CASE WHEN home THEN ' % ' ELSE ' 18% ' END||full_text,
   'Final Total (A+B+D) '||{_MONEY.format("net")}, 'Net Cost '||{_MONEY.format("whole")},
   'Total Cost incl Taxes '||{_MONEY.format("net+2*cg+ig")}, 'Rounding off 0.00', 'Bank Name: State Bank A/C 123456789012 IFSC SBIN0123456'], lambda x: x IS NOT NULL) AS t FROM oz))"""
_FOUND = f"""WITH {_TX}, {_PRINTED}, {_detected("printed")}"""


@query(f"{_FOUND} SELECT doc_id, i::BIGINT AS line_no, field, value, keyword, confidence FROM found", "sales")
def candidates_all(spark, sf):
    """Every candidate of every field on printed invoices, row by row."""
    found = tx.candidates(invoice_texts(spark, sf))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "field", "value", "keyword", "confidence")


@query(f"{_FOUND} SELECT field, keyword, count(*) AS n, count(DISTINCT value) AS n_values FROM found GROUP BY 1, 2", "sales")
def candidate_counts(spark, sf):
    found = tx.candidates(invoice_texts(spark, sf))
    return found.groupBy("field", "keyword").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


@query(f"""WITH {_TX} SELECT okey AS doc_id, '07AABCF0001A1Z5' AS supplier_gstin, nullif(gst,'NA') AS buyer_gstin FROM oy""", "sales")
def gstin_resolution(spark, sf):
    return tx.resolve_gstins(tx.candidates(invoice_texts(spark, sf), ("gstin",)))


@query(f"""WITH {_TX} SELECT okey AS doc_id, strftime(od,'%d-%m-%Y') AS invoice_date, '31-12-2002' AS due_date FROM oy""", "sales")
def date_resolution(spark, sf):
    return tx.resolve_dates(tx.candidates(invoice_texts(spark, sf), ("invoice_date", "due_date")))


@query(f"""{_FOUND} SELECT doc_id, field, value, keyword, confidence FROM found
 QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence DESC, detector, i, word_no, n)=1""", "sales")
def candidates_best(spark, sf):
    best = tx.best_per_field(tx.candidates(invoice_texts(spark, sf)))
    return best.select("doc_id", "field", "value", "keyword", "confidence")


@query(f"""{_FOUND} SELECT doc_id, rank::BIGINT AS rank, field, value, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, detector, i, word_no, n) AS rank FROM found) WHERE rank<=3""", "sales")
def candidates_top3(spark, sf):
    top = tx.top_candidates(tx.candidates(invoice_texts(spark, sf)), 3)
    return top.select("doc_id", F.col("rank").cast("long").alias("rank"), "field", "value", "confidence")


@query(f"""WITH {_TX} SELECT okey AS doc_id, net::DOUBLE AS value, round(0.4*CASE WHEN true THEN 1.0 END+0.2*0.8+0.15*0.8+0.15*0.95+0.1*0.5,6) AS score
 FROM oy""", "sales")
def amount_choice(spark, sf):
    found = tx.candidates(invoice_texts(spark, sf), ("grand_total",))
    expected = _orders(spark, sf).select(F.col("okey").alias("doc_id"), F.lit("grand_total").alias("field"),
                                         _net().cast("double").alias("math_value"))
    out = tx.choose_amounts(found.filter("field = 'grand_total'"), expected)
    return out.select("doc_id", "value", F.round("score", 6).alias("score"))


@query(f"""{_FOUND} SELECT doc_id, field, coalesce(try_cast(value AS DOUBLE), 0) AS value, round(score, 6) AS score FROM (
  SELECT *, 0.5*0.4+confidence*0.2+0.8*0.15+CASE WHEN trim(coalesce(keyword,''))<>'' THEN 0.95 ELSE 0.5 END*0.15+0.5*0.1 AS score FROM found WHERE detector IN (2, 3))
 QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY round(score, 10) DESC, detector, i, word_no, n)=1""", "sales")
def amounts_by_evidence(spark, sf):
    """The chosen amount of every tax and total field, without calculated values to compare with."""
    found = tx.candidates(invoice_texts(spark, sf), (*tx.TAX_FIELDS.values(), *tx.TOTAL_FIELDS.values()))
    return tx.choose_amounts(found).select("doc_id", "field", "value", F.round("score", 6).alias("score"))


def _regions(lines: str) -> str:
    """Regions of ``lines`` (doc_id, i, line), as CTEs that end in ``regions``."""
    return f"""m AS (SELECT doc_id, i, {_any("lower(line)", tx.TABLE_WORDS)} AS tab, {_any("lower(line)", tx.TOTALS_WORDS)} AS tot, {_any("lower(line)", tx.PAYMENT_WORDS)} AS pay FROM {lines}),
 ta AS (SELECT *, coalesce(min(i) FILTER (tab) OVER (PARTITION BY doc_id), 2147483647) AS table_at FROM m),
 ea AS (SELECT *, coalesce(min(i) FILTER (i >= table_at AND NOT pay) OVER (PARTITION BY doc_id), 2147483647) AS item_at FROM ta),
 ra AS (SELECT *, coalesce(min(i) FILTER (i > item_at AND tot) OVER (PARTITION BY doc_id), 2147483647) AS totals_at FROM ea),
 regions AS (SELECT doc_id, i::BIGINT AS line_no, CASE WHEN pay THEN 'payment' WHEN i >= totals_at THEN 'totals' WHEN i >= table_at THEN 'items_table' ELSE 'metadata' END AS region FROM ra)"""


@query(f"WITH {_TX}, {_PRINTED}, {_regions('printed')} SELECT * FROM regions", "sales")
def line_regions(spark, sf):
    return tx.line_regions(invoice_texts(spark, sf)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "region")


@query("""SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, length(text)::BIGINT AS n_chars FROM documents""")
def document_lines(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    lines = tx.lines_of(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("chars"))
    return lines.select("doc_id", "n_lines", (F.col("chars") + F.col("n_lines") - 1).alias("n_chars"))


@query(f"""WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
 l AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS i FROM parts), {_regions("l")} SELECT * FROM regions""")
def document_regions(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return tx.line_regions(docs).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "region")


@query(f"""WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT conv_id*1000+turn+1000000000, text FROM conversations),
 p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM t), l AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS i FROM p), {_detected("l")}
 SELECT field, keyword, count(*) AS n, count(DISTINCT value) AS n_values FROM found GROUP BY 1, 2""")
def document_candidates(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text").unionByName(
        read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 10**9).alias("doc_id"), "text"))
    return tx.candidates(docs).groupBy("field", "keyword").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


# DuckDB's \\b knows ASCII letters only; the end of a number is spelled out
_NUMBER = tx.FAST_NUMBER.removesuffix(r"\b") + r"(?:[^\p{L}\p{N}_]|$)"


@query(f"""WITH f AS (SELECT page_id AS doc_id, list_distinct(regexp_extract_all(upper(html), '{tx.FAST_GSTIN}')) AS g,
  regexp_extract(html, '{tx.FAST_IRN}', 1) AS i, regexp_extract_all(html, '{_NUMBER}', 1) AS numbers FROM pages),
 n AS (SELECT *, list_filter(numbers, lambda x: length(x) >= 2) AS long FROM f)
 SELECT doc_id, g[1] AS gst_no, nullif(lower(i), '') AS irn, long[1] AS supplier_inv, len(list_distinct(long)) AS n_numbers FROM n""")
def page_fast_extract(spark, sf):
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return tx.fast_extract(pages).select("doc_id", "gst_no", "irn", "supplier_inv", F.size("numbers").cast("bigint").alias("n_numbers"))


@query(f"""WITH {_TX} SELECT okey AS doc_id, '07AABCF0001A1Z5' AS gst_no, no AS supplier_inv,
  CASE WHEN gst<>'NA' AND substr(gst,1,2)::INT<=38 THEN 2 ELSE 1 END::BIGINT AS n_gstins FROM oy""", "sales")
def fast_extract(spark, sf):
    out = tx.fast_extract(invoice_texts(spark, sf))
    number = F.try_element_at(F.filter("numbers", lambda v: v.rlike("^(MH|HR|OX)")), F.lit(1))
    return out.select("doc_id", "gst_no", number.alias("supplier_inv"), F.size("gstins").cast("bigint").alias("n_gstins"))


@query(f"""WITH {_TX} SELECT okey AS doc_id, no AS invoice_no, strftime(od,'%d-%m-%Y') AS voucher_date, nm AS customer_name,
  concat_ws('; ', CASE WHEN a>0 THEN 'SaaS/UPI Platform Charges' END, CASE WHEN b>0 THEN 'Soundbox Charges' END,
   CASE WHEN c>0 THEN 'Transactional Messaging Charges' END) AS narration FROM oy""", "sales")
def audit_fields(spark, sf):
    return tx.audit_fields(invoice_texts(spark, sf)).select("doc_id", "invoice_no", "voucher_date", "customer_name", "narration")


def note_texts(spark, sf):
    """One printed credit note per document number with credit-note lines."""
    lines = sales_lines(spark, sf, part=False).filter("voucher_type = 'Credit Note'")
    n = lines.groupBy("okey", "invoice_no", "original_no", "party_ledger_name", "o_orderdate").agg(
        *[money(F.sum(c)).alias(c) for c in ("taxable_value", "cgst_amount", "sgst_amount", "igst_amount")])
    m = F.col("okey") % 3
    def tax(label, c):
        return F.concat(F.lit(f"{label} @ 9% "), F.when(F.col(c) == 0, "-").otherwise(_fmt(c)), F.lit("\n"))
    total = F.col("taxable_value") + F.col("cgst_amount") + F.col("sgst_amount") + F.col("igst_amount")
    text = F.concat(
        F.lit("Credit Note Number: "), "invoice_no", F.lit(" Date:\n"), F.date_format("o_orderdate", "dd-MM-yyyy"),
        F.lit("\nBill To:\n"), "party_ledger_name", F.lit(" Original Invoice Number: "), "original_no",
        F.lit("\nOriginal Invoice Date: 01-01-1995\nReason for Credit Note: short supply\n"),
        F.when(m == 0, F.concat(F.lit("Total A Soundbox Charges 997319 50 "), _fmt("taxable_value"), F.lit("\n")))
        .when(m == 1, F.lit("code 998529\n")).otherwise(F.lit("no table\n")),
        F.lit("Subtotal: "), _fmt("taxable_value"), F.lit("\n"), tax("CGST", "cgst_amount"), tax("SGST", "sgst_amount"),
        tax("IGST", "igst_amount"), F.lit("Rounding off: 0.00\n"),
        F.when(F.col("okey") % 2 == 0, F.concat(_fmt(total), F.lit("\nIndian Rupees only"))).otherwise(""))
    return n.select(F.col("okey").alias("doc_id"), text.alias("text"), F.lit("credit_note").alias("document_type"))


_CN = """cn AS (SELECT okey, min(invoice_no) AS no, min(original_no) AS orig, min(party_ledger_name) AS nm, min(o_orderdate) AS od,
   sum(taxable_value) AS t, sum(cgst_amount) AS c, sum(sgst_amount) AS s, sum(igst_amount) AS i FROM sales
   WHERE voucher_type='Credit Note' GROUP BY 1)"""


@query(f"""WITH {_CN} SELECT okey AS doc_id, no AS credit_note_no, strftime(od,'%d-%m-%Y') AS note_date, orig AS original_invoice_no,
  nm AS party_name, t::DOUBLE AS taxable, c::DOUBLE AS cgst, i::DOUBLE AS igst, (t+c+s+i)::DOUBLE AS total,
  CASE WHEN okey%3=0 THEN '997319' WHEN contains(w,'9971') THEN '9971' WHEN contains(w,'997319') THEN '997319'
   WHEN contains(w,'998599') THEN '998599' WHEN okey%3=1 OR contains(w,'998529') THEN '998529' WHEN contains(w,'998313') THEN '998313'
   ELSE 'NOT SPECIFIED ON INVOICE' END AS hsn FROM (SELECT *, no||' '||nm||' '||orig AS w FROM cn)""", "sales")
def credit_notes(spark, sf):
    out = tx.credit_notes(note_texts(spark, sf))
    return out.select("doc_id", "credit_note_no", "note_date", "original_invoice_no", "party_name",
                      *d("taxable cgst igst total"), "hsn")


def _documents(spark, sf):
    invoices = invoice_texts(spark, sf).withColumn("document_type", F.lit("invoice"))
    return invoices.unionByName(note_texts(spark, sf).withColumn("doc_id", F.col("doc_id") + 10**12))


def _sheet(spark, sf):
    """The register: invoices with section columns, and notes; every seventh order is missing."""
    lines = sales_lines(spark, sf, part=False).filter("voucher_type <> 'Debit Note' AND okey % 7 <> 0")
    slot = F.col("line") % 3
    note = F.col("voucher_type") == "Credit Note"
    number = F.when(note, F.col("invoice_no")).otherwise(F.col("original_no"))
    names = {1: "saas_net", 2: "soundbox_net", 0: "transactional_net"}
    spread = F.col("okey") % 5 != 0
    return lines.groupBy(number.alias("doc_no"), F.when(note, "Credit Note").otherwise("Invoice").alias("doc_type"),
                         F.col("party_ledger_name").alias("party_name"), F.lit("01-01-2000").alias("doc_date")).agg(
        *[money(F.sum(F.when((slot == i) & spread, F.col("taxable_value")).otherwise(0))).alias(n) for i, n in names.items()],
        *[money(F.sum(F.lit(0))).alias(n) for n in ("kyc_net", "promotional_net", "late_charges")],
        *[money(F.sum(a)).alias(b) for a, b in (("taxable_value", "taxable"), ("cgst_amount", "cgst"), ("sgst_amount", "sgst"),
                                                ("igst_amount", "igst"), ("total_invoice_value", "total"))])


@query("""SELECT source, count(*) AS n, sum(v)::DOUBLE AS taxable FROM (
  SELECT CASE WHEN okey%5=0 THEN 'sheet_totals' ELSE 'sheet_sections' END AS source, CASE WHEN okey%5=0 THEN 0 ELSE line%3 END AS slot,
   okey, sum(taxable_value) AS v FROM sales WHERE okey%7<>0 AND voucher_type='Sales' GROUP BY 1,2,3
  UNION ALL SELECT 'own_document', 0, okey, sum(taxable_value) FROM sales WHERE okey%7<>0 AND voucher_type='Credit Note' GROUP BY 3)
 GROUP BY 1""", "sales")
def sheet_first_plan(spark, sf):
    out = sheet_first.plan(_sheet(spark, sf), _documents(spark, sf))
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("taxable_value").cast("double").alias("taxable"))


@query("""SELECT t AS document_type, count(*) AS n, count(no) AS numbered FROM (
  SELECT 'invoice' AS t, CASE WHEN min(party_gstin) IS NOT NULL THEN min(original_no) END AS no FROM sales GROUP BY okey
   HAVING okey%7=0 OR min(party_gstin) IS NULL OR count(*) FILTER (voucher_type='Sales')=0
  UNION ALL SELECT 'credit_note', min(invoice_no) FROM sales WHERE voucher_type='Credit Note' GROUP BY okey HAVING okey%7=0) GROUP BY 1""", "sales")
def gap_documents(spark, sf):
    out = sheet_first.gap_documents(_documents(spark, sf), _sheet(spark, sf))
    return out.groupBy("document_type").agg(F.count(F.lit(1)).alias("n"), F.count("doc_no").alias("numbered"))


def _bank_texts(spark, sf):
    """Each event as a statement line with one, two or three amounts at its end."""
    ev = read(spark, sf, "events")
    k = F.col("event_id") % 4
    text = F.concat(
        F.lit("Transactions at a Glance ICICI Bank\n"), F.date_format("ts", "dd/MM/yyyy"), F.lit(" UPI "), "event_type",
        F.when(k == 0, "").when(k == 1, F.concat(F.lit(" "), F.format_number("value", 2)))
        .when(k == 2, F.concat(F.lit(" "), F.format_number("value", 2), F.lit(" 1,000.00Cr")))
        .otherwise(F.concat(F.lit(" "), F.format_number("value", 2), F.lit(" 0.50 99.00"))))
    return ev.select(F.col("event_id").alias("doc_id"), text.alias("text"))


@query("""SELECT event_id AS doc_id, strftime(ts,'%d/%m/%Y') AS date, 'UPI '||event_type AS narration,
  CASE WHEN event_id%4>=2 THEN printf('%.2f', value) ELSE '' END AS debit, CASE WHEN event_id%4=3 THEN '0.50' ELSE '' END AS credit,
  CASE event_id%4 WHEN 0 THEN '' WHEN 1 THEN printf('%.2f', value) WHEN 2 THEN '' ELSE '99.00' END AS balance, 'ICICI' AS bank,
  CASE WHEN event_id%4=0 THEN 'UNCERTAIN' ELSE 'SURE' END AS confidence FROM events""")
def bank_transactions(spark, sf):
    return tx.bank_transactions(_bank_texts(spark, sf)).drop("line_no")


@query("""SELECT confidence, count(*) AS n FROM (SELECT CASE WHEN event_id%4=0 THEN 'UNCERTAIN' ELSE 'SURE' END AS confidence FROM events)
 WHERE confidence='SURE' GROUP BY 1""")
def bank_sure_only(spark, sf):
    return tx.bank_transactions(_bank_texts(spark, sf), "SURE").groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey%3=0 THEN 'UDYAM-MH-12-'||lpad(c_custkey::VARCHAR,greatest(7,length(c_custkey::VARCHAR))::INT,'0')
   ELSE 'UNKNOWN' END AS udyam_number, CASE WHEN c_custkey%2=0 THEN c_name ELSE 'UNKNOWN VENDOR' END AS enterprise_name,
  CASE WHEN c_custkey%4=0 THEN 'Manufacturing' ELSE 'Services' END AS major_activity,
  CASE c_custkey%5 WHEN 0 THEN 'MICRO' WHEN 1 THEN 'SMALL' ELSE 'UNKNOWN' END AS enterprise_type FROM customer""")
def certificates(spark, sf):
    cust = read(spark, sf, "customer")
    key = F.col("c_custkey")
    text = F.concat(
        F.when(key % 3 == 0, F.concat(F.lit("udyam-mh-12-"), F.lpad(key.cast("string"), F.greatest(F.lit(7), F.length(key.cast("string"))), F.lit("0"))))
        .otherwise(""), F.lit("\n"), F.when(key % 2 == 0, F.concat(F.lit("Name of Enterprise : "), "c_name", F.lit(" : x"))).otherwise(""), F.lit("\n"),
        F.when(key % 4 == 0, "MANUFACTURING").otherwise(""), F.lit("\n"),
        F.when(key % 5 == 0, "Enterprise Type : Micro").when(key % 5 == 1, "a Small unit").otherwise(""))
    return tx.certificates(cust.select(key.alias("doc_id"), text.alias("text")))


@query("""SELECT CASE WHEN original_no LIKE 'OX%' THEN 'ox' WHEN original_no LIKE 'MH%' THEN 'firm' END AS profile,
  count(DISTINCT okey) AS n FROM sales GROUP BY 1""", "sales")
def vendor_profiles(spark, sf):
    # a number fills its seven digits from order 1,000,000 on, so any digit may follow the letters; OX alone is in SOUNDBOX
    profiles = [{"name": "ox", "invoice_number_prefix": [f"OX{i}" for i in range(10)]},
                {"name": "firm", "gstin": "", "invoice_number_prefix": [*[f"MH{i}" for i in range(10)], "MHX"]}]
    found = tx.vendor_profile(F.col("text"), profiles)
    return invoice_texts(spark, sf).groupBy(found.alias("profile")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_TX} SELECT okey AS doc_id, CASE WHEN okey%2=0 THEN coalesce(nullif(gst,'NA'),'') ELSE '07AABCF0001A1Z5' END AS seller FROM oy""", "sales")
def seller_gstins(spark, sf):
    buyers = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(FIRM_GSTIN))).otherwise(F.array(F.lit("x")))
    return invoice_texts(spark, sf).select("doc_id", tx.seller_gstin(F.col("text"), buyers).alias("seller"))


@query("""SELECT doc_id, length(regexp_replace(text,'\\s','','g'))>=40 AND
  length(regexp_replace(text,'\\s','','g'))*2>=length(text) AS usable FROM documents""")
def text_layers(spark, sf):
    docs = read(spark, sf, "documents")
    return docs.select("doc_id", usable_text_layer(F.array("text")).alias("usable"))


@query("""SELECT doc_id, regexp_matches(lower(text),'export invoice|letter of undertaking|without payment of integrated|without payment of igst|zero-rated supply|zero rated supply')
  OR regexp_matches(lower(text),'\\blut\\b') AS export FROM documents""")
def export_markers(spark, sf):
    return read(spark, sf, "documents").select("doc_id", export_marker(F.col("text")).alias("export"))


@query("""SELECT conv_id, turn, CASE WHEN length(t)>80 THEN substr(t,1,80)||'...' ELSE t END AS clean FROM
  (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text,'[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]','','g'),'[\\t\\n\\x0B\\f\\r ]+',' ','g')) AS t FROM conversations)""")
def clean_texts(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", sanitize_text(F.col("text"), 80).alias("clean"))


@query("""SELECT amount, count(*) AS n FROM (SELECT CASE WHEN c_custkey%3=0 THEN '' ELSE printf('%.2f', c_acctbal) END AS amount FROM customer) GROUP BY 1""")
def clean_amounts(spark, sf):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Rs "), F.col("c_acctbal").cast("string"))).otherwise(
        F.concat(F.lit("₹ "), F.format_number("c_acctbal", 2)))
    return read(spark, sf, "customer").groupBy(sanitize_amount(raw).alias("amount")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT label, count(*) AS n FROM (SELECT CASE p_partkey%5 WHEN 0 THEN 'HSN' WHEN 1 THEN 'TOTAL' WHEN 2 THEN 'CGST' WHEN 3 THEN 'OTHER'
  ELSE 'TAXABLE' END AS label FROM part) GROUP BY 1""")
def header_labels(spark, sf):
    m = F.col("p_partkey") % 5
    header = F.when(m == 0, "SAC Code").when(m == 1, "Tax Amount").when(m == 2, " CGST Amount ").when(m == 3, "xyz").otherwise("Taxable Value")
    return read(spark, sf, "part").groupBy(header_label(header).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, sha256(concat_ws('|', least(lower(p_name),lower(p_type)), greatest(lower(p_name),lower(p_type)))||'::'||
  concat_ws('|', printf('%.2f', least(p_size::DOUBLE, p_retailprice)), printf('%.2f', greatest(p_size::DOUBLE, p_retailprice)))) AS fingerprint FROM part""")
def layout_fingerprints(spark, sf):
    print_ = layout_fingerprint(F.array(F.concat(F.lit(" "), "p_name"), "p_type"), F.array("p_retailprice", F.col("p_size").cast("double")))
    return read(spark, sf, "part").select("p_partkey", print_.alias("fingerprint"))


@query("""SELECT rejected, count(*) AS n FROM (SELECT regexp_matches(v, '^(\\d{4}|\\d{6}|\\d{8}|\\d{4}\\.\\d{2})$') OR okey%9=0 AS rejected FROM (
  SELECT okey, CASE WHEN taxable_value=floor(taxable_value) THEN CAST(taxable_value AS BIGINT)::VARCHAR ELSE taxable_value::DOUBLE::VARCHAR END AS v FROM sales))
 GROUP BY 1""", "sales")
def hsn_guard(spark, sf):
    column = F.when(F.col("okey") % 9 == 0, "hsn").otherwise("AMOUNT")
    bad = amount_rejected_as_hsn(F.col("taxable_value"), F.lit("1"), column)
    return sales_lines(spark, sf, part=False).groupBy(bad.alias("rejected")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT score, count(*) AS n FROM (SELECT greatest(0, least(1, 0.5+pct*0.05-CASE WHEN okey%2=0 THEN 0.3 ELSE 0 END))::DOUBLE AS score FROM sales)
 GROUP BY 1""", "sales")
def evidence_scores(spark, sf):
    score = evidence_score(F.col("pct").cast("double") * 0.05, F.when(F.col("okey") % 2 == 0, 0.3).otherwise(0.0))
    return sales_lines(spark, sf, part=False).groupBy(F.round(score, 6).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN igst_amount>0 AND g THEN 'B2B' WHEN igst_amount>0 THEN 'B2CL' WHEN cgst_amount=0 THEN 'EXP' WHEN g THEN 'B2B'
  ELSE 'B2CS' END AS category, count(*) AS n FROM (SELECT *, length(coalesce(party_gstin,''))=15 AS g FROM sales) GROUP BY 1""", "sales")
def audit_categories(spark, sf):
    c = simple_audit_category(*[F.col(x) for x in ("party_gstin", "igst_amount", "cgst_amount", "sgst_amount")])
    return sales_lines(spark, sf, part=False).groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id AS doc_id, strftime(ts,'%d-%b-%Y') AS found FROM events""")
def dates_in_text(spark, sf):
    ev = read(spark, sf, "events")
    return ev.select(F.col("event_id").alias("doc_id"), first_date_in(F.concat(
        F.lit("paid on "), F.date_format("ts", "dd-MMM-yyyy"), F.lit(" then 2024-01-02"))).alias("found"))


@query("""SELECT gstin AS gst_no, inv_no AS supplier_inv, inv_date AS invoice_date,
  CASE WHEN gstin='' THEN 'No' WHEN okey%3=0 THEN 'Yes' WHEN okey%3=1 AND skey%2=0 THEN 'Yes' ELSE 'No' END AS in_drive FROM extra2b""", "extra2b")
def gap_verification(spark, sf):
    """Statement-only records looked up in document texts: same month, next month, too late, absent."""
    from .q_gstr2b import reconciliation
    from .tables import statement_2b
    extra = reconciliation(spark, sf).extra
    okey = F.regexp_extract("supplier_inv", r"(\d+)/\d+$", 1).cast("bigint")
    skey = F.regexp_extract("supplier_inv", r"/(\d+)$", 1).cast("bigint")
    st = statement_2b(spark, sf).select("gstin", "inv_no", "inv_date", "okey", "skey")
    month = F.to_date("inv_date", "dd-MM-yyyy")
    shown = F.when(F.col("okey") % 3 == 0, month).when((F.col("okey") % 3 == 1) & (F.col("skey") % 2 == 0), F.add_months(month, 1)) \
        .when(F.col("okey") % 3 == 1, F.add_months(month, 2))
    docs = st.filter(F.col("gstin") != "").select(
        F.concat("inv_no", F.lit("-"), "gstin").alias("doc_id"), shown.alias("month"), F.concat(
            F.lit("Invoice of "), F.regexp_replace("gstin", "^(..)", "$1 "), F.lit(" no. "), F.lower("inv_no"), F.lit(" thanks")).alias("text")
    ).filter("month IS NOT NULL")
    return state.verify_gaps(extra, docs).select("gst_no", "supplier_inv", "invoice_date", "in_drive")
