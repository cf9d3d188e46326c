"""Line cleaning, the reconciliation engine and validation over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from khata.functions.common import money
from khata.functions.tax import dec, interstate_decision, tax_paths as path_of, variance_category
from khata.operators import cleaning, recon_engine, validation

from .registry import query
from .tables import FIRM_GSTIN, purchase_lines, sales_documents, sales_lines
from .util import d


def _with_subtotals(spark, sf):
    """Order lines plus a printed subtotal after the first three line numbers: right, wrong, or missing."""
    lines = sales_lines(spark, sf).select(
        "okey", (F.col("line") * 2).alias("position"), F.col("seq.l_extendedprice").alias("tie"),
        "particulars", "taxable_value")
    head = lines.filter("position <= 6 AND okey % 4 <> 3").groupBy("okey").agg(
        F.sum("taxable_value").alias("s")).select(
        "okey", F.lit(7).cast("bigint").alias("position"), F.lit(0.0).alias("tie"),
        F.when(F.col("okey") % 4 == 0, "Sub Total").when(F.col("okey") % 4 == 1, "GRAND TOTAL :")
        .otherwise("Amount Payable").alias("particulars"),
        money(F.when(F.col("okey") % 4 == 1, F.col("s") + 100).when(F.col("okey") % 4 == 2, F.col("s") - 2)
              .otherwise(F.col("s"))).alias("taxable_value"))
    return lines.unionByName(head)


@query("""WITH l AS (SELECT okey, line*2 AS position, particulars, taxable_value, false AS sub FROM sales
  UNION ALL SELECT okey, 7, CASE okey%4 WHEN 0 THEN 'Sub Total' WHEN 1 THEN 'GRAND TOTAL :' ELSE 'Amount Payable' END,
   CASE okey%4 WHEN 1 THEN sum(taxable_value)+100 WHEN 2 THEN sum(taxable_value)-2 ELSE sum(taxable_value) END, true
  FROM sales WHERE line<=3 AND okey%4<>3 GROUP BY okey)
 SELECT okey, position, particulars, taxable_value::DOUBLE AS taxable_value FROM l WHERE NOT sub OR okey%4=1""",
       "sales")
def subtotal_removal(spark, sf):
    out = cleaning.remove_subtotals(_with_subtotals(spark, sf), ["okey"], "position", ["tie"])
    return out.select("okey", "position", "particulars", *d("taxable_value"))


def _sections(spark, sf):
    """Order lines as printed sections; some orders were partly or wholly paid in advance."""
    lines = sales_lines(spark, sf, part=False).select(
        "okey", F.col("seq").alias("position"), F.col("taxable_value").alias("taxable"), "pct", "party_state")
    # a section's place in its document: lines of an order sorted by arrival
    order = Window.partitionBy("okey")
    paid = lines.select("*", F.sum("taxable").over(order).alias("whole"), F.max("taxable").over(order).alias("largest"))
    net = (
        F.when(F.col("okey") % 5 == 0, F.col("whole") - F.col("largest") - dec("10.25"))
        .when(F.col("okey") % 5 == 1, F.col("whole") - dec("100.00"))
        .when(F.col("okey") % 35 == 2, F.lit(0)).otherwise(F.col("whole")))
    return paid.select(
        "okey", "position", "taxable", money(F.greatest(F.lit(0), net)).alias("net_taxable"),
        F.when(F.col("party_state") == "07", 9.0).otherwise(0.0).alias("cgst_rate"),
        F.when(F.col("party_state") == "07", 9.0).otherwise(0.0).alias("sgst_rate"),
        F.when(F.col("party_state") == "07", 0.0).otherwise(18.0).alias("igst_rate"))


_SECTIONS = """sec AS (SELECT okey, seq, party_state, taxable_value AS taxable, greatest(0, CASE WHEN okey%5=0 THEN whole-largest-10.25
   WHEN okey%5=1 THEN whole-100 WHEN okey%35=2 THEN 0 ELSE whole END) AS net, whole
  FROM (SELECT *, sum(taxable_value) OVER (PARTITION BY okey) AS whole,
    max(taxable_value) OVER (PARTITION BY okey) AS largest FROM sales)),
 casc AS (SELECT *, CASE WHEN abs(whole-net)>0.01 THEN taxable - CASE WHEN greatest(0,whole-net-before)>0.005
    THEN least(taxable, greatest(0,whole-net-before)) ELSE 0 END ELSE taxable END AS left_over FROM (
  SELECT *, coalesce(sum(taxable) OVER (PARTITION BY okey ORDER BY taxable DESC, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before,
   row_number() OVER (PARTITION BY okey ORDER BY seq) AS rn FROM sec)),
 kept AS (SELECT * FROM casc WHERE left_over>0.005 OR abs(whole-net)<=0.01 OR (whole-net>=whole-0.005 AND rn=1))"""


@query(f"""WITH {_SECTIONS} SELECT okey, taxable::DOUBLE AS original, left_over::DOUBLE AS taxable, net::DOUBLE AS net_taxable
 FROM kept""", "sales")
def advance_cascade(spark, sf):
    sections = _sections(spark, sf).withColumn("original", F.col("taxable"))
    out = cleaning.cascade_advance(sections, ["okey"], "position")
    return out.select("okey", *d("original taxable net_taxable"))


@query(f"""WITH {_SECTIONS}, r AS (SELECT *, CASE WHEN party_state='07' THEN 9 ELSE 0 END AS cr,
   CASE WHEN party_state='07' THEN 0 ELSE 18 END AS ir,
   row_number() OVER (PARTITION BY okey ORDER BY seq DESC) AS back FROM kept),
 t AS (SELECT *, round(left_over*cr*0.01,2) AS c, round(left_over*ir*0.01,2) AS i FROM r)
 SELECT okey, left_over::DOUBLE AS taxable,
  (CASE WHEN back=1 THEN round(net*cr*0.01,2) - (sum(c) OVER (PARTITION BY okey) - c) ELSE c END)::DOUBLE AS cgst,
  (CASE WHEN back=1 THEN round(net*ir*0.01,2) - (sum(i) OVER (PARTITION BY okey) - i) ELSE i END)::DOUBLE AS igst
 FROM t""", "sales")
def tax_apportion(spark, sf):
    kept = cleaning.cascade_advance(_sections(spark, sf), ["okey"], "position")
    out = cleaning.apportion_taxes(kept, ["okey"], "position")
    return out.select("okey", *d("taxable cgst igst"))


def _client_sections(spark, sf):
    """Client-sheet rows: one per sales document, its amount split over the six section columns."""
    lines = sales_lines(spark, sf)
    names = list(cleaning.SECTION_HSN)
    slot = F.col("line") % 7
    return lines.groupBy(F.col("invoice_no").alias("doc_no"), F.col("voucher_type").alias("doc_type")).agg(
        *[money(F.sum(F.when(slot == i, F.col("taxable_value")).otherwise(0))).alias(n)
          for i, n in enumerate(names, 1)],
        *[money(F.sum(f"{s}_amount")).alias(s) for s in ("cgst", "sgst", "igst")])


@query("""WITH b AS (SELECT invoice_no, slot, sum(taxable_value) AS amt FROM (SELECT *, line%7 AS slot FROM sales)
   WHERE slot>0 AND voucher_type='Sales' GROUP BY 1,2),
 t AS (SELECT invoice_no, sum(igst_amount) AS igst, sum(cgst_amount) AS cgst FROM sales GROUP BY 1),
 s AS (SELECT b.*, t.igst, t.cgst, sum(amt) OVER w AS whole, max(slot) OVER w AS last FROM b JOIN t USING (invoice_no)
   WINDOW w AS (PARTITION BY invoice_no)),
 p AS (SELECT *, ((2*(igst*100)::HUGEINT*(amt*100)::HUGEINT + (whole*100)::HUGEINT) // (2*(whole*100)::HUGEINT)) AS ip,
   ((2*(cgst*100)::HUGEINT*(amt*100)::HUGEINT + (whole*100)::HUGEINT) // (2*(whole*100)::HUGEINT)) AS cp FROM s)
 SELECT invoice_no AS doc_no, CASE slot WHEN 1 THEN 'saas_net' WHEN 2 THEN 'transactional_net' WHEN 3 THEN 'kyc_net'
   WHEN 4 THEN 'promotional_net' WHEN 5 THEN 'late_charges' ELSE 'soundbox_net' END AS section,
  CASE slot WHEN 1 THEN '9971' WHEN 2 THEN '998599' WHEN 3 THEN '998529' WHEN 4 THEN '998599'
   WHEN 5 THEN 'NOT SPECIFIED ON INVOICE' ELSE '997319' END AS hsn, amt::DOUBLE AS taxable,
  (CASE WHEN slot=last THEN (igst*100)::HUGEINT-(sum(ip) OVER (PARTITION BY invoice_no)-ip) ELSE ip END * 0.01)::DOUBLE AS igst,
  (CASE WHEN slot=last THEN (cgst*100)::HUGEINT-(sum(cp) OVER (PARTITION BY invoice_no)-cp) ELSE cp END * 0.01)::DOUBLE AS cgst
 FROM p""", "sales")
def section_unpivot(spark, sf):
    out = cleaning.explode_sections(cleaning.sections_to_lines(_client_sections(spark, sf)))
    return out.select("doc_no", "section", "hsn", *d("taxable igst cgst"))


@query("""SELECT okey, hsn, pct2::DOUBLE AS rate, count(*) AS n, sum(tax)::DOUBLE AS tax,
   sum(taxable_value+tax)::DOUBLE AS total FROM (SELECT *, CASE WHEN party_state='07' THEN 2*round(taxable_value*pct2*0.005,2)
   ELSE round(taxable_value*pct2*0.01,2) END AS tax FROM (
   SELECT *, CASE WHEN gstr1_category='NIL_EXEMPT' THEN 0 WHEN pct=0 AND hsn LIKE '99%' THEN 18 ELSE pct END::DECIMAL(4,0) AS pct2
   FROM sales)) GROUP BY 1,2,3""", "sales")
def tax_recompute(spark, sf):
    lines = sales_lines(spark, sf)
    # the printed columns decide; a line without tax falls back on the parties' states
    across = interstate_decision(
        F.col("cgst_amount"), F.col("sgst_amount"), F.col("igst_amount"),
        F.lit(FIRM_GSTIN), F.concat("party_state", F.lit("XXXXX")))
    out = cleaning.recompute_taxes(lines, across)
    tax = F.col("cgst_amount") + F.col("sgst_amount") + F.col("igst_amount")
    return out.groupBy("okey", "hsn", "rate").agg(
        F.count(F.lit(1)).alias("n"), F.sum(tax).cast("double").alias("tax"),
        F.sum("total_invoice_value").cast("double").alias("total"))


@query("""SELECT seq, okey, (CASE WHEN line%2=0 AND discount>0 AND line%3<>0 AND abs(gross-qty*rate)<1
    THEN round(CAST(qty*rate AS DECIMAL(18,2))-discount,2)
   WHEN line%4=1 AND discount>0 AND discount<=gross THEN gross-discount ELSE gross END)::DOUBLE AS fixed
 FROM sales""".replace("SELECT seq, okey,", "SELECT okey, line,"), "sales")
def discount_fix(spark, sf):
    """Gross stored as taxable: priced lines, unpriced lines without tax, and lines left alone."""
    lines = sales_lines(spark, sf, part=False)
    even, unpriced = F.col("line") % 2 == 0, F.col("line") % 4 == 1
    priced = even & (F.col("line") % 3 != 0)
    raw = lines.select(
        "okey", "line", "discount", money(F.col("gross")).alias("taxable_value"),
        F.when(priced, F.col("qty")).when(unpriced, 0.0).otherwise(1.0).alias("qty"),
        F.when(priced, F.col("rate")).when(unpriced, 0.0).otherwise(0.0).alias("rate"),
        money(F.when(unpriced, F.col("gross")).otherwise(0)).alias("total_invoice_value"))
    fixed = cleaning.fix_discounts(raw)
    return fixed.select("okey", "line", F.col("taxable_value").cast("double").alias("fixed"))


@query("""SELECT hsn2 AS hsn, count(*) AS n, count(*) FILTER (p LIKE '%soundbox%') AS n_narrated FROM (
 SELECT p, CASE WHEN line%2=0 THEN hsn WHEN p LIKE '%soundbox%' THEN '997319' WHEN p LIKE '%gst verification%' THEN '998529'
   ELSE '9971' END AS hsn2 FROM (SELECT *, CASE okey%3 WHEN 0 THEN 'soundbox rent' WHEN 1 THEN 'gst verification'
     ELSE 'misc' END AS p FROM sales WHERE taxable_value>0)) GROUP BY 1""", "sales")
def hsn_autofill(spark, sf):
    okey = F.col("okey")
    lines = sales_lines(spark, sf).withColumns({
        "particulars": F.when(okey % 3 == 0, "Soundbox rent").when(okey % 3 == 1, "GST Verification")
        .otherwise("misc"),
        "hsn": F.when(F.col("line") % 2 == 0, F.col("hsn")).when(F.col("line") % 3 == 0, "nan"),
        "narration": F.lit(None).cast("string")})
    return cleaning.quality_control(lines).groupBy("hsn").agg(
        F.count(F.lit(1)).alias("n"), F.count("narration").alias("n_narrated"))


@query("""SELECT okey, CASE WHEN line%2=0 THEN invoice_no ELSE original_no END AS invoice_no,
  party_gstin, coalesce(place_of_supply, substr(party_gstin,1,2)) AS place_of_supply,
  'Sales' AS voucher_type, count(*) AS n FROM sales GROUP BY ALL""", "sales")
def header_fill(spark, sf):
    lines = sales_lines(spark, sf, part=False)
    bare = lines.select(
        "task_id", "okey", F.lit(None).cast("string").alias("voucher_date"), F.lit("").alias("voucher_type"),
        F.when(F.col("line") % 2 == 0, F.col("invoice_no")).alias("invoice_no"),
        F.lit(" ").alias("party_ledger_name"), F.lit(None).cast("string").alias("party_gstin"),
        F.lit(None).cast("string").alias("place_of_supply"))
    headers = lines.groupBy("task_id").agg(
        *[F.min(c).alias(c) for c in ("voucher_date", "voucher_type", "party_ledger_name", "party_gstin",
                                      "place_of_supply")], F.min("original_no").alias("invoice_no"))
    out = cleaning.fill_from_header(bare, headers, "task_id", "Sales")
    return out.groupBy("okey", "invoice_no", "party_gstin", "place_of_supply", "voucher_type").agg(
        F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS okey, coalesce(n,0) AS n_lines,
  (CASE WHEN n>0 THEN t ELSE CAST(o_totalprice AS DECIMAL(18,2)) END)::DOUBLE AS overall_taxable_value,
  coalesce(i,0)::DOUBLE AS overall_igst_amount
 FROM orders LEFT JOIN (SELECT okey, count(*) AS n, sum(taxable_value) AS t, sum(igst_amount) AS i FROM sales GROUP BY 1)
   ON okey=o_orderkey""", "sales")
def line_tax_sums(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("okey"), money(F.col("o_totalprice")).alias("taxable_value"),
        *[F.lit(None).cast("decimal(18,2)").alias(c) for c in ("cgst_amount", "sgst_amount", "igst_amount")])
    out = cleaning.line_tax_sums(sales_lines(spark, sf, part=False), orders, "okey")
    return out.select("okey", "n_lines", *d("overall_taxable_value overall_igst_amount"))


def _summary(spark, sf):
    """The printed summary of each order, with known errors by ``okey % 12``."""
    lines = sales_lines(spark, sf, part=False)
    s = lines.groupBy("task_id", "okey").agg(
        *[money(F.sum(c)).alias(c) for c in ("taxable_value", "cgst_amount", "sgst_amount", "igst_amount",
                                             "discount", "advances")],
        F.min("party_gstin").alias("buyer_gstin"), F.min("party_state").alias("party_state"),
        F.min("party_ledger_name").alias("buyer_name"), F.min("place_of_supply").alias("place_of_supply"),
        F.min("gstr1_category").alias("gstr1_category"), F.min("original_no").alias("number"),
        F.min("voucher_date").alias("invoice_date"), F.min("ckey").alias("ckey"))
    m = F.col("okey") % 12
    built = F.col("taxable_value") + F.col("cgst_amount") + F.col("sgst_amount") + F.col("igst_amount")
    home = F.col("party_state") == "07"
    return s.select(
        "task_id", "okey", "ckey", "buyer_gstin", "buyer_name", "place_of_supply", "gstr1_category", "number",
        "invoice_date", F.col("party_state").alias("buyer_state"), F.lit(FIRM_GSTIN).alias("supplier_gstin"),
        money(F.when(m == 1, F.col("taxable_value") + 500).otherwise(F.col("taxable_value"))).alias("taxable_value"),
        money(F.when((m == 4) & ~home, F.col("cgst_amount") + 10).otherwise(F.col("cgst_amount"))).alias("cgst_amount"),
        "sgst_amount",
        money(F.when((m == 4) & home, F.col("igst_amount") + 10).otherwise(F.col("igst_amount"))).alias("igst_amount"),
        money(F.lit(0)).alias("cess_amount"),
        money(F.when(m == 5, dec("0.60")).otherwise(0)).alias("round_off"),
        money(F.when(m == 2, built + 75).when(m == 3, built - F.col("discount") - F.col("advances"))
              .when(m == 4, built + 10).when(m == 5, built + dec("0.60")).otherwise(built)).alias("grand_total"))


_REC = """summ AS (SELECT okey, task_id, okey%12 AS m, sum(taxable_value) AS st, sum(cgst_amount) AS c0, sum(sgst_amount) AS s0,
   sum(igst_amount) AS i0, sum(discount) AS sd, sum(advances) AS sa, min(party_gstin) AS bg, min(party_state) AS ps,
   bool_and((line%3=0 AND pct IN (5,12,18,28) OR rate<=0 OR abs(greatest(0,qty*rate-discount::DOUBLE)-taxable_value::DOUBLE)<=1
      OR rate IN (5,12,18,28))
     AND abs(taxable_value+cgst_amount+sgst_amount+igst_amount-total_invoice_value)<=1) AS l1, count(*) AS n,
   min(place_of_supply) AS pos, min(gstr1_category) AS cat, min(ckey) AS ckey, min(o_orderdate) AS od FROM sales GROUP BY 1,2),
 pr AS (SELECT *, CASE WHEN m=1 THEN st+500 ELSE st END AS t, CASE WHEN m=4 AND ps<>'07' THEN c0+10 ELSE c0 END AS c,
   CASE WHEN m=4 AND ps='07' THEN i0+10 ELSE i0 END AS i, CASE WHEN m=5 THEN 0.60 ELSE 0 END AS ro,
   st+c0+s0+i0+CASE m WHEN 2 THEN 75 WHEN 3 THEN -sd-sa WHEN 4 THEN 10 WHEN 5 THEN 0.60 ELSE 0 END AS g FROM summ),
 ck AS (SELECT *, abs(t-st)<=1 OR abs(t-(st-sd))<=1 AS l2a, abs(t+c+s0+i+ro-g)<=1 AS l2b,
   abs(st+c0+s0+i0-sd-sa-g)<=1 AS mas, st+c0+s0+i0-sd-sa AS mtot, t+c+s0+i+ro AS ctot,
   (CASE WHEN (c>0 OR s0>0) AND i>0 THEN 1 ELSE 0 END + CASE WHEN length(coalesce(bg,''))>=2 AND ps<>'07' AND (c>0 OR s0>0) THEN 1 ELSE 0 END
    + CASE WHEN length(coalesce(bg,''))>=2 AND ps='07' AND i>0 THEN 1 ELSE 0 END) AS ge FROM pr),
 eng AS (SELECT *, CASE WHEN NOT((l2a AND l2b) OR mas) THEN 'BLOCKED' WHEN NOT (l1 AND ge=0) THEN 'NEEDS_REVIEW'
   ELSE 'ERP_READY' END AS status,
   round((4.95-0.49*(CASE WHEN l2a THEN 0 ELSE 1 END + CASE WHEN l2b THEN 0 ELSE 1 END + CASE WHEN ge=0 THEN 0 ELSE 3 END))*0.2,2)::DOUBLE
     AS conf FROM ck)"""


def _report(spark, sf):
    return recon_engine.reconcile(sales_lines(spark, sf, part=False), _summary(spark, sf))


@query(f"""WITH {_REC} SELECT task_id, n AS n_lines, l1 AS lines_ok, l2a AS taxable_ok, l2b AS totals_ok, ge=0 AS gst_ok,
  mas AS master_ok, ge::BIGINT AS n_gst_errors, status, conf AS overall_confidence, mtot::DOUBLE AS master_total FROM eng""", "sales")
def recon_engine_status(spark, sf):
    return _report(spark, sf).select(
        "task_id", "n_lines", "lines_ok", "taxable_ok", "totals_ok", "gst_ok", "master_ok",
        F.size("gst_errors").cast("bigint").alias("n_gst_errors"), "status", "overall_confidence",
        *d("master_total"))


@query(f"""WITH {_REC} SELECT task_id, field, (CASE WHEN cor THEN calc ELSE val END)::DOUBLE AS value, cor AS corrected FROM (
 SELECT task_id, 'taxable_value' AS field, t AS val, st AS calc, l1 AND abs(t-st)>1 AS cor FROM eng
 UNION ALL SELECT task_id, 'grand_total', g, mtot, l1 AND abs(g-mtot)>1 FROM eng
 UNION ALL SELECT task_id, 'cgst_amount', c, c, false FROM eng UNION ALL SELECT task_id, 'sgst_amount', s0, s0, false FROM eng
 UNION ALL SELECT task_id, 'igst_amount', i, i, false FROM eng)""", "sales")
def canonical_values(spark, sf):
    return recon_engine.canonical_values(_report(spark, sf)).select("task_id", "field", *d("value"), "corrected")


@query(f"""WITH {_REC} SELECT task_id, field, extracted::DOUBLE AS extracted, calc::DOUBLE AS calculated, ok AS verified,
  CASE WHEN ok THEN 0.7 ELSE 0.2 END::DOUBLE AS score,
  CASE WHEN ok THEN NULL WHEN abs(extracted-calc)<=1.5 THEN 'ROUND_OFF' ELSE 'COLUMN_SHIFT' END AS correction_category
 FROM (SELECT task_id, 'taxable_value' AS field, t AS extracted, st AS calc, l2a AS ok FROM eng
  UNION ALL SELECT task_id, 'grand_total', g, ctot, l2b FROM eng)""", "sales")
def evidence_rows(spark, sf):
    out = recon_engine.evidence_rows(_report(spark, sf))
    return out.select("task_id", "field", *d("extracted calculated"), "verified", F.round("score", 4).alias("score"),
                      "correction_category")


@query(f"""WITH {_REC} SELECT task_id, 'taxable_value' AS field, 'ERROR' AS severity, abs(t-st)::DOUBLE AS variance FROM eng WHERE NOT l2a
 UNION ALL SELECT task_id, 'grand_total', 'BLOCKER', abs(g-ctot)::DOUBLE FROM eng WHERE NOT l2b""", "sales")
def review_items(spark, sf):
    return recon_engine.review_items(_report(spark, sf)).select("task_id", "field", "severity", *d("variance"))


@query("""SELECT path, verified, count(*) AS n, sum(variance)::DOUBLE AS variance FROM (
 SELECT CASE WHEN va<=vb AND va<=vc THEN 'Path A' WHEN vb<=vc THEN 'Path B' ELSE 'Path C' END AS path,
  least(va,vb,vc) AS variance, least(va,vb,vc)<=1.5 AS verified FROM (
  SELECT abs(taxable_value+cgst_amount+sgst_amount-tot) AS va, abs(taxable_value+igst_amount-tot) AS vb,
   abs(gross-discount+cgst_amount+sgst_amount+igst_amount-CASE WHEN okey%3=0 THEN advances ELSE 0 END*0-tot) AS vc
  FROM (SELECT *, CASE WHEN okey%9=0 THEN total_invoice_value+3 ELSE total_invoice_value END AS tot FROM sales))) GROUP BY 1,2""",
       "sales")
def tax_paths(spark, sf):
    lines = sales_lines(spark, sf, part=False)
    total = F.when(F.col("okey") % 9 == 0, F.col("total_invoice_value") + 3).otherwise(F.col("total_invoice_value"))
    best = path_of(F.col("taxable_value"), F.col("cgst_amount"), F.col("sgst_amount"), F.col("igst_amount"),
                   total, gross=F.col("gross"), discount=F.col("discount"))
    out = lines.select(best.alias("b")).select("b.*")
    return out.groupBy("path", "verified").agg(
        F.count(F.lit(1)).alias("n"), F.sum("variance").cast("double").alias("variance"))


@query("""SELECT CASE WHEN okey%10=0 THEN 'HSN_AS_AMOUNT' WHEN discount>1000 THEN 'GLOBAL_DISCOUNT'
   WHEN okey%10=1 AND discount<=1 THEN 'ROUND_OFF' WHEN okey%10=2 THEN 'FREIGHT_INCLUDED' ELSE 'UNKNOWN' END AS category,
  count(*) AS n FROM sales GROUP BY 1""", "sales")
def variance_categories(spark, sf):
    lines = sales_lines(spark, sf, part=False)
    m = F.col("okey") % 10
    found = variance_category(m == 0, F.col("discount") > 1000, m == 1, m == 2, F.col("discount"))
    return lines.groupBy(found["category"].alias("category")).agg(F.count(F.lit(1)).alias("n"))


def _registry(spark, sf):
    """Registry entries of the customers: active, cancelled on a known day, or on an unknown one."""
    customers = sales_lines(spark, sf, part=False).groupBy("ckey", "party_gstin").agg(
        F.min("party_state").alias("state"))
    ck = F.col("ckey")
    return customers.filter((ck % 11 != 0) & F.col("party_gstin").isNotNull()).select(
        "ckey", F.col("party_gstin").alias("gstin"),
        F.when(ck % 7 == 1, "Cancelled").otherwise("Active").alias("status"),
        F.when(ck % 14 == 1, F.lit("1997-06-30")).cast("date").alias("status_change_date"),
        F.when(ck % 13 == 0, "99").otherwise(F.col("state")).alias("state_code"))


def _invoices(spark, sf):
    inv = _summary(spark, sf)
    rates = validation.line_rates_ok(sales_lines(spark, sf, part=False), "task_id")
    okey = F.col("okey")
    wide = inv.join(rates, "task_id", "left").select(
        "*",
        F.when(okey % 19 != 0, F.col("number")).alias("invoice_no"),
        F.when(okey % 29 == 0, "01-01-1994").otherwise("31-12-2001").alias("due_date"),
        F.when(okey % 31 == 0, "08").otherwise("07").alias("supplier_state"),
        F.when(okey % 43 != 0, F.lit("Firm")).alias("supplier_name"))
    return validation.with_registry(wide, _registry(spark, sf), "ckey")  # from 260,000 customers on some share a GSTIN


_VAL = f"""{_REC}, iv AS (SELECT *, upper(trim(coalesce(bg,''))) AS ub,
   regexp_matches(upper(trim(coalesce(bg,''))), '^[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][A-Z0-9]Z[A-Z0-9]$') AS bok FROM eng),
 rg AS (SELECT *, bok AND ckey%11<>0 AS known, CASE WHEN ckey%7<>1 THEN 'active' WHEN ckey%14<>1 THEN 'needs_review'
   WHEN DATE '1997-06-30'>od::DATE THEN 'active' ELSE 'inactive' END AS st5, ckey%13<>0 AS same FROM iv),
 ru AS (SELECT task_id, unnest([
  {{'id':'INV_001','sev':'BLOCKER','ok':okey%19<>0}}, {{'id':'INV_002','sev':'BLOCKER','ok':true}},
  {{'id':'INV_003','sev':'ERROR','ok':od::DATE<=DATE '2001-01-01'}},
  {{'id':'INV_004','sev':'ERROR','ok':CASE WHEN okey%29=0 THEN od::DATE<=DATE '1994-01-01' ELSE od::DATE<=DATE '2001-12-31' END}},
  {{'id':'GST_001','sev':'BLOCKER','ok':true}}, {{'id':'GST_002','sev':'ERROR','ok':bok}},
  {{'id':'GST_003','sev':'ERROR','ok':okey%31<>0}},
  {{'id':'GST_004','sev':'ERROR','ok':pos IS NULL OR (length(pos)=2 AND pos<>'25')}},
  {{'id':'GST_005','sev':'WARNING','ok':NOT known OR (st5='active' AND same)}},
  {{'id':'MATH_001','sev':'BLOCKER','ok':abs(ctot-g)<=1.5}}, {{'id':'MATH_002','sev':'BLOCKER','ok':g>0}},
  {{'id':'GST_008','sev':'ERROR','ok':true}},
  {{'id':'CLASS_001','sev':'ERROR','ok':cat<>'B2B' OR length(coalesce(bg,''))>=15}},
  {{'id':'CLASS_002','sev':'ERROR','ok':cat<>'B2CS' OR length(coalesce(bg,''))<15}},
  {{'id':'CLASS_003','sev':'ERROR','ok':cat<>'B2CL' OR g>250000}},
  {{'id':'MAND_001','sev':'BLOCKER','ok':okey%43<>0}}, {{'id':'MAND_002','sev':'BLOCKER','ok':t<>0}}]) AS r, known, st5, same FROM rg)"""
_AS_OF = "2001-01-01"


@query(f"""WITH {_VAL} SELECT task_id, r.id AS rule_id, r.sev AS severity, r.ok AS passed,
  CASE WHEN r.id<>'GST_005' THEN CASE WHEN r.ok THEN 'PASS' ELSE 'FAIL' END WHEN NOT known THEN 'SKIPPED'
   WHEN r.ok THEN 'PASS' WHEN st5='needs_review' THEN 'NEEDS_REVIEW' ELSE 'FAIL' END AS status FROM ru""", "sales")
def validation_results(spark, sf):
    rules = validation.standard_rules(F.lit(_AS_OF).cast("date"))
    return validation.rule_results(_invoices(spark, sf), rules).select(
        "task_id", "rule_id", "severity", "passed", "status")


@query(f"""WITH {_VAL} SELECT task_id, score, CASE WHEN blk THEN 'BLOCKED' WHEN score<92 OR err THEN 'NEEDS_REVIEW'
   ELSE 'ERP_READY' END AS overall_status, CASE WHEN mf THEN 'FAILED' ELSE 'PASSED' END AS math_status,
  CASE WHEN gf THEN 'FAILED' ELSE 'PASSED' END AS gst_status FROM (
 SELECT task_id, greatest(0,100-sum(CASE WHEN r.ok THEN 0 WHEN r.sev='BLOCKER' THEN 15 WHEN r.sev='ERROR' THEN 8
   ELSE 3 END))::DOUBLE AS score, bool_or(NOT r.ok AND r.sev='BLOCKER') AS blk, bool_or(NOT r.ok AND r.sev='ERROR') AS err,
  bool_or(NOT r.ok AND r.id LIKE 'MATH%') AS mf,
  bool_or(NOT r.ok AND r.id IN ('GST_001','GST_002','GST_003','GST_004','GST_005')) AS gf FROM ru GROUP BY 1)""", "sales")
def validation_scores(spark, sf):
    rules = validation.standard_rules(F.lit(_AS_OF).cast("date"))
    return validation.scores(_invoices(spark, sf), rules).drop("failed_rules")


@query("""SELECT e AS error, count(*) AS n FROM (SELECT unnest(list_filter([
   CASE WHEN okey%19=0 THEN 'Missing invoice number' END, CASE WHEN okey%23=0 THEN 'Missing voucher date' END,
   CASE WHEN abs(taxable_value+cgst_amount+sgst_amount+igst_amount-total_invoice_value)>2 THEN 'Math mismatch' END],
   lambda x: x IS NOT NULL)) AS e FROM sales) GROUP BY 1""", "sales")
def line_checks(spark, sf):
    lines = sales_lines(spark, sf, part=False).withColumns({
        "invoice_no": F.when(F.col("okey") % 19 != 0, F.col("invoice_no")),
        "voucher_date": F.when(F.col("okey") % 23 == 0, "").otherwise(F.col("voucher_date"))})
    out = validation.line_errors(lines).select(F.explode("errors").alias("error"))
    kind = F.when(F.col("error").startswith("Math"), "Math mismatch").otherwise(F.col("error"))
    return out.groupBy(kind.alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT i.field AS field, i.issue AS issue, i.severity AS severity, count(*) AS n FROM (SELECT unnest(list_filter([
   CASE WHEN okey%19=0 THEN {'field':'supplier_inv','issue':'missing','severity':'error'} END,
   CASE WHEN okey%19=1 THEN {'field':'supplier_inv','issue':'format','severity':'error'} END,
   CASE WHEN g='' THEN {'field':'gst_no','issue':'missing','severity':'error'} END,
   CASE WHEN g<>'' AND length(g)<>15 THEN {'field':'gst_no','issue':'length','severity':'error'} END,
   CASE WHEN okey%21=0 THEN {'field':'irn','issue':'format','severity':'error'} END,
   CASE WHEN abs(taxable_value+cgst_amount+sgst_amount+igst_amount-total_invoice_value)>1
     THEN {'field':'total_amount','issue':'math','severity':'error'} END,
   CASE WHEN place_of_supply IS NULL THEN {'field':'place_of_supply','issue':'missing','severity':'warning'} END],
   lambda x: x IS NOT NULL)) AS i FROM (SELECT *, coalesce(party_gstin,'') AS g FROM sales)) GROUP BY 1,2,3""", "sales")
def entry_issues(spark, sf):
    okey = F.col("okey")
    lines = sales_lines(spark, sf, part=False).select(
        "okey", "voucher_date", "party_gstin", "taxable_value", "cgst_amount", "sgst_amount", "igst_amount",
        "total_invoice_value", "place_of_supply",
        F.when(okey % 19 == 0, " ").when(okey % 19 == 1, F.concat("invoice_no", F.lit("#")))
        .otherwise(F.col("invoice_no")).alias("invoice_no"),
        F.when(okey % 21 == 0, F.lit("abc")).otherwise(F.sha2("invoice_no", 256)).alias("irn"))
    return validation.entry_issues(lines).groupBy("field", "issue", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_REC} SELECT task_id, abs(t+c+s0+i-g)<=2 AS math_balanced,
  coalesce(bg,'') NOT LIKE '%-%' AND bg IS NOT NULL AS gstin_format_valid,
  CASE WHEN abs(t+c+s0+i-g)<=2 AND bg IS NOT NULL AND bg NOT LIKE '%-%' THEN 'PASSED' ELSE 'FAILED' END AS validation_status
 FROM eng""", "sales")
def document_verdicts(spark, sf):
    out = validation.document_verdict(sales_lines(spark, sf, part=False), _summary(spark, sf))
    return out.select("task_id", "math_balanced", "gstin_format_valid", "validation_status")
