"""Whole chains and event windows over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from khata.operators import canonical, metrics
from khata.plans import invoice_audit, period_close, purchase_recon
from khata.streaming import events as ev

from .q_checks import _REC, _invoices, _summary
from .q_ops import _EV, _files, obs_events
from .registry import query
from .tables import REGISTRATIONS, client_rows, purchase_lines, sales_documents, sales_lines, statement_2b
from .util import d

_TYPE = """CASE event_type WHEN 'view' THEN 'extraction_quality_score' WHEN 'purchase' THEN 'file_metrics' WHEN 'error' THEN 'system_flag'
  WHEN 'click' THEN 'file_start' ELSE 'file_done' END"""


@query(f"""WITH {_EV} SELECT strftime(date_trunc('hour', ts),'%Y-%m-%d %H:%M') AS window_start, {_TYPE} AS event_type,
  CASE WHEN event_type='error' THEN CASE WHEN k<50 THEN 'CRITICAL' ELSE 'HIGH' END END AS severity,
  CASE WHEN event_type='error' THEN 'FLAG_'||(k%5)::VARCHAR END AS flag_id, count(*) AS n FROM ev GROUP BY 1,2,3,4""")
def event_windows(spark, sf):
    out = ev.event_counts(obs_events(spark, sf))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "severity",
                      "flag_id", "n")


@query(f"""WITH {_EV} SELECT strftime(date_trunc('hour', ts) - to_hours(h::INT),'%Y-%m-%d %H:%M') AS window_start, tenant_id, count(*) AS n
 FROM ev, (SELECT unnest(range(24)) AS h) WHERE event_type='error' GROUP BY 1,2""")
def notification_windows(spark, sf):
    out = ev.notification_rate(obs_events(spark, sf))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "tenant_id", "n")


@query("""SELECT batch_id, count(*) AS seen, count(*) FILTER (okey%13<>0) AS ok, count(*) FILTER (okey%13=0) AS failed,
  sum(okey*37%5000)::BIGINT AS total_ms FROM (SELECT DISTINCT okey, batch_id FROM sales) GROUP BY 1""", "sales")
def batch_progress(spark, sf):
    return ev.batch_progress(_files(spark, sf)).drop("cost_inr")


@query(f"""WITH {_EV} SELECT {_TYPE} AS event_type, count(*) AS n FROM ev WHERE file_id NOT IN (SELECT file_id FROM ev WHERE event_id%20=7) GROUP BY 1""")
def events_without_replaced(spark, sf):
    log = obs_events(spark, sf)
    return ev.without_replaced(log, log.filter("is_replay").select("file_id").distinct()).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_EV} SELECT event_id, {_TYPE} AS event_type, strftime(ts,'%Y-%m-%d %H:%M:%S') AS at FROM ev WHERE file_id='F7'""")
def event_trace(spark, sf):
    """What happened to one file, in order: a look-up, so other files are not the feature."""
    out = metrics.trace(obs_events(spark, sf), "F7")
    return out.select("event_id", "event_type", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT DISTINCT upper(invoice_no) AS invoice_no, upper(coalesce(party_gstin,'')) AS party_gstin, upper(voucher_date) AS voucher_date FROM sales""", "sales")
def first_sightings(spark, sf):
    lines = sales_lines(spark, sf, part=False).withColumn("timestamp_utc", F.col("o_orderdate"))
    unique = ev.first_sightings(lines.select("invoice_no", "party_gstin", "voucher_date", "timestamp_utc"))
    return unique.select("invoice_no", "party_gstin", "voucher_date")


@query("""SELECT count(*) FILTER (status='PASS') AS n_pass, count(*) FILTER (status='CLIENT_MISSING') AS n_client_missing,
  count(*) FILTER (status='MISSING_SOURCE_PDF') AS n_missing FROM (SELECT CASE WHEN c.doc_no IS NULL THEN 'CLIENT_MISSING'
   WHEN coalesce(o.party_gstin,'')='' THEN 'NO' WHEN abs(o.taxable-c.taxable)<=2.5 AND abs(o.igst-c.igst)<=2.5 AND abs(o.cgst-c.cgst)<=2.5
    AND abs(o.sgst-c.sgst)<=2.5 AND abs(o.total-c.total)<=2.5 THEN 'PASS' END AS status
  FROM (SELECT invoice_no AS doc_no, * FROM docs) o LEFT JOIN cld c ON o.doc_no=c.doc_no)""", "docs cld")
def period_close_summary(spark, sf):
    out = period_close.close_period(sales_lines(spark, sf), client_rows(sales_documents(spark, sf)), REGISTRATIONS)
    status = F.col("status")
    return out["entries"].agg(*[F.count(F.when(status == s, 1)).alias(n) for s, n in (
        ("PASS", "n_pass"), ("CLIENT_MISSING", "n_client_missing"), ("MISSING_SOURCE_PDF", "n_missing"))])


@query("""SELECT recon_status, client_action, count(*) AS n FROM (SELECT recon_status, CASE recon_status WHEN 'mismatch' THEN
   'Flag for accountant review' WHEN 'missing_in_2b' THEN 'Auto-notify client: follow up with vendor (ITC at risk)' END AS client_action FROM rows2b)
 GROUP BY 1,2""", "rows2b")
def purchase_recon_actions(spark, sf):
    out = purchase_recon.reconcile_purchases(purchase_lines(spark, sf, part=False), statement_2b(spark, sf))
    return out["rows"].groupBy("recon_status", "client_action").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_REC} SELECT task_id, status AS recon_status, conf AS recon_confidence,
  CASE WHEN abs(t+c+s0+i-g)<=2 AND bg IS NOT NULL AND bg NOT LIKE '%-%' THEN 'PASSED' ELSE 'FAILED' END AS validation_status FROM eng""", "sales")
def invoice_audit_status(spark, sf):
    invoices = _invoices(spark, sf).drop("rates_ok")
    out = invoice_audit.audit(sales_lines(spark, sf, part=False), _summary(spark, sf), invoices, F.lit("2001-01-01").cast("date"))
    return out.select("task_id", "recon_status", "recon_confidence", "validation_status")


@query("""SELECT okey, count(*) AS n_lines, sum(t)::DOUBLE AS taxable, sum(tax)::DOUBLE AS tax FROM (
  SELECT okey, t, CASE WHEN party_state='07' THEN 2*round(t*p*0.005,2) ELSE round(t*p*0.01,2) END AS tax FROM (
   SELECT okey, party_state, taxable_value AS t, CASE WHEN gstr1_category='NIL_EXEMPT' THEN 0 WHEN pct=0 AND hsn LIKE '99%' THEN 18 ELSE pct END::DECIMAL(4,0) AS p
   FROM sales)) GROUP BY 1""", "sales")
def cleaned_lines(spark, sf):
    """The cleaning chain on net lines; a document without printed tax falls back on its parties' states."""
    lines = sales_lines(spark, sf).withColumns({"discount": F.lit(0).cast("decimal(18,2)"), "tie": F.col("seq.l_extendedprice")})
    any_tax = F.sum(F.col("cgst_amount") + F.col("igst_amount")).over(Window.partitionBy("okey"))
    home = F.col("party_state") == "07"
    marked = lines.withColumn("any_tax", any_tax).withColumns({
        "cgst_amount": F.when((F.col("any_tax") == 0) & home, F.lit("0.01").cast("decimal(18,2)")).otherwise(F.col("cgst_amount")),
        "igst_amount": F.when((F.col("any_tax") == 0) & ~home, F.lit("0.01").cast("decimal(18,2)")).otherwise(F.col("igst_amount"))})
    out = invoice_audit.clean_lines(marked, "okey", "line", ["tie"])
    return out.groupBy("okey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("taxable_value").cast("double").alias("taxable"),
        F.sum(F.col("cgst_amount") + F.col("sgst_amount") + F.col("igst_amount")).cast("double").alias("tax"))


_DOC_KEY = ("task_id", "invoice_no")
_HEADS = "voucher_date party_ledger_name party_gstin place_of_supply"


@query("""SELECT task_id, invoice_no, okey, line, first_value(voucher_date) OVER w AS voucher_date, first_value(party_ledger_name) OVER w AS party_ledger_name,
  first_value(party_gstin) OVER w AS party_gstin, first_value(place_of_supply) OVER w AS place_of_supply, particulars, hsn, qty, rate, discount::DOUBLE AS discount,
  taxable_value::DOUBLE AS taxable_value, cgst_amount::DOUBLE AS cgst_amount, sgst_amount::DOUBLE AS sgst_amount, igst_amount::DOUBLE AS igst_amount,
  total_invoice_value::DOUBLE AS total_invoice_value, first_value(gstr1_category) OVER w AS gstr1_category
 FROM sales WINDOW w AS (PARTITION BY task_id, invoice_no ORDER BY seq)""", "sales")
def canonical_round_trip(spark, sf):
    """Sales lines nested by document, in parts of three lines, and flattened again."""
    nested = canonical.to_canonical(sales_lines(spark, sf), canonical.SALES, _DOC_KEY, part_lines=3)
    back = canonical.to_lines(nested, canonical.SALES, _DOC_KEY)
    return back.select("task_id", "invoice_no", F.col("seq.l_orderkey").alias("okey"), F.col("seq.l_linenumber").cast("long").alias("line"), *_HEADS.split(), "particulars",
                       "hsn", "qty", "rate", *d("discount taxable_value cgst_amount sgst_amount igst_amount total_invoice_value"), "gstr1_category")


@query("""SELECT task_id, invoice_no, n_lines, n_lines AS n_items, party_name AS supplier, 'Client Company' AS buyer, coalesce(gstin,'') AS gstin,
   taxable::DOUBLE AS taxable_value, (cgst+sgst+igst)::DOUBLE AS tax, total::DOUBLE AS grand_total, 'SQL Load' AS method
  FROM (SELECT okey::VARCHAR AS task_id, invoice_no, count(*) AS n_lines, min(party_ledger_name) AS party_name, min(party_gstin) AS gstin,
   sum(taxable_value) AS taxable, sum(cgst_amount) AS cgst, sum(sgst_amount) AS sgst, sum(igst_amount) AS igst, sum(total_invoice_value) AS total
   FROM books GROUP BY 1,2)""", "books")
def canonical_invoices(spark, sf):
    """Purchase documents as canonical invoices: head and totals of every document, its items counted over all parts."""
    lines = purchase_lines(spark, sf).withColumn("itc_eligibility", F.col("itc_category"))
    nested = canonical.to_canonical(lines, canonical.PURCHASE, _DOC_KEY, part_lines=3)
    flat = nested.groupBy(*_DOC_KEY).agg(
        F.sum(F.size("line_items")).alias("n_lines"), F.sum(F.size(F.array_distinct("line_items.seq"))).alias("n_items"),
        *[F.first(c).alias(c) for c in ("supplier", "buyer", "tax_summary")])
    s = "tax_summary."
    return flat.select(
        *_DOC_KEY, "n_lines", "n_items", F.col("supplier.legal_name.value").alias("supplier"), F.col("buyer.name.value").alias("buyer"),
        F.coalesce("supplier.gstin.value", F.lit("")).alias("gstin"), F.col(f"{s}taxable_value.value").cast("double").alias("taxable_value"),
        (F.col(f"{s}cgst_amount.value") + F.col(f"{s}sgst_amount.value") + F.col(f"{s}igst_amount.value")).cast("double").alias("tax"),
        F.col(f"{s}grand_total.value").cast("double").alias("grand_total"), F.col(f"{s}grand_total.confidence.method").alias("method"))
