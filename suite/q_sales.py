"""Sales three-way match, filing, duplicates and registers over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.functions.itc import itc_block_reason, itc_category
from khata.operators import duplicates, filing, msme, registers, sales_recon

from .registry import query
from .tables import (
    FIRM_STATE, REGISTRATIONS, client_rows, os_rows, purchase_lines, sales_documents, sales_lines,
)
from .util import d


def _entries(spark, sf):
    docs = sales_documents(spark, sf)
    return sales_recon.reconcile_documents(os_rows(docs), client_rows(docs))


@query("""SELECT doc_no, doc_type, status,
  CASE WHEN c THEN d_taxable END::DOUBLE AS delta_taxable, CASE WHEN c THEN d_igst END::DOUBLE AS delta_igst,
  CASE WHEN c THEN d_total END::DOUBLE AS delta_total,
  status='CLIENT_SHEET_ERROR' AND okey%11=1 AS known_inversion
 FROM (SELECT *, status IN ('PASS','CLIENT_SHEET_ERROR','UNRESOLVED_CONFLICT') AS c FROM recon3)""", "recon3")
def sales_three_way(spark, sf):
    return _entries(spark, sf).select("doc_no", "doc_type", "status",
                                      *d("delta_taxable delta_igst delta_total"), "known_inversion")


@query("""SELECT status, count(*) AS n, count(*) FILTER (status<>'PASS') AS needs_attention
 FROM recon3 GROUP BY 1""", "recon3")
def recon_histogram(spark, sf):
    return sales_recon.status_histogram(_entries(spark, sf))


@query("""SELECT o::DOUBLE AS os_net_taxable, c::DOUBLE AS client_net_taxable, g::DOUBLE AS gstr1_net_taxable,
  (o-c)::DOUBLE AS os_vs_client, (o-g)::DOUBLE AS os_vs_gstr1, abs(o-c)<=2.5 AND abs(o-g)<=2.5 AS matches
 FROM (SELECT sum(CASE WHEN doc_type='Invoice' THEN taxable ELSE -taxable END) AS o FROM osd),
  (SELECT sum(CASE WHEN doc_type='Invoice' THEN taxable ELSE -taxable END) AS c FROM cld),
  (SELECT sum(CASE WHEN voucher_type='Sales' THEN taxable_value ELSE -taxable_value END) AS g FROM sales)""",
       "osd cld sales")
def totals_three_way(spark, sf):
    docs = sales_documents(spark, sf)
    filed = sales_lines(spark, sf, part=False).select(
        F.col("voucher_type").alias("doc_type"), F.col("taxable_value").alias("taxable"))
    out = sales_recon.totals_check(os_rows(docs), client_rows(docs), filed)
    return out.select(*d("os_net_taxable client_net_taxable gstr1_net_taxable os_vs_client os_vs_gstr1"),
                      "matches")


@query("""SELECT sum(CASE WHEN voucher_type='Sales' THEN taxable_value ELSE -taxable_value END)::DOUBLE AS net_taxable FROM sales""", "sales")
def net_taxable(spark, sf):
    lines = sales_lines(spark, sf, part=False)
    return sales_recon.net_taxable(lines, "voucher_type", "taxable_value").select(*d("net_taxable"))


@query("""WITH a AS (SELECT *, CASE okey%10 WHEN 0 THEN 'ERR' WHEN 1 THEN 'WARN' WHEN 2 THEN NULL ELSE 'PASS' END AS status FROM sales)
 SELECT count(*) AS total_invoices, count(*) FILTER (status='PASS') AS n_pass, count(*) FILTER (status='WARN') AS n_warn,
  count(*) FILTER (status='ERR') AS n_err, round(count(*) FILTER (status='PASS')*100.0/count(*),1)::DOUBLE AS accuracy_pct,
  sum(taxable_value)::DOUBLE AS total_taxable, sum(total_invoice_value)::DOUBLE AS total_value FROM a""", "sales")
def audit_batch_summary(spark, sf):
    kind = F.col("okey") % 10
    status = F.when(kind == 0, "ERR").when(kind == 1, "WARN").when(kind != 2, "PASS")
    out = registers.audit_batch_summary(sales_lines(spark, sf, part=False).withColumn("status", status))
    return out.select("total_invoices", "n_pass", "n_warn", "n_err", *d("accuracy_pct total_taxable total_value"))


@query("""SELECT invoice_no AS doc_no, count(*) AS n, sum(taxable_value)::DOUBLE AS taxable FROM sales
 GROUP BY 1 HAVING count(*)>1""", "sales")
def dup_doc_numbers(spark, sf):
    lines = sales_lines(spark, sf, part=False).select(
        F.col("invoice_no").alias("doc_no"), F.col("taxable_value").alias("taxable"))
    return sales_recon.duplicate_numbers(lines).select("doc_no", "n", *d("taxable"))


@query("""SELECT CASE WHEN status IN ('MISSING_SOURCE_PDF','UNVERIFIABLE_NO_GSTIN') THEN 'skipped'
   WHEN status='UNRESOLVED_CONFLICT' THEN 'flagged' ELSE 'included' END AS filing_outcome,
  status AS doc_status, count(*) AS n_lines, count(DISTINCT invoice_no) AS n_docs,
  sum(taxable_value)::DOUBLE AS taxable
 FROM sales LEFT JOIN recon3 ON invoice_no=doc_no GROUP BY 1,2""", "sales recon3")
def filing_gate(spark, sf):
    marked = filing.with_recon_status(sales_lines(spark, sf, part=False), _entries(spark, sf))
    return marked.groupBy("filing_outcome", "doc_status").agg(
        F.count(F.lit(1)).alias("n_lines"), F.countDistinct("invoice_no").alias("n_docs"),
        F.sum("taxable_value").cast("double").alias("taxable"))


@query("""SELECT CASE p WHEN 'MH' THEN '27AABCM0001A1Z5' WHEN 'HR' THEN '06AABCH0001A1Z5'
   ELSE 'UNKNOWN_REGISTRATION' END AS registration, count(*) AS n_lines, sum(taxable_value)::DOUBLE AS taxable
 FROM (SELECT *, CASE WHEN invoice_no LIKE 'CR%' THEN substr(original_no,1,2) ELSE substr(invoice_no,1,2) END AS p
   FROM sales) GROUP BY 1""", "sales")
def registration_split(spark, sf):
    return filing.with_registration(sales_lines(spark, sf), REGISTRATIONS).groupBy("registration").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("taxable_value").cast("double").alias("taxable"))


@query("""WITH kept AS (SELECT *, CASE p WHEN 'MH' THEN '27AABCM0001A1Z5' WHEN 'HR' THEN '06AABCH0001A1Z5'
     ELSE 'UNKNOWN_REGISTRATION' END AS registration
   FROM (SELECT s.*, r.status, CASE WHEN invoice_no LIKE 'CR%' THEN substr(original_no,1,2)
      ELSE substr(invoice_no,1,2) END AS p FROM sales s LEFT JOIN recon3 r ON invoice_no=doc_no)
   WHERE coalesce(status,'') NOT IN ('MISSING_SOURCE_PDF','UNVERIFIABLE_NO_GSTIN'))
 SELECT registration, registration<>'UNKNOWN_REGISTRATION' AS has_data, count(*) AS n_lines,
  CASE WHEN registration='UNKNOWN_REGISTRATION' THEN 0 ELSE sum(s*taxable_value) END::DOUBLE AS total_taxable,
  CASE WHEN registration='UNKNOWN_REGISTRATION' THEN 0 ELSE sum(s*(cgst_amount+sgst_amount+igst_amount)) END::DOUBLE AS total_tax,
  CASE WHEN registration='UNKNOWN_REGISTRATION' THEN 0 ELSE
    count(DISTINCT (invoice_no, coalesce(party_gstin,''), cat)) END AS total_invoices,
  count(DISTINCT CASE WHEN status='UNRESOLVED_CONFLICT' THEN invoice_no END) AS flagged_documents
 FROM (SELECT *, CASE WHEN voucher_type='Sales' THEN 1 ELSE -1 END AS s,
   CASE WHEN voucher_type='Sales' THEN gstr1_category ELSE 'CDN' END AS cat FROM kept) GROUP BY 1""",
       "sales recon3")
def filings_by_registration(spark, sf):
    docs = sales_documents(spark, sf)
    # outcomes don't depend on the client's places; without them both sides need the same columns, which are shuffled once
    client = client_rows(docs).drop("supplier_location", "state_of_supply", "interstate_or_intrastate")
    out = filing.filings_summary(sales_lines(spark, sf), sales_recon.reconcile_documents(os_rows(docs), client), REGISTRATIONS)
    return out.select("registration", "has_data", "n_lines", *d("total_taxable total_tax"),
                      "total_invoices", "flagged_documents")


@query("""SELECT batch_id, upper(invoice_no) AS invoice_no, upper(coalesce(party_gstin,'')) AS party_gstin,
  upper(voucher_date) AS voucher_date, count(*) AS "count"
 FROM (SELECT batch_id, invoice_no, party_gstin, voucher_date FROM sales
   UNION ALL SELECT batch_id, invoice_no, party_gstin, voucher_date FROM books)
 GROUP BY 1,2,3,4 HAVING count(*)>1""", "sales books")
def dup_within_batch(spark, sf):
    both = duplicates.both_registers(sales_lines(spark, sf, part=False),
                                     purchase_lines(spark, sf, part=False))
    return duplicates.within_batch(both).select("batch_id", "invoice_no", "party_gstin",
                                                "voucher_date", "count")


def _recycled(spark, sf):
    """Sales lines under a number range that starts again every 500 orders."""
    return sales_lines(spark, sf, part=False).withColumn(
        "invoice_no", F.concat(F.lit(" s-"), (F.col("okey") % 500).cast("string")))


_RECYCLED = """rec AS (SELECT *, 'S-'||(okey%500)::VARCHAR AS no, upper(coalesce(party_gstin,'')) AS g FROM sales)"""


@query(f"""WITH {_RECYCLED}, cur AS (SELECT no, g, count(*) AS n FROM rec
   WHERE batch_id=(SELECT max(batch_id) FROM rec) GROUP BY 1,2)
 SELECT DISTINCT no AS invoice_no, g AS party_gstin, batch_id AS other_batch_id, n+1 AS "count"
 FROM rec JOIN cur USING (no, g) WHERE batch_id<>(SELECT max(batch_id) FROM rec)""", "sales")
def dup_cross_batch(spark, sf):
    lines = _recycled(spark, sf)
    current = lines.agg(F.max("batch_id").alias("batch_id"))
    return duplicates.cross_batch(lines, current).select("invoice_no", "party_gstin", "other_batch_id", "count")


@query(f"""WITH {_RECYCLED} SELECT no AS invoice_no, g AS party_gstin, count(DISTINCT batch_id) AS n_batches,
  min(batch_id) AS first_batch, max(batch_id) AS last_batch, count(*) AS n_lines FROM rec GROUP BY 1,2
 HAVING count(DISTINCT batch_id)>1""", "sales")
def dup_shared_documents(spark, sf):
    return duplicates.shared_documents(_recycled(spark, sf))


@query(f"""WITH {_RECYCLED}, w AS (SELECT count(*) AS n FROM (SELECT 1 FROM rec
    GROUP BY batch_id, no, g, upper(voucher_date) HAVING count(*)>1)),
  cur AS (SELECT DISTINCT no, g FROM rec WHERE batch_id=(SELECT max(batch_id) FROM rec)),
  x AS (SELECT count(*) AS n FROM (SELECT DISTINCT no, g, batch_id FROM rec JOIN cur USING (no, g)
    WHERE batch_id<>(SELECT max(batch_id) FROM rec)))
 SELECT w.n+x.n AS total_duplicates, x.n AS critical_count, w.n AS high_count, w.n+x.n>0 AS has_duplicates
 FROM w, x""", "sales")
def dup_report(spark, sf):
    lines = _recycled(spark, sf)
    current = lines.agg(F.max("batch_id").alias("batch_id"))
    return duplicates.report(duplicates.within_batch(lines), duplicates.cross_batch(lines, current))


@query(f"""WITH {_RECYCLED} SELECT no AS invoice_no, g AS party_gstin, task_id, min(task_id) OVER w AS first_task,
   count(*) AS n FROM rec GROUP BY tenant_id, no, g, upper(voucher_date), task_id
 WINDOW w AS (PARTITION BY tenant_id, no, g, upper(voucher_date))
 QUALIFY min(task_id) OVER w <> max(task_id) OVER w""", "sales")
def dup_probe_per_document(spark, sf):
    lines = _recycled(spark, sf)
    return duplicates.already_processed(lines).groupBy("invoice_no", "party_gstin", "task_id", "first_task") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n.invoice_no, n.original_no AS original_invoice_no, f.g AS resolved_gstin, count(*) AS n_lines
 FROM sales n LEFT JOIN (SELECT tenant_id, invoice_no, arg_min(party_gstin, seq) AS g FROM sales
   WHERE party_gstin IS NOT NULL AND voucher_type='Sales' GROUP BY 1,2) f
   ON n.tenant_id=f.tenant_id AND n.original_no=f.invoice_no
 WHERE n.voucher_type<>'Sales' GROUP BY 1,2,3""", "sales")
def note_gstin_inherit(spark, sf):
    lines = sales_lines(spark, sf, part=False)
    sales = F.col("voucher_type") == "Sales"
    out = duplicates.inherit_gstin(lines.filter(~sales).drop("party_gstin"), lines.filter(sales))
    return out.groupBy("invoice_no", "original_invoice_no", "resolved_gstin").agg(
        F.count(F.lit(1)).alias("n_lines"))


_REGISTER = """reg AS (
 SELECT a.*, h.hsn, h.nature, p.particulars FROM (
  SELECT invoice_no, voucher_date, party_gstin, party_ledger_name, place_of_supply, gstr1_category,
   sum(taxable_value) AS taxable_value, sum(discount) AS discount, sum(advances) AS advances,
   sum(sgst_amount) AS sgst_amount, sum(cgst_amount) AS cgst_amount, sum(igst_amount) AS igst_amount,
   sum(total_invoice_value) AS total_invoice_value FROM dis GROUP BY 1,2,3,4,5,6) a
 JOIN (SELECT invoice_no, CASE WHEN count(DISTINCT hsn)=1 THEN min(hsn) END AS hsn,
   arg_min(narration, seq) AS nature FROM dis GROUP BY 1) h USING (invoice_no)
 JOIN (SELECT invoice_no, string_agg(particulars, ' | ' ORDER BY s) AS particulars FROM (
   SELECT invoice_no, trim(particulars) AS particulars, min(seq) AS s FROM dis GROUP BY 1,2) GROUP BY 1) p
   USING (invoice_no)),"""
_DISTINCT = """dis AS (SELECT invoice_no, voucher_date, party_gstin, party_ledger_name, place_of_supply,
  gstr1_category, taxable_value, discount, advances, sgst_amount, cgst_amount, igst_amount,
  total_invoice_value, particulars, narration, hsn, min(seq) AS seq FROM sales GROUP BY ALL),"""


def _register(spark, sf):
    return registers.sales_register(sales_lines(spark, sf))


@query(f"""WITH {_DISTINCT} {_REGISTER} z AS (SELECT 1)
 SELECT invoice_no, voucher_date, party_gstin, gstr1_category, taxable_value::DOUBLE AS taxable_value,
  discount::DOUBLE AS discount, advances::DOUBLE AS advances, igst_amount::DOUBLE AS igst_amount,
  total_invoice_value::DOUBLE AS total_invoice_value, hsn, nature, particulars FROM reg""", "sales")
def sales_register(spark, sf):
    return _register(spark, sf).select(
        "invoice_no", "voucher_date", "party_gstin", "gstr1_category",
        *d("taxable_value discount advances igst_amount total_invoice_value"), "hsn", "nature", "particulars")


@query(f"""WITH {_DISTINCT} {_REGISTER} k AS (SELECT *, sgst_amount+cgst_amount+igst_amount AS tax,
   gstr1_category IN ('EXP','B2CS') OR taxable_value<30000 AS ex,
   coalesce(nature LIKE '%professional%', false) AS prof FROM reg)
 SELECT invoice_no, gstr1_category, CASE WHEN tax=0 AND taxable_value>0 THEN 'Export LUT'
   WHEN igst_amount>0 THEN 'Interstate' WHEN cgst_amount>0 THEN 'Intrastate' ELSE 'Exempt/Zero-rated' END AS gst_type,
  CASE WHEN ex THEN 'No' ELSE 'Yes' END AS tds_applicable,
  CASE WHEN ex THEN '–' WHEN prof THEN '194J' ELSE '194C' END AS tds_section,
  (CASE WHEN ex THEN 0 WHEN prof THEN round(taxable_value*10*0.01,2) ELSE round(taxable_value*2*0.01,2) END)::DOUBLE AS tds_deducted,
  (taxable_value-CASE WHEN ex THEN 0 WHEN prof THEN round(taxable_value*10*0.01,2) ELSE round(taxable_value*2*0.01,2) END)::DOUBLE AS net_receivable
 FROM k""", "sales")
def tds_workings(spark, sf):
    return registers.tds_workings(_register(spark, sf)).select(
        "invoice_no", "gstr1_category", "gst_type", "tds_applicable", "tds_section",
        *d("tds_deducted net_receivable"))


@query(f"""WITH {_DISTINCT} {_REGISTER} k AS (SELECT *, sgst_amount+cgst_amount+igst_amount AS tax FROM reg),
 v AS (SELECT *, tax=0 AND taxable_value>0 AS ex, abs(total_invoice_value-taxable_value-tax) AS var FROM k)
 SELECT invoice_no, gstr1_category, (taxable_value+tax)::DOUBLE AS computed_total,
  (CASE WHEN ex THEN 0 ELSE var END)::DOUBLE AS variance,
  CASE WHEN ex THEN 'PASS – Export LUT' WHEN var<=2.5 THEN 'PASS' ELSE 'REVIEW – Variance ₹'||var::DECIMAL(18,2)::VARCHAR END
   AS match_status FROM v""", "sales")
def matching_sheet(spark, sf):
    return registers.matching_sheet(_register(spark, sf)).select(
        "invoice_no", "gstr1_category", *d("computed_total variance"), "match_status")


_ITC = """CASE WHEN hsn LIKE '8703%' OR hsn LIKE '3304%' THEN 'ITC_BLOCKED'
  WHEN upper(itc_category) IN ('YES','ELIGIBLE') THEN 'ITC_ELIGIBLE' WHEN upper(itc_category)='NO' THEN 'ITC_BLOCKED'
  WHEN upper(itc_category)='PARTIAL' THEN 'ITC_RESTRICTED' WHEN upper(itc_category)='NIL_RATED' THEN 'ITC_EXEMPT'
  ELSE 'ITC_UNKNOWN' END"""


def _purchases(spark, sf):
    lines = purchase_lines(spark, sf)
    hsn, part, given = F.col("hsn"), F.col("particulars"), F.col("itc_category")
    return lines.select(*[c for c in lines.columns if c != "itc_category"],
                        itc_category(hsn, part, given).alias("itc_category"),
                        itc_block_reason(hsn, part).alias("block_reason"))


@query(f"""SELECT category, block_reason, count(*) AS n, sum(taxable_value)::DOUBLE AS taxable FROM (
 SELECT taxable_value, {_ITC} AS category, CASE WHEN hsn LIKE '8703%' OR hsn LIKE '3304%'
   THEN 'Section 17(5) — blocked HSN' END AS block_reason FROM books) GROUP BY 1,2""", "books")
def itc_eligibility(spark, sf):
    return _purchases(spark, sf).groupBy(F.col("itc_category").alias("category"), "block_reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("taxable_value").cast("double").alias("taxable"))


@query(f"""SELECT invoice_no, party_ledger_name, particulars, taxable_value::DOUBLE AS taxable_value, hsn,
  {_ITC} AS itc_status, total_invoice_value::DOUBLE AS total_invoice_value FROM books
 QUALIFY row_number() OVER (PARTITION BY invoice_no, party_ledger_name, particulars, taxable_value ORDER BY seq)=1""",
       "books")
def purchase_register(spark, sf):
    out = registers.purchase_register(_purchases(spark, sf))
    return out.select("invoice_no", "party_ledger_name", "particulars", *d("taxable_value"), "hsn",
                      "itc_status", *d("total_invoice_value"))


@query(f"""WITH r AS (SELECT taxable_value AS a, {_ITC} AS c FROM books
  QUALIFY row_number() OVER (PARTITION BY invoice_no, party_ledger_name, particulars, taxable_value ORDER BY seq)=1)
 SELECT category, coalesce(sum(a),0)::DOUBLE AS taxable_amount, count(a) AS line_items,
  CASE category WHEN 'ITC_BLOCKED' THEN coalesce(sum(a),0) WHEN 'ITC_RESTRICTED' THEN coalesce(sum(a),0)
   WHEN 'TOTAL' THEN sum(a) FILTER (c<>'ITC_ELIGIBLE') ELSE 0 END::DOUBLE AS itc_at_risk
 FROM (SELECT unnest(['ITC_ELIGIBLE','ITC_BLOCKED','ITC_RESTRICTED','ITC_EXEMPT','ITC_UNKNOWN','TOTAL']) AS category)
 LEFT JOIN r ON category=c OR category='TOTAL' GROUP BY 1""", "books")
def itc_summary(spark, sf):
    out = registers.itc_summary(registers.purchase_register(_purchases(spark, sf)))
    return out.select("category", *d("taxable_amount"), "line_items", *d("itc_at_risk"))


def _msme(spark, sf):
    lines = purchase_lines(spark, sf, part=False)
    skey = F.col("skey")
    bills = lines.select(
        "invoice_no", "okey", "skey",
        F.to_date("o_orderdate").alias("invoice_date"),
        F.when(skey % 9 != 0, F.to_date("pay_date")).alias("payment_date"),
        F.when(skey % 4 == 0, "micro").when(skey % 4 == 1, "SMALL").when(skey % 4 == 2, "MEDIUM")
        .otherwise("UNKNOWN").alias("enterprise_type"),
        (F.col("okey") % 2 == 0).alias("has_agreement"), F.col("taxable_value").alias("amount"),
        (skey % 3 == 0).alias("is_verified"),
    )
    return msme.compliance(bills, F.lit("2002-01-01").cast("date"))


_MSME = """ms AS (SELECT *, greatest(0, elapsed-lim) AS delay, skey%4 IN (0,1) AS elig FROM (
 SELECT invoice_no, skey, taxable_value AS amount, skey%9=0 AS unpaid, CASE WHEN okey%2=0 THEN 45 ELSE 15 END AS lim,
  greatest(0, date_diff('day', o_orderdate::DATE, CASE WHEN skey%9=0 THEN DATE '2002-01-01' ELSE pay_date::DATE END))
   AS elapsed FROM books)),
 mi AS (SELECT *, CASE WHEN elig AND delay>0 THEN amount ELSE 0 END AS dis,
  round(CASE WHEN elig AND delay>0 THEN amount::DOUBLE*pow(1+3*0.0675::DOUBLE/12, elapsed/30.417::DOUBLE)-amount::DOUBLE ELSE 0 END,2) AS interest
  FROM ms)"""


@query(f"""WITH {_MSME} SELECT invoice_no, elapsed AS days_elapsed, lim::BIGINT AS limit_days, delay AS delay_days,
  delay>0 AS is_delayed, elig AS is_eligible_msme, unpaid AS is_unpaid, amount::DOUBLE AS amount,
  dis::DOUBLE AS disallowed_amount, interest AS interest_penalty FROM mi""", "books")
def msme_43bh(spark, sf):
    return _msme(spark, sf).select(
        "invoice_no", "days_elapsed", "limit_days", "delay_days", "is_delayed", "is_eligible_msme",
        "is_unpaid", *d("amount disallowed_amount"), "interest_penalty")


@query(f"""WITH {_MSME} SELECT sum(amount)::DOUBLE AS total_amount, sum(dis)::DOUBLE AS total_disallowed,
  sum(interest::DECIMAL(18,2))::DOUBLE AS total_interest, count(*) FILTER (skey%3=0) AS n_verified FROM mi""", "books")
def msme_portfolio(spark, sf):
    return msme.portfolio(_msme(spark, sf)).select(*d("total_amount total_disallowed"), "total_interest",
                                                   "n_verified")


@query(f"""WITH {_MSME} SELECT 'all' AS tab, count(*) AS n FROM mi UNION ALL
  SELECT 'disallowed', count(*) FILTER (dis>0) FROM mi UNION ALL
  SELECT 'verified', count(*) FILTER (skey%3=0) FROM mi""", "books")
def msme_tabs(spark, sf):
    register = _msme(spark, sf)
    out = None
    for name in ("all", "disallowed", "verified"):
        part = msme.tab(register, name).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("tab"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT batch_id, count(*) AS n_lines, sum(taxable_value)::DOUBLE AS taxable,
  sum(cgst_amount+sgst_amount+igst_amount)::DOUBLE AS tax, sum(total_invoice_value)::DOUBLE AS value,
  count(*) FILTER (cgst_amount+sgst_amount+igst_amount=0) AS zero_tax FROM sales GROUP BY 1""", "sales")
def batch_strip(spark, sf):
    out = registers.batch_strip(sales_lines(spark, sf, part=False))
    return out.select("batch_id", "n_lines", *d("taxable tax value"), "zero_tax")
