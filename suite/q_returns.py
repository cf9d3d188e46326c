"""Return sections (GSTR-1) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.functions.dates import gst_date
from khata.functions.ids import resolve_pos
from khata.functions.tax import SLAB_RATES, active_tax, is_export, rate_of
from khata.operators import gstr1, return_document

from .registry import query
from .tables import FIRM_GSTIN, FIRM_STATE, sales_lines
from .util import d


def _groups(spark, sf):
    return gstr1.invoice_groups(sales_lines(spark, sf, part=False), FIRM_STATE)


@query("""SELECT hsn AS hsn_sc, rt, arg_min(substr(particulars,1,30),seq) AS "desc",
  sum(sign*qty)::DOUBLE AS qty, sum(sign*total)::DOUBLE AS val, sum(sign*taxable_value)::DOUBLE AS txval,
  sum(sign*igst_amount)::DOUBLE AS iamt, sum(sign*cgst_amount)::DOUBLE AS camt,
  sum(sign*sgst_amount)::DOUBLE AS samt, 'NOS' AS uqc
 FROM (SELECT *, CASE WHEN voucher_type='Sales' THEN 1 ELSE -1 END AS sign, pct::DOUBLE AS rt,
   CASE WHEN total_invoice_value=0 THEN taxable_value+cgst_amount+sgst_amount+igst_amount
     ELSE total_invoice_value END AS total FROM sales) GROUP BY 1,2""", "sales")
def hsn_summary(spark, sf):
    out = gstr1.hsn_summary(sales_lines(spark, sf))
    return out.select("hsn_sc", "rt", "desc", "qty", *d("val txval iamt camt samt"), "uqc")


@query("""SELECT is_b2b, hsn AS hsn_sc, rt, row_number() OVER (PARTITION BY is_b2b ORDER BY first_seq) AS num,
   txval, val FROM (
  SELECT is_b2b, hsn, pct::DOUBLE AS rt, min(seq) AS first_seq, sum(sign*taxable_value)::DOUBLE AS txval,
   sum(sign*total)::DOUBLE AS val
  FROM (SELECT *, CASE WHEN voucher_type='Sales' THEN 1 ELSE -1 END AS sign,
    (CASE WHEN voucher_type='Sales' THEN gstr1_category WHEN length(coalesce(party_gstin,''))>=15 THEN 'CDNR'
       ELSE 'CDNUR' END) IN ('B2B','CDNR') AS is_b2b,
    CASE WHEN total_invoice_value=0 THEN taxable_value+cgst_amount+sgst_amount+igst_amount
      ELSE total_invoice_value END AS total FROM sales) GROUP BY 1,2,3)""", "sales")
def hsn_by_buyer_kind(spark, sf):
    out = gstr1.numbered(gstr1.hsn_summary(sales_lines(spark, sf), split_b2b=True), ["is_b2b"])
    return out.select("is_b2b", "hsn_sc", "rt", "num", *d("txval val"))


_RATE = """CASE WHEN taxable<=0 OR (cgst+sgst+igst)<=0 THEN 0.0 ELSE
   (SELECT arg_min(r, struct_pack(a:=abs(r*taxable-100*(cgst+sgst+igst)), r:=r))
    FROM (SELECT unnest([0,0.1,0.25,1,1.5,3,5,6,7.5,12,18,28]::DECIMAL(4,2)[]) AS r)) END::DOUBLE"""


@query(f"""SELECT gstin, party_name AS receiver_name, invoice_no AS invoice_number, doc_date AS invoice_date,
  total::DOUBLE AS invoice_value, pos AS place_of_supply, {_RATE} AS rate, taxable::DOUBLE AS taxable_value,
  cgst::DOUBLE AS cgst, sgst::DOUBLE AS sgst, igst::DOUBLE AS igst
 FROM groups WHERE category='B2B'""", "groups")
def b2b_invoices(spark, sf):
    out = gstr1.b2b_rows(_groups(spark, sf))
    return out.select("gstin", "receiver_name", "invoice_number", "invoice_date",
                      *d("invoice_value"), "place_of_supply", "rate",
                      *d("taxable_value cgst sgst igst"))


@query(f"""SELECT pos AS place_of_supply, invoice_no AS invoice_number, doc_date AS invoice_date,
  total::DOUBLE AS invoice_value, {_RATE} AS rate, taxable::DOUBLE AS taxable_value, igst::DOUBLE AS igst,
  0.0::DOUBLE AS cgst FROM groups WHERE category='B2CL'""", "groups")
def b2cl_by_pos(spark, sf):
    out = gstr1.b2cl_rows(_groups(spark, sf))
    return out.select("place_of_supply", "invoice_number", "invoice_date", *d("invoice_value"),
                      "rate", *d("taxable_value igst cgst"))


@query(f"""SELECT CASE WHEN pos<>'07' THEN 'INTER' ELSE 'INTRA' END AS sply_tp, pos, rate,
  sum(taxable)::DOUBLE AS taxable, sum(igst)::DOUBLE AS igst, sum(cgst)::DOUBLE AS cgst,
  sum(sgst)::DOUBLE AS sgst, count(*) AS n_invoices
 FROM (SELECT *, {_RATE} AS rate FROM groups WHERE category='B2CS') GROUP BY 1,2,3""", "groups")
def b2cs_buckets(spark, sf):
    out = gstr1.b2cs_rows(_groups(spark, sf), FIRM_STATE)
    return out.select("sply_tp", "pos", "rate", *d("taxable igst cgst sgst"), "n_invoices")


@query(f"""SELECT CASE WHEN igst=0 THEN 'WOPAY' ELSE 'WPAY' END AS exp_typ, invoice_no AS invoice_number,
  doc_date AS invoice_date, total::DOUBLE AS invoice_value, {_RATE} AS rate,
  taxable::DOUBLE AS taxable_value, igst::DOUBLE AS igst FROM groups WHERE category='EXP'""", "groups")
def exp_invoices(spark, sf):
    out = gstr1.exp_rows(_groups(spark, sf))
    return out.select("exp_typ", "invoice_number", "invoice_date", *d("invoice_value"), "rate",
                      *d("taxable_value igst"))


@query(f"""SELECT category AS section, gstin, CASE WHEN voucher_type LIKE 'Debit%' THEN 'D' ELSE 'C' END AS ntty,
  invoice_no AS note_number, doc_date AS note_date, total::DOUBLE AS note_value, pos AS place_of_supply,
  CASE WHEN category='CDNR' THEN NULL WHEN pos<>'07' THEN 'INTER' ELSE 'INTRA' END AS supply_type,
  {_RATE} AS rate, taxable::DOUBLE AS taxable_value FROM groups WHERE category IN ('CDNR','CDNUR')""", "groups")
def cdn_notes(spark, sf):
    out = gstr1.note_rows(_groups(spark, sf), FIRM_STATE)
    return out.select("section", "gstin", "ntty", "note_number", "note_date", *d("note_value"),
                      "place_of_supply", "supply_type", "rate", *d("taxable_value"))


@query("""SELECT sply_ty, coalesce(sum(CASE WHEN (pos='07')=(sply_ty='INTRB2B') THEN taxable_value END),0)::DOUBLE
   AS expt_amt, 0.0::DOUBLE AS nil_amt
 FROM (SELECT unnest(['INTRB2B','INTRB2C']) AS sply_ty) LEFT JOIN
  (SELECT taxable_value, coalesce(nullif(regexp_extract(coalesce(place_of_supply,''),'^(\\d{2})',1),''),
     nullif(regexp_extract(coalesce(party_gstin,''),'^(\\d{2})',1),''),'07') AS pos
   FROM sales WHERE gstr1_category='NIL_EXEMPT') ON true GROUP BY 1""", "sales")
def nil_buckets(spark, sf):
    out = gstr1.nil_rows(sales_lines(spark, sf, part=False), FIRM_STATE)
    return out.select("sply_ty", *d("expt_amt nil_amt"))


@query("""SELECT CASE voucher_type WHEN 'Sales' THEN 'Invoices for outward supply' ELSE voucher_type END
   AS nature_of_document, min(invoice_no) AS sr_no_from, max(invoice_no) AS sr_no_to,
  count(DISTINCT invoice_no) AS total_number, count(DISTINCT invoice_no) AS net_issued
 FROM sales GROUP BY 1""", "sales")
def docs_issued(spark, sf):
    return gstr1.docs_issued(sales_lines(spark, sf, part=False)).drop("cancelled")


@query(f"""SELECT 1::BIGINT AS doc_num, 'Invoices for outward supply' AS doc_typ,
   (count(*) FILTER (category IN ('B2B','B2CL','EXP')) +
    count(DISTINCT CASE WHEN category='B2CS' THEN pos||':'||rate::VARCHAR END))::BIGINT AS totnum
  FROM (SELECT category, pos, {_RATE} AS rate FROM groups)
 UNION ALL SELECT 2::BIGINT, 'Credit Note', count(*) FILTER (category IN ('CDNR','CDNUR')) FROM groups""",
       "groups")
def doc_summary(spark, sf):
    return gstr1.doc_summary(_groups(spark, sf))


@query("""SELECT strftime(o_orderdate,'%m%Y') AS fp, count(*) AS n_lines FROM sales GROUP BY 1
 ORDER BY count(*) DESC, min(seq) LIMIT 1""", "sales")
def filing_period(spark, sf):
    return gstr1.filing_period(sales_lines(spark, sf, part=False))


@query("""SELECT '07AABCF0001A1Z5' AS registration, fp, gt, total_invoices, total_taxable, total_igst,
   total_cgst, total_sgst, (total_igst+total_cgst+total_sgst) AS total_tax, sections
 FROM (SELECT sum(total_invoice_value)::DOUBLE AS gt, sum(s*taxable_value)::DOUBLE AS total_taxable,
   sum(s*igst_amount)::DOUBLE AS total_igst, sum(s*cgst_amount)::DOUBLE AS total_cgst,
   sum(s*sgst_amount)::DOUBLE AS total_sgst
  FROM (SELECT *, CASE WHEN voucher_type='Sales' THEN 1 ELSE -1 END AS s FROM sales)),
 (SELECT count(*) AS total_invoices, concat_ws(',', max(CASE WHEN category='B2B' THEN 'b2b' END),
    max(CASE WHEN category='B2CL' THEN 'b2cl' END), max(CASE WHEN category='B2CS' THEN 'b2cs' END),
    max(CASE WHEN category='EXP' THEN 'exp' END), max(CASE WHEN category='CDNR' THEN 'cdnr' END),
    max(CASE WHEN category='CDNUR' THEN 'cdnur' END)) AS sections FROM groups),
 (SELECT strftime(o_orderdate,'%m%Y') AS fp FROM sales GROUP BY 1 ORDER BY count(*) DESC, min(seq) LIMIT 1)""",
       "sales groups")
def return_envelope(spark, sf):
    lines = sales_lines(spark, sf, part=False).withColumn("registration", F.lit(FIRM_GSTIN))
    groups = gstr1.invoice_groups(lines, FIRM_STATE, ["registration"])
    out = gstr1.return_envelope(lines, groups)
    return out.select("registration", "fp", *d("gt"), "total_invoices",
                      *d("total_taxable total_igst total_cgst total_sgst total_tax"),
                      F.array_join("sections_with_data", ",").alias("sections"))


@query("""SELECT gstin AS party_gstin, 0::BIGINT AS part, count(*) AS n_documents,
  sum(taxable)::DOUBLE AS txval, sum(total)::DOUBLE AS val, min(invoice_no) AS first_number
 FROM groups WHERE category='B2B' GROUP BY 1""", "groups")
def nested_b2b(spark, sf):
    """The nested section, read back from its arrays."""
    nested = gstr1.nested_section(_groups(spark, sf), "B2B", "party_gstin")
    return nested.select("party_gstin", "part", F.inline("inv")).groupBy("party_gstin", "part").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum(F.col("itms")[0]["itm_det"]["txval"]).cast("double").alias("txval"),
        F.sum("val").cast("double").alias("val"), F.min("inum").alias("first_number"),
    )


@query("""SELECT category, count(*) AS n_invoices, sum(n_lines)::BIGINT AS n_lines,
  sum(taxable)::DOUBLE AS taxable FROM groups GROUP BY 1""", "groups")
def category_counts(spark, sf):
    return _groups(spark, sf).groupBy("category").agg(
        F.count(F.lit(1)).alias("n_invoices"), F.sum("n_lines").alias("n_lines"),
        F.sum("taxable").cast("double").alias("taxable"))


@query("""SELECT pct::DOUBLE AS rate, count(*) AS n, sum(taxable_value)::DOUBLE AS taxable,
  count(*) FILTER (abs(CASE WHEN rate IN (5,12,18,28) THEN 1 ELSE 0 END)=1) AS n_slab_priced
 FROM sales GROUP BY 1""", "sales")
def rate_snap(spark, sf):
    lines = sales_lines(spark, sf, part=False)
    rate = rate_of(*[F.col(c) for c in ("taxable_value", "cgst_amount", "sgst_amount", "igst_amount")],
                   rates=SLAB_RATES)
    return lines.groupBy(rate.alias("rate")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("taxable_value").cast("double").alias("taxable"),
        F.count(F.when(F.col("rate").isin(5.0, 12.0, 18.0, 28.0), 1)).alias("n_slab_priced"))


@query("""SELECT strftime(o_orderdate,'%d-%m-%Y') AS day, tax, exported, pos, count(*) AS n FROM (
  SELECT o_orderdate, CASE WHEN igst_amount>0.01 THEN 'interstate' WHEN cgst_amount>0.01 THEN 'intrastate' END AS tax,
   coalesce(place_of_supply,'')='OUTSIDE INDIA' AS exported,
   coalesce(nullif(regexp_extract(coalesce(place_of_supply,''),'^(\\d{2})',1),''),
     nullif(regexp_extract(coalesce(party_gstin,''),'^(\\d{2})',1),''),'07') AS pos FROM sales)
 GROUP BY ALL""", "sales")
def dates_states_tax_types(spark, sf):
    lines = sales_lines(spark, sf, part=False)
    return lines.groupBy(
        gst_date(F.col("voucher_date")).alias("day"),
        active_tax(F.col("igst_amount"), F.col("cgst_amount"), F.col("sgst_amount")).alias("tax"),
        is_export(F.col("place_of_supply"), F.lit(None).cast("string")).alias("exported"),
        resolve_pos(F.col("place_of_supply"), F.col("party_gstin"), FIRM_STATE).alias("pos"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT section, grp, number, doc_date, val, txval, pos, kind FROM (
  SELECT lower(category) AS section, CASE WHEN category IN ('B2B','CDNR') THEN gstin WHEN category='B2CL' THEN pos WHEN category='EXP' THEN CASE WHEN igst=0 THEN 'WOPAY' ELSE 'WPAY' END
    ELSE '' END AS grp, invoice_no AS number, doc_date, total::DOUBLE AS val, taxable::DOUBLE AS txval, CASE WHEN category NOT IN ('B2CL','EXP') THEN pos END AS pos,
   CASE WHEN category IN ('CDNR','CDNUR') THEN CASE WHEN lower(voucher_type) LIKE '%debit%' THEN 'D' ELSE 'C' END END AS kind
  FROM groups WHERE category IN ('B2B','B2CL','EXP','CDNR','CDNUR'))""", "groups")
def return_documents(spark, sf):
    """Every document of the return's text, read back from its row."""
    lines = sales_lines(spark, sf, part=False).withColumn("registration", F.lit(FIRM_GSTIN))
    rows = return_document.return_rows(lines, FIRM_STATE)
    names = {return_document.CDNUR: "cdnur", **{k: v[0] for k, v in return_document.GROUPED.items()}}
    section = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("section"))
    read = F.from_json(F.regexp_replace("value", "^,", ""), """inum STRING, nt_num STRING, idt STRING, nt_dt STRING, val STRING, pos STRING, ntty STRING,
        itms ARRAY<STRUCT<itm_det: STRUCT<txval: STRING>, txval: STRING>>""")
    docs = rows.filter((F.col("step") == return_document.ENTRY) & F.col("section").isin(*names))
    docs = docs.select(section.alias("section"), "grp", F.inline(F.array(read)))  # behind a generator a text is read once, not once for each field
    item = F.get("itms", F.lit(0))
    return docs.select(
        "section", "grp", F.coalesce("inum", "nt_num").alias("number"), F.coalesce("idt", "nt_dt").alias("doc_date"), F.col("val").cast("double").alias("val"),
        F.coalesce(item["itm_det"]["txval"], item["txval"]).cast("double").alias("txval"), "pos", F.col("ntty").alias("kind"))
