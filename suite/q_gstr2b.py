"""Books against the 2B statement over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata import schemas
from khata.operators import gstr2b

from .registry import query
from .tables import purchase_lines, statement_2b
from .util import d


def reconciliation(spark, sf):
    books = gstr2b.normalise_books(purchase_lines(spark, sf, part=False))
    return gstr2b.Reconciliation(books, statement_2b(spark, sf))


@query("""SELECT norm_key, amount::DOUBLE AS amount, cgst::DOUBLE AS cgst, igst::DOUBLE AS igst,
  total::DOUBLE AS total_amount, n_lines, party_name AS party_ac_name, invoice_no AS supplier_inv
 FROM bookinv""", "bookinv")
def books_by_invoice(spark, sf):
    books = gstr2b.normalise_books(purchase_lines(spark, sf, part=False))
    out = gstr2b.books_by_invoice(books)
    return out.select("norm_key", *d("amount cgst igst total_amount"), "n_lines", "party_ac_name",
                      "supplier_inv")


@query("""SELECT norm_key, t_inv_no AS inv_no_2b, total::DOUBLE AS total_amount, t_total::DOUBLE AS total_2b,
  abs(total-t_total)<=2 AS within FROM exact2b""", "exact2b")
def recon2b_exact(spark, sf):
    exact = reconciliation(spark, sf).exact
    return exact.select("norm_key", F.col("rec.inv_no").alias("inv_no_2b"), *d("total_amount"),
                        F.col("rec.total_val").cast("double").alias("total_2b"),
                        (F.abs(F.col("total_amount") - F.col("rec.total_val")) <= 2).alias("within"))


@query("""SELECT norm_key AS book_key, t_inv_no AS inv_no_2b, t_total::DOUBLE AS total_2b
 FROM fuzzycand""", "fuzzycand")
def fuzzy_pairs(spark, sf):
    r = reconciliation(spark, sf)
    pairs = gstr2b.fuzzy_pairs(r.unmatched, r.remaining)
    records = r.remaining.select(F.col("seq").alias("rec_seq"), F.col("inv_no").alias("inv_no_2b"),
                                 F.col("total_val").cast("double").alias("total_2b"))
    return pairs.join(records, "rec_seq").select("book_key", "inv_no_2b", "total_2b")


@query("""SELECT norm_key, invoice_no AS supplier_inv, total_amount::DOUBLE AS total_amount, recon_status,
  fuzzy_matched, t_inv_no AS "2b_inv_no", t_total::DOUBLE AS "2b_total_val", diff_amount::DOUBLE AS diff_amount
 FROM rows2b""", "rows2b")
def recon2b_rows(spark, sf):
    rows = reconciliation(spark, sf).rows
    return rows.select("norm_key", "supplier_inv", *d("total_amount"), "recon_status", "fuzzy_matched",
                       "2b_inv_no", *d("2b_total_val diff_amount"))


@query("""SELECT gstin AS gst_no, inv_no AS supplier_inv, inv_date AS invoice_date,
  taxable_val::DOUBLE AS amount, total_val::DOUBLE AS total_amount FROM extra2b""", "extra2b")
def not_in_books(spark, sf):
    extra = reconciliation(spark, sf).extra
    return extra.select("gst_no", "supplier_inv", "invoice_date", *d("amount total_amount"))


@query("""SELECT norm_key, n_lines, total::DOUBLE AS total_amount FROM bookinv
 WHERE norm_key NOT IN (SELECT norm_key FROM match2b)""", "bookinv match2b")
def missing_in_2b(spark, sf):
    return reconciliation(spark, sf).missing.select("norm_key", "n_lines", *d("total_amount"))


_SUMMARY = """SELECT count(*) FILTER (s='matched') AS n_matched, count(*) FILTER (s='mismatch') AS n_mismatch,
  count(*) FILTER (s='missing_in_2b') AS n_missing_in_2b, count(*) FILTER (s='not_in_books') AS n_not_in_books,
  coalesce(sum(a) FILTER (s='matched'),0) AS amt_matched, coalesce(sum(a) FILTER (s='mismatch'),0) AS amt_mismatch,
  coalesce(sum(a) FILTER (s='missing_in_2b'),0) AS amt_missing_in_2b,
  coalesce(sum(a) FILTER (s='not_in_books'),0) AS amt_not_in_books,
  count(*) AS total_rows, count(*) FILTER (f) AS fuzzy_matched_count
 FROM (SELECT recon_status AS s, total_amount AS a, fuzzy_matched AS f FROM rows2b
   UNION ALL SELECT 'not_in_books', total_val, false FROM extra2b)"""


@query(f"""SELECT * REPLACE (amt_matched::DOUBLE AS amt_matched, amt_mismatch::DOUBLE AS amt_mismatch,
  amt_missing_in_2b::DOUBLE AS amt_missing_in_2b, amt_not_in_books::DOUBLE AS amt_not_in_books),
  (amt_missing_in_2b+amt_mismatch)::DOUBLE AS itc_at_risk FROM ({_SUMMARY})""", "rows2b extra2b")
def recon2b_summary(spark, sf):
    out = reconciliation(spark, sf).summary
    money_cols = [c for c in out.columns if c.startswith(("amt_", "itc_"))]
    return out.select(*[c for c in out.columns if c not in money_cols], *d(" ".join(money_cols)))


@query(f"""SELECT amt_matched::DOUBLE AS matched_itc, round(amt_matched*1.05,2)::DOUBLE AS cap,
  (amt_matched+amt_mismatch+amt_missing_in_2b)::DOUBLE AS total_claimed,
  greatest(0, amt_matched+amt_mismatch+amt_missing_in_2b-round(amt_matched*1.05,2))::DOUBLE AS excess,
  amt_matched+amt_mismatch+amt_missing_in_2b-round(amt_matched*1.05,2) > 0 AS breached
 FROM ({_SUMMARY})""", "rows2b extra2b")
def rule_36_4(spark, sf):
    out = gstr2b.rule_36_4(reconciliation(spark, sf).summary)
    return out.select(*d("matched_itc cap total_claimed excess"), "breached")


def _documents(spark, sf):
    """Each statement record as a JSON document, in the three accepted shapes by turns."""
    st = statement_2b(spark, sf)
    item = F.struct(*[F.col(a).cast("double").alias(b) for a, b in (
        ("taxable_val", "txval"), ("igst", "iamt"), ("cgst", "camt"), ("sgst", "samt"))])
    shape = F.col("okey") % 3
    items = F.array(F.when(shape == 0, F.to_json(F.struct(item.alias("itm_det")))).otherwise(F.to_json(item)))
    inv = F.concat(
        F.lit('{"inum":"'), "inv_no", F.lit('","dt":"'), "inv_date", F.lit('","val":'),
        F.col("total_val").cast("string"), F.lit(',"itms":'),
        F.when(F.col("okey") % 7 == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), items[0], F.lit("]"))),
        F.lit("}"))
    b2b = F.concat(F.lit('"b2b":[{"ctin":"'), "gstin", F.lit('","inv":['), inv, F.lit("]}]"))
    rg = F.lit('"gstin":" 07aabcf0001a1z5 "')
    text = (
        F.when(shape == 0, F.concat(F.lit('{"data":{"docdata":{'), b2b, F.lit("},"), rg, F.lit("}}")))
        .when(shape == 1, F.concat(F.lit('{"docdata":{'), b2b, F.lit("}}")))
        .otherwise(F.concat(F.lit("{"), b2b, F.lit(","), rg, F.lit("}"))))
    sid = F.concat_ws("-", F.col("own").cast("string"), "okey", "skey", "copy")
    parsed = st.select(sid.alias("sid"), F.from_json(text, schemas.GSTR2B_STATEMENT).alias("j"))
    return parsed.select("sid", "j.*").drop("statement_id").withColumnRenamed("sid", "statement_id")


@query("""SELECT gstin, inv_no, inv_date, norm_key, CASE WHEN okey%7=0 THEN total_val ELSE taxable_val END::DOUBLE
   AS taxable_val, CASE WHEN okey%7=0 THEN 0 ELSE igst END::DOUBLE AS igst, total_val::DOUBLE AS total_val
 FROM twob""", "twob")
def statement_flatten(spark, sf):
    out = gstr2b.parse_statement(_documents(spark, sf))
    return out.select("gstin", "inv_no", "inv_date", "norm_key", *d("taxable_val igst total_val"))


@query("""SELECT CASE WHEN okey%3=1 THEN NULL ELSE '07AABCF0001A1Z5' END AS recipient_gstin, count(*) AS n
 FROM twob GROUP BY 1""", "twob")
def statement_recipient(spark, sf):
    return gstr2b.recipient_gstin(_documents(spark, sf)).groupBy("recipient_gstin").agg(
        F.count(F.lit(1)).alias("n"))
