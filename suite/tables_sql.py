"""The same invoice tables as SQL, for checking."""

from __future__ import annotations

import re

_PAD7 = "lpad({0}::VARCHAR, greatest(7, length({0}::VARCHAR))::INT, '0')"
_PAD4 = "lpad(({0} % 10000)::VARCHAR, 4, '0')"


def _gstin(state: str, key: str) -> str:
    plain = f"{state} || 'AABC' || chr((65 + ({key} // 10000) % 26)::INT) || {_PAD4.format(key)} || 'A1Z5'"
    return (
        f"CASE WHEN {key} % 5 = 0 THEN NULL WHEN {key} % 7 = 0 THEN "
        f"lower(substr({plain},1,2) || '-' || substr({plain},3)) ELSE {plain} END"
    )


def _date_text(d: str, key: str) -> str:
    return (
        f"CASE {key} % 4 WHEN 0 THEN strftime({d},'%d-%m-%Y') WHEN 1 THEN strftime({d},'%d/%m/%Y') "
        f"WHEN 2 THEN strftime({d},'%Y-%m-%d') ELSE strftime({d},'%d-%b-%Y') END"
    )


_STATE = "lpad(({0} + 1)::VARCHAR, 2, '0')"
_PCT = """CAST(CASE CAST(round(l_tax*100) AS INT) WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 5
  WHEN 3 THEN 12 WHEN 4 THEN 12 WHEN 5 THEN 18 WHEN 6 THEN 18 WHEN 7 THEN 18 ELSE 28 END AS DECIMAL(2,0))"""
_GROSS = "CAST(l_extendedprice AS DECIMAL(12,2))"
_TAXABLE = f"CAST(round({_GROSS} * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(12,2))"
_HSN = """CASE p_type WHEN 'ECONOMY' THEN '8471' WHEN 'SMALL' THEN '9971' WHEN 'MEDIUM' THEN '998599'
  WHEN 'PROMO' THEN '3304' WHEN 'STANDARD' THEN '997319' WHEN 'LARGE' THEN '8703' END"""
_LINE_ORDER = "l_orderkey, l_linenumber, l_extendedprice, l_partkey"


def _taxes(state: str) -> str:
    return f"""
  CAST(CASE WHEN {state} = '07' THEN round(taxable*pct*0.005, 2) ELSE 0 END AS DECIMAL(18,2)) AS cgst,
  CAST(CASE WHEN {state} = '07' THEN round(taxable*pct*0.005, 2) ELSE 0 END AS DECIMAL(18,2)) AS sgst,
  CAST(CASE WHEN {state} = '07' THEN 0 ELSE round(taxable*pct*0.01, 2) END AS DECIMAL(18,2)) AS igst"""


TABLES: dict[str, str] = {}

TABLES["sale0"] = f"""
 SELECT row_number() OVER (ORDER BY {_LINE_ORDER}) AS seq, *,
   l_orderkey AS okey, c_custkey AS ckey, {_STATE.format('c_nationkey')} AS party_state,
   {_GROSS} AS gross, {_TAXABLE} AS taxable, {_PCT} AS pct,
   (CASE WHEN l_orderkey%17=0 THEN 'OX' WHEN l_orderkey%2=0 THEN 'MH' ELSE 'HR' END)
     || {_PAD7.format('l_orderkey')} AS original_no,
   l_returnflag='R' AS credit, (l_returnflag='A' AND l_linenumber=7) AS debit
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
   JOIN part ON l_partkey=p_partkey"""

TABLES["sale1"] = f"""
 SELECT *, {_taxes('party_state')},
   CASE WHEN ckey%23=0 THEN 'OUTSIDE INDIA' WHEN ckey%3=0 THEN NULL WHEN ckey%3=1 THEN party_state
     ELSE party_state||'-State' END AS place_of_supply,
   {_gstin('party_state', 'ckey')} AS party_gstin
 FROM sale0"""

TABLES["sale2"] = """
 SELECT *, CAST(CASE WHEN okey%37=0 THEN 0 WHEN okey%41=0 THEN taxable+cgst+sgst+igst+5
     ELSE taxable+cgst+sgst+igst END AS DECIMAL(18,2)) AS total_invoice_value,
   CASE WHEN pct=0 AND l_linenumber%2=0 THEN 'NIL_EXEMPT' END AS raw_category
 FROM sale1"""

TABLES["sales"] = f"""
 SELECT seq, okey, ckey, party_state, original_no, gross, pct, o_orderdate,
   okey::VARCHAR AS task_id, 'B'||strftime(o_orderdate,'%Y%m') AS batch_id, c_mktsegment AS tenant_id,
   {_date_text('o_orderdate', 'okey')} AS voucher_date,
   CASE WHEN credit THEN 'Credit Note' WHEN debit THEN 'Debit Note' ELSE 'Sales' END AS voucher_type,
   CASE WHEN credit THEN 'CR'||{_PAD7.format('okey')} WHEN debit THEN 'DN'||{_PAD7.format('okey')}
     ELSE original_no END AS invoice_no,
   c_name AS party_ledger_name, party_gstin, place_of_supply,
   CASE WHEN credit OR debit THEN p_name||' (against '||original_no||')' ELSE p_name END AS particulars,
   {_HSN} AS hsn, l_quantity AS qty, l_linenumber AS line,
   CASE WHEN l_linenumber%3=0 THEN pct::DOUBLE
     ELSE (CAST(CAST(round(l_extendedprice*100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS DECIMAL(18,0))*0.01)::DOUBLE
     END AS rate,
   CAST(taxable AS DECIMAL(18,2)) AS taxable_value, CAST(gross-taxable AS DECIMAL(18,2)) AS discount,
   CAST(CASE WHEN l_linenumber=1 AND okey%50=0 THEN 10 ELSE 0 END AS DECIMAL(18,2)) AS advances,
   cgst AS cgst_amount, sgst AS sgst_amount, igst AS igst_amount, total_invoice_value,
   CASE okey%6 WHEN 0 THEN 'professional services' WHEN 1 THEN 'supply' END AS narration,
   CASE WHEN raw_category IS NOT NULL THEN raw_category
     WHEN length(coalesce(party_gstin,''))>=15 AND (credit OR debit) THEN 'CDNR'
     WHEN length(coalesce(party_gstin,''))>=15 THEN 'B2B'
     WHEN coalesce(place_of_supply,'')='OUTSIDE INDIA' THEN 'EXP'
     WHEN credit OR debit THEN 'CDNUR'
     WHEN place_of_supply IS NOT NULL AND substr(place_of_supply,1,2)<>'07'
       AND total_invoice_value>50000 THEN 'B2CL'
     ELSE 'B2CS' END AS gstr1_category
 FROM sale2"""

TABLES["groups"] = """
 SELECT *, CASE WHEN printed=0 THEN taxable+cgst+sgst+igst ELSE printed END AS total,
   CASE WHEN category='B2B' THEN coalesce(nullif(regexp_extract(gstin,'^(\\d{2})',1),''), pos0)
        WHEN category='CDNR' THEN coalesce(nullif(regexp_extract(gstin,'^(\\d{2})',1),''), '07')
        ELSE pos0 END AS pos, strftime(odate,'%d-%m-%Y') AS doc_date
 FROM (SELECT invoice_no, trim(coalesce(party_gstin,'')) AS gstin,
   CASE WHEN voucher_type<>'Sales' AND length(trim(coalesce(party_gstin,'')))>=15 THEN 'CDNR'
        WHEN voucher_type<>'Sales' THEN 'CDNUR' ELSE upper(gstr1_category) END AS category,
   sum(taxable_value) AS taxable, sum(cgst_amount) AS cgst, sum(sgst_amount) AS sgst,
   sum(igst_amount) AS igst, sum(total_invoice_value) AS printed, count(*) AS n_lines, min(seq) AS first_seq,
   min(party_ledger_name) AS party_name, min(o_orderdate) AS odate, min(voucher_type) AS voucher_type,
   coalesce(nullif(regexp_extract(coalesce(min(place_of_supply),''),'^(\\d{2})',1),''),
     nullif(regexp_extract(coalesce(min(party_gstin),''),'^(\\d{2})',1),''),'07') AS pos0
   FROM sales GROUP BY 1,2,3)"""

TABLES["buy0"] = f"""
 SELECT row_number() OVER (ORDER BY {_LINE_ORDER}) AS seq, *, l_orderkey AS okey, s_suppkey AS skey,
   {_STATE.format('s_nationkey')} AS state, {_GROSS} AS gross, {_TAXABLE} AS taxable, {_PCT} AS pct
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN supplier ON l_suppkey=s_suppkey
   JOIN part ON l_partkey=p_partkey WHERE l_returnflag='N'"""

TABLES["books"] = f"""
 SELECT *, taxable_value+cgst_amount+sgst_amount+igst_amount AS total_invoice_value FROM (
 SELECT seq, okey, skey, okey::VARCHAR AS task_id, 'B'||strftime(o_orderdate,'%Y%m') AS batch_id,
   o_orderdate, l_shipdate AS pay_date, {_date_text('o_orderdate', 'okey')} AS voucher_date,
   'PI/'||{_PAD7.format('okey')}||'/'||skey::VARCHAR AS invoice_no, s_name AS party_ledger_name,
   {_gstin('state', 'skey')} AS party_gstin, state AS place_of_supply, p_name AS particulars,
   {_HSN} AS hsn, l_quantity AS qty, pct::DOUBLE AS rate,
   CAST(taxable AS DECIMAL(18,2)) AS taxable_value, cgst AS cgst_amount, sgst AS sgst_amount,
   igst AS igst_amount,
   CASE skey%6 WHEN 0 THEN 'YES' WHEN 1 THEN 'eligible' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'NIL_RATED'
     WHEN 4 THEN 'no' END AS itc_category
 FROM (SELECT *, {_taxes('state')} FROM buy0))"""

TABLES["st0"] = f"""
 SELECT l_returnflag='N' AS own, okey, skey, state, sum(taxable) AS taxable, sum(igst) AS igst,
   sum(cgst) AS cgst, sum(sgst) AS sgst FROM (
   SELECT *, {_taxes('state')} FROM (
     SELECT *, l_orderkey AS okey, s_suppkey AS skey, {_STATE.format('s_nationkey')} AS state,
       {_TAXABLE} AS taxable, {_PCT} AS pct
     FROM lineitem JOIN supplier ON l_suppkey=s_suppkey
     WHERE l_returnflag='N' OR (l_returnflag='A' AND l_orderkey%25=0)))
 GROUP BY 1,2,3,4"""

TABLES["twob"] = f"""
 SELECT *, gstin||'||'||regexp_replace(upper(inv_no),'[^A-Z0-9]','','g') AS norm_key,
   row_number() OVER (ORDER BY NOT own, okey, skey, copy) AS seq FROM (
 SELECT own, okey, skey, m, copy,
   coalesce(regexp_replace(upper({_gstin('state', 'skey')}),'[^A-Z0-9]','','g'),'') AS gstin,
   (CASE WHEN NOT own THEN 'EXT/' WHEN m=3 THEN '' ELSE 'PI/' END)||{_PAD7.format('okey')}||'/'||skey::VARCHAR AS inv_no,
   '01-'||lpad((okey%12+1)::VARCHAR,2,'0')||'-2024' AS inv_date,
   taxable AS taxable_val, igst, cgst, sgst,
   CASE m WHEN 1 THEN taxable+igst+cgst+sgst+1.50 WHEN 2 THEN taxable+igst+cgst+sgst+50
     ELSE taxable+igst+cgst+sgst END AS total_val
 FROM (SELECT *, CASE WHEN own THEN (okey*31+skey)%20 ELSE -1 END AS m FROM st0)
   JOIN (SELECT unnest([0,1]) AS copy) ON copy=0 OR m=4
 WHERE m<>0)"""

TABLES["bookinv"] = """
 SELECT norm_key, split_part(norm_key,'||',1) AS gstin, split_part(norm_key,'||',2) AS inv,
   sum(taxable_value) AS amount, sum(cgst_amount) AS cgst, sum(sgst_amount) AS sgst,
   sum(igst_amount) AS igst, sum(total_invoice_value) AS total, count(*) AS n_lines, min(seq) AS first_seq,
   min(party_ledger_name) AS party_name, min(invoice_no) AS invoice_no
 FROM (SELECT *, coalesce(regexp_replace(upper(party_gstin),'[^A-Z0-9]','','g'),'')||'||'||
   regexp_replace(upper(invoice_no),'[^A-Z0-9]','','g') AS norm_key FROM books) GROUP BY 1"""

TABLES["first2b"] = "SELECT * FROM twob QUALIFY row_number() OVER (PARTITION BY norm_key ORDER BY seq)=1"

TABLES["exact2b"] = """
 SELECT b.*, t.seq AS t_seq, t.inv_no AS t_inv_no, t.gstin AS t_gstin, t.taxable_val AS t_taxable,
   t.total_val AS t_total, false AS fuzzy
 FROM bookinv b JOIN first2b t USING (norm_key)"""

TABLES["fuzzycand"] = """
 SELECT b.*, t.seq AS t_seq, t.inv_no AS t_inv_no, t.gstin AS t_gstin, t.taxable_val AS t_taxable,
   t.total_val AS t_total, true AS fuzzy
 FROM (SELECT * FROM bookinv WHERE norm_key NOT IN (SELECT norm_key FROM exact2b)) b
 JOIN (SELECT *, split_part(norm_key,'||',2) AS tinv FROM twob
       WHERE norm_key NOT IN (SELECT norm_key FROM exact2b)) t
   ON b.gstin=t.gstin AND abs(b.total-t.total_val)<=2 AND b.inv<>'' AND t.tinv<>'' AND b.inv<>t.tinv
   AND ((length(b.inv)>=4 AND length(t.tinv)>=4 AND (contains(b.inv,t.tinv) OR contains(t.tinv,b.inv)))
     OR (ltrim(b.inv,'0')<>'' AND ltrim(b.inv,'0')=ltrim(t.tinv,'0')))"""

TABLES["match2b"] = """
 SELECT *, CASE WHEN abs(total-t_total)<=2 THEN 'matched' ELSE 'mismatch' END AS status
 FROM (SELECT * FROM exact2b UNION ALL
  SELECT * FROM fuzzycand QUALIFY row_number() OVER (PARTITION BY norm_key ORDER BY t_seq)=1)"""

TABLES["rows2b"] = """
 SELECT b.seq, k.norm_key, k.invoice_no, b.total_invoice_value AS total_amount,
   coalesce(m.status,'missing_in_2b') AS recon_status, coalesce(m.fuzzy,false) AS fuzzy_matched,
   m.t_inv_no, m.t_total, m.total - m.t_total AS diff_amount
 FROM (SELECT *, coalesce(regexp_replace(upper(party_gstin),'[^A-Z0-9]','','g'),'')||'||'||
   regexp_replace(upper(invoice_no),'[^A-Z0-9]','','g') AS norm_key FROM books) b
 JOIN bookinv k USING (norm_key) LEFT JOIN match2b m USING (norm_key)"""

TABLES["extra2b"] = """
 SELECT * FROM twob WHERE norm_key NOT IN (SELECT norm_key FROM exact2b)
   AND seq NOT IN (SELECT t_seq FROM match2b WHERE fuzzy)"""

TABLES["docs"] = """
 SELECT invoice_no, okey, min(voucher_type) AS voucher_type, min(party_gstin) AS party_gstin,
   min(party_state) AS party_state, sum(taxable_value) AS taxable, sum(igst_amount) AS igst,
   sum(cgst_amount) AS cgst, sum(sgst_amount) AS sgst, sum(total_invoice_value) AS total,
   CASE WHEN min(voucher_type)='Sales' THEN 'Invoice' ELSE min(voucher_type) END AS doc_type
 FROM sales GROUP BY 1,2"""

TABLES["osd"] = "SELECT invoice_no AS doc_no, * FROM docs WHERE okey%13<>0"

TABLES["cld"] = """
 SELECT invoice_no AS doc_no, doc_type, party_gstin, okey, party_state AS state_of_supply,
   CASE WHEN okey%2=0 THEN 'MH' ELSE 'HR' END AS supplier_location,
   CASE WHEN (party_state = CASE WHEN okey%2=0 THEN '27' ELSE '06' END) = (okey%11<>1)
     THEN 'Intrastate' ELSE 'Interstate' END AS flag,
   CASE WHEN okey%11=2 THEN taxable+100 ELSE taxable END AS taxable,
   CASE WHEN okey%11=1 THEN CASE WHEN igst>0 THEN 0 ELSE cgst+sgst END ELSE igst END AS igst,
   CASE WHEN okey%11=1 THEN CASE WHEN igst>0 THEN round(igst*0.5,2) ELSE 0 END ELSE cgst END AS cgst,
   CASE WHEN okey%11=1 THEN CASE WHEN igst>0 THEN round(igst*0.5,2) ELSE 0 END ELSE sgst END AS sgst,
   total
 FROM docs WHERE okey%11<>0"""

TABLES["recon3"] = """
 SELECT *, CASE WHEN o_no IS NULL THEN 'MISSING_SOURCE_PDF' WHEN c_no IS NULL THEN 'CLIENT_MISSING'
   WHEN coalesce(o_gstin,'')='' THEN 'UNVERIFIABLE_NO_GSTIN'
   WHEN abs(d_taxable)<=2.5 AND abs(d_igst)<=2.5 AND abs(d_cgst)<=2.5 AND abs(d_sgst)<=2.5
     AND abs(d_total)<=2.5 THEN 'PASS'
   WHEN o_tax IS NOT NULL AND c_tax IS NOT NULL AND o_tax<>c_tax THEN 'CLIENT_SHEET_ERROR'
   ELSE 'UNRESOLVED_CONFLICT' END AS status
 FROM (SELECT coalesce(o.doc_no,c.doc_no) AS doc_no, coalesce(o.doc_type,c.doc_type) AS doc_type,
   o.doc_no AS o_no, c.doc_no AS c_no, o.party_gstin AS o_gstin,
   coalesce(o.okey,c.okey) AS okey, c.flag, c.supplier_location, c.state_of_supply,
   o.taxable-c.taxable AS d_taxable, o.igst-c.igst AS d_igst, o.cgst-c.cgst AS d_cgst,
   o.sgst-c.sgst AS d_sgst, o.total-c.total AS d_total,
   CASE WHEN o.igst>0.01 THEN 'interstate' WHEN o.cgst>0.01 OR o.sgst>0.01 THEN 'intrastate' END AS o_tax,
   CASE WHEN c.igst>0.01 THEN 'interstate' WHEN c.cgst>0.01 OR c.sgst>0.01 THEN 'intrastate' END AS c_tax
 FROM osd o FULL JOIN cld c ON o.doc_no=c.doc_no)"""


def _needs(name: str) -> list[str]:
    body = TABLES[name]
    return [t for t in TABLES if t != name and re.search(rf"\b{t}\b", body)
            and re.search(rf"(?i)(from|join)\s+\(?\s*{t}\b", body)]


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        for dep in _needs(name):
            visit(dep)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return out


def with_tables(sql: str, uses: str) -> str:
    """Prefix the SQL with the CTEs it names (and those they need)."""
    names = _order(uses.split())
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n].strip()})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
