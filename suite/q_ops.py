"""Events, grading, follow-up state, ledger and file inventory over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from khata.functions.common import money
from khata.functions.dates import fiscal_month_index, last_periods, period_folder, voucher_to_iso, iso_to_voucher
from khata.functions.score import call_cost_inr, composite_quality, priority_score
from khata.operators import filing, golden, gstr1, gstr2b, ledger, metrics, state, views
from khata.session import cut_lineage
from khata.sources import inventory, tables as source

from .q_gstr2b import reconciliation
from .registry import query
from .tables import FIRM_GSTIN, FIRM_STATE, purchase_lines, read, sales_lines, statement_2b
from .util import d

_KIND = {"view": "extraction_quality_score", "purchase": "file_metrics", "error": "system_flag",
         "click": "file_start", "signup": "file_done"}


def obs_events(spark, sf):
    """The event table as a pipeline log."""
    return as_log(read(spark, sf, "events"))


def as_log(ev):
    kind = F.when(F.lit(False), F.lit(""))
    for name, label in _KIND.items():
        kind = kind.when(F.col("event_type") == name, label)
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.to_json(F.struct(
        (k / 100.0).alias("composite_score"), F.struct(F.col("value").alias("total_cost_inr")).alias("model_cost")))
    user = F.col("user_id")
    return ev.select(
        "event_id", F.when(user % 3 != 0, F.concat(F.lit("T"), (user % 3).cast("string"))).alias("tenant_id"),
        F.when(F.col("event_id") % 50 != 0, F.concat(F.lit("B"), user.cast("string"))).alias("batch_id"),
        F.concat(F.lit("F"), F.floor(F.col("event_id") / 4).cast("string")).alias("file_id"),
        kind.alias("event_type"), F.when(F.col("event_type") == "error", F.when(k < 50, "CRITICAL").otherwise("HIGH"))
        .alias("severity"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("FLAG_"), (k % 5).cast("string"))).alias("flag_id"),
        body.alias("payload_json"), F.col("ts").alias("timestamp_utc"), (F.col("event_id") % 20 == 7).alias("is_replay"),
        k.cast("bigint").alias("k"), "value")


_EV = """ev AS (SELECT *, CASE WHEN user_id%3<>0 THEN 'T'||(user_id%3)::VARCHAR END AS tenant_id,
  CASE WHEN event_id%50<>0 THEN 'B'||user_id::VARCHAR END AS batch_id, 'F'||(event_id//4)::VARCHAR AS file_id,
  CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)"""


@query(f"""WITH {_EV} SELECT batch_id IS NOT NULL AS accepted, count(*) AS n FROM ev GROUP BY 1""")
def event_quarantine(spark, sf):
    good, bad = metrics.split_events(obs_events(spark, sf))
    return good.select(F.lit(True).alias("accepted")).unionByName(bad.select(F.lit(False).alias("accepted"))) \
        .groupBy("accepted").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_EV} SELECT event_type, count(*) AS n FROM ev WHERE tenant_id IS NULL GROUP BY 1""")
def tenant_isolation(spark, sf):
    names = F.create_map(*[F.lit(x) for k, v in _KIND.items() for x in (v, k)])
    return metrics.of_tenant(obs_events(spark, sf), None).groupBy(names[F.col("event_type")].alias("event_type")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_EV} SELECT count(DISTINCT batch_id) AS total_batches, count(DISTINCT file_id) AS total_files,
  round(sum(CASE WHEN event_type='view' THEN k*0.01 END)::DOUBLE/count(*) FILTER (event_type='view'),3) AS average_quality_score,
  round(sum(CASE WHEN event_type='purchase' THEN CAST(value AS DECIMAL(18,4)) END),2)::DOUBLE AS total_cost_inr,
  count(*) FILTER (event_type='error') AS total_flags FROM ev""")
def workspace_stats(spark, sf):
    return metrics.workspace_stats(obs_events(spark, sf))


@query(f"""WITH {_EV} SELECT batch_id, round((sum(k*0.01) FILTER (event_type='view'))::DOUBLE
    /count(*) FILTER (event_type='view'),3) AS average_quality_score,
  count(*) FILTER (event_type='error') AS flags_count FROM ev GROUP BY 1""")
def batch_overview(spark, sf):
    return metrics.batch_overview(obs_events(spark, sf)).drop("created_at")


@query(f"""WITH {_EV} SELECT batch_id, file_id, flag FROM (SELECT *, 'FLAG_'||(k%5)::VARCHAR AS flag FROM ev
  WHERE event_type='error' ORDER BY ts DESC, event_id LIMIT 10)""")
def recent_flags(spark, sf):
    flags = obs_events(spark, sf).filter("event_type = 'system_flag'")
    return metrics.recent(flags, "timestamp_utc", 10, "event_id").select(
        "batch_id", "file_id", F.col("flag_id").alias("flag"))


@query(f"""WITH {_EV} SELECT batch_id, file_id, arg_max(k*0.01, ts)::DOUBLE AS composite_score FROM ev
  WHERE event_type='view' GROUP BY 1,2""")
def latest_scores(spark, sf):
    return metrics.file_scores(obs_events(spark, sf))


def _files(spark, sf):
    """One row per order as an extracted file, its figures taken from its own lines."""
    lines = sales_lines(spark, sf, part=False)
    f = lines.groupBy("okey", "batch_id").agg(
        F.count(F.lit(1)).alias("raw_items"), money(F.sum("discount")).alias("disc"),
        F.count(F.when(F.col("pct") == 0, 1)).alias("zero"))
    okey = F.col("okey")
    return f.select(
        "okey", "batch_id", okey.cast("string").alias("file_id"), okey.alias("seq"),
        F.when(okey % 13 == 0, "failed").otherwise("ok").alias("status"),
        (okey * 37 % 5000).alias("total_ms"), money(F.col("disc") * F.lit(0.001).cast("decimal(4,3)")).alias("cost_inr"),
        F.col("zero").alias("corrections"), F.col("zero").alias("subtotals_dropped"), (okey % 17 == 0).alias("unallocated"),
        (okey % 23 != 0).alias("json_ok"), (okey % 101 / 100.0).alias("composite_score"), "raw_items",
        (okey % 7 != 0).alias("math_balanced"), (okey % 5 != 0).alias("gstin_valid"), (okey % 11 != 0).alias("no_tax_conflict"),
        F.when(okey % 29 == 0, "extract").alias("stage_failed"), F.when(okey % 3 == 0, "BLOCKED").alias("recon_status"),
        F.when(okey % 2 == 0, okey % 100 / 100.0).alias("recon_confidence"), (okey % 4).alias("page_count"),
        (okey % 9000).alias("prompt_tokens"), (okey % 700).alias("completion_tokens"))


_FILES = """fl AS (SELECT okey, batch_id, okey*37%5000 AS ms, round(sum(discount)*0.001,2) AS cost, count(*) AS raw,
  count(*) FILTER (pct=0) AS zero FROM sales GROUP BY 1,2)"""


@query(f"""WITH {_FILES} SELECT batch_id, count(*) AS submitted, count(*) FILTER (okey%13<>0) AS completed_ok,
  count(*) FILTER (okey%13=0) AS failed, round(count(*) FILTER (okey%13=0)*100.0::DOUBLE/count(*),1) AS error_rate_pct,
  sum(ms)::BIGINT AS wall_ms, arg_min(okey::VARCHAR, (-ms, okey)) AS slowest_file, arg_min(okey::VARCHAR, (-cost, okey)) AS priciest_file,
  max(ms) AS slowest_ms, sum(cost)::DOUBLE AS total_cost, sum(zero)::BIGINT AS total_corrections,
  count(*) FILTER (zero>0) AS files_corrected, count(*) FILTER (okey%23=0) AS json_failures FROM fl GROUP BY 1""", "sales")
def batch_metrics(spark, sf):
    return metrics.batch_metrics(_files(spark, sf)).select(
        "batch_id", "submitted", "completed_ok", "failed", "error_rate_pct", "wall_ms", "slowest_file", "priciest_file",
        "slowest_ms", *d("total_cost"), "total_corrections", "files_corrected", "json_failures")


@query(f"""WITH {_FILES}, b AS (SELECT batch_id, count(*) AS n, sum(cost)::DOUBLE AS c, sum(ms) AS w,
   count(*) FILTER (okey%13=0) AS f, count(*) FILTER (okey%17=0) AS u FROM fl GROUP BY 1)
 SELECT batch_id, 'HIGH_BATCH_COST' AS flag_id FROM b WHERE round(c/n,2)*n>500
 UNION ALL SELECT batch_id, 'BATCH_FAILURE_RATE' FROM b WHERE round(f*100.0/n,1)>10
 UNION ALL SELECT batch_id, 'SLOW_BATCH' FROM b WHERE w>300000
 UNION ALL SELECT batch_id, 'UNALLOCATED_ROW_SPIKE' FROM b WHERE u*100.0/n>20""", "sales")
def batch_alerts(spark, sf):
    return metrics.batch_alerts(metrics.batch_metrics(_files(spark, sf))).select("batch_id", "flag_id")


@query(f"""WITH {_FILES}, a AS (SELECT batch_id, avg(cost::DOUBLE) AS av FROM fl GROUP BY 1)
 SELECT file_id, batch_id, flag_id FROM (SELECT okey::VARCHAR AS file_id, batch_id, unnest([
  CASE WHEN okey%101/100.0<0.6 THEN 'NUMBER_HALLUCINATION_SUSPECTED' END, CASE WHEN okey%7=0 THEN 'MATH_IMBALANCE_AFTER_CORRECTION' END,
  CASE WHEN okey%5=0 THEN 'GSTIN_INVALID_FORMAT' END, CASE WHEN okey%11=0 THEN 'IGST_CGST_CONFLICT' END,
  CASE WHEN zero::DOUBLE/raw>0.3 THEN 'HIGH_CORRECTION_RATE' END, CASE WHEN okey%17=0 THEN 'UNALLOCATED_ROW_INJECTED' END,
  CASE WHEN cost>20 OR (av>0 AND cost::DOUBLE>3*av) THEN 'COST_SPIKE_PER_FILE' END,
  CASE WHEN zero>0 THEN 'SUBTOTAL_DOUBLE_COUNT_RISK' END, CASE WHEN okey%23=0 THEN 'JSON_PARSE_FAILURE' END,
  CASE WHEN okey%29=0 THEN 'PARTIAL_TRACE' END, CASE WHEN okey%3=0 THEN 'RECONCILIATION_BLOCKED' END,
  CASE WHEN okey%2=0 AND okey%100/100.0<0.6 THEN 'RECONCILIATION_LOW_CONFIDENCE' END]) AS flag_id
 FROM fl JOIN a USING (batch_id)) WHERE flag_id IS NOT NULL""", "sales")
def quality_flags(spark, sf):
    return metrics.file_flags(_files(spark, sf)).select("file_id", "batch_id", "flag_id")


@query(f"""WITH {_FILES} SELECT okey, round((okey%9000+okey%700)::DOUBLE/greatest(okey%4,1),1) AS tokens_per_page,
  round(zero::DOUBLE/raw,3) AS correction_rate FROM fl""", "sales")
def file_metrics(spark, sf):
    return metrics.file_metrics(_files(spark, sf)).select("okey", "tokens_per_page", "correction_rate")


@query(f"""WITH {_FILES} SELECT okey, round(p,2)+0.0 AS prompt_cost, round(c,2) AS completion_cost FROM (
  SELECT okey, okey%9000/1000000.0::DOUBLE*CASE WHEN okey%3=0 THEN 0.075*83.0::DOUBLE WHEN okey%3=1 THEN 0.59*83.0::DOUBLE ELSE 0 END AS p,
  okey%700/1000000.0::DOUBLE*CASE WHEN okey%3=0 THEN 0.30*83.0::DOUBLE WHEN okey%3=1 THEN 0.59*83.0::DOUBLE ELSE 0 END AS c FROM fl)""", "sales")
def call_costs(spark, sf):
    m = F.col("okey") % 3
    model = F.when(m == 0, "gemini-2.5-flash").when(m == 1, "meta-llama/llama-3.3-70b-instruct").otherwise("unlisted")
    cost = call_cost_inr(model, F.col("prompt_tokens"), F.col("completion_tokens"))
    return _files(spark, sf).select("okey", cost["prompt_cost"].alias("prompt_cost"),
                                    cost["completion_cost"].alias("completion_cost"))


@query(f"""WITH {_FILES} SELECT okey, round(okey%101/100.0::DOUBLE*0.40 + CASE WHEN okey%7<>0 THEN 0.3 ELSE 0 END
  + CASE WHEN okey%5<>0 THEN 0.2 ELSE 0 END + CASE WHEN okey%23<>0 THEN 0.1 ELSE 0 END,2) AS quality FROM fl""", "sales")
def composite_quality_scores(spark, sf):
    q = composite_quality(F.col("composite_score"), F.col("math_balanced"), F.col("gstin_valid"), F.col("json_ok"))
    return _files(spark, sf).select("okey", F.round(q, 2).alias("quality"))


@query("""SELECT 'B'||strftime(o_orderdate,'%Y%m') AS batch_id, count(*) FILTER (o_orderstatus='P') AS pending,
  count(*) FILTER (o_orderstatus='F') AS completed, count(*) FILTER (o_orderstatus='O') AS failed, count(*) AS total
 FROM orders GROUP BY 1""")
def task_status_counts(spark, sf):
    tasks = read(spark, sf, "orders").select(
        F.concat(F.lit("B"), F.date_format("o_orderdate", "yyyyMM")).alias("batch_id"),
        F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "F", "COMPLETED")
        .otherwise("FAILED").alias("status"))
    return metrics.task_status_counts(tasks).drop("processing")


@query("""WITH v AS (SELECT okey, sum(total_invoice_value) AS v FROM sales GROUP BY 1)
 SELECT o_orderkey AS okey, round((1-coalesce(CASE WHEN o_orderkey%4<>0 THEN o_orderkey%100/100.0::DOUBLE END,0.5))*40
  + CASE o_orderkey%3 WHEN 0 THEN 35 WHEN 1 THEN 15 ELSE 0 END + CASE WHEN o_orderkey%5=0 THEN 20 ELSE 0 END
  + CASE WHEN o_orderkey%7=0 THEN 25 ELSE 0 END + least(o_orderkey%6,3)*8
  + CASE WHEN coalesce(v,0)>=100000 THEN 15 ELSE 0 END,2) AS priority_score, o_orderkey%6 AS manual_flag_count
 FROM orders LEFT JOIN v ON okey=o_orderkey""", "sales")
def priority_queue(spark, sf):
    okey = F.col("o_orderkey")
    orders = read(spark, sf, "orders").select("o_orderkey")
    task = okey.cast("string").alias("task_id")
    tasks = orders.select(
        task, okey.alias("seq"), F.when(okey % 3 == 0, "BLOCKED").when(okey % 3 == 1, "NEEDS_REVIEW")
        .otherwise("ERP_READY").alias("recon_status"),
        F.when(okey % 5 == 0, "FAILED").otherwise("PASSED").alias("validation_status"))
    scores = orders.filter("o_orderkey % 4 <> 0").select(task, (okey % 100 / 100.0).alias("composite_score"))
    edits = orders.filter("o_orderkey % 6 > 0").select(task, F.explode(F.sequence(F.lit(1), okey % 6)).alias("edit"))
    double = orders.filter("o_orderkey % 7 = 0").select(task)
    flags = orders.filter("o_orderkey % 8 = 0").select(task)
    values = sales_lines(spark, sf, part=False).groupBy("task_id").agg(
        F.sum("total_invoice_value").alias("total_invoice_value"))
    out = metrics.review_queue(tasks, scores, flags, edits, double, values)
    return out.select(F.col("seq").alias("okey"), "priority_score", "manual_flag_count")


def _cases(spark, sf):
    """Golden cases as JSON: each order's total, customer and status as extracted and as expected."""
    okey = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice"), 2).cast("decimal(14,2)")
    seen = F.when(okey % 5 == 0, cents + 1).when(okey % 5 == 1, cents + F.lit("0.01").cast("decimal(4,2)")).otherwise(cents)
    text = F.concat(
        F.lit('{"case_id":"'), okey.cast("string"), F.lit('","document_type":"sales_invoice","fields":{"total":{"extracted":'),
        F.when(okey % 11 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), seen.cast("string"), F.lit('"'))),
        F.lit(',"expected":'), cents.cast("string"), F.lit(',"confidence":0.9},"status":{"extracted":" '),
        F.when(okey % 3 == 0, F.lit("x")).otherwise(F.lower("o_orderstatus")), F.lit('","expected":"'),
        F.col("o_orderstatus"), F.lit('"},"due":{"extracted":null,"expected":null}}}'))
    return read(spark, sf, "orders").select(F.from_json(text, golden.CASE_SCHEMA).alias("c")).select("c.*")


_GOLD = """g AS (SELECT o_orderkey::VARCHAR AS case_id, o_orderkey%11<>0 AND o_orderkey%5<>0 AND (o_orderkey%5<>1 OR
  abs((CAST(o_totalprice AS DECIMAL(14,2))+0.01)::DOUBLE-CAST(o_totalprice AS DECIMAL(14,2))::DOUBLE)<=0.01) AS t, o_orderkey%3<>0 AS s FROM orders)"""


@query(f"""WITH {_GOLD} SELECT case_id, 3::BIGINT AS total_fields, (t::INT+s::INT+1)::BIGINT AS correct_fields,
  round((t::INT+s::INT+1)/3.0::DOUBLE,4) AS field_accuracy, t AND s AS exact_match FROM g""")
def golden_accuracy(spark, sf):
    return golden.case_scores(golden.graded(golden.fields_of(_cases(spark, sf)))).drop("document_type")


@query(f"""WITH {_GOLD} SELECT field_name, count(*) AS total, count(*) FILTER (ok) AS correct,
  round(count(*) FILTER (ok)::DOUBLE/count(*),4) AS accuracy FROM (SELECT 'total' AS field_name, t AS ok FROM g
  UNION ALL SELECT 'status', s FROM g UNION ALL SELECT 'due', true FROM g) GROUP BY 1""")
def golden_by_field(spark, sf):
    return golden.field_scores(golden.graded(golden.fields_of(_cases(spark, sf))))


@query(f"""WITH {_GOLD} SELECT count(*) AS total_cases, count(*) FILTER (t AND s) AS exact_match_cases,
  round(count(*) FILTER (t AND s)::DOUBLE/count(*),4) AS document_level_accuracy, sum(t::INT+s::INT+1)::BIGINT AS correct_fields,
  round(sum(t::INT+s::INT+1)::DOUBLE/(3*count(*)),4) AS field_level_accuracy FROM g""")
def golden_set(spark, sf):
    scores = golden.case_scores(golden.graded(golden.fields_of(_cases(spark, sf))))
    return golden.set_score(scores).drop("total_fields")


@query("""SELECT field, count(*) AS total, count(*) FILTER (ok) AS correct FROM (
  SELECT 'taxable' AS field, abs(coalesce(t,0)-CAST(o_totalprice AS DECIMAL(18,2)))<=1 AS ok FROM orders LEFT JOIN
   (SELECT okey, sum(gross) AS t FROM sales GROUP BY 1) ON okey=o_orderkey
  UNION ALL SELECT 'igst', coalesce(i,0)<=1 FROM orders LEFT JOIN (SELECT okey, sum(igst_amount) AS i FROM sales GROUP BY 1)
   ON okey=o_orderkey) GROUP BY 1""", "sales")
def backtest_accuracy(spark, sf):
    mine = sales_lines(spark, sf, part=False).groupBy("okey").agg(
        F.sum("gross").alias("taxable"), F.sum("igst_amount").alias("igst"))
    gold = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("okey"), money(F.col("o_totalprice")).alias("taxable"), F.lit(0).alias("igst"))
    return golden.backtest(mine, gold, "okey", ["taxable", "igst"]).drop("accuracy_pct")


def _annotated(spark, sf):
    rows = reconciliation(spark, sf).all_rows
    found = F.when(F.col("recon_status") == "not_in_books",
                   F.when(F.crc32("supplier_inv") % 2 == 0, "Yes").otherwise("No"))
    return state.annotate_rows(rows.withColumn("in_drive", found))


@query("""SELECT recon_status, client_action, count(*) AS n FROM (
 SELECT recon_status, CASE recon_status WHEN 'mismatch' THEN 'Flag for accountant review' WHEN 'missing_in_2b' THEN
   'Auto-notify client: follow up with vendor (ITC at risk)' END AS client_action FROM rows2b
 UNION ALL SELECT 'not_in_books', 'Request invoice from client (pending accountant review)' FROM extra2b) GROUP BY 1,2""",
       "rows2b extra2b")
def gap_annotation(spark, sf):
    rows = reconciliation(spark, sf).all_rows.withColumn(
        "in_drive", F.when(F.col("recon_status") == "not_in_books", "No"))
    return state.annotate_rows(rows).groupBy("recon_status", "client_action").agg(F.count(F.lit(1)).alias("n"))


def _slim(spark, sf):
    """The reconciliation of books without the columns that no trigger needs, which are then neither joined nor shuffled."""
    books = gstr2b.normalise_books(purchase_lines(spark, sf, part=False))
    return gstr2b.Reconciliation(books.select("seq", "norm_key", "gst_no", "supplier_inv", "amount", "total_amount"),
                                 statement_2b(spark, sf).select(*gstr2b.RECORD, "norm_key", "seq"))


def _gaps(spark, sf):
    r = _slim(spark, sf)
    rows = r.missing_lines.unionByName(
        r.extra.withColumn("in_drive", F.lit("No")).withColumn("seq", F.struct(
            *[F.lit(None).cast(t).alias(n) for n, t in
              (("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_extendedprice", "double"), ("l_partkey", "bigint"))])),
        allowMissingColumns=True)
    return state.gaps_of(rows).select("*", F.lit("T1").alias("tenant_id"), F.lit(FIRM_GSTIN).alias("registration_gstin"))


def _old_state(spark, sf):
    """State of an earlier run: every third missing invoice is known, and so are vanished ones."""
    inv = _slim(spark, sf).invoices
    mod = F.substring("supplier_inv", 4, 7).cast("bigint") % 3
    rows = inv.filter((F.col("gst_no") != "") & (mod < 2)).select(
        F.lit("T1").alias("tenant_id"), F.lit(FIRM_GSTIN).alias("registration_gstin"),
        F.col("gst_no").alias("counterparty_gstin"), F.col("supplier_inv").alias("invoice_no"),
        F.lit("missing_in_2b").alias("bucket"), F.lit("2023-12").alias("period"), money(F.lit(1)).alias("amount"),
        F.when(mod == 0, "resolved").otherwise("sent").alias("status"),
        F.lit("2023-12-20 00:00:00").cast("timestamp_ntz").alias("last_triggered_at"), F.lit(2).cast("bigint").alias("trigger_count"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"))
    return rows.select(*state.TRIGGER_COLUMNS)


_NOW = "2024-01-31 00:00:00"


def _merged(spark, sf):
    scope = spark.range(1).select(F.lit("T1").alias("tenant_id"), F.lit(FIRM_GSTIN).alias("registration_gstin"),
                                  F.lit("2024-01").alias("period"), F.lit(True).alias("require_review"))
    return state.merge_triggers(_old_state(spark, sf), _gaps(spark, sf), scope, F.lit(_NOW).cast("timestamp_ntz"))


_TRIG = """gp AS (SELECT party_gstin AS g, b.invoice_no AS no, 'missing_in_2b' AS bucket, arg_max(total_amount, b.seq) AS amt
   FROM rows2b r JOIN books b USING (seq) WHERE recon_status='missing_in_2b' AND party_gstin IS NOT NULL GROUP BY 1,2
   UNION ALL SELECT gstin, inv_no, 'not_in_books', max(total_val) FROM extra2b WHERE gstin<>'' GROUP BY 1,2),
 os AS (SELECT party_gstin AS g, invoice_no AS no, 'missing_in_2b' AS bucket, okey%3 AS md FROM books
   WHERE party_gstin IS NOT NULL AND okey%3<2 GROUP BY 1,2,4),
 mg AS (SELECT coalesce(gp.g,os.g) AS g, coalesce(gp.no,os.no) AS no, coalesce(gp.bucket,os.bucket) AS bucket,
   CASE WHEN gp.g IS NULL THEN '2023-12' ELSE '2024-01' END AS period, coalesce(gp.amt,1) AS amount,
   CASE WHEN os.g IS NULL THEN CASE gp.bucket WHEN 'not_in_books' THEN 'pending_review' ELSE 'queued' END
    WHEN gp.g IS NOT NULL THEN CASE WHEN md=0 THEN 'queued' ELSE 'sent' END ELSE 'resolved' END AS status,
   CASE WHEN os.g IS NULL THEN 0 ELSE 2 END AS cnt, os.g IS NOT NULL AS old
  FROM gp FULL JOIN os ON gp.g=os.g AND gp.no=os.no AND gp.bucket=os.bucket)"""


_VERDICT = """CASE WHEN bucket<>'not_in_books' AND no LIKE '%5' THEN 'needs no approval' WHEN status<>'pending_review' THEN 'not pending review: '||status END"""


def _votes(spark, sf):
    """The merged state, and votes on all of it: records missing in the books and numbers that end in 5 are approved, the others rejected."""
    merged = cut_lineage(_merged(spark, sf))  # written once: it is the state, and its own decisions are joined with it
    action = F.when((F.col("bucket") == "not_in_books") | F.endswith("invoice_no", F.lit("5")), "approve").otherwise("reject")
    return merged, state.decide_triggers(merged, merged.select(*state.TRIGGER_KEY, action.alias("action")))


@query(f"""WITH {_TRIG} SELECT g AS counterparty_gstin, no AS invoice_no, bucket, {_VERDICT} AS reason, ({_VERDICT}) IS NULL AS accepted FROM mg""",
       "rows2b extra2b books")
def trigger_decisions(spark, sf):
    return _votes(spark, sf)[1].select("counterparty_gstin", "invoice_no", "bucket", "reason", "accepted")


@query(f"""WITH {_TRIG} SELECT g AS counterparty_gstin, no AS invoice_no, amount::DOUBLE AS amount FROM mg
 WHERE bucket='not_in_books' AND status='pending_review'""", "rows2b extra2b books")
def trigger_listing(spark, sf):
    """Approved triggers of a tenant, after the votes are applied."""
    merged, decided = _votes(spark, sf)
    after = state.apply_decisions(merged, decided)
    return state.triggers_of(after, "T1", FIRM_GSTIN, "approved").select("counterparty_gstin", "invoice_no", *d("amount"))


@query(f"""WITH {_TRIG} SELECT g AS counterparty_gstin, no AS invoice_no, bucket, period, amount::DOUBLE AS amount, status,
  cnt::BIGINT AS trigger_count FROM mg""", "rows2b extra2b books")
def gap_trigger_merge(spark, sf):
    return _merged(spark, sf).select("counterparty_gstin", "invoice_no", "bucket", "period", *d("amount"), "status",
                                     "trigger_count")


@query(f"""WITH {_TRIG} SELECT bucket, status, CASE WHEN status IN ('queued','sent') THEN 'sent' END AS outcome, count(*) AS n
 FROM mg GROUP BY 1,2,3""", "rows2b extra2b books")
def due_triggers(spark, sf):
    policy = spark.range(1).select(F.lit("T1").alias("tenant_id"), F.lit(True).alias("auto_vendor_followup"))
    out = state.due_outcome(_merged(spark, sf), policy, F.lit(_NOW).cast("timestamp_ntz"))
    return out.groupBy("bucket", "status", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT tenant, period, arg_max(status, (o_orderdate, o_orderkey)) AS status, max(o_orderdate)::DATE::VARCHAR AS day FROM (
  SELECT c_mktsegment AS tenant, strftime(o_orderdate,'%Y-%m') AS period, o_orderstatus AS status, o_orderdate, o_orderkey
  FROM orders JOIN customer ON o_custkey=c_custkey) GROUP BY 1,2""")
def latest_review(spark, sf):
    return _latest(spark, sf).select("tenant", "period", "status", F.to_date("created_at").cast("string").alias("day"))


def _reviews(spark, sf):
    orders, cust = read(spark, sf, "orders"), read(spark, sf, "customer")
    return orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("tenant"), F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        F.col("o_orderkey").alias("review_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))


def _latest(spark, sf):
    return state.latest_review(_reviews(spark, sf), ["tenant", "period"])


@query("""SELECT new_status, reason, count(*) AS n FROM (SELECT CASE WHEN a='reject' AND notes='' THEN 'a rejection needs notes'
   WHEN st<>'PENDING_REVIEW' THEN 'already '||st END AS reason, CASE WHEN (a='reject' AND notes='') OR st<>'PENDING_REVIEW' THEN st
   WHEN a='approve' THEN 'APPROVED' ELSE 'REJECTED' END AS new_status FROM (
   SELECT CASE o_orderstatus WHEN 'P' THEN 'PENDING_REVIEW' WHEN 'F' THEN 'APPROVED' ELSE 'REJECTED' END AS st,
    CASE WHEN o_orderkey%2=0 THEN 'approve' ELSE 'reject' END AS a, CASE WHEN o_orderkey%5=0 THEN '' ELSE 'n' END AS notes FROM orders))
 GROUP BY 1,2""")
def review_decisions(spark, sf):
    reviews = _reviews(spark, sf).withColumn("status", F.when(F.col("status") == "P", "PENDING_REVIEW").when(
        F.col("status") == "F", "APPROVED").otherwise("REJECTED"))
    rid = F.col("review_id")
    decisions = reviews.select("review_id", F.when(rid % 2 == 0, "approve").otherwise("reject").alias("action"),
                               F.when(rid % 5 == 0, " ").otherwise("n").alias("notes"))
    return state.decide_reviews(reviews, decisions).groupBy("new_status", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT field_name, count(*) AS n FROM (SELECT 'hsn' AS field_name FROM sales WHERE okey%10=0 AND hsn<>'9971'
  UNION ALL SELECT 'taxable_value' FROM sales WHERE okey%4=0) GROUP BY 1""", "sales")
def correction_events(spark, sf):
    lines = sales_lines(spark, sf)
    before = lines.select("seq", "hsn", "taxable_value", "invoice_no")
    okey = F.col("okey")
    after = lines.select("seq", F.when(okey % 10 == 0, "9971").otherwise(F.col("hsn")).alias("hsn"),
                         money(F.when(okey % 4 == 0, F.col("taxable_value") + 1).otherwise(F.col("taxable_value")))
                         .alias("taxable_value"), "invoice_no")
    out = state.corrections(before, after, ["seq"], ["hsn", "taxable_value", "invoice_no"])
    return out.groupBy("field_name").agg(F.count(F.lit(1)).alias("n"))


def _postable(spark, sf):
    return sales_lines(spark, sf, part=False).withColumn("voucher_iso", F.date_format("o_orderdate", "yyyy-MM-dd"))


_LEGS = """lg AS (SELECT okey, CASE k WHEN 0 THEN party_ledger_name WHEN 1 THEN CASE WHEN voucher_type='Debit Note' THEN
    'Purchase Account' ELSE 'Sales Account' END WHEN 2 THEN 'CGST' WHEN 3 THEN 'SGST' ELSE 'IGST' END AS ledger,
   CASE k WHEN 0 THEN CASE WHEN total_invoice_value=0 THEN taxable_value+cgst_amount+sgst_amount+igst_amount ELSE total_invoice_value END
    WHEN 1 THEN taxable_value WHEN 2 THEN cgst_amount WHEN 3 THEN sgst_amount ELSE igst_amount END AS amount,
   CASE WHEN (voucher_type='Credit Note') = (k=0) THEN 'Cr' ELSE 'Dr' END AS side, k
  FROM sales, (SELECT unnest([0,1,2,3,4]) AS k) WHERE k<2 OR (k=2 AND cgst_amount<>0) OR (k=3 AND sgst_amount<>0) OR (k=4 AND igst_amount<>0))"""


@query(f"""WITH {_LEGS} SELECT okey, ledger, side, count(*) AS n, sum(amount)::DOUBLE AS amount FROM lg GROUP BY 1,2,3""", "sales")
def journal_legs(spark, sf):
    legs = ledger.journal_legs(_postable(spark, sf), "voucher_iso")
    return legs.groupBy("okey", "ledger", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"))


@query(f"""WITH {_LEGS} SELECT ledger, coalesce(sum(amount) FILTER (side='Dr'),0)::DOUBLE AS debit,
  coalesce(sum(amount) FILTER (side='Cr'),0)::DOUBLE AS credit, count(*) AS n_legs FROM lg GROUP BY 1""", "sales")
def ledger_balance(spark, sf):
    out = ledger.ledger_balance(ledger.journal_legs(_postable(spark, sf), "voucher_iso"))
    return out.select("ledger", *d("debit credit"), "n_legs")


@query("""SELECT count(*) AS n, sum(taxable_value)::DOUBLE AS taxable FROM sales WHERE okey%3=0 AND okey%4<>0""", "sales")
def push_candidates(spark, sf):
    okey = F.col("okey")
    items = sales_lines(spark, sf, part=False).select(
        F.lit("sales").alias("item_type"), F.col("seq").cast("string").alias("item_id"), F.lit("C1").alias("company"),
        F.when(okey % 3 == 0, "ERP_READY").otherwise("BLOCKED").alias("recon_status"), "taxable_value", "okey")
    log = items.filter("okey % 2 = 0").select(
        "item_type", "item_id", "company", F.when(okey % 4 == 0, "success").otherwise("failed").alias("status"))
    return ledger.to_push(items, log).agg(F.count(F.lit(1)).alias("n"), F.sum("taxable_value").cast("double").alias("taxable"))


@query("""SELECT party_ledger_name, CASE WHEN bool_or(voucher_type<>'Debit Note') THEN 'Sundry Debtors' ELSE 'Sundry Creditors' END AS parent
 FROM sales WHERE ckey%4<>0 GROUP BY 1""", "sales")
def missing_parties(spark, sf):
    known = read(spark, sf, "customer").filter("c_custkey % 4 = 0").select(F.upper("c_name").alias("name"))
    return ledger.missing_parties(sales_lines(spark, sf, part=False), known).select("party_ledger_name", "parent")


@query("""SELECT okey, arg_min(line, (CASE WHEN pct=18 THEN 0 ELSE 1 END, CASE WHEN pct<>18 THEN discount END, line, l))::BIGINT AS attempt
 FROM (SELECT *, gross AS l FROM sales) GROUP BY 1""".replace("(CASE WHEN pct=18 THEN 0 ELSE 1 END, CASE WHEN pct<>18 THEN discount END, line, l)",
 "row(CASE WHEN pct=18 THEN 0 ELSE 1 END, CASE WHEN pct<>18 THEN discount ELSE -1 END, line, l)"), "sales")
def best_attempt(spark, sf):
    lines = sales_lines(spark, sf, part=False)
    attempts = lines.select("okey", F.struct("line", "gross").alias("attempt"),
                            F.when(F.col("pct") == 18, "ERP_READY").otherwise("BLOCKED").alias("recon_status"),
                            F.col("discount").alias("variance_total"))
    return ledger.best_attempt(attempts, "okey").select("okey", F.col("attempt.line").alias("attempt"))


def _inventory(spark, sf):
    """A file listing: documents as files in folders named after source and language."""
    docs = read(spark, sf, "documents")
    did = F.col("doc_id")
    folder = (F.when(did % 6 == 0, "Sales Invoice").when(did % 6 == 1, "Credit Note/June").when(did % 6 == 2, "Sale Analysis")
              .when(did % 6 == 3, F.lit(None)).when(did % 6 == 4, "misc/Credit Note").otherwise("misc"))
    ext = F.when(did % 5 == 0, ".xlsx").when(did % 5 == 1, ".zip").otherwise(".PDF")
    return docs.select("doc_id", did.cast("string").alias("file_id"), F.md5("text").alias("md5"),
                       F.concat_ws("/", folder, F.concat(did.cast("string"), ext)).alias("path"))


@query("""SELECT t AS document_type, count(*) AS n FROM (SELECT CASE doc_id%6 WHEN 0 THEN 'invoice' WHEN 1 THEN 'credit_note'
  WHEN 4 THEN 'credit_note' WHEN 5 THEN 'unknown' WHEN 3 THEN CASE doc_id%5 WHEN 0 THEN 'client_sheet' WHEN 1 THEN 'unknown' ELSE 'invoice' END
  END AS t FROM documents) WHERE t IS NOT NULL GROUP BY 1""")
def file_types(spark, sf):
    return inventory.histogram(inventory.classify(_inventory(spark, sf)))


@query("""SELECT CASE doc_id%5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'archive' ELSE 'invoice' END AS document_type, count(*) AS n
 FROM documents GROUP BY 1""")
def purchase_file_types(spark, sf):
    return inventory.histogram(inventory.classify(_inventory(spark, sf), purchase=True))


def _changed(spark, sf):
    files = _inventory(spark, sf)
    did = F.col("doc_id")
    tracker = files.filter("doc_id % 4 <> 0").select(
        "file_id", F.when(did % 4 == 1, "old").otherwise(F.col("md5")).alias("md5"),
        F.when(did % 4 == 2, "failed").otherwise("completed").alias("status"))
    return inventory.needs_processing(files, tracker)


@query("""SELECT doc_id, CASE WHEN doc_id%4=0 THEN 'new' ELSE 'updated' END AS change FROM documents WHERE doc_id%4<3""")
def incremental_files(spark, sf):
    return _changed(spark, sf).select("doc_id", "change")


@query("""SELECT change, deferred, count(*) AS n FROM (SELECT CASE WHEN doc_id%4=0 THEN 'new' ELSE 'updated' END AS change,
  row_number() OVER (ORDER BY doc_id)>100 AS deferred FROM documents WHERE doc_id%4<3) GROUP BY 1,2""")
def file_budget(spark, sf):
    return inventory.within_budget(_changed(spark, sf), 100, "doc_id").groupBy("change", "deferred").agg(
        F.count(F.lit(1)).alias("n"))


@query("""SELECT strftime(o_orderdate,'%Y-%m') AS period, ((month(o_orderdate)+8)%12+1)::BIGINT AS fiscal_month,
  ((month(o_orderdate)+8)%12+1)::VARCHAR||'. '||strftime(o_orderdate,'%B %Y') AS folder,
  strftime(o_orderdate,'%Y%m%d') AS voucher_day, count(*) AS n FROM orders GROUP BY ALL""")
def period_folders(spark, sf):
    day = F.col("o_orderdate")
    iso = F.date_format(day, "yyyy-MM-dd")
    return read(spark, sf, "orders").groupBy(
        F.date_format(day, "yyyy-MM").alias("period"), fiscal_month_index(day).cast("bigint").alias("fiscal_month"),
        period_folder(day).alias("folder"), iso_to_voucher(voucher_to_iso(iso_to_voucher(iso))).alias("voucher_day"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT strftime(m - to_months(i::INT),'%Y-%m') AS period, i AS back FROM
 (SELECT date_trunc('month', max(o_orderdate)) AS m FROM orders), (SELECT unnest(range(24)) AS i)""")
def recent_periods(spark, sf):
    last = read(spark, sf, "orders").agg(F.max("o_orderdate").alias("m"))
    return last.select(F.posexplode(last_periods(F.to_date("m"))).alias("back", "period")).select(
        F.col("back").cast("bigint").alias("back"), "period")


@query("""SELECT tenant_id, count(*) AS n, sum(taxable_value)::DOUBLE AS taxable FROM sales WHERE tenant_id='BUILDING' GROUP BY 1""", "sales")
def tenant_lines(spark, sf):
    lines = sales_lines(spark, sf, part=False).drop("batch_id", "tenant_id")
    cust = read(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    orders = read(spark, sf, "orders")
    tasks = orders.select(F.col("o_orderkey").cast("string").alias("task_id"), F.col("o_custkey").alias("batch_id"))
    batches = cust.select(F.col("c_custkey").alias("batch_id"), F.col("c_mktsegment").alias("tenant_id"))
    return source.tenant_lines(lines, tasks, batches, "BUILDING").groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("taxable_value").cast("double").alias("taxable"))


@query("""SELECT o_orderstatus AS recon_status, count(*) AS n FROM orders WHERE o_orderstatus<>'F' GROUP BY 1
 UNION ALL SELECT NULL, count(*) FROM orders WHERE o_orderstatus='F'""")
def export_gate(spark, sf):
    st = F.col("o_orderstatus")
    tasks = read(spark, sf, "orders").select(F.when(st == "O", "ERP_READY").when(st == "P", "BLOCKED").alias("recon_status"), "o_orderstatus")
    tasks = tasks.unionByName(tasks.filter("recon_status = 'BLOCKED'").withColumn("recon_status", F.lit("NEEDS_REVIEW")))
    kept = filing.export_gate(tasks)
    return kept.groupBy(F.when(F.col("recon_status").isNotNull(), F.col("o_orderstatus")).alias("recon_status")).agg(
        F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS n, sum(taxable_value)::DOUBLE AS taxable FROM sales WHERE okey%4=0 AND strftime(o_orderdate,'%Y-%m')='1997-03'""", "sales")
def period_filter(spark, sf):
    return filing.period_lines(sales_lines(spark, sf, part=False), "1997-03").agg(
        F.count(F.lit(1)).alias("n"), F.sum("taxable_value").cast("double").alias("taxable"))


@query("""SELECT invoice_no AS "Invoice No", coalesce(party_gstin,'') AS "Party GSTIN", hsn AS "HSN",
  nullif(advances,0)::DOUBLE AS "Advances", nullif(total_invoice_value,0)::DOUBLE AS "Total Invoice Value",
  coalesce(narration,'') AS "Narration", 'f.pdf' AS "Source File" FROM sales""", "sales")
def register_view(spark, sf):
    out = views.project(sales_lines(spark, sf), views.SALES_REGISTER, {"source_file": "f.pdf"})
    return out.select("Invoice No", "Party GSTIN", "HSN", *d("Advances"),
                      F.col("Total Invoice Value").cast("double").alias("Total Invoice Value"), "Narration", "Source File")


@query("""SELECT invoice_no AS "SUPPLIER INV NO", coalesce(party_gstin,'') AS "GST NO", coalesce(party_ledger_name,'') AS "PARTY A/C NAME",
  nullif(taxable_value,0)::DOUBLE AS "AMOUNT", nullif(igst_amount,0)::DOUBLE AS "IGST", nullif(total_invoice_value,0)::DOUBLE AS "TOTAL AMOUNT" FROM books""", "books")
def purchase_view(spark, sf):
    out = views.project(purchase_lines(spark, sf), views.PURCHASE_REGISTER)
    return out.select("SUPPLIER INV NO", "GST NO", "PARTY A/C NAME", *[F.col(c).cast("double").alias(c) for c in ("AMOUNT", "IGST", "TOTAL AMOUNT")])


@query("""SELECT invoice_no AS "Invoice No", coalesce(party_gstin,'') AS "Party GSTIN", coalesce(gstr1_category,'') AS "GSTR-1 Category",
  nullif(taxable_value,0)::DOUBLE AS "Taxable Value", nullif(cgst_amount,0)::DOUBLE AS "CGST Amount", '' AS "Note",
  CASE WHEN okey%10=0 THEN 'ERR' ELSE '' END AS "Status" FROM sales""", "sales")
def audit_view(spark, sf):
    lines = sales_lines(spark, sf).withColumn("status", F.when(F.col("okey") % 10 == 0, "ERR"))
    out = views.project(lines, views.AUDIT)
    return out.select("Invoice No", "Party GSTIN", "GSTR-1 Category", *[F.col(c).cast("double").alias(c) for c in ("Taxable Value", "CGST Amount")], "Note", "Status")


@query("""SELECT "Recon Status", count(*) AS n, count("Fuzzy Matched") AS fuzzy, sum(v)::DOUBLE AS total FROM (
  SELECT recon_status AS "Recon Status", CASE WHEN fuzzy_matched THEN 1 END AS "Fuzzy Matched", total_amount AS v FROM rows2b
  UNION ALL SELECT 'not_in_books', NULL, total_val FROM extra2b) GROUP BY 1""", "rows2b extra2b")
def recon2b_view(spark, sf):
    out = views.project(reconciliation(spark, sf).all_rows, views.GSTR2B_RECONCILIATION)
    return out.groupBy("Recon Status").agg(F.count(F.lit(1)).alias("n"), F.count("Fuzzy Matched").alias("fuzzy"),
                                           F.sum("Total Value (Books)").cast("double").alias("total"))


@query("""SELECT invoice_no AS "Reference", voucher_date AS "DocumentDate", taxable_value::DOUBLE AS "AmountLC", hsn AS "HSNSAC" FROM sales""", "sales")
def erp_columns(spark, sf):
    rows = sales_lines(spark, sf).select("invoice_no", "voucher_date", F.col("taxable_value").cast("double").alias("taxable_value"), "hsn")
    return views.rename_for_erp(rows, "sap")


@query("""SELECT lower(category) AS sheet, invoice_no AS number, NULL::VARCHAR AS until, gstin, party_name AS party, doc_date, total::DOUBLE AS value, taxable::DOUBLE AS taxable, pos,
   CASE WHEN category='CDNR' THEN CASE WHEN lower(voucher_type) LIKE '%debit%' THEN 'D' ELSE 'C' END END AS kind FROM groups WHERE category IN ('B2B','CDNR')
 UNION ALL SELECT 'docs', min(trim(invoice_no)), max(trim(invoice_no)), NULL, NULL, NULL, count(DISTINCT trim(invoice_no))::DOUBLE, NULL, NULL,
   CASE WHEN voucher_type='Sales' THEN 'Invoices for outward supply' ELSE voucher_type END FROM sales GROUP BY voucher_type""", "groups sales")
def flat_sheets(spark, sf):
    """Rows of the sheets that list documents; b2cs and hsn sheets have queries of their own."""
    sheets = gstr1.flat_sheets(sales_lines(spark, sf), FIRM_STATE)

    def no(name):
        return F.lit(None).cast("string").alias(name)

    b2b = sheets["b2b"].select(
        F.lit("b2b").alias("sheet"), F.col("invoice_number").alias("number"), no("until"), "gstin", F.col("receiver_name").alias("party"), F.col("invoice_date").alias("doc_date"),
        F.col("invoice_value").cast("double").alias("value"), F.col("taxable_value").cast("double").alias("taxable"), F.col("place_of_supply").alias("pos"), no("kind"))
    cdnr = sheets["cdnr"].select(
        F.lit("cdnr").alias("sheet"), F.col("note_number").alias("number"), no("until"), "gstin", F.col("receiver_name").alias("party"), F.col("note_date").alias("doc_date"),
        F.col("note_value").cast("double").alias("value"), F.col("taxable_value").cast("double").alias("taxable"), F.col("place_of_supply").alias("pos"), F.col("ntty").alias("kind"))
    docs = sheets["docs"].select(
        F.lit("docs").alias("sheet"), F.col("sr_no_from").alias("number"), F.col("sr_no_to").alias("until"), F.col("total_number").cast("double").alias("value"),
        F.col("nature_of_document").alias("kind"))
    return b2b.unionByName(cdnr).unionByName(docs, allowMissingColumns=True)


def _vouchers(spark, sf):
    """Orders as voucher XML elements, read back field by field.

    Parsing takes far longer than its few bytes tell, so lines are dealt out evenly, over as many tasks as a shuffle has.
    """
    lines = sales_lines(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), F.coalesce(value.cast("string"), F.lit("")), F.lit(f"</{name}>"))
    def tax(name, c):
        return F.concat(F.lit("<ACCOUNTINGALLOCATIONS.LIST>"), tag("LEDGERNAME", F.lit(name)), tag("AMOUNT", -F.col(c)),
                        F.lit("</ACCOUNTINGALLOCATIONS.LIST>"))
    entry = F.concat(
        F.lit("<ALLINVENTORYENTRIES.LIST>"), tag("STOCKITEMNAME", F.col("particulars")), tag("BILLEDQTY", F.col("qty")),
        tag("RATE", F.col("rate")), tag("AMOUNT", -F.col("taxable_value")), tax("Output CGST", "cgst_amount"),
        tax("Output SGST", "sgst_amount"), tax("Output IGST", "igst_amount"), F.lit("</ALLINVENTORYENTRIES.LIST>"))
    xml = F.concat(
        F.lit("<VOUCHER>"), tag("DATE", F.date_format("o_orderdate", "yyyyMMdd")), tag("VOUCHERTYPENAME", F.col("voucher_type")),
        tag("VOUCHERNUMBER", F.col("invoice_no")), tag("PARTYLEDGERNAME", F.col("party_ledger_name")),
        tag("PARTYGSTIN", F.col("party_gstin")), entry, F.lit("</VOUCHER>"))
    return lines.select(F.from_xml(xml, source.VOUCHER_SCHEMA).alias("v")).select("v.*")


@query("""SELECT strftime(o_orderdate,'%Y-%m-%d') AS voucher_date, invoice_no, CASE WHEN party_gstin IS NULL THEN 'B2C (Small)' ELSE 'B2B' END
  AS gstr1_category, count(*) AS n, sum(taxable_value)::DOUBLE AS taxable, sum(cgst_amount)::DOUBLE AS cgst, sum(igst_amount)::DOUBLE AS igst,
  sum(taxable_value+cgst_amount+sgst_amount+igst_amount)::DOUBLE AS total FROM sales GROUP BY 1,2,3""", "sales")
def voucher_xml(spark, sf):
    out = source.voucher_lines(_vouchers(spark, sf), "sales")
    return out.groupBy("voucher_date", "invoice_no", "gstr1_category").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(a).cast("double").alias(b) for a, b in (
            ("taxable_value", "taxable"), ("cgst_amount", "cgst"), ("igst_amount", "igst"), ("total_invoice_value", "total"))])


@query("""SELECT doc_no, doc_type, taxable::DOUBLE AS taxable, igst::DOUBLE AS igst, total::DOUBLE AS total, state_of_supply FROM cld""", "cld")
def client_register(spark, sf):
    """A client's wide sheet: long headers, commas in amounts, '-' for nothing."""
    from .tables import client_rows, sales_documents
    rows = client_rows(sales_documents(spark, sf))
    def typed(c):
        return F.when(F.col(c) == 0, "-").otherwise(F.format_string("%s", F.format_number(F.col(c), 2)))
    sheet = rows.select(
        F.col("doc_type").alias("Document Type Code"), F.concat(F.lit(" "), "doc_no").alias("Document  No."),
        F.col("party_gstin").alias("Recipient Billing GSTIN"), F.col("state_of_supply").alias("State of  Supply"),
        typed("taxable").alias("Net Basic Amt"), typed("igst").alias("IGST"), F.lit("7").alias("IGST3"),
        typed("total").alias("Invoice Value"))
    out = source.client_register(sheet)
    return out.select("doc_no", "doc_type", *d("taxable igst total"), "state_of_supply")
