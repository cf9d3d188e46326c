"""State changes compared row by row: due runs, review versions, corrections, delivery attempts, ledger masters, layouts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from khata.functions.common import money
from khata.operators import golden, layouts, ledger, state
from khata.session import checkpoint_dir
from khata.sources import tables as source

from .q_ops import _NOW, _TRIG, _merged, _reviews
from .registry import query
from .tables import gstin, read, sales_lines, state_of
from .tables_sql import _STATE, _gstin


@query(f"""WITH {_TRIG} SELECT g AS counterparty_gstin, no AS invoice_no, bucket, CASE WHEN status IN ('queued','sent') THEN 'sent' ELSE status END AS status,
  (cnt + CASE WHEN status IN ('queued','sent') THEN 1 ELSE 0 END)::BIGINT AS trigger_count,
  CASE WHEN status IN ('queued','sent') THEN '{_NOW[:10]}' WHEN old THEN '2023-12-20' END AS last_day FROM mg""", "rows2b extra2b books")
def due_run(spark, sf):
    """The state after everything due was sent."""
    policy = spark.range(1).select(F.lit("T1").alias("tenant_id"), F.lit(True).alias("auto_vendor_followup"))
    out = state.run_due(_merged(spark, sf), policy, F.lit(_NOW).cast("timestamp_ntz"))
    return out.select("counterparty_gstin", "invoice_no", "bucket", "status", "trigger_count", F.date_format("last_triggered_at", "yyyy-MM-dd").alias("last_day"))


@query("""WITH r AS (SELECT c_mktsegment AS tenant, strftime(o_orderdate,'%Y-%m') AS period, o_orderkey, o_orderdate, o_orderstatus FROM orders JOIN customer ON o_custkey=c_custkey),
 k AS (SELECT tenant, period, count(*) AS n, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM r GROUP BY 1,2)
 SELECT tenant, period, n + CASE WHEN st='P' THEN 0 ELSE 1 END AS n_versions, 'PENDING_REVIEW' AS status, CASE WHEN st='P' THEN id ELSE -id END AS review_id FROM k""")
def review_versions(spark, sf):
    """A new review is asked for every period; none is added where the latest still waits."""
    key = ["tenant", "period"]
    old = _reviews(spark, sf).withColumn("status", F.when(F.col("status") == "P", "PENDING_REVIEW").when(F.col("status") == "F", "APPROVED").otherwise("REJECTED"))
    asked = state.latest_review(old, key).select(
        *key, (-F.col("review_id")).alias("review_id"), F.lit("PENDING_REVIEW").alias("status"), (F.col("created_at") + F.make_dt_interval(F.lit(1))).alias("created_at"))
    after = state.append_reviews(old, asked, key, skip_pending=True)
    latest = state.latest_review(after, key).select(*key, "status", "review_id")
    return after.groupBy(*key).agg(F.count(F.lit(1)).alias("n_versions")).join(latest, key)


@query("""SELECT okey::VARCHAR AS case_id, seq_text, field_name, extracted, expected, confidence FROM (
  SELECT okey, okey::VARCHAR||'/'||line::VARCHAR||'/'||gross::VARCHAR||'/'||particulars AS seq_text, 'hsn' AS field_name, hsn AS extracted, '9971' AS expected, 0.5::DOUBLE AS confidence
   FROM sales WHERE okey%10=0 AND hsn IS DISTINCT FROM '9971'
  UNION ALL SELECT okey, okey::VARCHAR||'/'||line::VARCHAR||'/'||gross::VARCHAR||'/'||particulars, 'taxable_value', taxable_value::VARCHAR, CAST(taxable_value+1 AS DECIMAL(18,2))::VARCHAR, 0.5
   FROM sales WHERE okey%4=0)""", "sales")
def golden_from_corrections(spark, sf):
    """Every correction between two snapshots of the lines, as a golden data point."""
    okey = F.col("okey")
    lines = sales_lines(spark, sf).withColumn("seq_text", F.concat_ws("/", okey.cast("string"), F.col("line").cast("string"), F.col("gross").cast("string"), "particulars"))
    before = lines.select("task_id", "seq", "seq_text", "hsn", "taxable_value", "invoice_no")
    after = lines.select(
        "task_id", "seq", "seq_text", F.when(okey % 10 == 0, "9971").otherwise(F.col("hsn")).alias("hsn"),
        money(F.when(okey % 4 == 0, F.col("taxable_value") + 1).otherwise(F.col("taxable_value"))).alias("taxable_value"), "invoice_no")
    edits = state.corrections(before, after, ["task_id", "seq", "seq_text"], ["hsn", "taxable_value", "invoice_no"])
    noted = edits.select("seq_text", "task_id", "field_name", "original_value", "corrected_value", F.lit(0.5).alias("confidence_before"))
    points = golden.annotations_to_fields(noted.withColumn("task_id", F.struct("task_id", "seq_text")))
    return points.select("case_id.task_id", "case_id.seq_text", "field_name", "extracted", "expected", "confidence").withColumnRenamed("task_id", "case_id")


@query("""WITH d AS (SELECT DISTINCT invoice_no, okey FROM sales WHERE okey%3=0)
 SELECT invoice_no AS item_id, 1::BIGINT AS batch_no, CASE WHEN okey%4=0 THEN 'failed' ELSE 'success' END AS status FROM d
 UNION ALL SELECT invoice_no, 2, CASE WHEN okey%8=0 THEN 'failed' ELSE 'success' END FROM d WHERE okey%4=0
 UNION ALL SELECT invoice_no, 3, 'success' FROM d WHERE okey%8=0""", "sales")
def push_attempts(spark, sf):
    """The log of three deliveries: what failed is tried again, what succeeded never is."""
    okey = F.col("okey")
    items = sales_lines(spark, sf, part=False).select(
        F.lit("sales").alias("item_type"), F.col("invoice_no").alias("item_id"), F.lit("C1").alias("company"),
        F.when(okey % 3 == 0, "ERP_READY").otherwise("BLOCKED").alias("recon_status"), "okey").distinct()
    log = spark.createDataFrame([], "item_type string, item_id string, company string, status string, batch_no long")
    for batch, fails in enumerate((okey % 4 == 0, okey % 8 == 0, F.lit(False)), 1):
        tried = ledger.to_push(items, log).withColumns({"status": F.when(fails, "failed").otherwise("success"), "batch_no": F.lit(batch).cast("long")})
        log = ledger.append_log(log, tried)
    return log.select("item_id", "batch_no", "status")


@query(f"""SELECT CASE WHEN c_custkey%2=0 THEN c_name ELSE 'Led & Co '||c_name END AS name, CASE WHEN c_custkey%4<>3 THEN c_mktsegment ELSE '' END AS parent,
  {_gstin(_STATE.format('c_nationkey'), 'c_custkey')} AS gstin, CASE WHEN c_custkey%3=0 THEN 'Road '||c_custkey::VARCHAR END AS address, {_STATE.format('c_nationkey')} AS state,
  CASE WHEN c_custkey%5=0 THEN 0 ELSE c_acctbal END AS opening_balance FROM customer""")
def ledger_master(spark, sf):
    """Customers written as ledger elements, names as attributes or elements, and read back."""
    key = F.col("c_custkey")
    name = F.when(key % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("Led & Co "), "c_name"))
    code = state_of(F.col("c_nationkey"))
    balance = F.when(key % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledgers-{uuid.uuid4().hex}"
    read(spark, sf, "customer").select(
        F.when(key % 3 != 0, name).alias("_NAME"), F.when(key % 3 == 0, name).alias("NAME"), F.when(key % 4 != 3, F.col("c_mktsegment")).alias("PARENT"),
        gstin(code, key).alias("LEDGERGSTREGISTRATIONNUMBER"), F.when(key % 3 == 0, F.concat(F.lit("Road "), key.cast("string"))).alias("ADDRESS"),
        code.alias("LEDGERSTATENAME"), balance.alias("OPENINGBALANCE"),
    ).write.format("xml").option("rootTag", "ENVELOPE").option("rowTag", "LEDGER").save(path)
    return source.read_ledgers(spark, path).withColumn("opening_balance", F.col("opening_balance").cast("double"))


_PART_KEY = "concat_ws('|', least(lower(p_name),lower(p_type)), greatest(lower(p_name),lower(p_type)))||'::'||concat_ws('|', printf('%.2f', p_size::DOUBLE))"


@query(f"""WITH p AS (SELECT *, {_PART_KEY} AS k FROM part), m AS (SELECT k, arg_max(p_brand, p_partkey) AS vendor, arg_max(p_partkey, p_partkey) AS last FROM p WHERE p_partkey%3<>0 GROUP BY 1)
 SELECT p.p_partkey, m.vendor, 'path-'||m.last::VARCHAR AS accepted_path, m.last IS NOT NULL AS known FROM p LEFT JOIN m USING (k)""")
def layout_lookup(spark, sf):
    """Two of three parts are remembered as layouts; all are looked up, their headers in another order and case."""
    part, key = read(spark, sf, "part"), F.col("p_partkey")
    size = F.array(F.col("p_size").cast("double"))
    stored = part.filter(key % 3 != 0).select(
        F.col("p_brand").alias("vendor"), F.array("p_name", "p_type").alias("headers"), size.alias("coordinates"),
        F.create_map(F.lit("0"), F.col("p_type")).alias("semantic_mapping"), F.concat(F.lit("path-"), key.cast("string")).alias("accepted_path"), key.alias("seq"))
    probes = part.select("p_partkey", F.array(F.upper("p_type"), F.concat(F.lit(" "), "p_name")).alias("headers"), size.alias("coordinates"))
    return layouts.look_up(probes, layouts.remember(stored)).select("p_partkey", "vendor", "accepted_path", "known")
