"""Streams run over the given events until none are left, their sinks read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from khata.session import checkpoint_dir
from khata import schemas
from khata.streaming import events as ev, sinks, triggers
from .q_ops import as_log
from .registry import query
from .tables import read

DAY_ZERO = 1704067200000000  # 2024-01-01 in microseconds
STRETCH = 12  # the events of a month, spread over a year


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; by a pattern, as the path of a stream may not be a single file."""
    schema = read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input there is, from a file sink that a batch is written to once."""
    spark = stream.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema.add("epoch", "long")).option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def trigger_events(events: DataFrame) -> DataFrame:
    """Events as rows about triggers: who buys or looks opens a gap, who clicks closes it, who signs up approves, an error rejects."""
    micros = (F.unix_micros(F.col("ts").cast("timestamp")) - DAY_ZERO) * STRETCH + DAY_ZERO
    return events.select(
        F.lit("T1").alias("tenant_id"), F.lit("R1").alias("registration_gstin"), F.concat(F.lit("G"), "user_id").alias("counterparty_gstin"),
        (F.col("event_id") % 20).cast("string").alias("invoice_no"),
        F.when(F.col("user_id") % 2 == 0, "not_in_books").otherwise("missing_in_2b").alias("bucket"),
        F.timestamp_micros(micros).alias("at"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("purchase", "view"), "open").when(F.col("event_type") == "click", "gone")
        .when(F.col("event_type") == "signup", "approve").otherwise("reject").alias("event"),
        (F.col("user_id") % 3 != 0).alias("require_review"), (F.col("user_id") % 5 != 1).alias("auto_followup"))


@query(f"""WITH RECURSIVE rows AS (
  SELECT 'G'||user_id AS counterparty_gstin, (event_id%20)::VARCHAR AS invoice_no,
   CASE WHEN user_id%2=0 THEN 'not_in_books' ELSE 'missing_in_2b' END AS bucket,
   ((epoch_us(ts)-{DAY_ZERO})*{STRETCH}+{DAY_ZERO})//1000 AS t,
   CASE event_type WHEN 'click' THEN 'gone' WHEN 'signup' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'open' END AS e,
   CASE WHEN user_id%2=1 THEN 'queued' WHEN user_id%3<>0 THEN 'pending_review' ELSE 'approved' END AS s0, user_id%5<>1 AS auto,
   row_number() OVER (PARTITION BY user_id, event_id%20 ORDER BY ts, event_id) AS n FROM events
), steps AS (
  SELECT counterparty_gstin, invoice_no, bucket, 0::BIGINT AS n, NULL::VARCHAR AS s, NULL::BIGINT AS l, 0::BIGINT AS c,
   0 AS created, 0 AS reopened, 0 AS decided, 0 AS resolved, false AS auto FROM rows WHERE n=1
  UNION ALL
  SELECT counterparty_gstin, invoice_no, bucket, n, CASE WHEN send THEN 'sent' ELSE s2 END, CASE WHEN send THEN t ELSE l1 END,
   c1+send::INT, created+(e='open' AND s1 IS NULL)::INT, reopened+coalesce(e='open' AND s1='resolved', false)::INT,
   decided+coalesce(s2 IN ('approved','rejected') AND s1='pending_review', false)::INT, resolved+coalesce(e='gone' AND s2='resolved' AND s1<>'resolved', false)::INT, auto
  FROM (SELECT *, coalesce((bucket='not_in_books' AND s2 IN ('approved','sent') OR bucket<>'not_in_books' AND s2 IN ('queued','sent') AND auto)
     AND (l1 IS NULL OR t-l1>=2592000000), false) AS send
   FROM (SELECT *, CASE WHEN e='open' THEN CASE WHEN s1 IS NULL OR s1='resolved' THEN s0 ELSE s1 END
      WHEN e='gone' AND s1 NOT IN ('resolved','rejected') THEN 'resolved'
      WHEN e='approve' AND s1='pending_review' THEN 'approved' WHEN e='reject' AND s1='pending_review' THEN 'rejected' ELSE s1 END AS s2
    FROM (SELECT r.*, created, reopened, decided, resolved, CASE WHEN k>0 THEN 'sent' ELSE s END AS s1, l+k*2592000000 AS l1, c+k AS c1
     FROM (SELECT p.*, r.t, r.e, r.s0, r.auto AS rauto, r.n AS rn, CASE WHEN p.l IS NOT NULL AND (p.bucket='not_in_books' AND p.s IN ('approved','sent')
        OR p.bucket<>'not_in_books' AND p.s IN ('queued','sent') AND p.auto) THEN greatest(0,(r.t-p.l)//2592000000) ELSE 0 END AS k
      FROM steps p JOIN rows r ON r.counterparty_gstin=p.counterparty_gstin AND r.invoice_no=p.invoice_no AND r.n=p.n+1) q
     JOIN rows r ON r.counterparty_gstin=q.counterparty_gstin AND r.invoice_no=q.invoice_no AND r.n=q.rn)))
), last AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY counterparty_gstin, invoice_no) AS m FROM steps) WHERE n=m AND s IS NOT NULL),
 done AS (SELECT *, CASE WHEN l IS NOT NULL AND (bucket='not_in_books' AND s IN ('approved','sent') OR bucket<>'not_in_books' AND s IN ('queued','sent') AND auto)
   THEN greatest(0, ((SELECT max(t) FROM rows)-3600000-l)//2592000000) ELSE 0 END AS k FROM last)
SELECT counterparty_gstin, invoice_no, bucket, CASE WHEN k>0 THEN 'sent' ELSE s END AS status, c+k AS trigger_count, l+k*2592000000 AS last_ms,
 created, reopened, decided, resolved FROM done""")
def trigger_timers(spark, sf):
    """The last state of every trigger and what happened to it, from the stream's actions."""
    triggers.use_timers(spark)
    actions = drained(triggers.trigger_actions(trigger_events(stream_of(spark, sf, "events"))))
    is_sent = F.col("action") == "sent"

    def n(*names):
        return F.count(F.when(F.col("action").isin(*names), 1))

    order = F.struct("epoch", "at", "step")
    return actions.groupBy("counterparty_gstin", "invoice_no", "bucket").agg(
        F.max_by("status", order).alias("status"), F.max("trigger_count").alias("trigger_count"),
        F.max(F.when(is_sent, F.unix_millis("at"))).alias("last_ms"), n("created").alias("created"), n("reopened").alias("reopened"),
        n("approved", "rejected").alias("decided"), n("resolved").alias("resolved"))


def newest(rows: DataFrame, *key: str) -> DataFrame:
    """Of the updates of a stream the last one of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*key, "r.*")


def log_stream(spark: SparkSession, sf: str) -> DataFrame:
    return as_log(stream_of(spark, sf, "events"))


@query(name="event_windows_stream")
def event_windows_stream(spark, sf):
    """The counts of event_windows from a stream with a watermark, as last updated."""
    out = newest(drained(ev.event_counts(log_stream(spark, sf)), "update"), "window_start", "event_type", "severity", "flag_id")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "severity", "flag_id", "n")


@query(name="notification_stream")
def notification_stream(spark, sf):
    """The sliding day of notification_windows from a stream."""
    out = newest(drained(ev.notification_rate(log_stream(spark, sf)), "update"), "window_start", "tenant_id")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "tenant_id", "n")


@query("""SELECT 'B'||strftime(o_orderdate,'%Y%m') AS batch_id, count(*) AS seen, count(*) FILTER (o_orderkey%13<>0) AS ok,
  count(*) FILTER (o_orderkey%13=0) AS failed, sum(o_orderkey*37%5000)::BIGINT AS total_ms FROM orders GROUP BY 1""")
def progress_stream(spark, sf):
    """Orders arriving as processed files; the running counters of their batches."""
    key = F.col("o_orderkey")
    files = stream_of(spark, sf, "orders").select(
        F.concat(F.lit("B"), F.date_format("o_orderdate", "yyyyMM")).alias("batch_id"), F.when(key % 13 == 0, "failed").otherwise("ok").alias("status"),
        (key * 37 % 5000).alias("total_ms"), F.lit(0).cast("decimal(18,2)").alias("cost_inr"))
    return newest(drained(ev.batch_progress(files), "update"), "batch_id").drop("cost_inr", "epoch")


@query("""SELECT DISTINCT user_id::VARCHAR AS invoice_no, upper(event_type) AS party_gstin, strftime(ts,'%Y-%m-%d') AS voucher_date FROM events""")
def first_sightings_stream(spark, sf):
    """Each document's first arrival; a user's event of a kind and day is a document, seen again with every other such event."""
    seen = stream_of(spark, sf, "events").select(
        F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("invoice_no"), F.col("event_type").alias("party_gstin"),
        F.date_format("ts", "yyyy-MM-dd").alias("voucher_date"), F.col("ts").alias("timestamp_utc"))
    return drained(ev.first_sightings(seen)).select("invoice_no", "party_gstin", "voucher_date")


@query("""SELECT page_id::VARCHAR AS file_id, md5(coalesce(html,'')) AS md5, CASE WHEN page_id%7=0 THEN 'failed' ELSE 'completed' END AS status FROM pages WHERE page_id%11<>0
 UNION ALL SELECT page_id::VARCHAR, md5(coalesce(html,'')), 'failed' FROM pages WHERE page_id%11=0""")
def file_tracker_stream(spark, sf):
    """Pages polled as files: the tracker that the sink leaves. Some fail, of some nothing is heard."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tracker-{uuid.uuid4().hex}"
    number = F.col("file_id").cast("long")

    def handle(todo: DataFrame) -> DataFrame:
        return todo.where(number % 11 != 0).select("file_id", F.when(number % 7 == 0, "failed").otherwise("completed").alias("status"))

    files = stream_of(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("file_id"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("md5"), F.col("page_id").alias("seq"))
    run = files.writeStream.foreachBatch(sinks.file_sink(f"{path}/state", handle)).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return sinks.read_version(spark, f"{path}/state", sinks.newest_version(spark, f"{path}/state"), sinks.TRACKER_SCHEMA)


@query("""WITH g AS (SELECT 'R'||(user_id%3)::VARCHAR AS registration_gstin, 'G'||user_id::VARCHAR AS counterparty_gstin, (event_id%50)::VARCHAR AS invoice_no,
   CASE WHEN user_id%2=0 THEN 'not_in_books' ELSE 'missing_in_2b' END AS bucket, round(value,2)::DECIMAL(18,2) AS amount, event_id, (event_id//7)%3 AS run FROM events),
 r AS (SELECT registration_gstin, counterparty_gstin, invoice_no, bucket, run, arg_max(amount, event_id) AS amount FROM g WHERE NOT (run=2 AND registration_gstin='R1') GROUP BY ALL),
 k AS (SELECT registration_gstin, counterparty_gstin, invoice_no, bucket, max(run) AS last, arg_max(amount, run) AS amount FROM r GROUP BY ALL)
 SELECT registration_gstin, counterparty_gstin, invoice_no, bucket, amount::DOUBLE AS amount, '2024-0'||(last+1)::VARCHAR AS period,
  CASE WHEN last < CASE WHEN registration_gstin='R1' THEN 1 ELSE 2 END THEN 'resolved' WHEN bucket='not_in_books' THEN 'pending_review' ELSE 'queued' END AS status FROM k""")
def gap_trigger_runs(spark, sf):
    """Three reconciliation runs through the sink, one registration absent from the last; the second is delivered twice, as after a failure."""
    user, event = F.col("user_id"), F.col("event_id")
    gaps = read(spark, sf, "events").select(
        F.lit("T").alias("tenant_id"), F.concat(F.lit("R"), (user % 3).cast("string")).alias("registration_gstin"), F.concat(F.lit("G"), user.cast("string")).alias("counterparty_gstin"),
        (event % 50).cast("string").alias("invoice_no"), F.when(user % 2 == 0, "not_in_books").otherwise("missing_in_2b").alias("bucket"),
        F.round("value", 2).cast("decimal(18,2)").alias("amount"), event.alias("seq"), (F.floor(event / 7) % 3).alias("run"))
    gaps = gaps.where("NOT (run = 2 AND registration_gstin = 'R1')")
    path = f"{checkpoint_dir(spark).rstrip('/')}/triggers-{uuid.uuid4().hex}"
    for epoch in (0, 1, 1, 2):
        scope = gaps.select("tenant_id", "registration_gstin").distinct().withColumns({"period": F.lit(f"2024-0{epoch + 1}"), "require_review": F.lit(True)})
        sinks.trigger_sink(path, scope, F.lit(f"2024-0{epoch + 1}-28").cast("timestamp_ntz"))(gaps.where(F.col("run") == epoch).drop("run"), epoch)
    state = sinks.read_version(spark, path, sinks.newest_version(spark, path), schemas.GAP_TRIGGERS)
    return state.select("registration_gstin", "counterparty_gstin", "invoice_no", "bucket", F.col("amount").cast("double").alias("amount"), "period", "status")


# the same rows, whether the log is a table or a stream
def share_checks(oracles: dict[str, str]) -> None:
    oracles["event_windows_stream"] = oracles["event_windows"]
    oracles["notification_stream"] = oracles["notification_windows"]
