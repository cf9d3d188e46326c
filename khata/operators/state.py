"""Keyed follow-up state, reviews and corrections: each step maps old state to new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import first_nonzero, money, text, zero_if_null
from ..functions.dates import is_due

TRIGGER_KEY = ["tenant_id", "registration_gstin", "counterparty_gstin", "invoice_no", "bucket"]
TRIGGER_COLUMNS = [*TRIGGER_KEY, "period", "amount", "status", "last_triggered_at", "trigger_count", "resolved_at"]
CLOSED = ("resolved", "rejected")
# Labels written on reconciliation rows.
FOUND_LABEL = "Entry missing in Tally"
ASK_CLIENT = "Request invoice from client (pending accountant review)"
ACTIONS = {
    "mismatch": "Flag for accountant review",
    "missing_in_2b": "Auto-notify client: follow up with vendor (ITC at risk)",
}


def annotate_rows(rows: DataFrame) -> DataFrame:
    """Follow-up columns on reconciliation rows; ``in_drive`` is Yes, No or NULL (not looked up)."""
    gap = F.col("recon_status") == "not_in_books"
    chain = F.when(gap & (F.col("in_drive") == "No"), ASK_CLIENT)
    for status, label in ACTIONS.items():
        chain = chain.when(F.col("recon_status") == status, label)
    return rows.withColumns({
        "tally_entry_status": F.when(gap & (F.col("in_drive") == "Yes"), FOUND_LABEL),
        "client_action": chain,
    })


def gaps_of(rows: DataFrame) -> DataFrame:
    """Trigger candidates: statement records found nowhere, and books the statement lacks."""
    status = F.col("recon_status")
    open_gap = (status == "missing_in_2b") | ((status == "not_in_books") & (F.col("in_drive") == "No"))
    return rows.filter(open_gap & (text(F.col("gst_no")) != "") & (text(F.col("supplier_inv")) != "")).select(
        F.col("gst_no").alias("counterparty_gstin"), F.col("supplier_inv").alias("invoice_no"),
        F.col("recon_status").alias("bucket"),
        first_nonzero(F.col("total_amount"), F.col("2b_total_val"), F.col("amount")).alias("amount"), "seq")


def merge_triggers(state: DataFrame, gaps: DataFrame, scope: DataFrame, now: Column) -> DataFrame:
    """New state after one reconciliation run.

    ``scope`` has one row per (tenant_id, registration_gstin) of this run with its period and
    ``require_review``; ``gaps`` carry tenant and registration too. State outside the scope stays as
    it is. Merging the same gaps twice changes nothing.
    """
    latest = gaps.groupBy(*TRIGGER_KEY).agg(F.max_by("amount", "seq").alias("g_amount"))
    run = scope.select("tenant_id", "registration_gstin", F.col("period").alias("s_period"),
                       F.coalesce("require_review", F.lit(True)).alias("require_review"), F.lit(True).alias("in_run"))
    merged = (
        state.withColumn("known", F.lit(True))
        .join(latest.withColumn("open", F.lit(True)), TRIGGER_KEY, "full_outer")
        .join(run, ["tenant_id", "registration_gstin"], "left"))
    initial = F.when(
        F.col("bucket") == "not_in_books",
        F.when(F.coalesce("require_review", F.lit(True)), "pending_review").otherwise("approved"),
    ).otherwise("queued")
    known, opened = F.coalesce("known", F.lit(False)), F.coalesce("open", F.lit(False))
    reopened = known & opened & (F.col("status") == "resolved")
    vanished = known & ~opened & F.coalesce("in_run", F.lit(False)) & ~F.col("status").isin(*CLOSED)
    return merged.select(
        *TRIGGER_KEY,
        F.when(opened, F.coalesce("s_period", "period")).otherwise(F.col("period")).alias("period"),
        money(F.when(opened, F.col("g_amount")).otherwise(F.col("amount"))).alias("amount"),
        F.when(~known | reopened, initial).when(vanished, "resolved").otherwise(F.col("status")).alias("status"),
        "last_triggered_at", zero_if_null(F.col("trigger_count")).alias("trigger_count"),
        F.when(vanished, now).when(reopened, F.lit(None)).otherwise(F.col("resolved_at")).alias("resolved_at"))


def due_outcome(state: DataFrame, policy: DataFrame, now: Column) -> DataFrame:
    """State with ``outcome`` (sent / skipped / NULL when no candidate) and the skip reason."""
    rows = state.join(policy.select("tenant_id", "auto_vendor_followup"), "tenant_id", "left")
    candidate = F.col("status").isin("approved", "queued", "sent")
    reason = (
        F.when((F.col("bucket") == "missing_in_2b") & ~F.coalesce("auto_vendor_followup", F.lit(False)),
               "auto_vendor_followup disabled")
        .when((F.col("bucket") == "not_in_books") & ~F.col("status").isin("approved", "sent"),
              F.concat(F.lit("status="), "status", F.lit(", not approved")))
        .when(~is_due(F.col("last_triggered_at"), now), "not due (sent within last 30 days)"))
    return rows.withColumns({
        "reason": F.when(candidate, reason),
        "outcome": F.when(candidate, F.when(reason.isNull(), "sent").otherwise("skipped"))})


def run_due(state: DataFrame, policy: DataFrame, now: Column) -> DataFrame:
    """State after sending everything due: status, time and counter move on together."""
    sent = F.coalesce(F.col("outcome") == "sent", F.lit(False))
    rows = due_outcome(state, policy, now)
    return rows.select(
        *TRIGGER_KEY, "period", "amount", F.when(sent, "sent").otherwise(F.col("status")).alias("status"),
        F.when(sent, now).otherwise(F.col("last_triggered_at")).alias("last_triggered_at"),
        F.when(sent, F.col("trigger_count") + 1).otherwise(F.col("trigger_count")).alias("trigger_count"),
        "resolved_at")


def triggers_of(state: DataFrame, tenant: str, registration: str | None = None, status: str | None = None) -> DataFrame:
    """A tenant's triggers, of one registration and status if named."""
    rows = state.filter(F.col("tenant_id") == tenant)
    if registration is not None:
        rows = rows.filter(F.col("registration_gstin") == registration)
    return rows if status is None else rows.filter(F.col("status") == status)


def decide_triggers(state: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of approve / reject decisions: accepted, or the reason why not."""
    joined = decisions.join(state.select(*TRIGGER_KEY, "status"), TRIGGER_KEY, "left")
    reason = (
        F.when(F.col("status").isNull(), "no such trigger")
        .when((F.col("action") == "approve") & (F.col("bucket") != "not_in_books"), "needs no approval")
        .when(F.col("status") != "pending_review", F.concat(F.lit("not pending review: "), "status")))
    return joined.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def apply_decisions(state: DataFrame, decided: DataFrame) -> DataFrame:
    good = decided.filter("accepted").groupBy(*TRIGGER_KEY).agg(F.min("action").alias("action"))
    new = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected")
    return state.join(good, TRIGGER_KEY, "left").withColumn(
        "status", F.coalesce(new, F.col("status"))).select(*state.columns)


def latest_review(reviews: DataFrame, key: list[str]) -> DataFrame:
    rest = [c for c in reviews.columns if c not in key]
    return reviews.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct("created_at", "review_id")).alias("r")).select(*key, "r.*")


def append_reviews(reviews: DataFrame, new: DataFrame, key: list[str], skip_pending: bool = False) -> DataFrame:
    """Always new rows, never updates; optionally none where the latest is still pending."""
    if skip_pending:
        pending = latest_review(reviews, key).filter("status = 'PENDING_REVIEW'")
        new = new.join(pending.select(*key), key, "left_anti")
    return reviews.unionByName(new, allowMissingColumns=True)


def decide_reviews(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions with their validity: decided reviews are final, a rejection needs notes."""
    joined = decisions.join(reviews.select("review_id", F.col("status").alias("old_status")), "review_id", "left")
    reason = (
        F.when((F.col("action") == "reject") & (text(F.col("notes")) == ""), "a rejection needs notes")
        .when(F.col("old_status").isNull(), "no such review")
        .when(F.col("old_status") != "PENDING_REVIEW", F.concat(F.lit("already "), "old_status")))
    new = F.when(F.col("action") == "approve", "APPROVED").otherwise("REJECTED")
    return joined.withColumn("reason", reason).withColumn(
        "new_status", F.when(F.col("reason").isNull(), new).otherwise(F.col("old_status")))


def corrections(before: DataFrame, after: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Edits between two snapshots as (key, field, old, new)."""
    def long(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(
            key, fields, "field_name", name)

    both = long(before, "original_value").join(long(after, "corrected_value"), [*key, "field_name"])
    return both.filter(~F.col("original_value").eqNullSafe(F.col("corrected_value")))


def grams(c: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct substrings of the given sizes, in one pass over the text per size."""
    return F.array_distinct(F.concat(*[
        F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]))


ANCHORS = (1, 2, 3, 4, 8)
GSTIN_ANYWHERE = r"(?=(\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]))"


def anchor(number: Column) -> Column:
    """The end of a number, where serial digits differ most, in one of the anchor sizes."""
    n = F.length(number)
    size = F.when(n >= 8, 8).when(n >= 4, 4).otherwise(n)
    return F.substring(number, n - size + 1, size)


FEW = 64
"""Numbers wanted of a GSTIN in a month, up to which a document that names it is simply looked through for each."""


def verify_gaps(gaps: DataFrame, documents: DataFrame, few: int = FEW) -> DataFrame:
    """Gaps with ``in_drive``: Yes when a document of the month or the next holds GSTIN and number.

    ``gaps`` has gst_no, supplier_inv and invoice_date (DD-MM-YYYY); ``documents`` has doc_id, month
    (first day, DATE) and text. A number may sit anywhere in the whole text; to find it without
    comparing every gap with every document, both sides meet on the GSTINs that the text names. Of a GSTIN
    with up to ``few`` wanted numbers in a month all are candidates; of one with more, both sides meet on the last characters of
    the number too, so only texts that name such a GSTIN are cut into pieces. A GSTIN of an unusual shape meets on
    the month and the last characters of both. Only keys of documents are joined; each text is fetched once, to
    look for its candidates.
    """
    def clean(c: Column) -> Column:
        return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")

    month = F.trunc(F.try_to_timestamp(F.trim("invoice_date"), F.lit("d-M-yyyy")).cast("date"), "month")
    keyed = gaps.select(
        "*", clean(F.col("gst_no")).alias("_g"), clean(F.col("supplier_inv")).alias("_n"), month.alias("_m"))
    wanted = (
        keyed.filter((F.col("_g") != "") & (F.col("_n") != "") & F.col("_m").isNotNull())
        .select("_g", "_n", "_m", F.explode(F.array("_m", F.add_months("_m", 1).cast("date"))).alias("_doc_m"))
        .distinct().withColumn("_a", anchor(F.col("_n"))))
    shaped = F.col("_g").rlike(r"^\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]$")
    usual, odd = wanted.filter(shaped), wanted.filter(~shaped).withColumn("_ga", anchor(F.col("_g")))
    docs = documents.select("doc_id", F.trunc("month", "month").alias("_doc_m"), clean(F.col("text")).alias("_text"))
    doc = ["doc_id", "_doc_m"]
    # keys of documents only: the text stays behind until the candidates are known
    holders = docs.select(*doc, F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(GSTIN_ANYWHERE), F.lit(1)))).alias("_g"))
    holders = holders.join(usual.select("_g", "_doc_m"), ["_g", "_doc_m"], "left_semi").distinct()
    many = usual.groupBy("_g", "_doc_m").agg(F.count(F.lit(1)).alias("_wanted")).where(F.col("_wanted") > few).select("_g", "_doc_m")
    named = usual.join(many, ["_g", "_doc_m"], "left_anti")
    found_few = holders.join(named, ["_g", "_doc_m"]).select(*doc, "_g", "_n", "_m")
    crowded = holders.join(many, ["_g", "_doc_m"], "left_semi")
    near = docs.join(crowded, doc, "left_semi").select(*doc, F.explode(grams(F.col("_text"), ANCHORS)).alias("_a"))
    found_many = near.join(crowded, doc).join(usual, ["_g", "_doc_m", "_a"]).select(*doc, "_g", "_n", "_m")
    found_a = found_few.unionByName(found_many)
    month_docs = docs.join(odd.select("_doc_m"), "_doc_m", "left_semi").select(*doc, F.explode(grams(F.col("_text"), ANCHORS)).alias("_a"))
    # the longer one of the two ends is looked for first, the other one among what that leaves
    lead = F.length("_ga") > F.length("_a")
    asked = odd.select("_g", "_n", "_m", "_doc_m", F.when(lead, F.col("_ga")).otherwise(F.col("_a")).alias("_a"), F.when(lead, F.col("_a")).otherwise(F.col("_ga")).alias("_other"))
    found_b = month_docs.join(asked, ["_doc_m", "_a"]).drop("_a").withColumnRenamed("_other", "_a").join(
        month_docs, [*doc, "_a"], "left_semi").select(*doc, "_g", "_n", "_m")
    # a document's candidates are no more than its text has ends for, or few for each GSTIN it names
    candidates = found_a.unionByName(found_b).groupBy(*doc).agg(F.collect_set(F.struct("_g", "_n", "_m")).alias("_c"))
    kept = F.filter("_c", lambda c: F.col("_text").contains(c["_n"]) & F.col("_text").contains(c["_g"]))
    hits = docs.join(candidates, doc).select(F.explode(kept).alias("h")).select("h.*").distinct().withColumn("in_drive", F.lit("Yes"))
    return keyed.join(hits, ["_g", "_n", "_m"], "left").select(
        *gaps.columns, F.coalesce("in_drive", F.lit("No")).alias("in_drive"))
