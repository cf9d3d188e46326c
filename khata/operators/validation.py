"""Rule engine over invoice rows, and the line-level checks.

A rule is a column expression: the engine lays all rules of an invoice out as rows, passes
failures on to the rules that depend on them, and scores the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import flags_array, money, text, zero_if_null
from ..functions.dates import parse_date
from ..functions.ids import (
    GSTIN_BATCH, GSTIN_STATUTORY, GSTIN_STRICT, INVOICE_NO_STATUTORY, IRN_64_HEX, known_place_of_supply,
)
from ..functions.tax import (
    B2CL_THRESHOLD, TOL_BALANCE_FLAG, TOL_BROWSER, TOL_LINE_CHECK, TOL_MATH_RULE, dec,
)

# Points lost per failed rule, and the score below which a person must look.
POINTS = {"BLOCKER": 15.0, "ERROR": 8.0, "WARNING": 3.0, "INFO": 0.5}
REVIEW_BELOW = 92.0


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    passed: Column
    depends_on: Sequence[str] = field(default=())
    status: Column | None = None  # overrides PASS / FAIL


def _gstin_ok(name: str) -> Column:
    return F.upper(text(F.col(name))).rlike(GSTIN_STRICT)


def _flexible_date(c: Column) -> Column:
    """Dates with any separators; NULL when nothing fits."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(c, "[^a-zA-Z0-9]", " ")), " ", "-")
    short = F.when(
        clean.rlike(r"^\d{1,2}-\d{1,2}-\d{2}$"), F.try_to_timestamp(clean, F.lit("d-M-yy")).cast("date"))
    return F.coalesce(parse_date(clean), short)


def registry_status(status: Column, changed: Column, invoice_date: Column) -> Column:
    """active / inactive / needs_review on the day of the invoice, not today."""
    return (
        F.when(F.lower(text(status)) == "active", "active")
        .when(changed.isNull() | invoice_date.isNull(), "needs_review")
        .when(changed > invoice_date, "active").otherwise("inactive")
    )


def with_registry(invoices: DataFrame, registry: DataFrame, party: str | None = None) -> DataFrame:
    """Attach registry facts by GSTIN; invoices whose buyer is not listed keep NULLs.

    An invoice stays one row: of several entries of a GSTIN the latest change counts, one without a change before all.
    ``party`` names a column of both frames that tells apart parties listed under the same GSTIN.
    """
    same = [] if party is None else [F.col(party).alias("_p")]
    facts = registry.select(F.upper(F.trim("gstin")).alias("_g"), *same, F.struct(
        F.col("status_change_date").isNull().alias("unchanged"), "status_change_date", "status", "state_code").alias("entry"))
    facts = facts.groupBy(*[c for c in facts.columns if c != "entry"]).agg(F.max("entry").alias("e")).select(
        "_g", *(["_p"] if same else []), F.col("e.status").alias("reg_status"),
        F.col("e.status_change_date").alias("reg_changed"), F.col("e.state_code").alias("reg_state"))
    key = F.when(_gstin_ok("buyer_gstin"), F.upper(text(F.col("buyer_gstin")))) == F.col("_g")
    return invoices.join(facts, key & (F.col(party) == F.col("_p")) if same else key, "left").drop("_g", "_p")


def standard_rules(as_of: Column) -> list[Rule]:
    """All packs in their order. ``as_of`` is the day that counts as today."""
    inv, due = _flexible_date(F.col("invoice_date")), _flexible_date(F.col("due_date"))
    total = zero_if_null(F.col("grand_total"))
    parts = ("taxable_value", "cgst_amount", "sgst_amount", "igst_amount", "cess_amount", "round_off")
    built = sum((zero_if_null(F.col(c)) for c in parts[1:]), zero_if_null(F.col(parts[0])))
    category = F.upper(text(F.col("gstr1_category")))
    buyer = text(F.col("buyer_gstin"))
    s_state, s_gstin = text(F.col("supplier_state")), text(F.col("supplier_gstin"))
    as_of_status = registry_status(F.col("reg_status"), F.col("reg_changed"), parse_date(F.col("invoice_date")))
    known = F.col("reg_status").isNotNull()
    real, declared = text(F.col("reg_state")), text(F.col("buyer_state"))
    state_ok = (real == "") | (declared == "") | (real == declared)
    registered = ~known | ((as_of_status == "active") & state_ok)
    registry_label = (
        F.when(~known, "SKIPPED").when((as_of_status == "active") & state_ok, "PASS")
        .when(as_of_status == "needs_review", "NEEDS_REVIEW").otherwise("FAIL")
    )
    return [
        Rule("INV_001", "Invoice", "BLOCKER", text(F.col("invoice_no")) != ""),
        Rule("INV_002", "Invoice", "BLOCKER", text(F.col("invoice_date")) != ""),
        Rule("INV_003", "Invoice", "ERROR", inv.isNull() | (inv <= as_of)),
        Rule("INV_004", "Invoice", "ERROR", inv.isNull() | due.isNull() | (due >= inv)),
        Rule("GST_001", "GST", "BLOCKER", _gstin_ok("supplier_gstin")),
        Rule("GST_002", "GST", "ERROR", _gstin_ok("buyer_gstin"), ("GST_001",)),
        Rule("GST_003", "GST", "ERROR",
             (F.length(s_gstin) < 2) | (s_state == "") | (F.substring(s_gstin, 1, 2) == s_state)),
        Rule("GST_004", "GST", "ERROR", known_place_of_supply(F.col("place_of_supply"))),
        Rule("GST_005", "GST", "WARNING", registered, status=registry_label),
        Rule("MATH_001", "Math", "BLOCKER", F.abs(built - total) <= dec(TOL_MATH_RULE)),
        Rule("MATH_002", "Math", "BLOCKER", total > 0),
        Rule("GST_008", "Tax", "ERROR", F.coalesce(F.col("rates_ok"), F.lit(True))),
        Rule("CLASS_001", "Classification", "ERROR", (category != "B2B") | (F.length(buyer) >= 15)),
        Rule("CLASS_002", "Classification", "ERROR", (category != "B2CS") | (F.length(buyer) < 15)),
        Rule("CLASS_003", "Classification", "ERROR", (category != "B2CL") | (total > B2CL_THRESHOLD)),
        Rule("MAND_001", "Mandatory", "BLOCKER",
             (text(F.col("supplier_name")) != "") & (text(F.col("buyer_name")) != "")),
        Rule("MAND_002", "Mandatory", "BLOCKER", zero_if_null(F.col("taxable_value")) != 0),
    ]


def line_rates_ok(lines: DataFrame, key: str) -> DataFrame:
    """Per invoice whether every line's effective rate is within half a point of a slab.

    The rate is rounded to one decimal first, so 'within 0.5' means below 0.55 either way; compared
    crosswise to avoid division.
    """
    taxable = zero_if_null(F.col("taxable_value"))
    tax = sum((zero_if_null(F.col(c)) for c in ("sgst_amount", "igst_amount")), zero_if_null(F.col("cgst_amount")))
    near = F.lit(False)
    for slab in (0, 5, 12, 18, 28):
        near = near | (F.abs(tax * 100 - taxable * slab) < taxable * dec("0.55"))
    return lines.groupBy(key).agg(F.bool_and((taxable <= 0) | near).alias("rates_ok"))


def _effective(rules: Sequence[Rule]) -> dict[str, Column]:
    """Outcome of each rule after failed dependencies are passed on."""
    by_id = {r.rule_id: r for r in rules}
    done: dict[str, Column] = {}

    def outcome(rule_id: str) -> Column:
        if rule_id not in done:
            rule = by_id[rule_id]
            passed = F.coalesce(rule.passed, F.lit(False))
            for dep in rule.depends_on:
                passed = passed & outcome(dep)
            done[rule_id] = passed
        return done[rule_id]

    for rule in rules:
        outcome(rule.rule_id)
    return done


def rule_results(invoices: DataFrame, rules: Sequence[Rule], key: str = "task_id") -> DataFrame:
    """Long form: one row per invoice and rule."""
    effective = _effective(rules)
    structs = []
    for rule in rules:
        passed = effective[rule.rule_id]
        blocked = F.lit(False)
        for dep in rule.depends_on:
            blocked = blocked | ~effective[dep]
        label = rule.status if rule.status is not None else F.when(passed, "PASS").otherwise("FAIL")
        structs.append(F.struct(
            F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.category).alias("category"),
            F.lit(rule.severity).alias("severity"), passed.alias("passed"),
            F.when(blocked, "FAIL").otherwise(label).alias("status"), blocked.alias("skipped_by_dependency")))
    return invoices.select(key, F.inline(F.array(*structs)))


def scores(invoices: DataFrame, rules: Sequence[Rule], key: str = "task_id") -> DataFrame:
    """Score, overall and sub-statuses per invoice, worked out in the row itself without a shuffle."""
    effective = _effective(rules)
    marked = invoices.select(
        key, *[effective[r.rule_id].alias(f"_{r.rule_id}") for r in rules],
        *[F.lit(True).alias("_none")])
    failed = {r.rule_id: ~F.col(f"_{r.rule_id}") for r in rules}

    def ran(rule: Rule) -> Column:
        ok = F.lit(True)
        for dep in rule.depends_on:
            ok = ok & F.col(f"_{dep}")
        return ok

    def any_of(rows: Sequence[Column]) -> Column:
        out = F.lit(False)
        for c in rows:
            out = out | c
        return out

    lost = sum((F.when(failed[r.rule_id], POINTS[r.severity]).otherwise(0.0) for r in rules), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - lost))
    hard = ("BLOCKER", "ERROR")
    math_failed = any_of([failed[r.rule_id] & ran(r) for r in rules if r.category == "Math" and r.severity in hard])
    math_warn = any_of([failed[r.rule_id] & ran(r) for r in rules if r.category == "Math" and r.severity not in hard])
    gst_failed = any_of([failed[r.rule_id] & ran(r) for r in rules if r.category == "GST"])
    names = flags_array(*[(failed[r.rule_id], F.lit(r.rule_id)) for r in rules])
    return marked.select(
        key, score.alias("score"),
        F.when(any_of([failed[r.rule_id] for r in rules if r.severity == "BLOCKER"]), "BLOCKED")
        .when((score < REVIEW_BELOW) | any_of([failed[r.rule_id] for r in rules if r.severity == "ERROR"]),
              "NEEDS_REVIEW").otherwise("ERP_READY").alias("overall_status"),
        F.when(math_failed, "FAILED").when(math_warn, "WARNING").otherwise("PASSED").alias("math_status"),
        F.when(gst_failed, "FAILED").otherwise("PASSED").alias("gst_status"),
        names.alias("failed_rules"))


def line_errors(lines: DataFrame) -> DataFrame:
    """Lines with an array of error texts: missing number or date, totals out of balance."""
    parts = ("taxable_value", "sgst_amount", "cgst_amount", "igst_amount")
    built = sum((zero_if_null(F.col(c)) for c in parts[1:]), zero_if_null(F.col(parts[0])))
    total = zero_if_null(F.col("total_invoice_value"))
    message = F.concat(
        F.lit("Math mismatch: base + taxes ("), money(built).cast("string"), F.lit(") != total ("),
        money(total).cast("string"), F.lit(")"))
    missing_no = F.coalesce(F.col("invoice_no"), F.lit("")) == ""
    missing_date = F.coalesce(F.col("voucher_date"), F.lit("")) == ""
    return lines.withColumn("errors", flags_array(
        (missing_no, F.lit("Missing invoice number")), (missing_date, F.lit("Missing voucher date")),
        (F.abs(built - total) > TOL_LINE_CHECK, message)))


def entry_issues(lines: DataFrame) -> DataFrame:
    """Issues of the entry form as rows of (field, issue, severity); clean lines yield none."""
    number, gstin = text(F.col("invoice_no")), text(F.col("party_gstin"))
    irn = text(F.col("irn")) if "irn" in lines.columns else F.lit("")
    parts = ("taxable_value", "sgst_amount", "cgst_amount", "igst_amount")
    taxable, sgst, cgst, igst = (zero_if_null(F.col(c)) for c in parts)
    gap = F.abs(taxable + sgst + cgst + igst - zero_if_null(F.col("total_invoice_value")))

    def issue(field_name: str, what: str, severity: str = "error") -> Column:
        return F.struct(F.lit(field_name).alias("field"), F.lit(what).alias("issue"),
                        F.lit(severity).alias("severity"))

    found = flags_array(
        (number == "", issue("supplier_inv", "missing")),
        ((number != "") & ~F.regexp_replace(number, r"\s", "").rlike(INVOICE_NO_STATUTORY),
         issue("supplier_inv", "format")),
        (text(F.col("voucher_date")) == "", issue("invoice_date", "missing")),
        (gstin == "", issue("gst_no", "missing")),
        ((gstin != "") & (F.length(gstin) != 15), issue("gst_no", "length")),
        ((F.length(gstin) == 15) & ~F.upper(gstin).rlike(GSTIN_STATUTORY), issue("gst_no", "format")),
        ((irn != "") & ~irn.rlike(IRN_64_HEX), issue("irn", "format")),
        (gap > TOL_BROWSER, issue("total_amount", "math")),
        ((igst > 0) & ((sgst > 0) | (cgst > 0)), issue("igst", "exclusive", "warning")),
        (text(F.col("place_of_supply")) == "", issue("place_of_supply", "missing", "warning")),
    )
    return lines.withColumn("_i", F.explode(found)).select(*lines.columns, "_i.*")


def document_verdict(lines: DataFrame, summary: DataFrame, key: str = "task_id") -> DataFrame:
    """PASSED when totals balance, the first line's GSTIN is well formed and no line mixes taxes."""
    igst, cgst, sgst = (zero_if_null(F.col(c)) for c in ("igst_amount", "cgst_amount", "sgst_amount"))
    facts = lines.groupBy(key).agg(
        F.bool_or((igst > 0) & ((cgst > 0) | (sgst > 0))).alias("tax_conflict"),
        F.min_by(F.coalesce("party_gstin", F.lit("")), "seq").alias("first_gstin"))
    parts = ("taxable_value", "cgst_amount", "sgst_amount", "igst_amount")
    built = sum((zero_if_null(F.col(c)) for c in parts[1:]), zero_if_null(F.col(parts[0])))
    checks = summary.join(facts, key, "left").select(
        key, (F.abs(built - zero_if_null(F.col("grand_total"))) <= TOL_BALANCE_FLAG).alias("math_balanced"),
        F.coalesce(F.col("first_gstin").rlike(GSTIN_BATCH), F.lit(False)).alias("gstin_format_valid"),
        (~F.coalesce("tax_conflict", F.lit(False))).alias("no_tax_conflict"))
    ok = F.col("math_balanced") & F.col("gstin_format_valid") & F.col("no_tax_conflict")
    return checks.withColumn("validation_status", F.when(ok, "PASSED").otherwise("FAILED"))
