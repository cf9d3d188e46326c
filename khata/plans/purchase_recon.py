"""Books against statement, from lines to follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import gstr2b, state


def reconcile_purchases(
    lines: DataFrame, statement: DataFrame, documents: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Annotated rows, statement-only records, summary and the Rule 36(4) cap.

    Only statement-only records are looked up in the documents.
    """
    result = gstr2b.Reconciliation(gstr2b.normalise_books(lines), statement)
    extra = result.extra
    extra = (state.verify_gaps(extra, documents) if documents is not None
             else extra.withColumn("in_drive", F.lit(None).cast("string")))
    rows = result.rows.withColumn("in_drive", F.lit(None).cast("string"))
    summary = result.summary
    return {
        "rows": state.annotate_rows(rows), "extra": state.annotate_rows(extra), "summary": summary,
        "rule_36_4": gstr2b.rule_36_4(summary)}


def follow_up(
    reconciled: dict[str, DataFrame], old_state: DataFrame, scope: DataFrame, policy: DataFrame,
    tenant: str, registration: str, now: Column,
) -> DataFrame:
    """Trigger state after merging this run's gaps and sending what is due."""
    gaps = state.gaps_of(reconciled["rows"].withColumn("seq", F.lit(0))).unionByName(
        state.gaps_of(reconciled["extra"].withColumn("seq", F.lit(0))))
    keyed = gaps.select("*", F.lit(tenant).alias("tenant_id"), F.lit(registration).alias("registration_gstin"))
    return state.run_due(state.merge_triggers(old_state, keyed, scope, now), policy, now)
