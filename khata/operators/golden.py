"""Grading of extracted fields against golden cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.common import zero_if_null
from ..functions.score import values_match
from ..functions.tax import TOL_BACKTEST, TOL_GOLDEN

CASE_SCHEMA = (
    "case_id string, document_type string, source string, "
    "fields map<string, struct<extracted: variant, expected: variant, confidence: double>>"
)


def fields_of(cases: DataFrame) -> DataFrame:
    """One row per case and field; whether a field is numeric follows its expected JSON value."""
    rows = cases.select(
        "case_id", F.coalesce("document_type", F.lit("unknown")).alias("document_type"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.explode_outer("fields").alias("field_name", "f"))
    numeric = F.schema_of_variant("f.expected").rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)")
    return rows.select(
        "case_id", "document_type", "source", "field_name",
        F.try_variant_get("f.extracted", "$", "string").alias("extracted"),
        F.try_variant_get("f.expected", "$", "string").alias("expected"),
        F.coalesce(numeric, F.lit(False)).alias("numeric"), F.col("f.confidence").alias("confidence"))


def graded(fields: DataFrame) -> DataFrame:
    match = values_match(F.col("extracted"), F.col("expected"), F.col("numeric"), TOL_GOLDEN)
    return fields.withColumn("matched", F.when(F.col("field_name").isNotNull(), match))


def _share(part, whole):
    return F.when(whole == 0, 1.0).otherwise(F.round(part / F.greatest(whole, F.lit(1)), 4))


def case_scores(rows: DataFrame) -> DataFrame:
    total, good = F.count("field_name"), F.count(F.when(F.col("matched"), 1))
    return rows.groupBy("case_id", "document_type").agg(
        total.alias("total_fields"), good.alias("correct_fields"), _share(good, total).alias("field_accuracy"),
        (total == good).alias("exact_match"))


def set_score(scores: DataFrame) -> DataFrame:
    """The whole set from the per-case scores; an empty set scores 1.0."""
    cases, exact = F.count(F.lit(1)), F.count(F.when(F.col("exact_match"), 1))
    total, good = zero_if_null(F.sum("total_fields")), zero_if_null(F.sum("correct_fields"))
    return scores.agg(
        cases.alias("total_cases"), exact.alias("exact_match_cases"),
        _share(exact, cases).alias("document_level_accuracy"), total.alias("total_fields"),
        good.alias("correct_fields"), _share(good, total).alias("field_level_accuracy"))


def field_scores(rows: DataFrame) -> DataFrame:
    total, good = F.count("field_name"), F.count(F.when(F.col("matched"), 1))
    return rows.filter(F.col("field_name").isNotNull()).groupBy("field_name").agg(
        total.alias("total"), good.alias("correct"), _share(good, total).alias("accuracy"))


def annotations_to_fields(annotations: DataFrame) -> DataFrame:
    """Reviewer corrections as golden data points."""
    return annotations.select(
        F.col("task_id").alias("case_id"), "field_name", F.col("original_value").alias("extracted"),
        F.col("corrected_value").alias("expected"), F.col("confidence_before").alias("confidence"))


def backtest(extracted: DataFrame, golden: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Share of documents whose amount is within a rupee of the golden one, per field."""
    pairs = golden.select(key, *[F.col(f).alias(f"_g_{f}") for f in fields]).join(extracted, key, "left")
    hits = {
        f: F.coalesce(F.abs(zero_if_null(F.col(f)) - zero_if_null(F.col(f"_g_{f}"))) <= TOL_BACKTEST, F.lit(False))
        for f in fields}
    counts = pairs.agg(F.count(F.lit(1)).alias("n"),
                       *[F.count(F.when(c, 1)).alias(f"h_{f}") for f, c in hits.items()])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col("n").alias("total"), F.col(f"h_{f}").alias("correct"),
                 F.round(F.col(f"h_{f}") * 100.0 / F.greatest(F.col("n"), F.lit(1)), 2).alias("accuracy_pct"))
        for f in fields])))
