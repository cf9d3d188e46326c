"""Payments to micro and small enterprises under Section 43B(h)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import money
from ..functions.tax import msme_43bh


def compliance(bills: DataFrame, as_of: Column) -> DataFrame:
    """Bills with days, limits, disallowance and interest.

    Needs invoice_date, payment_date (DATE), enterprise_type, has_agreement and amount.
    """
    outcome = msme_43bh(
        F.col("invoice_date"), F.col("payment_date"), F.col("enterprise_type"),
        F.col("has_agreement"), F.col("amount"), as_of,
    )
    return bills.withColumn("_o", outcome).select(*bills.columns, "_o.*")


def tab(register: DataFrame, name: str) -> DataFrame:
    """Register tabs: all, disallowed or verified."""
    conditions = {"all": F.lit(True), "disallowed": F.col("disallowed_amount") > 0,
                  "verified": F.col("is_verified")}
    return register.filter(conditions[name])


def portfolio(register: DataFrame) -> DataFrame:
    return register.agg(
        money(F.sum("amount")).alias("total_amount"),
        money(F.sum("disallowed_amount")).alias("total_disallowed"),
        F.sum(F.col("interest_penalty").cast("decimal(18,2)")).cast("double").alias("total_interest"),
        F.count(F.when(F.col("is_verified"), 1)).alias("n_verified"),
    )
