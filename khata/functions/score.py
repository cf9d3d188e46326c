"""Priority, quality and confidence scores; cost of model calls."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import zero_if_null

# Review-priority weights.
W_CONFIDENCE, W_BLOCKED, W_NEEDS_REVIEW, W_FAILED = 40.0, 35.0, 15.0, 20.0
W_DUPLICATE, W_MANUAL_FLAG, MANUAL_FLAG_CAP, W_HIGH_VALUE = 25.0, 8.0, 3, 15.0
HIGH_VALUE = 100000
UNKNOWN_CONFIDENCE = 0.5

# Price per million tokens in USD and the exchange rate.
USD_TO_INR = 83.0
TOKEN_PRICES_USD = {
    "gemini-2.5-flash": (0.075, 0.30),
    "google/gemini-2.5-flash": (0.075 * 1.15, 0.30 * 1.15),
    "meta-llama/llama-3.3-70b-instruct": (0.59, 0.59),
    "claude-haiku-4-5-20251001": (1.00, 5.00),
    "claude-sonnet-4-6": (3.00, 15.00),
}


def priority_score(
    confidence: Column, recon_status: Column, validation_status: Column, is_duplicate: Column,
    manual_flags: Column, invoice_value: Column,
) -> Column:
    parts = (
        (1.0 - F.coalesce(confidence, F.lit(UNKNOWN_CONFIDENCE))) * W_CONFIDENCE
        + F.when(recon_status == "BLOCKED", W_BLOCKED)
        .when(recon_status == "NEEDS_REVIEW", W_NEEDS_REVIEW).otherwise(0.0)
        + F.when(validation_status == "FAILED", W_FAILED).otherwise(0.0)
        + F.when(F.coalesce(is_duplicate, F.lit(False)), W_DUPLICATE).otherwise(0.0)
        + F.least(zero_if_null(manual_flags), F.lit(MANUAL_FLAG_CAP)) * W_MANUAL_FLAG
        + F.when(zero_if_null(invoice_value) >= HIGH_VALUE, W_HIGH_VALUE).otherwise(0.0)
    )
    return F.round(parts, 2)


def composite_quality(grounding: Column, balanced: Column, gstin_ok: Column, self_check: Column) -> Column:
    def one(flag):
        return F.when(flag, 1.0).otherwise(0.0)

    return F.round(
        grounding * 0.40 + one(balanced) * 0.30 + one(gstin_ok) * 0.20 + one(self_check) * 0.10, 3
    )


def evidence_score(contributions: Column, penalties: Column) -> Column:
    """0.5 plus evidence minus penalties, kept within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + contributions - penalties))


def call_cost_inr(model: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    """struct(prompt_cost, completion_cost, total_cost); an unlisted model costs 0."""
    def price(side):
        chain = None
        for name, prices in TOKEN_PRICES_USD.items():
            value = F.lit(prices[side] * USD_TO_INR)
            chain = F.when(model == name, value) if chain is None else chain.when(model == name, value)
        return chain.otherwise(0.0)

    prompt = prompt_tokens / 1_000_000 * price(0)
    completion = completion_tokens / 1_000_000 * price(1)
    return F.struct(
        F.round(prompt, 2).alias("prompt_cost"),
        F.round(completion, 2).alias("completion_cost"),
        F.round(prompt + completion, 2).alias("total_cost"),
    )


def values_match(extracted: Column, expected: Column, numeric: Column, tolerance: float) -> Column:
    """Both missing match; numbers within the tolerance; text trimmed and case-blind."""
    close = F.coalesce(
        F.abs(extracted.try_cast("double") - expected.try_cast("double")) <= tolerance, F.lit(False)
    )
    same_text = F.lower(F.trim(extracted)) == F.lower(F.trim(expected))
    return (
        F.when(extracted.isNull() & expected.isNull(), True)
        .when(extracted.isNull() | expected.isNull(), False)
        .when(numeric, close)
        .otherwise(same_text)
    )
