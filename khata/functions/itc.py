"""Input-tax-credit eligibility under Section 17(5)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import any_contains, text

# Blocked HSN prefixes, blocked service words and accepted spellings.
BLOCKED_HSN_PREFIXES = ("8703", "8711", "8716", "3303", "3304", "3305", "3306", "3307")
BLOCKED_SERVICES = (
    "club membership", "health club", "fitness", "beauty treatment",
    "cosmetic surgery", "outdoor catering", "employee travel benefit",
    "works contract for immovable", "construction of immovable",
    "rent a cab", "life insurance", "health insurance",
)
SPELLINGS = {
    "ITC_ELIGIBLE": ("ELIGIBLE", "FULL_ITC", "YES", "Y", "ALLOWED", "ITC_ELIGIBLE"),
    "ITC_BLOCKED": ("BLOCKED", "NOT_ELIGIBLE", "NO", "N", "INELIGIBLE", "ITC_BLOCKED"),
    "ITC_RESTRICTED": ("RESTRICTED", "PARTIAL", "PRO_RATA", "ITC_RESTRICTED"),
    "ITC_EXEMPT": ("EXEMPT", "NIL_RATED", "ITC_EXEMPT"),
}
CATEGORIES = ("ITC_ELIGIBLE", "ITC_BLOCKED", "ITC_RESTRICTED", "ITC_EXEMPT", "ITC_UNKNOWN")
REASON_HSN = "Section 17(5) — blocked HSN"
REASON_SERVICE = "Section 17(5) — blocked service description"


def _blocked_by(hsn: Column, particulars: Column) -> tuple[Column, Column]:
    code = text(hsn)
    by_hsn = F.lit(False)
    for prefix in BLOCKED_HSN_PREFIXES:
        by_hsn = by_hsn | code.startswith(prefix)
    by_service = any_contains(F.lower(F.coalesce(particulars, F.lit(""))), BLOCKED_SERVICES)
    return by_hsn, by_service


def itc_category(hsn: Column, particulars: Column, given: Column) -> Column:
    by_hsn, by_service = _blocked_by(hsn, particulars)
    chain = F.when(by_hsn | by_service, "ITC_BLOCKED")
    for label, words in SPELLINGS.items():
        chain = chain.when(F.upper(F.coalesce(given, F.lit(""))).isin(*words), label)
    return chain.otherwise("ITC_UNKNOWN")


def itc_block_reason(hsn: Column, particulars: Column) -> Column:
    by_hsn, by_service = _blocked_by(hsn, particulars)
    return F.when(by_hsn, REASON_HSN).when(by_service, REASON_SERVICE)
