"""Text hygiene, header labels and layout fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import any_contains

# Header labels in the order they are tried.
HEADER_LABELS = {
    "HSN": r"\b(hsn|sac|hsn[-_\s]*code|sac[-_\s]*code)\b",
    "DESCRIPTION": r"\b(particulars|description|item|service|goods|product)\b",
    "QTY": r"\b(qty|quantity|units|nos|pcs|volume)\b",
    "RATE": r"\b(rate|price|unit[-_\s]*price|charges|val)\b",
    "DISCOUNT": r"\b(disc|discount|less|deduction)\b",
    "TAXABLE": r"\b(taxable|assessable|amount|value|taxable[-_\s]*value|net[-_\s]*amount)\b",
    "CGST": r"\b(cgst|central[-_\s]*gst|cgst[-_\s]*amount)\b",
    "SGST": r"\b(sgst|utgst|state[-_\s]*gst|sgst[-_\s]*amount)\b",
    "IGST": r"\b(igst|integrated[-_\s]*gst|igst[-_\s]*amount)\b",
    "TOTAL": r"\b(total|gross|net[-_\s]*total|final|total[-_\s]*amount)\b",
}
MIN_CHARS_PER_PAGE, MIN_INK_RATIO = 40, 0.5


def sanitize_text(c: Column, longest: int | None = None) -> Column:
    """Without control characters, white space as single blanks; cut only if the caller names a length."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    clean = F.trim(F.regexp_replace(clean, r"\s+", " "))
    if longest is None:
        return clean
    return F.when(F.length(clean) > longest, F.concat(F.substring(clean, 1, longest), F.lit("..."))).otherwise(clean)


def sanitize_amount(c: Column) -> Column:
    """Digits, one point and a sign; '' for anything else."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[₹$€£¥\s]", "")
    return F.when(bare.rlike(r"^-?[\d,]*\.?\d+$"), F.regexp_replace(bare, ",", "")).otherwise("")


def sanitize_date(c: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1F\x7F]", ""))
    return F.when(F.length(clean) > 30, "").otherwise(clean)


def header_label(header: Column) -> Column:
    """What a table column holds, by its header; tax words refine a plain amount."""
    h = F.lower(F.trim(header))
    chain = F.when(F.lit(False), F.lit(""))
    for label, pattern in HEADER_LABELS.items():
        chain = chain.when(h.rlike(pattern), label)
    label = chain.otherwise("OTHER")
    taxed = any_contains(h, ("cgst", "sgst", "igst")) | (h.contains("tax") & ~h.contains("taxable"))
    refined = (
        F.when(h.contains("cgst"), "CGST").when(any_contains(h, ("sgst", "utgst")), "SGST")
        .when(h.contains("igst"), "IGST").otherwise("TOTAL"))
    return F.when((label == "TAXABLE") & taxed, refined).otherwise(label)


def layout_fingerprint(headers: Column, coordinates: Column) -> Column:
    """SHA-256 over sorted header names and sorted column positions."""
    names = F.array_join(F.array_sort(F.transform(headers, lambda h: F.lower(F.trim(h)))), "|")
    spots = F.array_join(F.transform(F.array_sort(coordinates), lambda x: F.format_string("%.2f", x)), "|")
    return F.sha2(F.concat_ws("::", names, spots), 256)


def usable_text_layer(pages: Column) -> Column:
    """Enough visible characters per page, and not mostly white space."""
    whole = F.array_join(pages, "")
    ink = F.length(F.regexp_replace(whole, r"\s", ""))
    raw, n = F.length(whole), F.size(pages)
    return (n > 0) & (ink >= n * MIN_CHARS_PER_PAGE) & ((raw == 0) | (ink >= raw * MIN_INK_RATIO))


def export_marker(c: Column) -> Column:
    phrases = (
        "export invoice", "letter of undertaking", "without payment of integrated",
        "without payment of igst", "zero-rated supply", "zero rated supply")
    low = F.lower(F.coalesce(c, F.lit("")))
    return any_contains(low, phrases) | low.rlike(r"\blut\b")
