"""Identifiers: document numbers, GSTINs, states, HSN codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import any_contains, blank_to_null, text

# The GSTIN shape differs per place of use and the variants are kept apart.
GSTIN_STRICT = r"^\d{2}[A-Z]{5}\d{4}[A-Z]{1}[A-Z\d]{1}Z[A-Z\d]{1}$"
GSTIN_BATCH = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}$"
GSTIN_IN_TEXT = r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b"
GSTIN_STATUTORY = r"^(0[1-9]|[12][0-9]|3[0-8])[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
INVOICE_NO_STATUTORY = r"^[A-Za-z0-9/\-]{1,16}$"
IRN_64_HEX = r"^[a-fA-F0-9]{64}$"
HSN_SHAPE = r"^(\d{4}|\d{6}|\d{8}|\d{4}\.\d{2})$"

FUZZY_MIN_OVERLAP = 4

# State codes and names of the statute.
STATES = {
    "01": "JAMMU AND KASHMIR", "02": "HIMACHAL PRADESH", "03": "PUNJAB", "04": "CHANDIGARH",
    "05": "UTTARAKHAND", "06": "HARYANA", "07": "DELHI", "08": "RAJASTHAN", "09": "UTTAR PRADESH",
    "10": "BIHAR", "11": "SIKKIM", "12": "ARUNACHAL PRADESH", "13": "NAGALAND", "14": "MANIPUR",
    "15": "MIZORAM", "16": "TRIPURA", "17": "MEGHALAYA", "18": "ASSAM", "19": "WEST BENGAL",
    "20": "JHARKHAND", "21": "ODISHA", "22": "CHHATTISGARH", "23": "MADHYA PRADESH",
    "24": "GUJARAT", "26": "DADRA AND NAGAR HAVELI AND DAMAN AND DIU", "27": "MAHARASHTRA",
    "29": "KARNATAKA", "30": "GOA", "31": "LAKSHADWEEP", "32": "KERALA", "33": "TAMIL NADU",
    "34": "PUDUCHERRY", "35": "ANDAMAN AND NICOBAR ISLANDS", "36": "TELANGANA",
    "37": "ANDHRA PRADESH", "38": "LADAKH",
}


def normalize_id(c: Column) -> Column:
    """Upper case, letters and digits only; NULL becomes ''."""
    return F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]", "")


def match_key(gstin: Column, number: Column) -> Column:
    return F.concat_ws("||", normalize_id(gstin), normalize_id(number))


def duplicate_key(c: Column) -> Column:
    """Trim and upper case only: punctuation still tells documents apart."""
    return F.upper(text(c))


def state_of_gstin(gstin: Column) -> Column:
    return F.regexp_extract(text(gstin), r"^(\d{2})", 1)


def state_of_supply(pos: Column) -> Column:
    return F.regexp_extract(text(pos), r"^(\d{2})", 1)


def resolve_pos(pos: Column, gstin: Column, fallback) -> Column:
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.coalesce(
        blank_to_null(state_of_supply(pos)), blank_to_null(state_of_gstin(gstin)), fallback
    )


def number_prefix(number: Column) -> Column:
    """What is left of a document number without its digits."""
    return F.regexp_replace(F.coalesce(number, F.lit("")), r"\d", "")


def original_invoice(particulars: Column) -> Column:
    """The number in '(against MH0000201)', or ''."""
    return F.regexp_extract(
        F.coalesce(particulars, F.lit("")), r"\(against ([A-Za-z]*\d+)\)", 1
    )


def routing_prefix(number: Column, particulars: Column) -> Column:
    """Notes numbered CR… follow the registration of the invoice they correct."""
    own, original = number_prefix(number), original_invoice(particulars)
    return F.when((own == "CR") & (original != ""), number_prefix(original)).otherwise(own)


def fuzzy_same_number(a: Column, b: Column) -> Column:
    """Normalised numbers that differ but plausibly name one document."""
    both = (a != "") & (b != "") & (a != b)
    long_enough = (F.length(a) >= FUZZY_MIN_OVERLAP) & (F.length(b) >= FUZZY_MIN_OVERLAP)
    contained = long_enough & (a.contains(b) | b.contains(a))
    bare_a, bare_b = F.ltrim(a, F.lit("0")), F.ltrim(b, F.lit("0"))
    return both & (contained | ((bare_a != "") & (bare_a == bare_b)))


LONGEST_PIECE = 64


def substrings(c: Column, shortest: int = FUZZY_MIN_OVERLAP, longest: int = LONGEST_PIECE) -> Column:
    """Every distinct substring of ``shortest`` to ``longest`` characters."""
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length(c) - shortest + 1),
            lambda i: F.transform(
                F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length(c) - i + 1)),
                lambda n: F.substring(c, i, n),
            ),
        )
    )
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.when(F.length(c) >= shortest, pieces).otherwise(empty))


def is_note(*cols: Column) -> Column:
    cond = F.lit(False)
    for c in cols:
        cond = cond | any_contains(F.lower(F.coalesce(c, F.lit(""))), ("credit", "debit"))
    return cond


def document_sign(doc_type: Column) -> Column:
    """-1 for credit and debit notes, +1 otherwise."""
    return F.when(is_note(doc_type), -1).otherwise(1)


def looks_like_hsn(amount_text: Column) -> Column:
    return F.regexp_replace(amount_text, r"[^\d.]", "").rlike(HSN_SHAPE)


def amount_rejected_as_hsn(amount: Column, hsn: Column, source_column: Column) -> Column:
    """An amount that is really an HSN code: by shape, by value or by column."""
    whole = amount == F.floor(amount)
    as_text = F.when(whole, amount.cast("bigint").cast("string")).otherwise(
        amount.cast("double").cast("string")
    )
    same = as_text == F.regexp_replace(F.coalesce(hsn, F.lit("")), r"[^\d.]", "")
    return looks_like_hsn(as_text) | same | (F.upper(source_column) == "HSN")


def known_place_of_supply(pos: Column) -> Column:
    """A state code, or text that contains / is contained in a state name (blank passes)."""
    clean = F.regexp_replace(F.upper(text(pos)), "[^A-Z0-9 ]", "")
    inside = F.lit("|".join(STATES.values())).contains(clean) & ~clean.contains("|")
    holds = clean.rlike("|".join(STATES.values()))
    return clean.isin(*STATES) | inside | holds
