"""Dates written in several text formats; NULL or '' where nothing parses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import text

# Accepted layouts in the order they are tried, with the shape that selects each.
DATE_FORMATS = (
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2}-[A-Za-z]+-\d{4}$", "d-MMMM-yyyy"),
)
RETRIGGER_DAYS = 30


def parse_date(c: Column) -> Column:
    """First layout that fits, as DATE."""
    s = text(c)
    return F.coalesce(
        *[
            F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(layout)).cast("date"))
            for shape, layout in DATE_FORMATS
        ]
    )


def gst_date(c: Column) -> Column:
    """DD-MM-YYYY; text already shaped like that survives even if the day does not exist."""
    s = text(c)
    return F.coalesce(
        F.date_format(parse_date(c), "dd-MM-yyyy"),
        F.when(s.rlike(r"^\d{2}-\d{2}-\d{4}"), s),
        F.lit(""),
    )


def month_bucket(d: Column) -> Column:
    return F.date_format(d, "MMyyyy")


def in_period(date_text: Column, period) -> Column:
    """DD-MM-YYYY text belongs to YYYY-MM; anything else does not."""
    period = F.lit(period) if isinstance(period, str) else period
    parts = F.split(F.coalesce(date_text, F.lit("")), "-")
    yyyy_mm = F.concat_ws("-", F.try_element_at(parts, F.lit(3)), F.try_element_at(parts, F.lit(2)))
    return (F.size(parts) == 3) & F.coalesce(yyyy_mm == period, F.lit(False))


def fiscal_month_index(d: Column, start_month: int = 4) -> Column:
    return F.pmod(F.month(d) - start_month, F.lit(12)) + 1


def period_folder(d: Column, start_month: int = 4) -> Column:
    """Folder name of a month, e.g. '3. June 2026'."""
    return F.concat(
        fiscal_month_index(d, start_month).cast("string"), F.lit(". "),
        F.date_format(d, "MMMM yyyy"),
    )


def voucher_to_iso(c: Column) -> Column:
    """YYYYMMDD (dashes and slashes ignored) to YYYY-MM-DD; unparseable text is returned as is."""
    clean = F.substring(F.regexp_replace(c, "[-/]", ""), 1, 8)
    parsed = F.when(clean.rlike(r"^\d{8}$"), F.try_to_timestamp(clean, F.lit("yyyyMMdd")))
    return F.coalesce(
        F.when(F.length(c) >= 8, F.date_format(parsed, "yyyy-MM-dd")), c
    )


def iso_to_voucher(c: Column) -> Column:
    head = F.substring(c, 1, 10)
    parsed = F.when(
        head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(head, F.lit("yyyy-M-d"))
    )
    return F.date_format(parsed, "yyyyMMdd")


def is_due(last_triggered: Column, now: Column, days: int = RETRIGGER_DAYS) -> Column:
    return last_triggered.isNull() | (
        last_triggered <= now - F.make_dt_interval(F.lit(days))
    )


def last_periods(as_of: Column, months: int = 24) -> Column:
    """The latest ``months`` periods as YYYY-MM, newest first."""
    first = F.trunc(as_of, "month")
    return F.transform(
        F.sequence(F.lit(0), F.lit(months - 1)),
        lambda i: F.date_format(F.add_months(first, -i), "yyyy-MM"),
    )


# Day-first dates, then year-first ones, inside free text.
DATES_IN_TEXT = (
    r"(\b\d{1,2}[/\-\.\s]+(?:\d{1,2}|[A-Za-z]{3,9})[/\-\.\s]+\d{2,4}\b)",
    r"(\b\d{4}[/\-\.\s]+\d{1,2}[/\-\.\s]+\d{1,2}\b)",
)


def first_date_in(c: Column) -> Column:
    """The first date-like piece of a text, or NULL."""
    found = [F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit("")) for p in DATES_IN_TEXT]
    return F.trim(F.coalesce(*found))
