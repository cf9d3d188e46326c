"""Field extraction from document texts.

Everything is a column expression over (doc_id, text): the lines of a document are an array inside
its row, so finding candidates, regions and sections moves no data between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.common import any_contains, blank_to_null, money, text as as_text, zero_if_null
from ..functions.dates import first_date_in
from ..functions.ids import STATES
from ..functions.tax import dec
from ..functions.texts import sanitize_amount, sanitize_date, sanitize_text
from .cleaning import NOT_SPECIFIED_HSN

# Patterns and words of the detectors.
GSTIN_IN_LINE = r"\b\d{2}[A-Z]{5}\d{4}[A-Z]{1}[A-Z\d]{1}Z[A-Z\d]{1}\b"
PAN_IN_LINE = r"\b[A-Z]{5}\d{4}[A-Z]{1}\b"
IFSC_IN_LINE = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
DATE_IN_LINE = (
    r"(?i)\b(?:\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4})|(?:\d{1,2}[/\-\. ]"
    r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-zA-Z]*[/\-\. ]\d{2,4})\b")
TAX_NUMBER = r"\b\d+\.\d{2}\b|\b\d+%\b"
TOTAL_NUMBER = r"\b\d{1,3}(?:,\d{3})*\.\d{2}\b|\b\d+\.\d{2}\b"
INVOICE_WORDS = ("invoice no", "invoice number", "inv no", "invoice #", "bill no", "voucher no")
TAX_FIELDS = {"cgst": "cgst", "sgst": "sgst", "igst": "igst", "cess": "cess", "gst rate": "gst_rate",
              "tax amount": "tax_amount"}
TOTAL_FIELDS = {"total": "grand_total", "subtotal": "subtotal", "sub-total": "subtotal",
                "grand total": "grand_total", "net amount": "grand_total", "invoice value": "grand_total",
                "round off": "round_off", "rounded": "round_off"}
SELLER_WORDS = ("supplier", "seller", "from", "vendor")
BUYER_WORDS = ("buyer", "customer", "to", "recipient")

CANDIDATE = "array<struct<detector: int, field: string, value: string, keyword: string, confidence: double>>"


def lines_of(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _none() -> Column:
    return F.array().cast(CANDIDATE)


def _found(detector: int, field, value: Column, keyword, confidence) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    parts = {"detector": F.lit(detector), "field": lit(field).cast("string"), "value": value,
             "keyword": lit(keyword).cast("string"), "confidence": lit(confidence).cast("double")}
    return F.named_struct(*[x for name, c in parts.items() for x in (F.lit(name), c)])


def _all(line: Column, pattern: str) -> Column:
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(0))


def _when_near(low: Column, words, found: Column) -> Column:
    """Run a pattern only on lines that hold one of its words."""
    return F.when(any_contains(low, words), found).otherwise(F.array().cast("array<string>"))


def _gst_and_pan(low: Column) -> list[Column]:
    keyword = F.when(any_contains(low, SELLER_WORDS), "supplier").when(any_contains(low, BUYER_WORDS), "buyer")
    sure = F.when(any_contains(low, SELLER_WORDS), 0.95).when(any_contains(low, BUYER_WORDS), 0.9).otherwise(0.8)
    return [F.transform("gstin", lambda g: _found(0, "gstin", g, keyword, sure)),
            F.transform("pan", lambda p: _found(0, "pan", p, None, 0.7))]


def _invoice_numbers(line: Column) -> list[Column]:
    out = []
    for word in INVOICE_WORDS:
        value = F.regexp_extract(line, rf"^(?>.*?(?i:{word}))[:\-\s#]*+([a-zA-Z0-9/\-_]+)", 1)
        found = F.filter(F.array(value), lambda v: F.length(v) >= 3)
        hits = F.transform(found, lambda v: _found(1, "invoice_number", v, word, 0.85))
        out.append(F.when(F.col("low").contains(word), hits).otherwise(_none()))
    return out


def _numbers(numbers: str, low: Column, detector: int, words: dict[str, str], drop: str, confidence: float) -> list[Column]:
    def under(word: str, field: str) -> Column:
        hits = F.transform(numbers, lambda n: _found(detector, field, F.replace(n, F.lit(drop), F.lit("")), word, confidence))
        return F.when(low.contains(word), hits).otherwise(_none())

    return [under(word, field) for word, field in words.items()]


def _metadata(low: Column) -> list[Column]:
    due = low.contains("due")
    return [
        F.transform("ifsc", lambda v: _found(4, "ifsc", v, None, 0.9)),
        F.transform("dates", lambda v: _found(
            4, F.when(due, "due_date").otherwise("invoice_date"), v,
            F.when(due, "due date").otherwise("date"), 0.8)),
        F.transform("accounts", lambda v: _found(4, "bank_account", v, "account", 0.7)),
    ]


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """With columns that are worked out once a row: behind a generator they can't be put in place, inside a loop over lines for one."""
    return rows.select(*rows.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def candidates(documents: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """All detectors over all lines: (doc_id, field, value, keyword, confidence, context, seq).

    Each pattern runs once per line; the keyword rules then only reshape what it found. With ``fields`` only
    the candidates of these fields are looked for, in the same order.
    """
    def wanted(*names: str) -> bool:
        return fields is None or any(n in fields for n in names)

    empty = F.array().cast("array<string>")
    whole = documents.select("doc_id", F.split("text", "\n").alias("lines"))
    if wanted("pan"):
        gstins = F.transform("lines", lambda line: F.when(line.rlike(r"\dZ|[A-Z]Z"), _all(line, GSTIN_IN_LINE)).otherwise(empty))
        known = F.flatten(F.transform("gstins", lambda found, i: F.transform(
            found, lambda g: F.named_struct(F.lit("line_no"), i, F.lit("pan"), F.substring(g, 3, 10)))))
        whole = _once(_once(whole, gstins=gstins), pans=known)
        # a PAN counts unless a GSTIN up to its line holds it; settled here, so that no line carries the document's GSTINs
        fresh = F.transform("lines", lambda line, i: F.struct(
            line.alias("line"), F.get("gstins", i).alias("gstin"), F.when(line.rlike(r"\d{4}[A-Z]"), F.filter(
                _all(line, PAN_IN_LINE), lambda p: ~F.exists("pans", lambda k: (k["pan"] == p) & (k["line_no"] <= i)))).otherwise(empty).alias("pan")))
        rows = whole.select("doc_id", F.posexplode(fresh).alias("line_no", "l")).select("doc_id", "line_no", "l.line", "l.gstin", "l.pan")
    else:
        rows = whole.select("doc_id", F.posexplode("lines").alias("line_no", "line")).withColumns({
            "gstin": _all(F.col("line"), GSTIN_IN_LINE) if wanted("gstin") else empty, "pan": empty})
    line, low = F.col("line"), F.col("low")
    account = F.regexp_extract(line, r"\b\d{9,18}\b", 0)
    near_bank = any_contains(low, ("a/c", "account", "bank"))
    # a line without a digit can hold only an invoice number made of letters; other lines without candidates give no rows below.
    # No pattern is in a filter, where it would run once more.
    kept = rows.filter(line.rlike(r"\d") | any_contains(F.lower(line), INVOICE_WORDS))
    none = F.lit(None).cast("array<string>")
    staged = kept.withColumn("low", F.lower("line")).select(
        "*",
        _when_near(low, TAX_FIELDS, _all(line, TAX_NUMBER)).alias("tax_numbers") if wanted(*TAX_FIELDS.values()) else none.alias("tax_numbers"),
        _when_near(low, TOTAL_FIELDS, _all(line, TOTAL_NUMBER)).alias("total_numbers") if wanted(*TOTAL_FIELDS.values()) else none.alias("total_numbers"),
        _all(line, IFSC_IN_LINE).alias("ifsc") if wanted("ifsc") else none.alias("ifsc"),
        _all(line, DATE_IN_LINE).alias("dates") if wanted("invoice_date", "due_date") else none.alias("dates"),
        F.when(near_bank & (account != ""), F.array(account)).otherwise(empty).alias("accounts") if wanted("bank_account") else none.alias("accounts"))
    (gst, pan), (ifsc, dates, accounts) = _gst_and_pan(low), _metadata(low)
    tax = _numbers("tax_numbers", low, 2, TAX_FIELDS, "%", 0.75)
    total = _numbers("total_numbers", low, 3, TOTAL_FIELDS, ",", 0.8)
    found = F.concat(_none(), *[c for names, columns in (
        (("gstin",), [gst]), (("pan",), [pan]), (("invoice_number",), _invoice_numbers(line)), *zip([(f,) for f in TAX_FIELDS.values()], [[c] for c in tax]),
        *zip([(f,) for f in TOTAL_FIELDS.values()], [[c] for c in total]), (("ifsc",), [ifsc]), (("invoice_date", "due_date"), [dates]),
        (("bank_account",), [accounts])) if wanted(*names) for c in columns])
    out = staged.select("doc_id", "line_no", F.trim("line").alias("context"), F.posexplode(found).alias("pos", "c"))
    return out.select(
        "doc_id", "line_no", "c.field", "c.value", "c.keyword", "c.confidence", "context",
        F.struct("c.detector", "line_no", "pos").alias("seq"))


def _rank() -> Column:
    return F.struct(-F.col("confidence"), F.col("seq"))


def best_per_field(found: DataFrame) -> DataFrame:
    """Highest confidence per field, the earliest of equals."""
    return found.groupBy("doc_id", "field").agg(
        F.min_by(F.struct("value", "keyword", "confidence", "line_no"), _rank()).alias("b")
    ).select("doc_id", "field", "b.*")


def top_candidates(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` most confident candidates of each document."""
    order = Window.partitionBy("doc_id").orderBy(F.col("confidence").desc(), "seq")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def resolve_gstins(found: DataFrame) -> DataFrame:
    """Supplier and buyer GSTIN per document: by keyword, then leftovers in order."""
    rows = found.filter("field = 'gstin'").select("doc_id", F.struct("value", "line_no", "keyword").alias("r"), _rank().alias("rank"))
    doc = Window.partitionBy("doc_id")
    # all of it is windows over one shuffle: the texts are read once
    named = rows.select("*", *[
        F.min_by("r", F.when(F.col("r.keyword") == k, F.col("rank"))).over(doc).alias(k) for k in ("supplier", "buyer")])
    left = ~F.col("r").eqNullSafe(F.col("supplier")) & ~F.col("r").eqNullSafe(F.col("buyer"))
    placed = named.withColumn("n", F.when(left, F.sum(left.cast("int")).over(
        doc.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    out = placed.groupBy("doc_id").agg(
        *[F.max(k).alias(k) for k in ("supplier", "buyer")], *[F.max(F.when(F.col("n") == i, F.col("r.value"))).alias(f"spare{i}") for i in (1, 2)])
    return out.select(
        "doc_id", F.coalesce("supplier.value", "spare1").alias("supplier_gstin"),
        F.coalesce("buyer.value", F.when(F.col("supplier").isNull(), F.col("spare2")).otherwise(F.col("spare1")))
        .alias("buyer_gstin"))


def resolve_dates(found: DataFrame) -> DataFrame:
    """Invoice and due date; without a due date the second-ranked date stands in."""
    rows = found.filter("field IN ('invoice_date', 'due_date')").select("doc_id", "field", "value", _rank().alias("rank"))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank")))
    named = numbered.groupBy("doc_id").agg(
        F.max(F.when(F.col("n") == 2, F.col("value"))).alias("second"),
        *[F.min_by("value", F.when(F.col("field") == f, F.col("n"))).alias(f) for f in ("invoice_date", "due_date")])
    return named.select("doc_id", "invoice_date", F.coalesce("due_date", "second").alias("due_date"))


# Evidence weights, and the scores that have no measurement behind them.
W_MATH, W_OCR, W_LAYOUT, W_KEYWORD, W_VENDOR = 0.40, 0.20, 0.15, 0.15, 0.10
LAYOUT_SCORE, VENDOR_SCORE, WITH_KEYWORD, WITHOUT_KEYWORD = 0.8, 0.5, 0.95, 0.5


def choose_amounts(found: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Best amount per document and field by weighted evidence; ``expected`` holds calculated values."""
    rows = found if expected is None else found.join(
        expected.select("doc_id", "field", "math_value"), ["doc_id", "field"], "left")
    value = F.col("value").try_cast("double")
    gap = F.abs(value - F.col("math_value")) if expected is not None else F.lit(None).cast("double")
    math = F.when(gap <= 1.5, 1.0).when(gap <= 10.0, 0.8).when(gap.isNotNull(), 0.2).otherwise(0.5)
    worded = F.when(as_text(F.col("keyword")) != "", WITH_KEYWORD).otherwise(WITHOUT_KEYWORD)
    score = (math * W_MATH + F.col("confidence") * W_OCR + LAYOUT_SCORE * W_LAYOUT + worded * W_KEYWORD
             + VENDOR_SCORE * W_VENDOR)
    scored = rows.withColumn("score", F.round(score, 10))
    return scored.groupBy("doc_id", "field").agg(
        F.min_by(F.struct(zero_if_null(value).alias("value"), "score"), F.struct(-F.col("score"), F.col("seq"))).alias("b")
    ).select("doc_id", "field", "b.*")


# Words that open the item table, the totals and the payment block.
TABLE_WORDS = ("particulars", "description", "hsn", "qty", "quantity", "rate", "taxable", "sac")
TOTALS_WORDS = (
    "subtotal", "round off", "grand total", "net amount", "total payable", "total invoice", "total tax",
    "final total", "amount payable", "balance due",
    "@ 9%", "@ 18%", "@ 12%", "@ 5%", "@ 28%", "add: igst", "add: cgst")
PAYMENT_WORDS = ("bank name", "account no", "a/c", "ifsc", "rtgs", "neft")


def line_regions(documents: DataFrame) -> DataFrame:
    """Each line with its region: metadata, items_table, totals or payment.

    The turning points of a document are found inside its own row, going over its lines once: the first table header,
    and the first totals line after an item line has been seen.
    """
    def step(at: Column, x: Column) -> Column:
        i = at["i"]
        table = F.coalesce(at["table_at"], F.when(any_contains(x, TABLE_WORDS), i))
        item = F.coalesce(at["item_at"], F.when(table.isNotNull() & ~any_contains(x, PAYMENT_WORDS), i))
        totals = F.coalesce(at["totals_at"], F.when(at["item_at"].isNotNull() & any_contains(x, TOTALS_WORDS), i))
        return F.struct((i + 1).alias("i"), table.alias("table_at"), item.alias("item_at"), totals.alias("totals_at"))

    unset = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("i"), *[unset.alias(n) for n in ("table_at", "item_at", "totals_at")])
    docs = documents.select("doc_id", F.split("text", "\n").alias("lines"))
    at = F.aggregate(F.transform("lines", F.lower), start, step)
    rows = _once(docs, at=at).select("doc_id", "at.table_at", "at.totals_at", F.posexplode("lines").alias("line_no", "line"))
    n = F.col("line_no")
    region = (
        F.when(any_contains(F.lower("line"), PAYMENT_WORDS), "payment").when(n >= F.col("totals_at"), "totals")
        .when(n >= F.col("table_at"), "items_table").otherwise("metadata"))
    return rows.select("doc_id", "line_no", "line", region.alias("region"))


def _grab(c: Column, pattern: str, group: int = 1) -> Column:
    return blank_to_null(F.regexp_extract(c, pattern, group))


def _amount(c: Column) -> Column:
    return money(F.regexp_replace(c, ",", "").try_cast("decimal(20,4)"))


# The printed GST summary.
_MONEY = r"([\d,]+\.[\d]{2})"
_RATE = r"(\d*\.?\d*)\s*%\s+"
SUMMARY_ROW = _MONEY + r"\s+" + _RATE + _MONEY + r"\s+" + _RATE + _MONEY + r"\s+" + _RATE + _MONEY


def gst_summary(documents: DataFrame) -> DataFrame:
    """Amounts of the printed GST summary; several rows of the table are added up."""
    return _summarised(documents.select("doc_id", "text")).drop("text")


def _behind(c: Column, *labels: str) -> Column:
    """What follows the labels, each looked for behind the one before; '' where one is missing. The text stands in it once."""
    for label in labels:
        c = F.get(F.split(c, rf"\Q{label}\E", 2), F.lit(1))
    return F.coalesce(c, F.lit(""))


def _summarised(documents: DataFrame) -> DataFrame:
    rows = documents.withColumn("t", F.regexp_replace("text", r"[ \t]+", " "))
    hits = F.regexp_extract_all(_behind(F.col("t"), "Taxable Value", "Central Tax"), F.lit(SUMMARY_ROW), F.lit(0))
    start = F.lit(0).cast("decimal(18,2)")

    def total(group: int) -> Column:
        return F.when(F.size("hits") > 0, F.aggregate(
            "hits", start, lambda acc, h: (acc + zero_if_null(_amount(F.regexp_extract(h, SUMMARY_ROW, group)))).cast("decimal(18,2)")))

    def rate(group: int) -> Column:
        first = F.try_element_at(F.col("hits"), F.lit(1))
        return F.when(F.size("hits") > 0, F.coalesce(F.regexp_extract(first, SUMMARY_ROW, group).try_cast("double"), F.lit(0.0)))

    rows = rows.withColumn("hits", hits)
    out = rows.select(
        *documents.columns, total(1).alias("taxable_value"), rate(2).alias("cgst_rate"), total(3).alias("cgst_amount"),
        rate(4).alias("sgst_rate"), total(5).alias("sgst_amount"), rate(6).alias("igst_rate"),
        total(7).alias("igst_amount"),
        _amount(_grab(F.col("t"), r"Final Total\s*\([^)]*\)\s+" + _MONEY)).alias("final_total"),
        _amount(_grab(F.col("t"), r"Net Cost\s+" + _MONEY)).alias("net_cost"),
        _amount(_grab(F.col("t"), r"Total Cost incl Taxes\s+" + _MONEY)).alias("total_invoice_value"),
        _amount(_grab(F.col("t"), r"Rounding off\s+(-?[\d,]+\.[\d]{2})")).alias("round_off"))
    advance = money(F.col("net_cost") - F.coalesce("final_total", "taxable_value"))
    return out.withColumn("advance_amount", F.when(advance > dec("0.50"), advance))


# The header block of the invoice template.
HEADER_BLOCK = (
    r"(?s)Customer Name:\s*(.+?)\s*Billing Month:.*?GSTIN:\s*([0-9A-Z]{15})\s*Invoice Number:\s*(\S+).*?"
    r"Date of Invoice:\s*(\d{2}-\d{2}-\d{4})")


def _state_name(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(""))


def invoice_header(documents: DataFrame) -> DataFrame:
    """Party, GSTIN, number, date and place of supply; NULLs where the block is absent."""
    # without all its labels the block can't be there, and the pattern isn't tried
    body = F.when(_behind(F.col("text"), "Customer Name:", "Billing Month:", "GSTIN:", "Invoice Number:", "Date of Invoice:") != "", F.col("text"))

    def part(group: int) -> Column:
        return _grab(body, HEADER_BLOCK, group)

    out = documents.select(
        "doc_id", F.trim(F.regexp_replace(part(1), r"\s+", " ")).alias("party_name"), part(2).alias("party_gstin"),
        F.trim(part(3)).alias("invoice_no"), part(4).alias("voucher_date"))
    return out.withColumn("place_of_supply", F.when(
        F.col("party_gstin").isNotNull(), _state_name(F.substring("party_gstin", 1, 2))))


# The billing sections of the invoice template in order, with the HSN each stands for.
SECTIONS = (
    (r"A\s+SAAS\s*/\s*Mobile Application.*?Sub Total\s+([\d,]+\.\d{2})", "SaaS/UPI Platform Charges", "9971"),
    (r"B\s+Soundbox Charges.*?Sub Total\s+([\d,]+\.\d{2})", "Soundbox Charges", "997319"),
    (r"C\s+CBS\s*\(Core Banking Solution\)\s*([\d,]+\.\d{2})", "Core Banking Solution Charges", None),
    (r"D\s+Transactional Messages.*?Sub Total\s+\S*\s*\S*\s*\S*\s*([\d,]+\.\d{2})", "Transactional Messaging Charges", "998599"),
    (r"E\s+Promotional Messages.*?Sub Total\s+\S*\s*\S*\s*([\d,]+\.\d{2})", "Promotional Messaging Charges", "998599"),
    (r"F\s+KYC Charges.*?Sub Total\s+([\d,]+\.\d{2})", "KYC Verification Charges", "998529"),
    (r"G\s+Late Fees Charges\s+[\d,]+\.\d{2}\s*\d*%?\s*([\d,]+\.?\d*)", "Late Payment Fee", None),
    (r"H\s+Ad Hoc Charges\s+([\d,]+\.\d{2})", "Ad Hoc Charges", None),
    (r"[A-J]\s+Transactional Charges\b.*?Total\s+\S*\s*\S*\s*([\d,]+\.\d{2})", "High-Volume Transactional Charges", None),
    (r"[A-J]\s+UPI 2\.0 Transactional Messages.*?Sub Total\s+\S*\s*\S*\s*\S*\s*([\d,]+\.\d{2})",
     "UPI 2.0 Transactional Messaging Charges", "998599"),
)
SINGLE_LINE_END = r"(?<=[\d,]\.\d{2})\s*\n?B\s*\n?Final Total"
SINGLE_LINE_AMOUNT = r"([\d,]+\.\d{2})$"
SINGLE_LINE_ITEM = r"(?s)^(.+?)\n?(\d{4,8})\b"
DEFAULT_SECTION = ("SaaS/UPI Platform Charges", "9971")


# Words that every match of a section's pattern holds, in the order of the sections.
SECTION_WORDS = (
    "Mobile Application", "Soundbox Charges", "(Core Banking Solution)", "Transactional Messages", "Promotional Messages", "KYC Charges",
    "Late Fees Charges", "Ad Hoc Charges", "Transactional Charges", "UPI 2.0 Transactional Messages",
)


def _section_amounts(body: Column) -> list[Column]:
    """Amounts of the template's sections; a pattern is tried only where the words it begins with and the one that ends it are in the text."""
    out = []
    for (p, _, _), words in zip(SECTIONS, SECTION_WORDS, strict=True):
        end = "Sub Total" if "Sub Total" in p else "Total" if "?Total" in p else ""
        out.append(zero_if_null(_amount(F.when(body.contains(words) & body.contains(end), F.regexp_extract(body, "(?s)" + p, 1)))))
    return out


def sections_of(documents: DataFrame) -> DataFrame:
    """Billing sections with an amount, or the one ad-hoc line of a document without any.

    Columns other than the text are carried along.
    """
    body = F.col("text")
    carried = [c for c in documents.columns if c != "text"]
    rows = _once(documents, amounts=F.array(*_section_amounts(body)))
    # the one line runs from the first A to the amount before "B Final Total"; it is looked for only where no section has an amount
    rows = _once(rows, parts=F.when((F.array_max("amounts") <= 0) & body.contains("Final Total"), F.split(body, SINGLE_LINE_END, 2)))
    rows = _once(rows, head=F.when(F.size("parts") > 1, F.get("parts", F.lit(0))))
    rows = _once(rows, amount=F.regexp_extract("head", SINGLE_LINE_AMOUNT, 1))
    before = F.substr("head", F.lit(1), F.length("head") - F.length("amount"))
    rows = _once(rows, item=F.get(F.split(before, r"\bA\b\s*", 2), F.lit(1)))
    amount, item = F.col("amount"), F.col("item")
    hsn = F.regexp_extract(item, SINGLE_LINE_ITEM, 2)
    whole = (amount != "") & (hsn != "")
    rows = rows.withColumn("line", F.struct(
        F.when(whole, F.regexp_extract(item, SINGLE_LINE_ITEM, 1)).alias("words"), F.when(whole, hsn).otherwise("").alias("hsn"),
        F.when(whole, amount).otherwise("").alias("amount")))

    def section(pos: int, label: Column, hsn: Column, amount: Column) -> Column:
        return F.struct(F.lit(pos).alias("pos"), label.alias("particulars"), hsn.alias("hsn"), amount.alias("taxable"))

    named = [section(i, F.lit(label), F.lit(hsn or NOT_SPECIFIED_HSN), F.col("amounts")[i])
             for i, (_, label, hsn) in enumerate(SECTIONS)]
    words = blank_to_null(F.trim(F.regexp_replace(F.col("line.words"), r"\s+", " ")))
    only = section(len(SECTIONS), F.coalesce(words, F.lit("Ad Hoc Charges")), F.col("line.hsn"), zero_if_null(_amount(F.col("line.amount"))))
    bare = F.when(F.array_max("amounts") <= 0, only)
    return rows.select(*carried, F.inline(F.array(*named, bare))).filter(F.col("taxable") > 0)


def template_lines(documents: DataFrame) -> DataFrame:
    """Section lines net of advances, with taxes that add up to the document's own.

    The template has ten sections, so a document is a bounded group: its cascade and the share of
    its taxes are windows over at most ten rows, and all of them use one shuffle.
    """
    sides = ("cgst", "sgst", "igst")
    summary = _summarised(documents.select("doc_id", "text")).select(
        "doc_id", "text", zero_if_null(F.col("taxable_value")).alias("net"),
        *[zero_if_null(F.col(f"{s}_rate")).cast("decimal(6,2)").alias(f"{s}_rate") for s in sides])
    doc = Window.partitionBy("doc_id")
    ranked = doc.orderBy(F.col("taxable").desc(), "pos")
    rows = sections_of(summary).select(
        "*", F.round(F.sum("taxable").over(doc) - F.col("net"), 2).alias("gap"),
        zero_if_null(F.sum("taxable").over(ranked.rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
        F.row_number().over(doc.orderBy("pos")).alias("n"))
    open_gap = F.greatest(F.lit(0), F.col("gap") - F.col("before"))
    gapped = F.abs("gap") > dec("0.01")
    take = F.when(gapped & (open_gap > dec("0.005")), F.least(F.col("taxable"), open_gap)).otherwise(0)
    cut = rows.withColumn("left", money(F.col("taxable") - take)).withColumn(
        "most", F.max("left").over(doc))
    emptied = gapped & (F.col("most") <= dec("0.005"))
    kept = cut.filter(~gapped | (F.col("left") > dec("0.005")) | (emptied & (F.col("n") == 1)))

    def tax(base: str, side: str) -> Column:
        return money(F.round(F.col(base) * F.col(f"{side}_rate") * dec("0.01"), 2))

    taxed = kept.select(
        "doc_id", "net", "left", *[f"{s}_rate" for s in sides],
        F.when(emptied, 0).otherwise(F.col("pos")).alias("pos"),
        F.when(emptied, DEFAULT_SECTION[0]).otherwise(F.col("particulars")).alias("particulars"),
        F.when(emptied, DEFAULT_SECTION[1]).otherwise(F.col("hsn")).alias("hsn"),
        *[tax("left", s).alias(f"_{s}") for s in sides])
    shared = taxed.select("*", F.max("pos").over(doc).alias("last"), *[F.sum(f"_{s}").over(doc).alias(f"_sum_{s}") for s in sides])
    out = shared.select(
        "doc_id", "pos", "particulars", "hsn", F.col("left").alias("taxable"), *[
            money(F.when(F.col("pos") == F.col("last"), tax("net", s) - (F.col(f"_sum_{s}") - F.col(f"_{s}")))
                  .otherwise(F.col(f"_{s}"))).alias(s) for s in sides])
    return out.withColumn("total", money(F.col("taxable") + F.col("cgst") + F.col("sgst") + F.col("igst")))


# Credit-note labels, known codes in search order, and the code behind a section name.
NOTE_FIELDS = {
    "credit_note_no": r"Credit Note Number\s*:?\s*\n?\s*(\S+)",
    "note_date": r"Credit Note Number\s*:?\s*\S+\s*Date:\s*\n?\s*(\d{1,2}-\d{1,2}-\d{2,4})",
    "party_name": r"Bill To:\s*\n?\s*([^\n]+)",
    "original_invoice_no": r"Original Invoice Number\s*:?\s*\n?\s*(\S+)",
    "original_invoice_date": r"Original Invoice Date:\s*\n?\s*(\d{1,2}-\d{1,2}-\d{2,4})",
    "reason": r"Reason for Credit Note:\s*\n?\s*([^\n]+)",
}
NOTE_HSN = ("9971", "997319", "998599", "998529", "998313")
NOTE_SECTION_HSN = {
    "soundbox": "997319", "saas": "9971", "application": "9971", "upi 2.0": "998599", "upi2": "998599",
    "transactional": "998599", "promotional": "998599", "kyc": "998529", "core banking": None, "cbs": None,
    "late fee": None, "late payment": None, "late charges": None, "ad hoc": None,
}


def credit_notes(documents: DataFrame) -> DataFrame:
    """Credit notes among the documents with their fields, amounts (positive) and HSN."""
    body = F.col("text")
    rows = documents.filter(body.contains("Credit Note Number"))
    at = F.instr(body, "Subtotal")
    table = F.when(at > 1, F.substring(body, F.lit(1), at - 1)).otherwise(body)
    section = F.lower(F.trim(F.regexp_replace(
        F.regexp_extract(table, r"(?s)Total\s+[A-J]\s+(.+?)\s+[\d,]", 1), r"\s+", " ")))
    by_section = F.when(F.lit(False), F.lit(""))
    for word, code in NOTE_SECTION_HSN.items():
        by_section = by_section.when(section.contains(word), code or NOT_SPECIFIED_HSN)
    by_code = F.when(F.lit(False), F.lit(""))
    for code in NOTE_HSN:
        by_code = by_code.when(table.contains(code), code)

    def taxed(side: str, group: int) -> Column:
        # the last mention counts, as each one overwrites the one before
        return F.regexp_extract(
            body, rf"(?s).*{side}\s*@\s*([\d.]+)%\s*\n?\s*(-|[\d,]+\.\d{{2}})", group)

    party = F.trim(F.regexp_replace(
        F.regexp_replace(_grab(body, NOTE_FIELDS["party_name"]), r"\s*Original Invoice Number.*$", ""), r"\s+", " "))
    out = rows.select(
        "doc_id", *[F.trim(_grab(body, p)).alias(n) for n, p in NOTE_FIELDS.items() if n != "party_name"],
        party.alias("party_name"),
        zero_if_null(_amount(_grab(body, r"Subtotal:\s*\n?\s*([\d,]+\.\d{2})"))).alias("taxable"),
        zero_if_null(_amount(_grab(body, r"Rounding off\s*:?\s*\n?\s*(-?[\d,]+\.\d{2})"))).alias("round_off"),
        *[zero_if_null(taxed(s.upper(), 1).try_cast("double")).alias(f"{s}_rate") for s in ("cgst", "sgst", "igst")],
        *[zero_if_null(_amount(taxed(s.upper(), 2))).alias(s) for s in ("cgst", "sgst", "igst")],
        _amount(_grab(body, r"([\d,]+\.\d{2})\s*\n?\s*Indian Rupees")).alias("printed_total"),
        F.coalesce(by_section, by_code, F.lit(NOT_SPECIFIED_HSN)).alias("hsn"))
    built = F.col("taxable") + F.col("cgst") + F.col("sgst") + F.col("igst") + F.col("round_off")
    return out.withColumn("total", money(F.coalesce("printed_total", built))).drop("printed_total")


def document_numbers(documents: DataFrame) -> DataFrame:
    """The document's own number: a credit note's first, else the invoice header's."""
    body = F.col("text")
    note = F.when(body.contains("Credit Note Number"), F.trim(_grab(body, NOTE_FIELDS["credit_note_no"])))
    header = F.when(~body.contains("Credit Note Number"), F.trim(_grab(body, HEADER_BLOCK, 3)))
    return documents.select("doc_id", F.coalesce(note, header).alias("doc_no"),
                            body.contains("Credit Note Number").alias("is_note"))


def audit_fields(documents: DataFrame) -> DataFrame:
    """Header, customer, HSN and narration as the audit workbook shows them."""
    body = F.col("text")
    date = F.coalesce(
        _grab(body, r"(?i)Date of Invoice[:\s]*\n?\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"),
        _grab(body, r"(?i)(?:Date|Dated)[:\s]*(\d{1,2}[-/\s][A-Za-z]{3,9}[-/\s]\d{2,4}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"))
    labels = F.array_compact(F.array(*[
        F.when(amount > 0, F.lit(label)) for amount, (_, label, _) in zip(_section_amounts(body), SECTIONS)]))
    # a column of its own: it is used twice, and put in place the sections were looked for each time
    rows = documents.select("doc_id", "text", labels.alias("labels"))
    taxable = F.regexp_extract(_behind(F.regexp_replace("text", r"[ \t]+", " "), "Taxable Value", "Central Tax"), SUMMARY_ROW, 1)
    none = F.size("labels") == 0
    billed = F.when(none & (zero_if_null(_amount(taxable)) > 0), F.array(F.lit(DEFAULT_SECTION[0]))).otherwise(F.col("labels"))
    return rows.select(
        "doc_id", _grab(body, r"(?i)Invoice\s*(?:No|Number|#)[:\s]*([A-Z0-9/_-]{4,30})").alias("invoice_no"),
        F.trim(date).alias("voucher_date"),
        _grab(body, r"\b(\d{2}[A-Z]{5}\d{4}[A-Z]{1}\d{1}[Z]{1}[A-Z0-9]{1})\b").alias("party_gstin"),
        F.trim(F.regexp_replace(_grab(body, r"(?s)Customer Name:\s*\n?\s*(.+?)\s*\n?\s*Billing Month"), r"\s+", " "))
        .alias("customer_name"),
        _grab(F.regexp_replace("text", r"[ \t]+", " "), r"(?i)(?:HSN|SAC)[/\s]*(?:Code|No)?[:\s]*(\d{4,8})").alias("hsn"),
        F.array_join(billed, "; ").alias("narration"))


# Names a bank's statement carries, compared without case.
BANKS = {
    "ICICI": ["Transactions at a Glance", "ICICI Bank", "Transaction Statement"],
    "HDFC": ["Transaction Statement", "HDFC Bank", "Account Statement"],
    "Axis": ["Transaction Details", "Axis Bank", "Account Transactions"],
    "Kotak": ["Transaction List", "Kotak Mahindra", "Transaction Report"],
    "SBI": ["SBI", "State Bank", "Transaction"],
    "CANARA": ["Canara Bank", "Account Statement"],
    "BOI": ["Bank of India", "Transaction Statement"],
    "PNB": ["Punjab National Bank", "Account Statement"],
    "UNION": ["Union Bank", "Transaction Statement"],
}


def bank_of(c: Column) -> Column:
    """struct(bank, confidence): the bank with the largest share of its names present, the first of equals."""
    low = F.lower(F.coalesce(c, F.lit("")))
    shares = []
    for i, (bank, names) in enumerate(BANKS.items()):
        hits = sum((low.contains(n.lower()).cast("int") for n in names[1:]), low.contains(names[0].lower()).cast("int"))
        shares.append(F.struct((hits / len(names)).alias("confidence"), F.lit(-i).alias("place"), F.lit(bank).alias("bank")))
    best = F.array_max(F.array(*shares))
    return F.struct(F.when(best["confidence"] > 0, best["bank"]).otherwise("UNKNOWN").alias("bank"),
                    best["confidence"].alias("confidence"))


def transaction_confidence(date: Column, narration: Column, *amounts: Column) -> Column:
    def valid(a: Column) -> Column:
        t = F.lower(F.trim(a))
        return ~t.isin("nan", "none", "", "0", "0.00") & F.regexp_replace(t, "[, ]", "").try_cast("double").isNotNull()

    has_amount = F.lit(False)
    for a in amounts:
        has_amount = has_amount | F.coalesce(valid(a), F.lit(False))
    dated = first_date_in(date).isNotNull()
    told = ~F.lower(as_text(narration)).isin("nan", "none", "")
    return F.when(dated & told & has_amount, "SURE").when(dated & has_amount, "PROBABLE").otherwise("UNCERTAIN")


def bank_transactions(documents: DataFrame, confidence: str | None = None) -> DataFrame:
    """Statement lines that carry a date: up to three amounts at the end, the rest is narration."""
    rows = documents.select("doc_id", bank_of(F.col("text"))["bank"].alias("bank"), F.split("text", "\n").alias("lines"))
    lines = rows.select("doc_id", "bank", F.posexplode("lines").alias("line_no", "line")).withColumn("line", F.trim("line"))
    dated = lines.withColumn("date", first_date_in(F.col("line"))).filter(F.col("date").isNotNull())
    rest = F.trim(F.replace("line", F.col("date"), F.lit("")))
    split = dated.withColumn("tokens", F.filter(F.split(rest, r"\s+"), lambda t: t != ""))

    def from_end(i: int) -> Column:
        return F.coalesce(F.try_element_at(F.col("tokens"), F.lit(-i)), F.lit(""))

    def bare(token: Column) -> Column:
        return F.btrim(token, F.lit("crCRdrDR₹|"))

    def is_amount(token: Column) -> Column:
        return bare(token).rlike(r"^[\-\+]?[\d,\.]+$") & bare(token).rlike(r"\d")

    n = F.when(~is_amount(from_end(1)), 0).when(~is_amount(from_end(2)), 1).when(~is_amount(from_end(3)), 2).otherwise(3)
    counted = split.withColumn("n", n)
    words = F.array_join(F.slice("tokens", F.lit(1), F.size("tokens") - F.col("n")), " ")
    count = F.col("n")
    out = counted.select(
        "doc_id", "line_no", sanitize_date(F.col("date")).alias("date"),
        sanitize_text(F.coalesce(blank_to_null(words), F.lit("BANK TRANSACTION"))).alias("narration"),
        F.when(count == 2, sanitize_amount(from_end(2))).when(count == 3, sanitize_amount(from_end(3))).otherwise("").alias("debit"),
        F.when(count == 3, sanitize_amount(from_end(2))).otherwise("").alias("credit"),
        F.when(count > 0, sanitize_amount(from_end(1))).otherwise("").alias("balance"), "bank",
        *[F.when(count >= i, bare(from_end(i))).alias(f"_{i}") for i in (1, 2, 3)])
    # amounts count as printed: one marked Cr or Dr has no place in a column, but the line has an amount
    scored = out.withColumn("confidence", transaction_confidence(
        F.col("date"), F.col("narration"), F.col("_1"), F.col("_2"), F.col("_3"))).drop("_1", "_2", "_3")
    return scored if confidence is None else scored.filter(F.col("confidence") == confidence)


# Patterns of the fast pass; a number is taken whole, however long.
FAST_GSTIN = r"\b(0[1-9]|[12]\d|3[0-8])[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b"
FAST_IRN = r"\b([a-fA-F0-9]{64})\b"
FAST_NUMBER = (
    r"(?i)(?:Invoice|Inv|Bill|Debit\s*Note|Credit\s*Note|Tax\s*Invoice|Proforma)[\s.]*(?:No|Number|#|Ref)?[\s.:#-]*"
    r"([A-Za-z0-9][A-Za-z0-9\-/\\]*)\b")


def fast_extract(documents: DataFrame) -> DataFrame:
    """Distinct GSTINs, IRNs and invoice numbers of a text, and the first of each."""
    body = F.coalesce("text", F.lit(""))
    numbers = F.array_distinct(F.regexp_extract_all(body, F.lit(FAST_NUMBER), F.lit(1)))
    out = documents.select(
        "doc_id", F.array_distinct(F.regexp_extract_all(F.upper(body), F.lit(FAST_GSTIN), F.lit(0))).alias("gstins"),
        F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(FAST_IRN), F.lit(1)), F.lower)).alias("irns"),
        F.filter(numbers, lambda v: F.length(v) >= 2).alias("numbers"))
    return out.withColumns({n: F.try_element_at(F.col(c), F.lit(1)) for n, c in
                            (("gst_no", "gstins"), ("irn", "irns"), ("supplier_inv", "numbers"))})


def seller_gstin(body: Column, buyers: Column) -> Column:
    """The first GSTIN of a text that is not one of the buyers', or ''."""
    from ..functions.ids import GSTIN_IN_TEXT
    found = F.regexp_extract_all(F.upper(F.coalesce(body, F.lit(""))), F.lit(GSTIN_IN_TEXT), F.lit(0))
    others = F.filter(found, lambda g: ~F.array_contains(buyers, g))
    return F.coalesce(F.try_element_at(others, F.lit(1)), F.lit(""))


def vendor_profile(body: Column, profiles: list[dict]) -> Column:
    """Name of the first profile whose GSTIN is in the text, else of the first whose prefix is.

    Profiles are configuration, a handful of them, and become one expression without a join.
    """
    up = F.upper(F.coalesce(body, F.lit("")))
    chain = F.when(F.lit(False), F.lit(""))
    for p in profiles:
        if p.get("gstin"):
            chain = chain.when(up.contains(p["gstin"].upper()), p["name"])
    for p in profiles:
        raw = p.get("invoice_number_prefix") or []
        prefixes = [x.upper() for x in ([raw] if isinstance(raw, str) else raw) if x]
        if prefixes:
            chain = chain.when(any_contains(up, prefixes), p["name"])
    return chain


def certificates(documents: DataFrame) -> DataFrame:
    """Number, name, activity and type of an enterprise registration certificate."""
    body = F.coalesce("text", F.lit(""))
    patterns = (
        r"(?i)Name of Enterprise\s*:\s*([^\n]+)", r"(?i)Name of the Enterprise\s*:\s*([^\n]+)",
        r"(?i)NAME OF ENTERPRISE\s+([^\n]+)", r"(?i)M/s\s*:\s*([^\n]+)", r"(?i)M/S\s+([^\n]+)")
    raw = F.coalesce(*[F.nullif(F.regexp_extract(body, p, 1), F.lit("")) for p in patterns])
    name = F.trim(F.try_element_at(F.split(F.trim(raw), r"[:\t\r]"), F.lit(1)))
    kind = F.coalesce(
        _grab(F.get(F.split(body, r"(?i)Enterprise Type|Classification|Category", 2), F.lit(1)), r"(?i)\b(micro|small|medium|large)\b"),
        _grab(body, r"(?i)\b(micro|small|medium|large)\b"))
    return documents.select(
        "doc_id", F.coalesce(F.upper(_grab(body, r"(?i)\b(UDYAM-[A-Z]{2}-\d{2}-\d{7})\b")), F.lit("UNKNOWN")).alias("udyam_number"),
        F.coalesce(name, F.lit("UNKNOWN VENDOR")).alias("enterprise_name"),
        F.coalesce(F.initcap(_grab(body, r"(?i)\b(manufacturing|services)\b")), F.lit("Services")).alias("major_activity"),
        F.coalesce(F.upper(kind), F.lit("UNKNOWN")).alias("enterprise_type"))
