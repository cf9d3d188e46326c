"""Sales and purchase registers, TDS workings, matching sheet and ITC summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.common import any_contains, money, text, zero_if_null
from ..functions.itc import CATEGORIES
from ..functions.tax import TDS_THRESHOLD, TOL_MATCHING_SHEET, dec

KEYS = ["invoice_no", "voucher_date", "party_gstin", "party_ledger_name", "place_of_supply"]
SUMS = ["taxable_value", "discount", "advances", "sgst_amount", "cgst_amount", "igst_amount",
        "total_invoice_value"]
PLACEHOLDER = "Unallocated / Missing Lines"
BETWEEN = " | "
PART_CHARS = 1 << 20
# Words that make a service professional for TDS purposes.
PROFESSIONAL_WORDS = ("professional", "technical", "consulting", "audit", "legal", "management")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Lines without exact copies; of copies the earliest keeps its place."""
    columns = [*KEYS, "gstr1_category", *SUMS, "particulars", "narration", "hsn"]
    return lines.groupBy(*columns).agg(F.min("seq").alias("seq"))


def _part() -> Column:
    part = F.trim("particulars")
    return F.when((part != "") & (part != PLACEHOLDER), part)


def _names(distinct: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names of invoices as rows (KEYS, part, seq), of those with up to ``size`` characters and of the others; keys of the latter."""
    names = distinct.groupBy(*KEYS, _part().alias("part")).agg(F.min("seq").alias("seq")).where(F.col("part").isNotNull())
    chars = names.groupBy(*KEYS).agg(F.sum(F.length("part") + len(BETWEEN)).alias("chars"))
    large = chars.where(F.col("chars") > size).select(*[F.col(k).alias(f"_{k}") for k in KEYS])
    same = F.lit(True)
    for k in KEYS:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return names.join(large, same, "left_anti"), names.join(large, same, "left_semi"), large


def _joined() -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("seq", "part")))
    return F.array_join(F.transform(ordered, lambda x: x["part"]), BETWEEN)


def register_names(lines: DataFrame, size: int = PART_CHARS) -> DataFrame:
    """(KEYS, part_no, particulars): all names of every invoice in parts of about ``size`` characters, more only for a longer name.

    Read by ascending ``part_no``, which has gaps, the parts hold the names in the order of their first lines. Invoices
    with more names than one part holds are dealt out by ranges of ``seq``, so that no task has all of one invoice.
    """
    few, many, _ = _names(distinct_lines(lines), size)
    whole = few.groupBy(*KEYS).agg(_joined().alias("particulars")).select(*KEYS, F.lit(0).cast("long").alias("part_no"), "particulars")
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = many.repartitionByRange(n, *KEYS, "seq", "part").withColumn("chunk", F.spark_partition_id())
    so_far = Window.partitionBy("chunk", *KEYS).orderBy("seq", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chars = F.length("part") + len(BETWEEN)
    placed = dealt.withColumn("sub", F.floor((F.sum(chars).over(so_far) - chars) / size).cast("long"))
    cut = placed.groupBy("chunk", *KEYS, "sub").agg(_joined().alias("particulars"))
    number = F.shiftleft(F.col("chunk").cast("long"), 32) + F.col("sub")
    return whole.unionByName(cut.select(*KEYS, number.alias("part_no"), "particulars"))


def sales_register(lines: DataFrame, round_off: Column | None = None, size: int = PART_CHARS) -> DataFrame:
    """One row per invoice and category; missing keys form groups of their own.

    ``particulars`` holds all names of the invoice. Where they have more than ``size`` characters it is NULL,
    ``names_apart`` is true, and all of them are rows of ``register_names``.
    """
    first = F.when(F.col("narration").isNotNull(), F.struct("seq", "narration"))
    # one shuffle, by invoice: copies, names, sums and what all categories of an invoice share are then found where its lines are,
    # sorted and spilled if there are many, and no more names are gathered than one cell may hold
    used = lines.select(*KEYS, "gstr1_category", *SUMS, "particulars", "narration", "hsn", "seq").repartition(*KEYS)
    distinct = distinct_lines(used).withColumn("part", _part())
    named = distinct.withColumn("new", F.col("part").isNotNull() & (
        F.row_number().over(Window.partitionBy(*KEYS, "part").orderBy("seq")) == 1))
    so_far = Window.partitionBy(*KEYS).orderBy("seq", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = named.withColumn("chars", F.sum(F.when(F.col("new"), F.length("part") + len(BETWEEN)).otherwise(0)).over(so_far))
    sums = named.groupBy(*KEYS, "gstr1_category").agg(
        *[money(F.sum(c)).alias(c) for c in SUMS], F.min("hsn").alias("low"), F.max("hsn").alias("high"), F.min(first).alias("first"),
        F.max("chars").alias("chars"), F.collect_list(F.when(F.col("new") & (F.col("chars") <= size), F.struct("seq", "part"))).alias("names"))
    invoice = Window.partitionBy(*KEYS)
    shared = sums.select(
        *KEYS, "gstr1_category", *SUMS, F.min("low").over(invoice).alias("low"), F.max("high").over(invoice).alias("high"),
        F.min("first").over(invoice)["narration"].alias("nature"), (F.max("chars").over(invoice) > size).alias("names_apart"),
        F.flatten(F.collect_list("names").over(invoice)).alias("names"))
    texts = F.array_join(F.transform(F.array_sort("names"), lambda x: x["part"]), BETWEEN)
    return shared.select(
        *KEYS, "gstr1_category", *SUMS, F.when(F.col("low") == F.col("high"), F.col("low")).alias("hsn"), "nature",
        F.when(~F.col("names_apart") & (F.size("names") > 0), texts).alias("particulars"), "names_apart",
        money(round_off if round_off is not None else F.lit(0)).alias("round_off"))


def _tax() -> Column:
    return sum((zero_if_null(F.col(c)) for c in ("sgst_amount", "igst_amount")),
               zero_if_null(F.col("cgst_amount")))


def gst_type() -> Column:
    taxable, igst = zero_if_null(F.col("taxable_value")), zero_if_null(F.col("igst_amount"))
    sides = (zero_if_null(F.col("cgst_amount")) > 0) | (zero_if_null(F.col("sgst_amount")) > 0)
    return (
        F.when((_tax() == 0) & (taxable > 0), "Export LUT").when(igst > 0, "Interstate")
        .when(sides, "Intrastate").otherwise("Exempt/Zero-rated")
    )


def tds_workings(register: DataFrame) -> DataFrame:
    """GST routing and the TDS section, rate, amount and net receivable per register row."""
    taxable = zero_if_null(F.col("taxable_value"))
    category = F.upper(F.coalesce(F.col("gstr1_category"), F.lit("")))
    exempt = category.isin("EXP", "B2CS") | (taxable < TDS_THRESHOLD)
    professional = any_contains(F.lower(F.coalesce(F.col("nature"), F.lit(""))), PROFESSIONAL_WORDS)
    rate = F.when(exempt, dec("0.00")).when(professional, dec("10.00")).otherwise(dec("2.00"))
    kind = F.col("gst_type")
    return (
        register.withColumn("gst_type", gst_type())
        .select(
            *register.columns, "gst_type",
            F.when(kind == "Intrastate", 9.0).otherwise(0.0).alias("cgst_rate"),
            F.when(kind == "Interstate", 18.0).otherwise(0.0).alias("igst_rate"),
            money(_tax()).alias("total_tax"),
            F.when(kind == "Export LUT", "zero-rated, letter of undertaking")
            .when(kind == "Interstate", F.concat(F.lit("IGST only, "), category))
            .when(kind == "Intrastate", F.concat(F.lit("CGST and SGST, "), category))
            .otherwise(F.concat(F.lit("zero-rated or exempt, "), category)).alias("routing_rule"),
            F.when(exempt, "No").otherwise("Yes").alias("tds_applicable"),
            F.when(exempt, "–").when(professional, "194J").otherwise("194C").alias("tds_section"),
            rate.cast("double").alias("tds_rate"),
            money(F.round(taxable * rate * dec("0.01"), 2)).alias("tds_deducted"),
        )
        .withColumn("net_receivable", money(taxable - F.col("tds_deducted")))
    )


def matching_sheet(register: DataFrame, tolerance=TOL_MATCHING_SHEET) -> DataFrame:
    """Printed against computed total; untaxed export rows are exempt."""
    taxable, total = zero_if_null(F.col("taxable_value")), zero_if_null(F.col("total_invoice_value"))
    computed = taxable + _tax() + zero_if_null(F.col("round_off"))
    export = (_tax() == 0) & (taxable > 0)
    return register.select(
        *register.columns, money(_tax()).alias("total_tax"), money(computed).alias("computed_total"),
        money(F.when(export, 0).otherwise(F.abs(total - computed))).alias("variance"),
    ).withColumn(
        "match_status",
        F.when((F.col("total_tax") == 0) & (taxable > 0), "PASS – Export LUT")
        .when(F.col("variance") <= dec(tolerance), "PASS")
        .otherwise(F.concat(F.lit("REVIEW – Variance ₹"), F.col("variance").cast("string"))),
    )


PURCHASE_KEYS = ["invoice_no", "party_ledger_name", "particulars", "taxable_value"]


def purchase_register(lines: DataFrame) -> DataFrame:
    """First line per (number, party, particulars, amount) with its credit eligibility."""
    rest = [c for c in lines.columns if c not in PURCHASE_KEYS]
    given = [F.when(text(F.col(c)) != "", F.col(c)) for c in ("itc_category", "itc_eligibility")
             if c in lines.columns]
    first = lines.groupBy(*PURCHASE_KEYS).agg(F.min_by(F.struct(*rest), "seq").alias("row"))
    flat = first.select(*PURCHASE_KEYS, "row.*")
    return flat.withColumn("itc_status", F.coalesce(*given, F.lit("ITC_UNKNOWN")))


def itc_summary(register: DataFrame, status: str = "itc_status") -> DataFrame:
    """The five categories and TOTAL, always six rows, from one aggregation."""
    label = F.coalesce(F.col(status), F.lit("ITC_UNKNOWN"))
    amount = zero_if_null(F.col("taxable_value"))
    sums = register.agg(
        *[money(zero_if_null(F.sum(F.when(label == c, amount)))).alias(f"a_{c}") for c in CATEGORIES],
        *[F.count(F.when(label == c, 1)).alias(f"n_{c}") for c in CATEGORIES],
        money(zero_if_null(F.sum(amount))).alias("a_TOTAL"), F.count(F.lit(1)).alias("n_TOTAL"),
    )
    risk = {
        "ITC_BLOCKED": F.col("a_ITC_BLOCKED"), "ITC_RESTRICTED": F.col("a_ITC_RESTRICTED"),
        "TOTAL": F.col("a_TOTAL") - F.col("a_ITC_ELIGIBLE"),
    }
    return sums.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("category"), F.col(f"a_{c}").alias("taxable_amount"),
            F.col(f"n_{c}").alias("line_items"), money(risk.get(c, F.lit(0))).alias("itc_at_risk"),
        ) for c in (*CATEGORIES, "TOTAL")
    ])))


def audit_batch_summary(rows: DataFrame) -> DataFrame:
    """Counts by status, accuracy and sums of an audit workbook."""
    n = {s: F.count(F.when(F.col("status") == s, 1)) for s in ("PASS", "WARN", "ERR")}
    return rows.agg(
        F.count(F.lit(1)).alias("total_invoices"), *[c.alias(f"n_{s.lower()}") for s, c in n.items()],
        F.round(F.try_divide(n["PASS"] * 100.0, F.count(F.lit(1))), 1).alias("accuracy_pct"),
        money(F.sum("taxable_value")).alias("total_taxable"),
        money(F.sum("total_invoice_value")).alias("total_value"),
    )


def batch_strip(lines: DataFrame) -> DataFrame:
    """Headline figures of a batch: lines, taxable, tax, value and zero-tax lines."""
    return lines.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_lines"), money(F.sum("taxable_value")).alias("taxable"),
        money(F.sum(_tax())).alias("tax"), money(F.sum("total_invoice_value")).alias("value"),
        F.count(F.when((_tax() == 0) & (F.col("taxable_value") > 0), 1)).alias("zero_tax"),
    )
