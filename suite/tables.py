"""Driver tables as invoice tables: sales lines, purchase books, 2B statement, client sheet.

Only the joins a query needs are made. ``seq`` is a struct that sorts in arrival order, so no
global row number (and hence no single-task window) is ever computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from khata.functions.common import money
from khata.functions.ids import normalize_id
from khata.functions.tax import dec, keep_or_classify, return_category

FIRM_STATE = "07"
FIRM_GSTIN = "07AABCF0001A1Z5"
B2CL_THRESHOLD = 50000
REGISTRATIONS = {"MH": "27AABCM0001A1Z5", "HR": "06AABCH0001A1Z5"}

# Unique on every data set and a total order of arrival.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digits(c: Column, width: int) -> Column:
    """Zero-padded to ``width``, never cut."""
    s = c.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0"))


def gstin(state: Column, key: Column) -> Column:
    letter = F.char((F.lit(65) + F.pmod(F.floor(key / 10000), F.lit(26))).cast("int"))
    plain = F.concat(state, F.lit("AABC"), letter, digits(key % 10000, 4), F.lit("A1Z5"))
    odd = F.lower(F.concat(F.substring(plain, 1, 2), F.lit("-"), F.substring(plain, 3, 20)))
    return F.when(key % 5 == 0, F.lit(None)).when(key % 7 == 0, odd).otherwise(plain)


def state_of(nation: Column) -> Column:
    return F.lpad((nation + 1).cast("string"), 2, "0")


def date_text(d: Column, key: Column) -> Column:
    return (
        F.when(key % 4 == 0, F.date_format(d, "dd-MM-yyyy"))
        .when(key % 4 == 1, F.date_format(d, "dd/MM/yyyy"))
        .when(key % 4 == 2, F.date_format(d, "yyyy-MM-dd"))
        .otherwise(F.date_format(d, "dd-MMM-yyyy"))
    )


def _amounts(lines: DataFrame) -> DataFrame:
    """Gross, taxable, GST rate and taxes of a line whose party sits in ``party_state``."""
    steps = F.round(F.col("l_tax") * 100).cast("int")

    def by_steps(*values) -> Column:
        nil, low, middle, high, top = values
        return F.when(steps == 0, nil).when(steps <= 2, low).when(steps <= 4, middle).when(steps <= 7, high).otherwise(top)

    home = F.col("party_state") == FIRM_STATE
    gross = F.col("l_extendedprice").cast("decimal(12,2)")
    # the taxes' factors are exact decimals of a few digits, so products stay within 18 digits
    out = lines.select(
        "*", gross.alias("gross"), by_steps(0, 5, 12, 18, 28).cast("decimal(2,0)").alias("pct"), home.alias("home"),
        F.round(gross * (1 - F.col("l_discount").cast("decimal(4,2)")), 2)
        .cast("decimal(12,2)").alias("taxable"),
        by_steps(*map(dec, ("0.000", "0.025", "0.060", "0.090", "0.140"))).alias("half_rate"),
        by_steps(*map(dec, ("0.00", "0.05", "0.12", "0.18", "0.28"))).alias("full_rate"),
    )
    half = F.round(F.col("taxable") * F.col("half_rate"), 2)
    full = F.round(F.col("taxable") * F.col("full_rate"), 2)
    nothing = F.lit(0)
    return out.select(
        "*",
        money(F.when(F.col("home"), half).otherwise(nothing)).alias("cgst"),
        money(F.when(F.col("home"), half).otherwise(nothing)).alias("sgst"),
        money(F.when(F.col("home"), nothing).otherwise(full)).alias("igst"),
        F.when(F.col("home"), half + half).otherwise(full).alias("tax"),
    )


HSN_OF_TYPE = {
    "ECONOMY": "8471", "SMALL": "9971", "MEDIUM": "998599", "PROMO": "3304",
    "STANDARD": "997319", "LARGE": "8703",
}


def _hsn(ptype: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for name, code in HSN_OF_TYPE.items():
        chain = chain.when(ptype == name, code)
    return chain


def _heads(orders: DataFrame) -> DataFrame:
    """Header attributes, worked out once per order and not once per line."""
    okey = F.col("okey")
    original = F.concat(
        F.when(okey % 17 == 0, "OX").when(okey % 2 == 0, "MH").otherwise("HR"), digits(okey, 7)
    )
    return orders.select(
        "*", F.concat(F.lit("B"), F.date_format("o_orderdate", "yyyyMM")).alias("batch_id"),
        date_text(F.col("o_orderdate"), okey).alias("voucher_date"),
        original.alias("original_no"), digits(okey, 7).alias("order_digits"),
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("okey"), F.col("o_custkey").alias("ckey"), "o_orderdate")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, state = F.col("c_custkey"), state_of(F.col("c_nationkey"))
    pos = (
        F.when(key % 23 == 0, "OUTSIDE INDIA").when(key % 3 == 0, F.lit(None))
        .when(key % 3 == 1, state).otherwise(F.concat(state, F.lit("-State")))
    )
    return read(spark, sf_dir, "customer").select(
        key.alias("ckey"), F.col("c_name").alias("party_ledger_name"),
        F.col("c_mktsegment").alias("tenant_id"), state.alias("party_state"),
        gstin(state, key).alias("party_gstin"), pos.alias("place_of_supply"),
    )


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, state = F.col("s_suppkey"), state_of(F.col("s_nationkey"))
    given = (
        F.when(key % 6 == 0, "YES").when(key % 6 == 1, "eligible").when(key % 6 == 2, "PARTIAL")
        .when(key % 6 == 3, "NIL_RATED").when(key % 6 == 4, "no")
    )
    return read(spark, sf_dir, "supplier").select(
        key.alias("skey"), F.col("s_name").alias("party_ledger_name"), state.alias("party_state"),
        gstin(state, key).alias("party_gstin"), given.alias("itc_category"),
    )


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("item"),
        _hsn(F.col("p_type")).alias("hsn"),
    )


def _with_parts(rows: DataFrame, spark: SparkSession, sf_dir: str, part: bool) -> DataFrame:
    if part:
        return rows.join(_parts(spark, sf_dir), "l_partkey")
    return rows.select("*", F.lit("item").alias("item"), F.lit(None).cast("string").alias("hsn"))


def sales_lines(spark: SparkSession, sf_dir: str, part: bool = True) -> DataFrame:
    """Outward supplies: every lineitem row, sold to the customer of its order.

    Customers are joined to orders first: lines, of which there are many more, are then shuffled once for both. Orders get their texts
    behind that join and lines their parts before the other, so that neither is shuffled with more columns than it comes with.
    """
    heads = _heads(_orders(spark, sf_dir).join(_customers(spark, sf_dir), "ckey"))
    items = _with_parts(read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "okey"), spark, sf_dir, part)
    rows = _amounts(items.join(heads, "okey"))
    okey, line = F.col("okey"), F.col("l_linenumber")
    credit = F.col("l_returnflag") == "R"
    debit = (F.col("l_returnflag") == "A") & (line == 7)
    original = F.col("original_no")
    built = F.col("taxable") + F.col("tax")
    total = F.when(okey % 37 == 0, 0).when(okey % 41 == 0, built + 5).otherwise(built)
    paise = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    unit_price = F.floor(paise / F.col("l_quantity").cast("bigint"))
    lines = rows.select(
        F.struct(F.col("okey").alias("l_orderkey"), *LINE_ORDER[1:]).alias("seq"),
        okey.cast("string").alias("task_id"), "batch_id", "tenant_id", "voucher_date",
        F.when(credit, "Credit Note").when(debit, "Debit Note").otherwise("Sales").alias("voucher_type"),
        F.when(credit, F.concat(F.lit("CR"), "order_digits"))
        .when(debit, F.concat(F.lit("DN"), "order_digits")).otherwise(original).alias("invoice_no"),
        "party_ledger_name", "party_gstin", "place_of_supply",
        F.when(credit | debit, F.concat("item", F.lit(" (against "), original, F.lit(")")))
        .otherwise(F.col("item")).alias("particulars"),
        "hsn", F.col("l_quantity").alias("qty"), line.cast("bigint").alias("line"),
        F.when(line % 3 == 0, F.col("pct").cast("double"))
        .otherwise((unit_price.cast("decimal(18,0)") * dec("0.01")).cast("double")).alias("rate"),
        money(F.col("taxable")).alias("taxable_value"),
        money(F.col("gross") - F.col("taxable")).alias("discount"),
        money(F.when((line == 1) & (okey % 50 == 0), 10).otherwise(0)).alias("advances"),
        F.col("cgst").alias("cgst_amount"), F.col("sgst").alias("sgst_amount"),
        F.col("igst").alias("igst_amount"), money(total).alias("total_invoice_value"),
        F.when((F.col("pct") == 0) & (line % 2 == 0), "NIL_EXEMPT").alias("raw_category"),
        F.when(okey % 6 == 0, "professional services").when(okey % 6 == 1, "supply").alias("narration"),
        "o_orderdate", "okey", "ckey", "party_state", "original_no", "gross", "pct",
    )
    classified = return_category(
        F.col("party_gstin"), F.col("voucher_type"), F.col("particulars"), F.col("place_of_supply"),
        F.col("raw_category"), F.col("total_invoice_value"), FIRM_STATE, threshold=B2CL_THRESHOLD,
    )
    return lines.withColumn("gstr1_category", keep_or_classify(F.col("raw_category"), classified))


def purchase_lines(spark: SparkSession, sf_dir: str, part: bool = True) -> DataFrame:
    """Inward supplies: lineitem rows flagged N, bought from their supplier."""
    items = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").withColumnsRenamed({"l_orderkey": "okey", "l_suppkey": "skey"})
    items = _with_parts(items, spark, sf_dir, part)
    rows = _amounts(items.join(_heads(_orders(spark, sf_dir)), "okey").join(_suppliers(spark, sf_dir), "skey"))
    return rows.select(
        F.struct(F.col("okey").alias("l_orderkey"), *LINE_ORDER[1:]).alias("seq"),
        F.col("okey").cast("string").alias("task_id"), "batch_id", "voucher_date",
        F.lit("Purchase").alias("voucher_type"),
        F.concat(F.lit("PI/"), "order_digits", F.lit("/"), F.col("skey").cast("string"))
        .alias("invoice_no"),
        "party_ledger_name", "party_gstin", F.col("party_state").alias("place_of_supply"),
        F.col("item").alias("particulars"), "hsn",
        F.col("l_quantity").alias("qty"), F.col("pct").cast("double").alias("rate"),
        money(F.col("taxable")).alias("taxable_value"),
        F.col("cgst").alias("cgst_amount"), F.col("sgst").alias("sgst_amount"),
        F.col("igst").alias("igst_amount"),
        money(F.col("taxable") + F.col("tax")).alias("total_invoice_value"),
        "itc_category", F.lit(None).cast("string").alias("narration"),
        "o_orderdate", F.col("l_shipdate").alias("pay_date"), "okey", "skey",
    )


def statement_2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2B statement: books per invoice, perturbed in known ways, plus records of other sales."""
    li = read(spark, sf_dir, "lineitem").filter(
        "l_returnflag = 'N' OR (l_returnflag = 'A' AND l_orderkey % 25 = 0)"
    ).withColumnsRenamed({"l_orderkey": "okey", "l_suppkey": "skey"})
    supp = _suppliers(spark, sf_dir).select(
        "skey", "party_state", normalize_id(F.col("party_gstin")).alias("gstin")
    )
    rows = _amounts(li.join(supp, "skey"))
    per_invoice = rows.groupBy("l_returnflag", "okey", "skey", "gstin").agg(
        *[money(F.sum(c)).alias(c) for c in ("taxable", "igst", "cgst", "sgst")]
    )
    okey, skey = F.col("okey"), F.col("skey")
    own = F.col("l_returnflag") == "N"
    m = F.when(own, (okey * 31 + skey) % 20).otherwise(-1)
    body = F.concat(digits(okey, 7), F.lit("/"), skey.cast("string"))
    number = (
        F.when(~own, F.concat(F.lit("EXT/"), body)).when(m == 3, body)
        .otherwise(F.concat(F.lit("PI/"), body))
    )
    built = F.col("taxable") + F.col("igst") + F.col("cgst") + F.col("sgst")
    total = F.when(m == 1, built + dec("1.50")).when(m == 2, built + 50).otherwise(built)
    copies = F.explode(F.when(m == 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return per_invoice.filter(m != 0).select(
        "gstin", number.alias("inv_no"),
        F.concat(F.lit("01-"), F.format_string("%02d", (okey % 12 + 1).cast("int")), F.lit("-2024"))
        .alias("inv_date"),
        F.col("taxable").alias("taxable_val"), "igst", "cgst", "sgst", money(total).alias("total_val"),
        okey, skey, own.alias("own"), copies.alias("copy"),
    ).select(
        "*", F.concat_ws("||", "gstin", normalize_id(F.col("inv_no"))).alias("norm_key"),
        F.struct(~F.col("own"), "okey", "skey", "copy").alias("seq"),
    )


def sales_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines summed per document, all of them.

    A number holds its order's key, so documents are dealt by number alone. The key isn't grouped by: filters on it stay above the sums, and
    both sides of a match read the same ones.
    """
    lines = sales_lines(spark, sf_dir, part=False)
    return lines.groupBy("invoice_no").agg(
        F.min("okey").alias("okey"),
        F.min("voucher_type").alias("voucher_type"),
        F.min("party_gstin").alias("party_gstin"),
        F.min("party_state").alias("party_state"),
        *[money(F.sum(c)).alias(n) for c, n in (
            ("taxable_value", "taxable"), ("igst_amount", "igst"), ("cgst_amount", "cgst"),
            ("sgst_amount", "sgst"), ("total_invoice_value", "total"))],
    ).withColumn(
        "doc_type", F.when(F.col("voucher_type") == "Sales", "Invoice").otherwise(F.col("voucher_type"))
    )


def os_rows(docs: DataFrame) -> DataFrame:
    """Our side of the three-way match: documents we hold a source for."""
    return docs.filter("okey % 13 <> 0").select(
        F.col("invoice_no").alias("doc_no"), "doc_type", "party_gstin",
        "taxable", "igst", "cgst", "sgst", "total", F.col("okey").alias("seq"),
    )


def client_rows(docs: DataFrame) -> DataFrame:
    """The client's register: the same documents with known errors."""
    m = F.col("okey") % 11
    location = F.when(F.col("okey") % 2 == 0, "MH").otherwise("HR")
    code = F.when(F.col("okey") % 2 == 0, "27").otherwise("06")
    true_flag = F.when(F.col("party_state") == code, "Intrastate").otherwise("Interstate")
    inverse = F.when(F.col("party_state") == code, "Interstate").otherwise("Intrastate")
    half = money(F.round(F.col("igst") * dec("0.5"), 2))
    swapped_igst = F.when(F.col("igst") > 0, F.lit(0)).otherwise(F.col("cgst") + F.col("sgst"))
    swapped_side = F.when(F.col("igst") > 0, half).otherwise(F.lit(0))
    return docs.filter(m != 0).select(
        F.col("invoice_no").alias("doc_no"), "doc_type", "party_gstin",
        location.alias("supplier_location"), F.col("party_state").alias("state_of_supply"),
        F.when(m == 1, inverse).otherwise(true_flag).alias("interstate_or_intrastate"),
        money(F.when(m == 2, F.col("taxable") + 100).otherwise(F.col("taxable"))).alias("taxable"),
        money(F.when(m == 1, swapped_igst).otherwise(F.col("igst"))).alias("igst"),
        money(F.when(m == 1, swapped_side).otherwise(F.col("cgst"))).alias("cgst"),
        money(F.when(m == 1, swapped_side).otherwise(F.col("sgst"))).alias("sgst"),
        "total", F.col("okey").alias("seq"),
    )
