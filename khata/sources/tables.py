"""Readers of stored invoice tables and of exchange formats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.common import first_filled, money, text, zero_if_null
from ..functions.dates import voucher_to_iso


def tenant_lines(lines: DataFrame, tasks: DataFrame, batches: DataFrame, tenant: str | None) -> DataFrame:
    """Lines of one tenant by way of task and batch; the tenant filter reaches the batch scan."""
    mine = batches.filter(F.col("tenant_id").eqNullSafe(F.lit(tenant).cast("string"))).select("batch_id", "tenant_id")
    return lines.join(tasks.select("task_id", "batch_id").join(mine, "batch_id"), "task_id")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """GSTR-2B statements, one JSON document per file."""
    raw = spark.read.schema(schemas.GSTR2B_STATEMENT).option("multiLine", True).json(path)
    return raw.withColumn("statement_id", F.coalesce("statement_id", F.col("_metadata.file_path")))


# Register headers by prefix; the three taxes must match whole.
CLIENT_HEADERS = {
    "s.no": "sno", "document type code": "doc_type", "document no": "doc_no", "document date": "doc_date",
    "supplier location": "supplier_location", "recipient billing name": "party_name",
    "recipient billing gstin": "party_gstin", "b2b or b2c": "b2b_or_b2c", "state of supply": "state_of_supply",
    "interstate or intrastate": "interstate_or_intrastate", "net basic amt": "taxable", "invoice value": "total",
    "saas (gross- discount-advance)": "saas_net",
    "transactional charges (gross- discount-advance)": "transactional_net",
    "kyc charges (gross- discount-advance)": "kyc_net",
    "promotional chrs (gross- discount-advance)": "promotional_net",
    "late charges": "late_charges", "sound (gross- discount-advance)": "soundbox_net",
}
EXACT_HEADERS = ("igst", "sgst", "cgst")
CLIENT_AMOUNTS = ("taxable", "igst", "sgst", "cgst", "total", "saas_net", "transactional_net", "kyc_net",
                  "promotional_net", "late_charges", "soundbox_net")


def header_key(header: str) -> str:
    return " ".join(header.split()).lower()


def resolve_headers(headers: list[str], prefixes: Mapping[str, str] = CLIENT_HEADERS) -> dict[str, str]:
    """Register column per field, the first header that fits; looks at names only, never at rows."""
    found: dict[str, str] = {}
    for header in headers:
        key = header_key(header)
        if not key:
            continue
        for prefix, field in prefixes.items():
            if key.startswith(prefix):
                found.setdefault(field, header)
        if key in EXACT_HEADERS:
            found.setdefault(key, header)
    return found


def amount_of(c: Column) -> Column:
    """Numbers typed with commas; blank, '-' and other text count as zero."""
    clean = F.regexp_replace(F.trim(c.cast("string")), ",", "")
    return money(F.round(zero_if_null(clean.try_cast("decimal(20,4)")), 2))


def client_register(sheet: DataFrame) -> DataFrame:
    """A client's wide register (CSV or Parquet export) as client rows; rows without number or type go."""
    columns = resolve_headers(sheet.columns)

    def cell(field: str) -> Column:
        return F.col(f"`{columns[field]}`") if field in columns else F.lit(None).cast("string")

    texts = ("sno", "doc_type", "doc_no", "doc_date", "party_name", "party_gstin", "b2b_or_b2c",
             "supplier_location", "state_of_supply", "interstate_or_intrastate")
    rows = sheet.select(*[cell(f).cast("string").alias(f) for f in texts],
                        *[amount_of(cell(f)).alias(f) for f in CLIENT_AMOUNTS])
    return rows.filter((F.coalesce("doc_no", F.lit("")) != "") & (F.coalesce("doc_type", F.lit("")) != "")).withColumns(
        {"doc_no": F.trim("doc_no"), "state_of_supply": text(F.col("state_of_supply"))})


VOUCHER_SCHEMA = """
    DATE string, VOUCHERTYPENAME string, VOUCHERNUMBER string, REFERENCE string, PARTYLEDGERNAME string,
    BASICPARTYGSTIN string, PARTYGSTIN string, PLACEOFSUPPLY string, NARRATION string,
    `ALLINVENTORYENTRIES.LIST` array<struct<STOCKITEMNAME: string, BILLEDQTY: string, RATE: string,
        AMOUNT: string, `ACCOUNTINGALLOCATIONS.LIST`: array<struct<LEDGERNAME: string, AMOUNT: string>>>>
"""
LEDGER_SCHEMA = "_NAME string, NAME string, PARENT string, LEDGERGSTREGISTRATIONNUMBER string, PARTYGSTIN string, ADDRESS string, LEDGERSTATENAME string, OPENINGBALANCE string"
UNREGISTERED_PREFIX = "URP"


def read_vouchers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "VOUCHER").schema(VOUCHER_SCHEMA).load(path)


def read_ledgers(spark: SparkSession, path: str) -> DataFrame:
    """The chart of accounts: name, parent group, GSTIN, address, state and opening balance of every ledger.

    The name is an element or an attribute; a balance that is no number counts 0.
    """
    raw = spark.read.format("xml").option("rowTag", "LEDGER").schema(LEDGER_SCHEMA).load(path)
    return raw.select(
        F.coalesce(first_filled(F.col("NAME"), F.col("_NAME")), F.lit("")).alias("name"), F.coalesce("PARENT", F.lit("")).alias("parent"),
        first_filled(F.col("LEDGERGSTREGISTRATIONNUMBER"), F.col("PARTYGSTIN")).alias("gstin"), F.col("ADDRESS").alias("address"),
        F.col("LEDGERSTATENAME").alias("state"), money(_number(F.col("OPENINGBALANCE"))).alias("opening_balance"))


def _number(c: Column) -> Column:
    """A typed number with commas; anything else is zero."""
    return zero_if_null(F.regexp_replace(F.trim(c), ",", "").try_cast("decimal(18,4)"))


def _tax_sum(entries: Column, names: str) -> Column:
    start = F.lit(0).cast("decimal(20,4)")
    hit = F.filter(entries, lambda e: F.upper(F.coalesce(e["LEDGERNAME"], F.lit(""))).rlike(names))
    total = F.aggregate(hit, start, lambda acc, e: (acc + F.abs(_number(e["AMOUNT"]))).cast("decimal(20,4)"))
    return money(zero_if_null(total))


def voucher_lines(vouchers: DataFrame, register: str = "purchase") -> DataFrame:
    """Inventory entries of each voucher as lines; a voucher without any becomes one empty line."""
    rows = vouchers.select("*", F.posexplode_outer("`ALLINVENTORYENTRIES.LIST`").alias("pos", "e"))
    taxes = F.col("e.`ACCOUNTINGALLOCATIONS.LIST`")
    gstin = F.coalesce(first_filled(F.col("BASICPARTYGSTIN"), F.col("PARTYGSTIN")), F.lit(""))
    flat = rows.select(
        voucher_to_iso(F.col("DATE")).alias("voucher_date"), F.col("VOUCHERTYPENAME").alias("voucher_type"),
        first_filled(F.col("REFERENCE"), F.col("VOUCHERNUMBER")).alias("invoice_no"),
        F.coalesce("PARTYLEDGERNAME", F.lit("")).alias("party_ledger_name"), gstin.alias("party_gstin"),
        F.coalesce("PLACEOFSUPPLY", F.lit("")).alias("place_of_supply"),
        F.coalesce("NARRATION", F.lit("")).alias("narration"), F.coalesce("pos", F.lit(0)).alias("line_no"),
        F.coalesce("e.STOCKITEMNAME", F.lit("")).alias("particulars"), F.lit("").alias("hsn"),
        F.abs(_number(F.col("e.BILLEDQTY"))).cast("double").alias("qty"),
        _number(F.col("e.RATE")).cast("double").alias("rate"),
        money(F.abs(_number(F.col("e.AMOUNT")))).alias("taxable_value"),
        _tax_sum(taxes, "CGST").alias("cgst_amount"),
        _tax_sum(taxes, "^(?!.*CGST).*(SGST|UTGST)").alias("sgst_amount"),
        _tax_sum(taxes, "^(?!.*(CGST|SGST|UTGST)).*IGST").alias("igst_amount"))
    built = F.col("taxable_value") + F.col("cgst_amount") + F.col("sgst_amount") + F.col("igst_amount")
    unregistered = (F.col("party_gstin") == "") | F.col("party_gstin").startswith(UNREGISTERED_PREFIX)
    label = (F.lit("Input Tax Credit").alias("itc_eligibility") if register == "purchase" else
             F.when(unregistered, "B2C (Small)").otherwise("B2B").alias("gstr1_category"))
    return flat.select("*", money(built).alias("total_invoice_value"), label)
