"""Double-entry legs, the idempotent push, and missing parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import first_nonzero, money, text, zero_if_null
from ..functions.dates import iso_to_voucher

SALES_SIDE = ("sales", "credit note")
NOTES = ("credit note", "debit note")
VOUCHER_TYPES = (*SALES_SIDE, "purchase", "debit note")
READY = "ERP_READY"


def journal_legs(lines: DataFrame, date: str = "voucher_date") -> DataFrame:
    """One row per leg of a line: party, account and the non-zero taxes.

    Notes reverse their side, and purchases start from the opposite side of sales. Lines of other
    voucher types, without an ISO date or without a party are left out.
    """
    kind = F.lower(text(F.col("voucher_type")))
    sales_side, note = kind.isin(*SALES_SIDE), kind.isin(*NOTES)
    reversed_ = note != ~sales_side
    taxable, cgst, sgst, igst = (
        zero_if_null(F.col(c)) for c in ("taxable_value", "cgst_amount", "sgst_amount", "igst_amount"))
    total = F.coalesce(first_nonzero(F.col("total_invoice_value")), taxable + cgst + sgst + igst)

    def leg(ledger: Column, amount: Column, party: bool) -> Column:
        debit = ~reversed_ if party else reversed_
        return F.struct(ledger.alias("ledger"), money(amount).alias("amount"),
                        F.when(debit, "Dr").otherwise("Cr").alias("side"), F.lit(party).alias("is_party"))

    account = F.when(sales_side, "Sales Account").otherwise("Purchase Account")
    legs = F.concat(
        F.array(leg(F.col("party_ledger_name"), total, True), leg(account, taxable, False)),
        F.filter(F.array(leg(F.lit("CGST"), cgst, False), leg(F.lit("SGST"), sgst, False),
                         leg(F.lit("IGST"), igst, False)), lambda x: x["amount"] != 0))
    usable = kind.isin(*VOUCHER_TYPES) & iso_to_voucher(F.col(date)).isNotNull() & (
        text(F.col("party_ledger_name")) != "")
    return lines.filter(usable).select(
        *lines.columns, iso_to_voucher(F.col(date)).alias("voucher_day"), F.posexplode(legs).alias("leg_no", "leg")
    ).select(*lines.columns, "voucher_day", "leg_no", "leg.*")


def ledger_balance(legs: DataFrame) -> DataFrame:
    debit, credit = (F.sum(F.when(F.col("side") == s, F.col("amount"))) for s in ("Dr", "Cr"))
    return legs.groupBy("ledger").agg(
        money(zero_if_null(debit)).alias("debit"), money(zero_if_null(credit)).alias("credit"),
        F.count(F.lit(1)).alias("n_legs"),
    ).withColumn("balance", money(F.col("debit") - F.col("credit")))


def to_push(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items of export-ready tasks that no earlier push to the company delivered."""
    key = ["item_type", "item_id", "company"]
    done = log.filter("status = 'success'").select(*key)
    return items.filter(F.col("recon_status") == READY).join(done, key, "left_anti")


def append_log(log: DataFrame, results: DataFrame) -> DataFrame:
    """Every attempt is logged, failed ones too; earlier rows stay as they are."""
    return log.unionByName(results.select(*log.columns))


def missing_parties(lines: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Parties absent from the ledger master, compared without case, with their parent group."""
    kind = F.lower(text(F.col("voucher_type")))
    parties = lines.filter(text(F.col("party_ledger_name")) != "").groupBy(
        F.lower(F.trim("party_ledger_name")).alias("_k")).agg(
        F.min("party_ledger_name").alias("party_ledger_name"), F.max("party_gstin").alias("party_gstin"),
        F.max(F.when(kind.isin(*SALES_SIDE), 1).otherwise(0)).alias("_sales"))
    known = ledgers.select(F.lower(F.trim("name")).alias("_k"))
    return parties.join(known, "_k", "left_anti").select(
        "party_ledger_name", "party_gstin",
        F.when(F.col("_sales") == 1, "Sundry Debtors").otherwise("Sundry Creditors").alias("parent"))


def best_attempt(attempts: DataFrame, key: str) -> DataFrame:
    """Of several extraction attempts the first export-ready one, else the least total variance."""
    ready = F.col("recon_status") == READY
    rank = F.struct(F.when(ready, 0).otherwise(1), F.when(~ready, F.col("variance_total")), "attempt")
    rest = [c for c in attempts.columns if c != key]
    return attempts.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("r")).select(key, "r.*")


