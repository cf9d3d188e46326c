"""Purchase books against the GSTR-2B statement."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, free_shuffles
from ..functions.common import (
    first_filled, first_nonzero, money, zero_if_null,
)
from ..functions.ids import (
    FUZZY_MIN_OVERLAP, LONGEST_PIECE, fuzzy_same_number, match_key, normalize_id, substrings,
)
from ..functions.tax import RULE_36_4_FACTOR, TOL_2B_MATCH, dec
from .assign import assign_in_parts

BOOK_STATUSES = ("matched", "mismatch", "missing_in_2b")
STATUSES = (*BOOK_STATUSES, "not_in_books")
HEAD = ["supplier_inv", "gst_no", "party_ac_name", "invoice_date", "particulars"]
AMOUNTS = ["amount", "cgst", "sgst", "igst", "total_amount"]
RECORD = ["inv_no", "gstin", "inv_date", "taxable_val", "igst", "cgst", "sgst", "total_val"]


def normalise_books(items: DataFrame) -> DataFrame:
    """Books under one set of names, whichever of the two spellings the source uses."""
    def pick(*names: str, number: bool = False) -> Column:
        found = [F.col(n) for n in names if n in items.columns]
        if not found:
            return F.lit(0) if number else F.lit("")
        return zero_if_null(first_nonzero(*found)) if number else F.coalesce(first_filled(*found), F.lit(""))

    amounts = {
        "amount": pick("amount", "taxable_value", number=True),
        "cgst": pick("cgst", "cgst_amount", number=True),
        "sgst": pick("sgst", "sgst_amount", number=True),
        "igst": pick("igst", "igst_amount", number=True),
    }
    built = sum(list(amounts.values())[1:], amounts["amount"])
    given = [F.col(n) for n in ("total_amount", "total_invoice_value") if n in items.columns]
    total = F.coalesce(first_nonzero(*given), built) if given else built
    eligibility = (
        F.coalesce(first_filled(F.col("itc_eligibility")), F.lit("ITC_UNKNOWN"))
        if "itc_eligibility" in items.columns else F.lit("ITC_UNKNOWN")
    )
    out = items.select(
        "seq",
        pick("supplier_inv", "invoice_no").alias("supplier_inv"),
        pick("gst_no", "party_gstin").alias("gst_no"),
        pick("party_ac_name", "party_ledger_name").alias("party_ac_name"),
        pick("invoice_date", "voucher_date").alias("invoice_date"),
        pick("particulars").alias("particulars"),
        *[money(v).alias(k) for k, v in amounts.items()],
        money(total).alias("total_amount"),
        eligibility.alias("itc_eligibility"),
    )
    return out.withColumn("norm_key", match_key(F.col("gst_no"), F.col("supplier_inv")))


def books_by_invoice(books: DataFrame) -> DataFrame:
    """Normalised lines summed per key, with the head of the first line; of amounts and head as much as the lines carry."""
    head = F.struct(*[c for c in HEAD if c in books.columns])
    sums = [c for c in AMOUNTS if c in books.columns]
    return books.groupBy("norm_key").agg(
        *[money(F.sum(c)).alias(c) for c in sums],
        F.count(F.lit(1)).alias("n_lines"), F.min_by(head, "seq").alias("head"),
        F.min("seq").alias("first_seq"),
    ).select("norm_key", *sums, "n_lines", "head.*", "first_seq")


def parse_statement(raw: DataFrame) -> DataFrame:
    """Nested statements (schema GSTR2B_STATEMENT) to one row per invoice."""
    def filled(*arrays: Column) -> Column:
        return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays])

    suppliers = raw.select(
        "statement_id",
        F.posexplode(filled(F.col("data.docdata.b2b"), F.col("docdata.b2b"), F.col("b2b")))
        .alias("s_pos", "s"),
    )
    invoices = suppliers.select(
        "statement_id", "s_pos",
        normalize_id(first_filled(F.col("s.ctin"), F.col("s.gstin"))).alias("gstin"),
        F.posexplode(filled(F.col("s.inv"), F.col("s.invoices"))).alias("i_pos", "i"),
    )

    def item_sum(nested: str, plain: str) -> Column:
        def amount(itm: Column) -> Column:
            det = F.coalesce(itm["itm_det"], itm.dropFields("itm_det"))
            return zero_if_null(first_nonzero(det[nested], det[plain])).cast("decimal(18,4)")

        items = F.coalesce(filled(F.col("i.itms"), F.col("i.items")), F.array().cast(
            invoices.schema["i"].dataType["itms"].dataType))
        return F.aggregate(items, F.lit(0).cast("decimal(18,4)"),
                           lambda acc, itm: (acc + amount(itm)).cast("decimal(18,4)"))

    flat = invoices.select(
        "statement_id", "s_pos", "i_pos", "gstin",
        F.trim(F.coalesce(first_filled(F.col("i.inum"), F.col("i.inv_no"), F.col("i.invNo")), F.lit("")))
        .alias("inv_no"),
        F.trim(F.coalesce(first_filled(F.col("i.dt"), F.col("i.inv_date")), F.lit(""))).alias("inv_date"),
        zero_if_null(first_nonzero(F.col("i.val"), F.col("i.total_val"))).cast("decimal(18,4)").alias("val"),
        first_nonzero(F.col("i.txval"), F.col("i.taxable_val")).cast("decimal(18,4)").alias("own_taxable"),
        item_sum("txval", "taxable_val").alias("items_taxable"),
        item_sum("igst", "iamt").alias("igst"), item_sum("cgst", "camt").alias("cgst"),
        item_sum("sgst", "samt").alias("sgst"),
    ).filter(F.col("inv_no") != "")
    taxable = F.when(
        (F.col("items_taxable") == 0) & (F.col("val") > 0), F.coalesce("own_taxable", "val")
    ).otherwise(F.col("items_taxable"))
    built = taxable + F.col("igst") + F.col("cgst") + F.col("sgst")
    return flat.select(
        "gstin", "inv_no", "inv_date",
        money(F.round(taxable, 2)).alias("taxable_val"),
        *[money(F.round(F.col(c), 2)).alias(c) for c in ("igst", "cgst", "sgst")],
        money(F.round(F.coalesce(first_nonzero(F.col("val")), built), 2)).alias("total_val"),
        F.concat_ws("||", "gstin", normalize_id(F.col("inv_no"))).alias("norm_key"),
        F.struct("statement_id", "s_pos", "i_pos").alias("seq"),
    )


def recipient_gstin(raw: DataFrame) -> DataFrame:
    """The registration a statement was issued for; NULL rather than a guess."""
    paths = [F.col("gstin"), F.col("data.gstin"), F.col("docdata.gstin")]
    found = [F.when(F.length(F.trim(p)) >= 15, F.upper(F.trim(p))) for p in paths]
    return raw.select("statement_id", F.coalesce(*found).alias("recipient_gstin"))


def first_per_key(statement: DataFrame) -> DataFrame:
    return statement.groupBy("norm_key").agg(
        F.min_by(F.struct(*RECORD), "seq").alias("rec"), F.min("seq").alias("rec_seq")
    )


def exact_matches(invoices: DataFrame, statement: DataFrame) -> DataFrame:
    """Invoices whose key is in the statement, with the first record of that key."""
    return invoices.join(first_per_key(statement), "norm_key").withColumn("fuzzy_matched", F.lit(False))


def _tokens(number: Column, whole: str, parts: str, lengths: Column) -> Column:
    """Keys that meet whenever one number contains the other or the bare numbers agree.

    A number longer than any piece is looked for by its end. Only pieces as long as a number of the other side (``lengths``) can meet one.
    """
    bare = F.ltrim(number, F.lit("0"))
    pieces = F.filter(substrings(number), lambda s: F.array_contains(lengths, F.length(s)))
    return F.array_compact(F.concat(
        F.array(
            F.when(F.length(number) >= FUZZY_MIN_OVERLAP, F.concat(F.lit(f"{whole}:"), F.right(number, F.lit(LONGEST_PIECE)))),
            F.when(bare != "", F.concat(F.lit("0:"), bare)),
        ),
        F.transform(pieces, lambda s: F.concat(F.lit(f"{parts}:"), s)),
    ))


def fuzzy_pairs(invoices: DataFrame, statement: DataFrame) -> DataFrame:
    """Pairs left after the exact pass: same GSTIN, related numbers, totals within tolerance.

    Both sides are blocked on (GSTIN, amount band) and then meet on an equal token: a number, or
    a substring of the other side's number, of a length that numbers have on that side of the block. An invoice number
    has few substrings, so the pairs grow with the rows even where one GSTIN (or none) holds most of them.
    """
    width = 2 * TOL_2B_MATCH
    number = F.split_part(F.col("norm_key"), F.lit("||"), F.lit(2))
    left = invoices.select(
        F.col("norm_key").alias("book_key"), F.col("first_seq").alias("book_seq"),
        normalize_id(F.col("gst_no")).alias("g"), number.alias("book_inv"),
        F.col("total_amount").alias("book_total"),
    ).withColumn("band", F.explode(F.array_distinct(F.array(
        F.floor((F.col("book_total") - TOL_2B_MATCH) / width),
        F.floor((F.col("book_total") + TOL_2B_MATCH) / width)))))
    right = statement.select(
        F.col("seq").alias("rec_seq"), F.col("gstin").alias("g"), number.alias("rec_inv"),
        F.col("total_val").alias("rec_total"), F.floor(F.col("total_val") / width).alias("band"),
    )
    block = ["g", "band"]

    def lengths(rows: DataFrame, number: str) -> DataFrame:
        """The blocks of a side, and how long its numbers are there, as tokens."""
        return rows.groupBy(*block).agg(F.collect_set(F.least(F.length(number), F.lit(LONGEST_PIECE))).alias("lengths"))

    left_kept = left.join(lengths(right, "rec_inv"), block)
    right_kept = right.join(lengths(left, "book_inv"), block)
    meet = left_kept.withColumn("token", F.explode(_tokens(F.col("book_inv"), "w", "p", F.col("lengths")))).drop("lengths").join(
        right_kept.withColumn("token", F.explode(_tokens(F.col("rec_inv"), "p", "w", F.col("lengths")))).drop("lengths"),
        [*block, "token"],
    )
    ok = (F.abs(F.col("book_total") - F.col("rec_total")) <= TOL_2B_MATCH) & fuzzy_same_number(
        F.col("book_inv"), F.col("rec_inv"))
    return meet.filter(ok).select("book_key", "book_seq", "rec_seq", "g").dropDuplicates(["book_key", "rec_seq"])


def _settled(rows: DataFrame) -> DataFrame:
    """The rows written once, without the shuffles that made them: those of one step aren't kept beside those of the next."""
    out = cut_lineage(rows)
    del rows
    free_shuffles(out.sparkSession)
    return out


def fuzzy_matches(invoices: DataFrame, statement: DataFrame) -> DataFrame:
    """One-to-one fuzzy matches, books in arrival order, each statement record used once."""
    pairs = _settled(fuzzy_pairs(invoices, statement))
    chosen = assign_in_parts(pairs, "book_seq", "rec_seq", within=("g",))
    records = statement.select(F.col("seq").alias("rec_seq"), F.struct(*RECORD).alias("rec"))
    return (
        invoices.join(chosen, F.col("first_seq") == F.col("book_seq")).drop("book_seq")
        .join(records, "rec_seq").withColumn("fuzzy_matched", F.lit(True))
    )


class Reconciliation:
    """Frames of one reconciliation; each is computed only when asked for."""

    def __init__(self, books: DataFrame, statement: DataFrame):
        self.books, self.statement = books, statement
        self.invoices = books_by_invoice(books)
        self.exact = exact_matches(self.invoices, statement)
        self._fuzzy: DataFrame | None = None

    @cached_property
    def unmatched_lines(self) -> DataFrame:
        """Lines of the invoices the exact pass left over; few, used several times, so written once."""
        return _settled(self.books.join(self.statement.select("norm_key"), "norm_key", "left_anti"))

    @property
    def unmatched(self) -> DataFrame:
        """Invoices the exact pass left over."""
        return books_by_invoice(self.unmatched_lines)

    @cached_property
    def remaining(self) -> DataFrame:
        """Statement records whose key is not in the books, written once for the same reason."""
        return _settled(self.statement.join(self.books.select("norm_key"), "norm_key", "left_anti"))

    @property
    def fuzzy(self) -> DataFrame:
        if self._fuzzy is None:
            self._fuzzy = fuzzy_matches(self.unmatched, self.remaining)
        return self._fuzzy

    @property
    def matches(self) -> DataFrame:
        diff = money(F.col("total_amount") - F.col("rec.total_val"))
        status = F.when(F.abs(diff) <= TOL_2B_MATCH, "matched").otherwise("mismatch")
        both = self.exact.unionByName(self.fuzzy)
        return both.select(
            "norm_key", "rec", "rec_seq", "fuzzy_matched", diff.alias("diff_amount"),
            status.alias("recon_status"), F.col("total_amount").alias("agg_books_total"),
        )

    @property
    def rows(self) -> DataFrame:
        """Every books line with its outcome."""
        joined = self.books.join(self.matches, "norm_key", "left")
        return joined.select(
            *self.books.columns,
            F.coalesce("recon_status", F.lit("missing_in_2b")).alias("recon_status"),
            F.coalesce("fuzzy_matched", F.lit(False)).alias("fuzzy_matched"),
            *[F.col(f"rec.{c}").alias(f"2b_{c}") for c in RECORD],
            "diff_amount", "agg_books_total",
        )

    @property
    def missing(self) -> DataFrame:
        return self.unmatched.join(self.fuzzy.select("norm_key"), "norm_key", "left_anti")

    @property
    def missing_lines(self) -> DataFrame:
        """The missing_in_2b part of ``rows``, from what the exact pass left over: the books aren't read and joined again."""
        left = self.unmatched_lines.join(self.fuzzy.select("norm_key"), "norm_key", "left_anti")
        return left.withColumn("recon_status", F.lit("missing_in_2b"))

    @property
    def extra(self) -> DataFrame:
        """Statement records no invoice used; copies of a fuzzily used record stay."""
        left = self.remaining.join(
            self.fuzzy.select(F.col("rec_seq").alias("seq")), "seq", "left_anti"
        )
        return left.select(
            F.lit("not_in_books").alias("recon_status"),
            F.col("inv_no").alias("supplier_inv"), F.col("inv_date").alias("invoice_date"),
            F.col("gstin").alias("gst_no"), F.lit(None).cast("string").alias("party_ac_name"),
            F.col("taxable_val").alias("amount"), "igst", "cgst", "sgst",
            F.col("total_val").alias("total_amount"),
            *[F.col(c).alias(f"2b_{c}") for c in RECORD], "norm_key", "seq",
        )

    @property
    def all_rows(self) -> DataFrame:
        return self.rows.drop("seq").unionByName(self.extra.drop("seq"), allowMissingColumns=True)

    @property
    def summary(self) -> DataFrame:
        amount = zero_if_null(first_nonzero(F.col("total_amount"), F.col("2b_total_val")))
        slim = self.all_rows.select("recon_status", "fuzzy_matched", amount.alias("amt"))
        return summarize(slim)


def summarize(slim: DataFrame) -> DataFrame:
    """Counts of rows (not invoices) and amounts per status, in one row; never a missing status."""
    is_status = {s: F.col("recon_status") == s for s in STATUSES}
    out = slim.agg(
        *[F.count(F.when(c, 1)).alias(f"n_{s}") for s, c in is_status.items()],
        *[money(F.coalesce(F.sum(F.when(c, F.col("amt"))), F.lit(0))).alias(f"amt_{s}")
          for s, c in is_status.items()],
        F.count(F.lit(1)).alias("total_rows"),
        F.count(F.when(F.col("fuzzy_matched"), 1)).alias("fuzzy_matched_count"),
    )
    return out.withColumn("itc_at_risk", money(F.col("amt_missing_in_2b") + F.col("amt_mismatch")))


def rule_36_4(summary: DataFrame) -> DataFrame:
    """Provisional credit is capped at 105% of what the statement confirms."""
    out = summary.select(
        F.col("amt_matched").alias("matched_itc"),
        money(F.round(F.col("amt_matched") * dec(RULE_36_4_FACTOR), 2)).alias("cap"),
        money(F.col("amt_matched") + F.col("amt_mismatch") + F.col("amt_missing_in_2b"))
        .alias("total_claimed"),
    ).withColumn("excess", F.greatest(money(F.lit(0)), F.col("total_claimed") - F.col("cap")))
    return out.withColumn("breached", F.col("excess") > 0)
