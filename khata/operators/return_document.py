"""The return as one JSON document per registration, as an ordered stream of text rows.

Opening, document and closing rows are rows of a frame; sorted, they read as one JSON text. Nothing is nested in memory, so a
counterparty or a section with any number of documents is written by as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.common import money
from ..session import cut_lineage
from . import gstr1

HEAD, B2B, B2CL, B2CS, EXP, CDNR, CDNUR, NIL, HSN, DOC, SUMMARY = range(11)
OPEN, WITHIN, CLOSE = range(3)
GROUP_OPEN, ENTRY, GROUP_CLOSE = range(3)
PLACE = ["section", "part", "grp", "step", "seq", "later", "value"]
# Label of a section, and of the key and the list of its groups where it has any.
GROUPED = {B2B: ("b2b", "ctin", "inv"), B2CL: ("b2cl", "pos", "inv"), EXP: ("exp", "exp_typ", "inv"), CDNR: ("cdnr", "ctin", "nt")}
BRACKETS = {
    **{s: (f'"{name}":[', "],") for s, (name, _, _) in GROUPED.items()},
    B2CS: ('"b2cs":[', "],"), CDNUR: ('"cdnur":[', "],"), NIL: ('"nil":{"inv":[', "]},"), HSN: ('"hsn":{"data":[', "]},"),
}


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _lit(value, name: str) -> Column:
    return F.lit(value).alias(name)


def _zero(name: str) -> Column:
    return money(F.lit(0)).alias(name)


def _items(central: bool = True) -> Column:
    """The one item of a document: its totals at its rate. Large consumer invoices carry integrated tax only."""
    taxes = [F.col("cgst").alias("camt"), F.col("sgst").alias("samt")] if central else [_zero("camt"), _zero("samt")]
    detail = F.struct(F.col("taxable").alias("txval"), F.col("rate").alias("rt"), F.col("igst").alias("iamt"), *taxes, _zero("csamt"))
    return F.array(F.struct(_lit(1, "num"), detail.alias("itm_det"))).alias("itms")


def _entries(rows: DataFrame, by: list[str], section: int, grp: Column, seq: Column, text: Column) -> DataFrame:
    return rows.select(*by, F.lit(section).alias("section"), grp.alias("grp"), seq.alias("seq"), text.alias("value"))


def _documents(groups: DataFrame, firm_state: str, by: list[str]) -> DataFrame:
    """One row per document of the sections that list documents."""
    number, date, value = F.col("invoice_no"), F.col("doc_date").alias("idt"), F.col("total").alias("val")
    note = [F.when(F.col("voucher_type").contains("debit"), "D").otherwise("C").alias("ntty"), number.alias("nt_num"), F.col("doc_date").alias("nt_dt"), value]
    regular, pos = [_lit("N", "rchrg"), _lit("R", "inv_typ")], F.col("pos")
    export = F.array(F.struct(F.col("taxable").alias("txval"), F.col("rate").alias("rt"), F.col("igst").alias("iamt"), _zero("csamt"))).alias("itms")
    forms = {
        B2B: ("B2B", F.col("party_gstin"), [number.alias("inum"), date, value, pos, *regular, _items()]),
        B2CL: ("B2CL", pos, [number.alias("inum"), date, value, _items(central=False)]),
        EXP: ("EXP", F.when(F.col("igst") == 0, "WOPAY").otherwise("WPAY"),
              [number.alias("inum"), date, value, _lit("", "sbpcode"), _lit("", "sbnum"), _lit("", "sbdt"), export]),
        CDNR: ("CDNR", F.col("party_gstin"), [*note, pos, *regular, _items()]),
        CDNUR: ("CDNUR", F.lit(""), [*note, pos, F.when(pos != firm_state, "INTER").otherwise("INTRA").alias("typ"), _items()]),
    }
    section, grp, text = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for number_, (category, key, fields) in forms.items():
        here = F.col("category") == category
        section, grp, text = F.when(here, number_).otherwise(section), F.when(here, key).otherwise(grp), F.when(here, _json(*fields)).otherwise(text)
    rows = groups.filter(F.col("category").isin(*[c for c, _, _ in forms.values()]))
    return rows.select(*by, section.alias("section"), F.coalesce(grp, F.lit("")).alias("grp"), F.col("first_seq").alias("seq"), text.alias("value"))


def _sums(lines: DataFrame, groups: DataFrame, firm_state: str, by: list[str]) -> DataFrame:
    """Rows of the sections that are sums: small consumers by place and rate, nil-rated, HSN."""
    none, no_group = F.lit(None).cast(groups.schema["first_seq"].dataType), F.lit("")
    taxes = [F.col("igst").alias("iamt"), F.col("cgst").alias("camt"), F.col("sgst").alias("samt"), _zero("csamt")]
    b2cs = _entries(gstr1.b2cs_rows(groups, firm_state, by), by, B2CS, no_group, none, _json(
        "sply_tp", "pos", _lit("OE", "typ"), F.col("rate").alias("rt"), F.col("taxable").alias("txval"), *taxes))
    nil = _entries(gstr1.nil_rows(lines, firm_state, by), by, NIL, no_group, none, _json("sply_ty", "expt_amt", "nil_amt", "ngsup_amt"))
    hsn = _entries(gstr1.numbered(gstr1.hsn_summary(lines, by), by), by, HSN, no_group, F.col("first_seq"), _json(
        "num", "hsn_sc", "desc", "uqc", "qty", "val", "txval", "rt", "iamt", "camt", "samt", _zero("csamt")))
    return b2cs.unionByName(nil).unionByName(hsn)


def _frame(lines: DataFrame, groups: DataFrame, registration: str) -> DataFrame:
    """Opening and closing rows of the document and its sections."""
    totals = gstr1.return_envelope(lines, groups, registration)
    head = _json(F.col(registration).alias("gstin"), "fp", "gt", F.col("gt").alias("cur_gt"))
    closing = _json(F.col("fp").alias("filing_period"), "total_invoices", "total_taxable", "total_igst", "total_cgst", "total_sgst", "total_tax", "sections_with_data")
    kinds = gstr1.doc_summary(groups, [registration]).groupBy(registration).agg(F.array_sort(F.collect_list(F.struct(
        "doc_num", "doc_typ", F.array(F.struct(
            _lit(1, "num"), F.col("totnum").alias("to"), "totnum", _lit(0, "cancel"), F.col("totnum").alias("net_issue"))).alias("docs")))).alias("docdet"))
    texts = [(HEAD, OPEN, F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(",")))]
    for section, (opening, end) in BRACKETS.items():
        texts += [(section, OPEN, F.lit(opening)), (section, CLOSE, F.lit(end))]
    texts += [(DOC, OPEN, F.concat(F.lit('"doc":'), _json("docdet"), F.lit(","))), (SUMMARY, CLOSE, F.concat(F.lit('"_summary":'), "closing", F.lit("}")))]
    rows = totals.withColumns({"head": head, "closing": closing}).join(kinds, registration)
    return rows.select(registration, F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(p).alias("part"), v.alias("value")) for s, p, v in texts])))


def _with_comma(rows: DataFrame, key: list[str], later: Column) -> DataFrame:
    """Entries behind a comma where they are later ones; one without a registration has no frame to stand in."""
    return rows.filter(F.col(key[0]).isNotNull()).select(
        *key, F.lit(ENTRY).alias("step"), "seq", later.alias("later"), F.concat(F.when(later, ",").otherwise(""), "value").alias("value"))


def _placed(entries: DataFrame, firsts: DataFrame, key: list[str]) -> DataFrame:
    """The entries, all but the first of their group behind a comma.

    They are joined by the whole entry: by their group, all of a large one would meet in one task.
    """
    ahead = firsts.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("first.seq").alias("_seq"), F.col("first.value").alias("_value"))
    ahead = ahead.withColumn("_hash", F.xxhash64("_value"))
    same = [F.xxhash64("value") == F.col("_hash"), F.col("seq").eqNullSafe(F.col("_seq"))] + [F.col(c) == F.col(f"_{c}") for c in [*key, "value"]]
    return _with_comma(entries.join(ahead, same, "left"), key, F.col("_hash").isNull())


def return_rows(lines: DataFrame, firm_state: str, registration: str = "registration") -> DataFrame:
    """(registration, section, part, grp, step, seq, later, value): the rows of each registration's return, in any order.

    Sorted by all columns they are its JSON text. Groups of a section are in order of their key, documents in that of arrival.
    """
    by = [registration]
    groups = cut_lineage(gstr1.invoice_groups(lines, firm_state, by))
    # not written: sections that the reader leaves out are then not worked out either
    documents, sums = _documents(groups, firm_state, by), _sums(lines, groups, firm_state, by)
    # every entry but the first of its group, and every group but the first of its section, follows a comma
    key = [*by, "section", "grp"]
    first = F.min(F.struct("seq", "value"))
    firsts = documents.groupBy("grp", "section", *by).agg(first.alias("first"))
    first_group = firsts.groupBy(*by, "section").agg(F.min("grp").alias("first_grp"))
    # sums are few
    placed = _placed(documents, firsts, key).unionByName(_with_comma(sums, key, F.struct("seq", "value") != first.over(Window.partitionBy(*key))))
    named = firsts.filter(F.col("section").isin(*GROUPED)).join(first_group, [*by, "section"])
    label = F.lit("")
    for section, (_, name, items) in GROUPED.items():
        opening = F.concat(F.lit(f'{{"{name}":'), F.expr("substring(to_json(array(grp)), 2, length(to_json(array(grp))) - 2)"), F.lit(f',"{items}":['))
        label = F.when(F.col("section") == section, opening).otherwise(label)
    between = F.when(F.col("grp") == F.col("first_grp"), "").otherwise(",")
    # two frames, so that a reader of entries alone has neither
    opened = named.select(*key, F.lit(GROUP_OPEN).alias("step"), F.concat(between, label).alias("value"))
    closed = firsts.filter(F.col("section").isin(*GROUPED)).select(*key, F.lit(GROUP_CLOSE).alias("step"), F.lit("]}").alias("value"))
    within = placed.unionByName(opened, allowMissingColumns=True).unionByName(closed, allowMissingColumns=True).withColumn("part", F.lit(WITHIN))
    return within.unionByName(_frame(lines, groups, registration), allowMissingColumns=True).select(registration, *PLACE)


def ordered(rows: DataFrame, registration: str = "registration") -> DataFrame:
    """The rows in order over all partitions; a long section is spread over as many as it needs."""
    keys = [registration, *PLACE[:-1]]
    return rows.repartitionByRange(*keys).sortWithinPartitions(registration, *PLACE)


def write_returns(rows: DataFrame, path: str, registration: str = "registration") -> None:
    """A folder of text files per registration; joined in order of their names they are its JSON document."""
    ordered(rows, registration).select(registration, "value").write.partitionBy(registration).text(path)
