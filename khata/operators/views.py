"""Named output views: ordered columns, their labels, and the fields that may fill them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Labels and candidate fields of the four registers.
SALES_REGISTER = [
    ("Voucher Date", ["voucher_date"]), ("Voucher Type", ["voucher_type"]), ("Invoice No", ["invoice_no"]),
    ("Party Name", ["party_ledger_name"]), ("Party GSTIN", ["party_gstin"]),
    ("Place of Supply", ["place_of_supply"]), ("Particulars", ["particulars"]), ("HSN", ["hsn"]),
    ("Qty", ["qty"]), ("Rate", ["rate"]), ("Taxable Value", ["taxable_value"]), ("Discount", ["discount"]),
    ("Advances", ["advances"]), ("CGST", ["cgst_amount"]), ("SGST", ["sgst_amount"]), ("IGST", ["igst_amount"]),
    ("Total Invoice Value", ["total_invoice_value"]), ("GSTR1 Category", ["gstr1_category"]),
    ("Narration", ["narration"]), ("Processed Date", "processed_date"), ("Source File", "source_file"),
]
PURCHASE_REGISTER = [
    ("SUPPLIER INV NO", ["invoice_no"]), ("INVOICE DATE", ["voucher_date"]), ("GST NO", ["party_gstin"]),
    ("PARTY A/C NAME", ["party_ledger_name"]), ("PLACE OF SUPPLY", ["place_of_supply"]),
    ("PARTICULARS", ["particulars"]), ("AMOUNT", ["taxable_value"]), ("SGST", ["sgst_amount"]),
    ("CGST", ["cgst_amount"]), ("IGST", ["igst_amount"]), ("TOTAL AMOUNT", ["total_invoice_value"]),
    ("Narration", ["narration"]), ("HSN", ["hsn"]),
]
AUDIT = [
    ("S.No", ["s_no"]), ("File Name", ["file_name"]), ("Invoice No", ["invoice_no"]),
    ("Invoice Date", ["invoice_date"]), ("Party Name", ["party_ledger_name"]), ("Party GSTIN", ["party_gstin"]),
    ("Place of Supply", ["place_of_supply"]), ("Particulars", ["particulars"]), ("HSN/SAC", ["hsn"]),
    ("Taxable Value", ["taxable_value"]), ("CGST Rate (%)", ["cgst_rate"]), ("CGST Amount", ["cgst_amount"]),
    ("SGST Rate (%)", ["sgst_rate"]), ("SGST Amount", ["sgst_amount"]), ("IGST Rate (%)", ["igst_rate"]),
    ("IGST Amount", ["igst_amount"]), ("Total Tax", ["total_tax"]), ("Round Off", ["round_off"]),
    ("Advance Deducted", ["advance_deducted"]), ("Total Invoice Value", ["total_invoice_value"]),
    ("GSTR-1 Category", ["gstr1_category"]), ("Tax Type", ["tax_type"]), ("Nature", ["nature"]),
    ("Status", ["status"]), ("Note", ["note"]),
]
GSTR2B_RECONCILIATION = [
    ("Invoice No", ["invoice_no", "supplier_inv", "2b_inv_no"]),
    ("Invoice Date", ["voucher_date", "invoice_date"]),
    ("Party Ledger Name", ["party_ledger_name", "party_ac_name"]),
    ("Party GSTIN", ["party_gstin", "gst_no", "2b_gstin"]), ("Particulars", ["particulars"]),
    ("Taxable Value (Books)", ["taxable_value", "amount"]), ("CGST (Books)", ["cgst_amount", "cgst"]),
    ("SGST (Books)", ["sgst_amount", "sgst"]), ("IGST (Books)", ["igst_amount", "igst"]),
    ("Total Value (Books)", ["total_invoice_value", "total_amount"]),
    ("2B Taxable Value", ["2b_taxable_val"]), ("2B CGST", ["2b_cgst"]), ("2B SGST", ["2b_sgst"]),
    ("2B IGST", ["2b_igst"]), ("2B Total Value", ["2b_total_val"]),
    ("Diff Amount (Books - 2B)", ["diff_amount"]), ("Recon Status", ["recon_status"]),
    ("Fuzzy Matched", ["fuzzy_matched"]), ("In Drive?", ["in_drive"]),
    ("Entry Missing in Tally", ["tally_entry_status"]), ("Client Action / Status", ["client_action"]),
    ("ITC Eligibility", ["itc_eligibility"]),
]
# Column names of the target ERP layouts.
ERP_LAYOUTS = {
    "sap": {
        "party_ac_name": "VendorCode", "invoice_no": "Reference", "voucher_date": "DocumentDate",
        "taxable_value": "AmountLC", "igst_amount": "TaxAmountIGST", "cgst_amount": "TaxAmountCGST",
        "sgst_amount": "TaxAmountSGST", "total_invoice_value": "TotalAmountLC", "hsn": "HSNSAC",
        "VOUCHER NO": "DocumentNumber", "PARTY GSTIN": "TaxNumber3", "DATE": "PostingDate"},
    "netsuite": {
        "invoice_no": "InternalID", "voucher_date": "TranDate", "party_ac_name": "Entity",
        "taxable_value": "GrossAmt", "total_invoice_value": "Amount", "VOUCHER NO": "TranId", "DATE": "Date",
        "PARTY GSTIN": "VATRegNumber"},
    "dynamics": {
        "invoice_no": "InvoiceId", "voucher_date": "TransDate", "party_ac_name": "AccountNum",
        "total_invoice_value": "InvoiceAmount", "taxable_value": "LineAmount", "VOUCHER NO": "InvoiceRegister",
        "DATE": "DocumentDate"},
}


def project(rows: DataFrame, view: Sequence[tuple[str, list[str] | str]],
            context: Mapping[str, str] | None = None) -> DataFrame:
    """A register: per column the first candidate that is present, blanked where it is empty or 0.

    Amounts stay numbers: an empty or zero amount becomes NULL, which writers leave blank.
    """
    kinds = dict(rows.dtypes)

    def cell(source: list[str] | str) -> Column:
        if isinstance(source, str):
            return F.lit((context or {}).get(source, ""))
        present = [c for c in source if c in kinds]
        if not present:
            return F.lit("")
        value = F.coalesce(*[F.col(f"`{c}`") for c in present])
        kind = kinds[present[0]]
        if kind == "string":
            return F.coalesce(value, F.lit(""))
        if kind == "boolean":
            return F.nullif(value, F.lit(False))
        return F.nullif(value, F.lit(0))

    return rows.select(*[cell(source).alias(label) for label, source in view])


def rename_for_erp(rows: DataFrame, layout: str) -> DataFrame:
    """Columns under the target's names; columns the layout does not know keep theirs."""
    return rows.withColumnsRenamed(ERP_LAYOUTS.get(layout.lower(), {}))
