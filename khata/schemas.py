"""Declared schemas of the invoice tables, as DDL text for ``read.schema`` and ``from_json``."""

from __future__ import annotations


def _schema(spec: str) -> str:
    return " ".join(spec.split())


_LINE_HEAD = """
    task_id string, batch_id string, tenant_id string, seq long,
    voucher_date string, voucher_type string, invoice_no string,
    party_ledger_name string, party_gstin string, place_of_supply string,
    particulars string, hsn string, qty double, rate double,
    taxable_value decimal(18,2),
"""
_LINE_TAIL = """
    cgst_amount decimal(18,2), sgst_amount decimal(18,2), igst_amount decimal(18,2),
    total_invoice_value decimal(18,2),
"""

SALES_LINES = _schema(
    _LINE_HEAD + "discount decimal(18,2), advances decimal(18,2)," + _LINE_TAIL
    + "gstr1_category string, narration string"
)
PURCHASE_LINES = _schema(_LINE_HEAD + _LINE_TAIL + "itc_eligibility string, narration string")

GSTR2B_INVOICES = _schema("""
    gstin string, inv_no string, inv_date string, taxable_val decimal(18,2),
    igst decimal(18,2), cgst decimal(18,2), sgst decimal(18,2), total_val decimal(18,2),
    norm_key string, seq long
""")

INVOICE_SUMMARY = _schema("""
    task_id string, taxable_value decimal(18,2), cgst_amount decimal(18,2),
    sgst_amount decimal(18,2), igst_amount decimal(18,2), cess_amount decimal(18,2),
    round_off decimal(18,2), grand_total decimal(18,2)
""")

OBS_EVENTS = _schema("""
    tenant_id string, batch_id string, file_id string, event_type string, stage string,
    severity string, flag_id string, payload_json string, timestamp_utc timestamp_ntz,
    is_replay boolean
""")

GAP_TRIGGERS = _schema("""
    tenant_id string, period string, registration_gstin string, counterparty_gstin string,
    invoice_no string, bucket string, amount decimal(18,2), status string,
    last_triggered_at timestamp_ntz, trigger_count long, resolved_at timestamp_ntz
""")

_ITEM = """
    txval: double, taxable_val: double, igst: double, iamt: double,
    cgst: double, camt: double, sgst: double, samt: double
"""
_INVOICE = f"""
    inum: string, inv_no: string, invNo: string, dt: string, inv_date: string,
    val: double, total_val: double, txval: double, taxable_val: double,
    itms: array<struct<itm_det: struct<{_ITEM}>, {_ITEM}>>,
    items: array<struct<itm_det: struct<{_ITEM}>, {_ITEM}>>
"""
_SUPPLIER_LIST = (
    f"array<struct<ctin: string, gstin: string, inv: array<struct<{_INVOICE}>>, "
    f"invoices: array<struct<{_INVOICE}>>>>"
)
GSTR2B_STATEMENT = _schema(f"""
    statement_id string, gstin string, rgstin string,
    data struct<gstin: string, rgstin: string,
                docdata: struct<gstin: string, b2b: {_SUPPLIER_LIST}>>,
    docdata struct<gstin: string, b2b: {_SUPPLIER_LIST}>,
    b2b {_SUPPLIER_LIST}
""")
