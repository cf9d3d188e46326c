"""The driver contract: every query is registered, and a cross-section is compared with its SQL.

CHECK_ALL=1 compares all of them.
"""

import os

import pytest

from suite.check import compare, connect
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
CROSS_SECTION = [
    "hsn_summary", "b2cs_buckets", "return_envelope", "recon2b_summary", "fuzzy_pairs", "sales_three_way", "filings_by_registration",
    "sales_register", "itc_summary", "subtotal_removal", "tax_apportion", "recon_engine_status", "validation_scores",
    "gap_trigger_merge", "priority_queue", "candidates_best", "event_windows", "candidates_all", "canonical_round_trip", "trigger_timers",
    "event_windows_stream", "return_documents",
]
NAMES = sorted(queries()) if os.environ.get("CHECK_ALL") else CROSS_SECTION


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got = queries()[name](spark, SF).toPandas()
    sql = oracle_sql().get(name)
    if sql:
        assert compare(got, connect(SF).execute(sql).df()) == ""


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_vendor_profiles_of_full_width_numbers(spark, tmp_path):
    con = connect(SF)
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        con.execute(f"COPY (SELECT * REPLACE ({key}+3400000 AS {key}) FROM {name}) TO '{tmp_path}/{name}.parquet'")
    for name in ("customer", "part"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    got = queries()["vendor_profiles"](spark, str(tmp_path)).toPandas()
    assert compare(got, connect(str(tmp_path)).execute(oracle_sql()["vendor_profiles"]).df()) == ""
