"""Headline queries, timed: prints one JSON line.

Names on the command line replace the headline list. BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every query is written to a
noop sink, so all its rows are produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from khata.session import build_session  # noqa: E402
from suite import QUERIES  # noqa: E402

HEADLINE = [
    "hsn_summary", "b2b_invoices", "b2cs_buckets", "return_envelope", "books_by_invoice", "recon2b_rows", "recon2b_summary",
    "sales_three_way", "filings_by_registration", "dup_within_batch", "sales_register", "itc_summary", "msme_43bh",
    "subtotal_removal", "advance_cascade", "tax_recompute", "recon_engine_status", "validation_scores", "gap_trigger_merge",
    "quality_flags", "priority_queue", "journal_legs", "candidates_best", "template_lines", "event_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": str(max(cpus, 1) * 2), "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["category_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up the JVM
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
