"""Time the headline queries; prints one line of JSON.

Each query starts from the files: tokens and metrics kept for other queries are
forgotten first. The result goes to Spark's ``noop`` sink, so that all rows are
computed and none is collected. One untimed query warms the JVM.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from tidewatch.plans.catalog import QUERIES, forget_desks
from tidewatch.plans.session import session

HEADLINES = (
    "J2_named_inbox",
    "S1_sales_scan",
    "S2_contract",
    "M1_token_dictionary",
    "M2_dictionary_extension",
    "M3_mask",
    "M5_unmask_text",
    "M10_leak_audit",
    "P2_sale_line",
    "A2_distinct_customers",
    "A3_context_blocks",
    "A4_period_totals",
    "A5_period_spine",
    "A7_margin_and_velocity",
    "W5_growth_gap",
    "R6_evidence",
    "R9_drafts",
    "R10_length_check",
    "J1_cards",
    "J3_coverage",
    "O1_most_urgent",
    "V1_findings",
    "V2_reports",
    "V3_token_check",
    "ST1_risk_monitor",
    "ST2_count_once",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["J2_named_inbox"](spark, directory).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINES:
        forget_desks()
        start = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "seconds for all headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(directory).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
