"""Time the headline queries, each after one untimed run, and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from legajo.plans import catalog
from legajo.session import local_session

HEADLINE = [
    "case_consolidation",
    "wide_cases",
    "consolidation_metrics",
    "decisions_without_priority",
    "classified_documents",
    "cleaned_extractions",
    "field_quality",
    "registered_documents",
    "resolved_ocr",
    "numbered_cases",
    "cross_document_discrepancies",
    "access_counters",
    "feedback_statistics",
    "progress_report",
    "report_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    catalog.load()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # untimed
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
