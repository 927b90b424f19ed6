"""Headline timings: one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bookweave.plans import registry  # noqa: E402
from bookweave.session import local_session, ship_package  # noqa: E402

# Query, and the table whose rows give its throughput.
HEADLINES = {
    "catalog_search": "part",
    "dedupe_books": "part",
    "resolve": "orders",
    "enrich_fill": "part",
    "crawled_page_fields": "pages",
    "extract_cards": "part",
    "parse_toc_line": "toc_lines",
    "toc_from_pages": "toc_pages",
    "assign_levels": "entries",
    "validate_toc": "entries",
    "merge_tocs": "tocs",
    "spatial_texts": "line_boxes",
    "scanned_verdict": "doc_pages",
    "task_state": "events",
    "changed_only": "events",
    "idle_sessions": "events",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    ship_package(spark)
    registry.load()
    from bookweave.plans.views import Views

    views, seconds, rates = Views(spark, folder), {}, {}
    registry.QUERIES["catalog_search"](spark, folder).write.format("noop").mode("overwrite").save()  # warm up
    for name, source in HEADLINES.items():
        begun = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
        rates[name] = round(getattr(views, source).count() / seconds[name])
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
