"""Wall times of the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "order_change_counts",
    "table_changes_ordered",
    "file_changes",
    "flat_records",
    "conversion_outcomes",
    "archive_entries",
    "lineitem_chunks",
    "table_chunks",
    "text_pieces",
    "embedded_texts",
    "answers",
    "nearest_vectors",
    "patched_cells",
    "term_vectors",
    "supplier_ranks",
    "quartiles",
    "limited_requests",
    "job_states",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from rowloom.reports import QUERIES
    from rowloom.session import local_session

    spark = local_session(cpus, "rowloom-bench", memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM code paths and Python workers before the clock does
    QUERIES["nearest_vectors"](spark, folder).count()
    QUERIES["sorted_table"](spark, folder).count()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
