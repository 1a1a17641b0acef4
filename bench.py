"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Every query is timed with all its work: the shared staged panel is dropped before each, and
all result rows are produced. One untimed pass over a small query warms the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tailspark import build_session, catalog  # noqa: E402

HEADLINE = (
    "weekly_returns",
    "asof_fundamentals",
    "asof_controversies",
    "feature_panel",
    "forward_targets",
    "risk_buckets",
    "split_evaluation",
    "forward_overlay",
    "quarter_summary",
    "descriptive_stats",
    "correlation_matrix",
    "weekly_text",
    "bigram_terms",
    "cleaning_log",
    "forward_downside_signal",
    "model_scores",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__driver__memory="16g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["weekly_benchmark"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        catalog.forget()
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
