"""Headline timings: one JSON line with seconds per query.

What queries read but do not make is made first, each part timed once and cold under a name of its own: the
published table, the raw files, the event log, its pinned questions and verdicts, the result rows, and the
replay of all questions and attempts. Every query then runs once to warm up and ``BENCH_REPEATS`` times
more; its whole result goes to Spark's ``noop`` sink and the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from proofledger.session import build_session
from workloads import analogue, question_queries, verdict_queries
from workloads.registry import ENTRIES

OTHERS = [
    "q13_spelled_block_only", "q15_spelled_row_frame_over_history", "q30_spelled_date_range_and_case_count",
    "stage_rows", "stage_accounting", "check_staged_table", "profile_overview", "profile_ranges",
    "profile_duplicate_raw_rows", "profile_key_uniqueness", "profile_frame_contrast", "aggregate_grouped_medians",
    "window_town_month", "order_dearest_per_town", "print_orders_v1", "print_orders_v2", "compare_order_classes",
    "verdict_rows", "verdict_by_type", "verdict_failure_chart", "log_done_questions", "contract_checks",
    "source_csv_scan", "source_log_scan",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
        # Small inputs: written files of 4 MB keep all cores busy; a cluster keeps Spark's 64 MB.
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"})
    spark.sparkContext.setLogLevel("ERROR")
    cold = {
        "stage_and_publish": lambda: analogue.staged(spark, sf_dir),
        "cold_raw_csv": lambda: analogue.raw_csv(spark, sf_dir, dirty=True),
        "cold_event_log": lambda: analogue.event_log(spark, sf_dir),
        "cold_event_pins": lambda: verdict_queries.questions(spark, sf_dir),
        "cold_verdicts": lambda: verdict_queries.verdicts(spark, sf_dir),
        "cold_result_rows": lambda: analogue.order_rows(spark, sf_dir, 0),
        "cold_replay_verdicts": lambda: question_queries.verdict_table(spark, sf_dir).collect(),
    }
    seconds = {name: timed(part) for name, part in cold.items()}
    names = [n for n in ENTRIES if n[:1] == "q" and "_spelled_" not in n] + OTHERS
    for name in names:
        fn, _ = ENTRIES[name]

        def run() -> None:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()

        run()
        seconds[name] = statistics.median(timed(run) for _ in range(repeats))
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in seconds.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
