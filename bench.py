"""Headline queries at one scale; prints one JSON line with seconds per query."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from faultline.plans import QUERIES  # noqa: E402
from faultline.session import local_session  # noqa: E402

HEADLINE = [
    "d04_event_windows",
    "d07_window_granularity",
    "f05_incident_class",
    "f09_risk_score",
    "e05_rolling",
    "e08_e10_e12_detectors",
    "e11_sessionize",
    "e11_sessionize_global",
    "d14_f06_log_incidents",
    "d16_f08_multisource_incidents",
    "c06_mark_in_interval",
    "c07_next_event",
    "c10_d23_fault_windows",
    "c14_matched_controls",
    "c15_daily_controls",
    "c16_offset_coverage",
    "e25_horizon_labels",
    "m05_auc",
    "m07_m08_threshold_sweep",
    "m11_m15_prefault_summary",
    "m12_rank_signals",
    "b09_clean_text",
    "d01_ticket_analytics",
    "d29_duplicate_conflicts",
    "g01_tfidf",
    "c20_topk_similar",
    "g21_label_consistency",
    "g12_log_semantic",
    "t02_event_window_stream",
    "t03_incident_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores))
    QUERIES["d04_event_windows"](spark, folder).limit(1).collect()  # start-up, not timed
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
