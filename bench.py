"""Time the headline queries; one JSON line on standard output."""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark import workload
from tidemark.session import local_session
from tidemark.views import INPUT_PARTITIONS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = (
    "I7_evidence_top8", "W8_evidence_pool", "A1_coverage_counts", "W6_newest_per_role", "J11_items_since_boundary",
    "A2_trend_buckets", "J1_dictionary_with_state", "W3_home_ranking", "W5_related_top_k", "I18_topic_pages",
    "X16_upsert", "I12_due_notifications", "I1_normalised_fetch", "X5_article_cards", "J5_phrase_match",
    "I3_role_candidates", "P27_signal_policy", "S1_throttle_replay",
    "I11_role_discovery", "I4_classification", "I5_persisted_rows", "I8_score_refresh",
)


def main() -> None:
    spark = local_session("bench", CPUS, CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set(INPUT_PARTITIONS, CPUS)  # the tables are files of one row group
    entries = workload.load()
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for i in range(RUNS + 1):
            start = time.perf_counter()
            entries[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if i:  # the first run warms up
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cores": CPUS, "spark": spark.version,
        "shuffle_partitions": CPUS, "runs": RUNS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
