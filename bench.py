"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full into the ``noop`` sink (no collect to the
driver): one warm-up run, then the median of ``$BENCH_RUNS`` timed runs.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opslake.plans import registry  # noqa: E402
from opslake.session import get_session  # noqa: E402

HEADLINE = [
    "tenant_hop3", "tenant_hop2", "semi_join_id_list", "purge_batch", "long_running_filter", "state_pattern_join",
    "human_bytes", "backup_throughput", "duplicate_keys", "wait_deltas", "file_deltas", "counter_actuals",
    "topn_per_snapshot", "multi_metric_topn", "greedy_topn", "dedupe_best", "percent_of_total", "backup_gaps",
    "asof_previous", "chain_totals", "block_leaders", "xml_owner_waiter", "deadlock_findings", "findings_engine",
    "acl_explode", "scalar_clean", "plan_cost_sum", "full_frame_totals",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    registry.load_all()
    times = {}
    for name in names:
        spark.catalog.clearCache()  # nothing that an earlier query kept may be read
        fn = registry.QUERIES[name]
        fn(spark, sf).write.format("noop").mode("overwrite").save()       # warm-up
        ts = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            ts.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(ts), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total_median_sec", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf).replace("sf", ""), "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
