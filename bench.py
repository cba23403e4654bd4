"""Times the headline queries: one JSON line, seconds as the median of three warm runs."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from orrery import queries
from orrery.session import session

HEADLINE = (
    "join_count",
    "join_count_preagg",
    "join_rows",
    "join_lane_counts_16",
    "radix_histogram",
    "hash_table_buckets",
    "skew_split_join",
    "edge_load",
    "vertex_degrees",
    "csr_offsets",
    "grid_blocks",
    "replication_factor",
    "bfs_push",
    "bfs_blocked",
    "sssp",
    "cc_labels",
    "pagerank",
    "pagerank_fixed",
    "scatter_add",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(f"local[{cpus}]", cpus, "8g", **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        took = []
        for n in range(RUNS + 1):
            began = time.time()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took += [time.time() - began] if n else []  # the first run compiles
        seconds[name] = round(median(took), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
