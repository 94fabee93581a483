"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores. Every query
runs once, start to finish, into a sink that takes all rows; the session is
warmed by one small aggregate only.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weftgraph.plans import catalog
from weftgraph.session import local_session

HEADLINES = (
    "graph_stats", "contract_matrix", "dependency_matrix", "degree_ranking", "blast_radius", "blast_radius_all_endpoints",
    "consumes_api_edges", "calls_edges", "extract_all_languages", "extract_order_clients", "lexical_search", "hybrid_search",
    "cosine_topk_batch", "guardrail_decisions", "compacted_memory", "change_patches", "stream_guardrails",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    runs, _ = catalog.load()
    runs["repositories"](spark, sf_dir).count()
    names = sys.argv[1:] or HEADLINES
    seconds = {}
    for name in names:
        start = time.time()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
