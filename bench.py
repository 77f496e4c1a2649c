"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is run to completion with the ``noop`` sink (full execution, no
collect).  ``value`` is the sum of the per-query wall times.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusgraph.plans.catalog import all_queries  # noqa: E402
from corpusgraph.session import local_session  # noqa: E402

HEADLINE = [
    "shared_line_edges",
    "connected_components",
    "component_stats",
    "source_modularity",
    "label_propagation",
    "louvain",
    "leiden",
    "events_statistics",
    "events_resample_daily",
    "events_anomalies",
    "events_moving_average",
    "customer_orders_merge",
    "order_totals",
    "brand_descriptions",
    "document_search",
    "exact_duplicate_documents",
    "document_similarity_pairs",
    "rate_limit_decisions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")),
                          app="corpusgraph-bench")
    qs = all_queries()
    names = [n for n in (only or HEADLINE) if n in qs]
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
