"""Benchmark of the headline queries; prints one JSON line.

Every query runs once to warm the JVM and is then timed writing to a sink that drops all rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from groundline.plans.queries import QUERIES
from groundline.session import local_session

HEADLINE = [
    "tfidf_topk", "bm25_topk", "rrf_fusion", "vector_cosine_topk", "number_locations", "grounding_verdict",
    "corrections_by_kind", "attribution_findings", "sanitize_text", "two_level_chunks", "pipe_table_rows",
    "page_rehydrate", "hybrid_retrieve",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cores, shuffle_partitions=int(cores))
    by_name = {query.__name__: query for query in QUERIES}
    seconds = {}
    for name in chosen:
        for attempt in range(2):
            start = time.perf_counter()
            by_name[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
            print(f"{name} run {attempt + 1}: {seconds[name]} s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline query seconds, warm", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
