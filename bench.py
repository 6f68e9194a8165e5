"""Benchmark the headline queries; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "dense_eval",        # flagship: prequential dense evaluation (embeddings)
    "reports_split",     # text preparation + positions + split (documents)
    "doc_sections",      # HTML docs pipeline (pages)
    "overlap_eval",      # word-overlap evaluation (inverted index)
    "tfidf_ranked",      # tf-idf cosine ranking
    "blend_eval",        # tf-idf + dense blend evaluation (block path)
    "nsp_pairs",         # docs example builder (conversations)
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from dupescope.plans.queries import REGISTRY
    from dupescope.session import get_spark

    spark = get_spark()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if name not in REGISTRY:
            continue
        t = time.time()
        REGISTRY[name](spark, sf_dir).collect()
        times[name] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
