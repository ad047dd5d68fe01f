"""Time the headline queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS, BENCH_KEYS (comma separated or ``all``) and BENCH_RUNS change
the defaults.  Each query runs once to warm up and then BENCH_RUNS times; the median counts.
Results are written to the no-op sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from talkweave.catalog import entries  # noqa: E402
from talkweave.session import local_session  # noqa: E402

HEADLINE = (
    "parse_roundtrip", "turn_events", "mention_attribution", "connection_score", "person_scorecard",
    "group_scorecard", "weekly_series", "style_profile", "topic_bucket", "route_messages", "bm25_index",
    "bm25_topk", "cosine_topk", "hybrid_merge", "fast_retrieve", "qa_verdict", "timeline_positions",
    "context_blocks", "merge_intervals", "paired_exchanges", "recency_sample", "monthly_samples",
    "voice_candidates", "token_chunks", "prompt_rows", "parse_rerank",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_KEYS", "")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    table = entries()
    keys = list(table) if wanted == "all" else wanted.split(",") if wanted else list(HEADLINE)
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for key in keys:
        query = table[key][0]
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[key] = round(statistics.median(taken[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
