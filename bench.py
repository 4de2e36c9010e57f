"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query runs once to warm up and once timed, into the no-op sink, so that
all columns of all rows are computed and nothing is gathered on the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hearth.plans.queries import QUERIES
from hearth.session import build_session

HEADLINE = [
    "clean_corpus", "dedup_corpus", "label_distribution", "typo_audit", "index_build", "hash_embed",
    "knn_topk", "knn_topk_blocks", "knn_per_user", "retrieve_contexts", "turn_pairs", "memory_turns",
    "memory_facts", "memory_stats", "memory_listing", "memory_block", "prompt_table", "lexicon_toxicity",
    "toxicity_reduction", "bleu_corpus", "rouge_l_stemmed", "greedy_match_score", "emotion_alignment",
    "evaluation_run", "training_set", "stream_guard", "chat_turns", "memory_hits", "knn_clustered_exact",
    "evaluation_report", "classify_label", "stream_memory_ingest", "stream_retrieve",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"}
    spark = build_session("hearth-bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(run(name), 3)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf)}))


if __name__ == "__main__":
    main()
