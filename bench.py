"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trawl.plans.queries import REGISTRY
from trawl.session import build_session

HEADLINE = [
    "tokenize_documents", "term_stats", "inverted_index", "bm25_topk", "bm25_filtered",
    "dense_topk", "dense_text_topk", "mmr", "hybrid_rrf", "hybrid_interleave", "hybrid_gated",
    "company_decomposition", "query_split", "rerank_topk", "full_stack_topk", "eval_hybrid_means",
    "prompt_assembly", "page_text", "item_sections", "chunk_documents", "chunk_length_stats",
    "upsert_rows", "stored_collection", "latest_annual_reports",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("corpus_stats", "hashed_embeddings", "dense_topk"):  # start the workers
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        started = time.time()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


main()
