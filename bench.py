"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from loam import catalog
from loam.session import session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
#: Searches, scores, contexts, items, corpus statistics, graph, structures.
HEADLINE = (
    "search_or", "search_topk", "search_and", "score_advanced", "match_counts", "bulk_search", "fuzzy_search", "context_snippets", "frequency_dict", "word_clusters_topk",
    "item_index", "item_search", "position_to_item_halfopen", "merge_results", "graph_update_node", "degrees", "version_history", "state_as_of", "grid_shapes", "grid_evaluate",
    "module_mapping", "similarity_pairs", "dsl_commands",
)


def run(spark, query) -> float:
    began = time.perf_counter()
    query(spark, SF).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    spark = session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    run(spark, queries["search_or"])  # starts the Python workers and compiles
    took = {name: round(min(run(spark, queries[name]) for _ in range(2)), 3) for name in HEADLINE}
    size = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("sum(octet_length(text)) AS b", "count(*) AS n").first()
    print(json.dumps({
        "metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(SF).name.removeprefix("sf"),
        "document_search_mb_per_s": round(size["b"] / (1 << 20) / took["search_or"], 1), "documents_per_s": round(size["n"] / took["search_or"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
