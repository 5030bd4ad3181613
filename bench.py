"""Times the headline queries and prints one line of JSON."""

import json
import os
import time

from tessera.plans import catalog
from tessera.session import local

QUERIES = ["eval_breakdowns", "vec_rank_cosine", "knn_tags", "micro_prf", "pareto_front", "confounder_band", "gap_islands", "ngram_counts_2", "containment", "pairwise_mi", "pagerank", "score_percentages", "pl_sufficient_stats", "cluster_agglomerative", "chunk_sections", "hierarchy_closure", "text_views"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local(os.environ.get("BENCH_CPUS", "8"), 8)
    spark.sparkContext.setLogLevel("ERROR")
    found, all_queries = {}, catalog.queries()
    for name in QUERIES:
        start = time.time()
        all_queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        found[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
