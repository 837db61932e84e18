"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quillgraph.plans import load
from quillgraph.session import local_session

HEADLINE = [
    "p8_tokenise", "p12_ngrams", "a2_describe_numeric", "a5_author_counts", "i1_vocabulary", "i3_tfidf_index",
    "i7_cooccurrence", "i9_collocations", "i11_discriminative_terms", "q1_search_cosine", "q2_search_euclidean",
    "q8_vector_search", "q9_hybrid_search", "c5_silhouette", "c6_cluster_indices", "c12_central_documents",
    "c17_compare_labels", "g1_author_degrees", "g4_coupling_edges", "g6_combined_degrees", "g9_coauthor_network",
    "g14_components", "g17_path_stats", "g18_clustering_coefficient", "g21_pagerank", "g23_modularity",
    "m1_chi2_terms", "m4_knn_uniform", "m10_error_analysis",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    queries = load().QUERIES
    spark.read.parquet(f"{folder}/region.parquet").count()  # start-up is not part of a query
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
