"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from segscore.session import session

#: Queries over the larger tables, each with another plan shape.
HEADLINE = [
    "per_label_prf", "threshold_tuning", "average_precision", "micro_macro_summary", "bootstrap_f1_ci", "paired_comparison", "lineitem_bootstrap", "lineitem_pivot",
    "interval_overlap_join", "segment_documents", "html_text", "tfidf_top_terms", "oov_rate", "shingle_containment", "nearest_neighbour", "exclusion_cascade", "longest_sentences", "null_pvalues", "repeatability",
]


def main() -> None:
    path, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", 2 * int(cpus), **{"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    from segscore.queries import QUERIES

    QUERIES["split_summary"](spark, path).collect()  # starts the workers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    n = spark.read.parquet(f"{path}/documents.parquet").count()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": path.rstrip("/").rsplit("sf", 1)[-1], "documents": n}))
    spark.stop()


if __name__ == "__main__":
    main()
