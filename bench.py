"""Time the headline queries: one JSON line with the seconds of each and their sum."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES

HEADLINE = (
    "passages_flatten",
    "passages_clean",
    "collapse_documents",
    "section_texts",
    "pack_100",
    "pack_350",
    "chunk_text_section",
    "chunk_text_sentence",
    "chunk_quality",
    "dedupe_text",
    "latest_per_id",
    "dense_ids",
    "label_encode",
    "mean_pool",
    "attention_pool",
    "l2_normalize",
    "collection_roundtrip",
    "knn_cosine",
    "knn_l2",
    "knn_cells_all",
    "corpus_ids",
    "search_texts",
    "rag_end_to_end",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("litvec-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["hash_embed"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
