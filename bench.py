"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from buyerlens.registry import load
from buyerlens.session import local_session

HEADLINE = (
    "user_table",
    "universe_thresholds",
    "event_column_profile",
    "customer_engineered",
    "customer_prepared",
    "stratified_split",
    "user_constructs",
    "train_subsample",
    "roc_auc",
    "topk_accuracy",
    "macro_ovr_auc",
    "silhouette",
    "davies_bouldin",
    "calinski_harabasz",
    "interpretability_summary",
    "stability_map",
    "record_aggregate",
    "significance_vs_best",
    "sweet_spot",
    "soft_assignment",
    "pca_embedding",
    "kmeans_assignment",
    "mixture_posteriors",
    "autoencoder_embedding",
    "construct_vae_embedding",
    "binary_heads",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["event_mix"](spark, sf_dir).collect()  # start the session before timing
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    spark.stop()
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
