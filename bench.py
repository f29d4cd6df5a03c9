"""Time the headline queries and print one JSON line.

Each query runs once to warm up the JVM's compiler and once for the clock; its
whole result is computed and thrown away. The indexes of the pair corpus and of the
documents are built once, before the queries, and their times are reported on their own.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from msgtriage.catalog import queries as catalog  # noqa: E402
from msgtriage.operators import retrieval  # noqa: E402
from msgtriage.session import local_session  # noqa: E402

HEADLINE = (
    "reply_pairs", "capped_pairs", "leakage_anti_join", "weak_labels", "weak_training_set", "quota_sample",
    "normalize_text", "escalation_decision", "draft_reply", "tfidf_vocab", "tfidf_weights", "topk_retrieval",
    "simple_triage", "production_triage", "predict_intent", "simple_triage_fitted", "production_triage_fitted",
    "bleu4", "rouge_l", "pair_cosine", "per_class_prf",
    "system_comparison", "breakdown_counts", "weighted_kappa", "agreement_macro",
)


def clock(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, cores)
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> None:
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    index_seconds = clock(lambda: catalog.case_index(spark, sf_dir))
    document_index_seconds = clock(lambda: catalog.document_index(spark, sf_dir))
    times = {}
    for name in HEADLINE:
        once(name)
        times[name] = clock(lambda: once(name))
    asked = catalog.user_turns(spark, sf_dir)
    candidates = retrieval.candidates(asked, catalog.document_index(spark, sf_dir), 3).count()
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(json.dumps({
        "metric": "headline queries, total seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rsplit("sf", 1)[-1],
        "index_build_sec": index_seconds,
        "document_index_build_sec": document_index_seconds,
        "search_ms_per_query": round(1000 * times["topk_retrieval"] / asked.count(), 3),
        "search_pairs_scored": candidates,
        "triage_messages_per_sec": round(documents / times["production_triage"], 1),
        "fitted_triage_ms_per_message": round(1000 * times["production_triage_fitted"] / documents, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
