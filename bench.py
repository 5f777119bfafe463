"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = """
trust_exact trust_time_range trust_strict snapshot_trust trust_from_messages dimension_trust requested_scores
ring_mean ring_delta ring_changed change_only newest_value spike_severity
scalar_rule sustained_rule dynamicity_rule two_clause_rule rule_set symptom_intervals
health_rollup_quadratic child_reconcile graph_edges subservice_bags
memory_metrics process_counts cpu_percent disk_busy
tfidf_cosine dense_cosine_topk category_assign term_frequencies eval_micro_f1 query_augmentation
entity_tags service_grouping catalog_match session_120m
triples kg_nodes cardinality_audit latency_stats stream_trust
""".split()


def main() -> None:
    from trustloom.plans import registered_queries
    from trustloom.session import build_session
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session("trustloom-bench", master=f"local[{cpus}]",
                          shuffle_partitions=8 if cpus == "*" else int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    registered, seconds = registered_queries(), {}
    for name in wanted:
        start = time.time()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
