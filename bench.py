"""Headline timings: one JSON line with seconds per query (result fully computed, nothing written)."""

from __future__ import annotations

import json
import os
import sys
import time

from lexloom.plans import QUERIES
from lexloom.session import local_session

HEADLINE = ["bm25_topk", "multi_query_max", "pattern_scores", "condition_match", "scoped_retrieve", "structured_score", "rank_rules", "segment_units", "dedupe_by_content", "merge_by_signature",
            "variant_roles", "core_gate", "predicate_vocab", "object_vocab", "normalize_with_vocab", "prune_conflicts", "temporal_filter", "backward_plan",
            "forward_eval", "derive_closure", "unify", "score_tables", "cross_domain_frequencies", "stage_funnel", "generate_candidates", "build_rule_seeds", "session_facts"]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.conf.set("lexloom.input.tasks", os.environ.get("BENCH_CPUS", "8"))  # the bench tables are one row group each
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, root).write.format("noop").mode("overwrite").save()
        took[n] = round(time.time() - t0, 3)
        print(n, took[n], file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": root.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
