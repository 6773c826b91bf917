"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from proofmill.plans import load  # noqa: E402
from proofmill.session import local_session  # noqa: E402

HEADLINE = (
    "subject_aggregate",
    "eligibility_gate",
    "mirror_links",
    "audit_summary",
    "replicate_aggregate",
    "interval_consensus",
    "weighted_ensemble",
    "regression_metrics",
    "classification_metrics",
    "cross_conformal_coverage",
    "false_discovery_rates",
    "group_bootstrap_metrics",
    "paired_group_bootstrap",
    "permutation_correlation",
    "group_folds",
    "temporal_holdout",
    "rule_mining",
    "matched_pairs",
    "similarity_pairs",
    "nearest_neighbor",
    "similarity_components",
    "prioritization",
    "rank_sensitivity",
    "pareto_fronts",
    "ridge_selection",
    "censored_regression",
    "intake_validation",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    reg = load()
    spark = local_session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.time()
        reg.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
