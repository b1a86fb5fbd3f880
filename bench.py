"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``prepare`` is the cold preparation (joins, windows, splits, one write). Every other query starts from the
prepared flow table, as a user of the library would, and is read to the end.
"""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = [
    "assign_windows", "clean_flows", "split_random_flows", "unusual_hosts", "pagerank", "clustering", "host_context", "host_context_grouped", "neighbor_mean",
    "standardise_apply", "identity_probe", "spearman", "average_precision", "summary_metrics", "contrast", "prior_correction", "sessionize",
    "random_forest",
]


def main() -> None:
    from flowlens.plans import base, registry
    from flowlens.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    registry.load()
    times: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        out = work()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    flows = timed("prepare", lambda: base.labelled(spark, SF_DIR).count())
    timed("prepare_predictions", lambda: (base.predictions(spark, SF_DIR).count(), base.predictions(spark, SF_DIR, 1).count()))
    for name in HEADLINE:
        timed(name, lambda: registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": SF_DIR.rstrip("/").split("sf")[-1], "flows": flows,
        "host_context_flows_per_sec": round(flows / times["host_context"]), "host_context_grouped_flows_per_sec": round(flows / times["host_context_grouped"]), "random_forest_fit_and_score_flows_per_sec": round(flows / times["random_forest"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
