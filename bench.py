"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from alphaloom.session import local_session, share_code

QUERIES = ["x03_threshold_gate", "p06_chroma_key", "p18_green_despill", "n01_uncertain_edge", "n02_speckle", "a01_alpha_quality", "a18_p0_report", "a19_candidate_quality", "r03_region_select", "w01_temporal_flicker", "w10_queue_submit", "j05_manifest_merge",
           "n11_soft_support_restore", "u16_refine", "u15_black_enhance", "w03_adaptive_bidirectional", "r04_selection_guard", "k03_compose_output", "x02_flatten_metrics"]


def main() -> None:
    from alphaloom.plans import registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("OFF")
    share_code(spark)
    queries, seconds = registry.queries(), {}
    queries[QUERIES[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    queries["n01_uncertain_edge"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # Python workers too
    for name in QUERIES:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
