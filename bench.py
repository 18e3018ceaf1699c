"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "G10_global_ranking", "A10_filtered_ranks", "A11_filtered_evaluation", "A7_auroc",
    "W3_stratified_split", "J3_inductive_routing", "A5_temporal_report", "J1_reindex_edges",
    "A3_degree", "J6_edge_dating", "N1_degree_preserving", "J12_all_pairs_summary",
    "F7_attention_aggregation", "F9_relational_mean", "K6_kge_filtered_evaluation",
    "A13_expression_profile", "K8_training_epochs", "E2_nes", "E3_leave_one_out", "G1_anchor_bfs", "F1_entity_summary",
]


def main() -> None:
    from edgeloom.queries import all_queries
    from edgeloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    wanted = sys.argv[1:] or HEADLINE
    if wanted == ["all"]:
        wanted = list(registered)
    # Start the Python workers before the clock runs.
    spark.range(1000).repartition(int(cpus)).mapInPandas(lambda frames: frames, "id long").count()
    times = {}
    for name in wanted:
        if name not in registered:
            continue
        start = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        if len(sys.argv) > 1:
            print(name, times[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
