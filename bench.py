"""Time the headline queries; prints one JSON line."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ("events_summary", "events_dedup_ingest", "events_sessions", "plan_totals", "findings_rollup", "gpax_weighted", "multi_agg", "slot_profile", "slot_clash", "interval_overlap_exact", "bm25_topk", "tfidf_cosine_topk", "rrf_hybrid", "ir_metrics", "graph_critical_path", "greedy_plan")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from termloom import queries

    found, seconds = queries.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
