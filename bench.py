"""Time the headline queries; prints one JSON line."""

import json
import os
import time

from kerbline.plans.catalog import QUERIES
from kerbline.session import local_session

HEADLINE = (
    "next_stop_full_rate", "label_table", "base_features", "nearest_context", "model_features", "training_set", "expected_boardings",
    "seat_summary", "context_summary", "null_profile", "chrono_split", "route_split", "smoothed_rates", "historical_baseline",
    "proxy_stats", "proxy_fallback", "group_metrics", "roc_auc", "threshold_curve", "segment_thresholds", "event_days", "schedule_context",
    "live_rows", "scheduled_rows", "live_or_proxy", "upsert_latest", "import_outcomes", "json_envelope",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "kerbline-bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
