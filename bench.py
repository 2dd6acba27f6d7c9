"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local threads).
Each query runs once to warm up and then RUNS times; the best time counts.
"""

from __future__ import annotations

import json
import os
import pathlib
import time

from mercato.registry.catalog import QUERIES
from mercato.session import build_session

HEADLINE = [
    "revenue", "top_categories_revenue", "revenue_share_by_city", "repeat_rate_basket", "seasonal_anomaly",
    "seller_delay_stats", "delivery_features", "order_lookup", "churn_profile", "daily_category_sales",
    "weekly_resample", "drop_incomplete", "forecast_features", "profile_table", "impute_median",
    "check_primary_key", "check_foreign_key", "chunk_documents", "chunk_pages", "knn_topk", "cross_vectors",
    "retrieve_dedupe", "rerank", "build_context", "eval_report",
]
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in ("churn_profile", "delivery_features"):
        once(name)
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        once(name)
        seconds[name] = round(min(once(name) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": pathlib.Path(sf_dir).name.removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
