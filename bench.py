"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meshledger.catalog import REGISTRY  # noqa: E402
from meshledger.session import local_session  # noqa: E402

HEADLINE = ("reconcile_interfaces", "reconcile_devices", "reconcile_sites", "change_detect", "carry_forward_fold",
            "ingest_explode", "placeholder_override", "slug_text", "log_page", "log_combined", "log_metrics",
            "stream_sites", "constraints_network")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("meshledger-bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
