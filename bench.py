"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from haltwerk.plans.catalog import QUERIES  # noqa: E402
from haltwerk.session import local_session  # noqa: E402

HEADLINE = (
    "load_telemetry",
    "drops",
    "window_size",
    "stop_events",
    "rescued_stop_events",
    "schedule_inclusive",
    "core_stop_events",
    "feature_matrix",
    "project_core",  # writes the core table that later queries read
    "join_weather",
    "noisy_union",
    "gap_summary",
    "soft_dup_by_line",
    "gps_speed",
    "stationary_runs",
    "signal_alignment",
    "quantiles_by_line",
    "delay_spearman",
    "delay_by_status",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, app="haltwerk-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    line = {"metric": "total_wall_clock", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
