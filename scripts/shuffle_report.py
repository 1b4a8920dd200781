"""Measure what each headline query reads and shuffles, from Spark's event log.

The event log is written to a fresh scratch folder; per query (job group) the
report sums stages, tasks, rows read from files and shuffle bytes/rows written.

usage: python scripts/shuffle_report.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

METRICS = {
    "internal.metrics.input.recordsRead": "rows_read",
    "internal.metrics.shuffle.write.bytesWritten": "shuffle_bytes",
    "internal.metrics.shuffle.write.recordsWritten": "shuffle_rows",
}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="farewise-eventlog-")
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "16")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    import bench
    from farewise.plans import catalog as cat

    runs = {
        "hotspots": lambda: cat.q_hotspots(spark, sf),
        "hotspots (trip-level shape)": lambda: bench.trip_level_hotspots(spark, sf),
        "top_pickup_zones": lambda: cat.q_top_pickup_zones(spark, sf),
        "trips_per_hour": lambda: cat.q_trips_per_hour(spark, sf),
    }
    for name, make in runs.items():
        spark.sparkContext.setJobGroup(name, name)
        make().write.format("noop").mode("overwrite").save()
    spark.stop()

    stage_group, totals = {}, defaultdict(lambda: defaultdict(int))
    paths = [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)]
    for path in sorted(paths):
        if path.endswith((".crc", ".zstd", ".lz4", ".snappy")):
            continue
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                    if group:
                        totals[group]["jobs"] += 1
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    group = stage_group.get(info["Stage ID"])
                    if not group:
                        continue
                    totals[group]["stages"] += 1
                    totals[group]["tasks"] += info.get("Number of Tasks", 0)
                    for acc in info.get("Accumulables", []):
                        key = METRICS.get(acc.get("Name"))
                        if key:
                            totals[group][key] += int(acc.get("Value", 0))
    cols = ["jobs", "stages", "tasks", "rows_read", "shuffle_rows", "shuffle_bytes"]
    print("| query | " + " | ".join(cols) + " |")
    print("| --- |" + " --- |" * len(cols))
    for name in runs:
        t = totals.get(name, {})
        print(f"| {name} | " + " | ".join(str(t.get(c, 0)) for c in cols) + " |")


if __name__ == "__main__":
    main()
