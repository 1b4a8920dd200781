"""Write PLANS.md: the physical plans Catalyst picks for the key queries.

usage: python scripts/plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "16").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from farewise.fixtures import raw_trips
    from farewise.operators.enrich import attach_zones
    from farewise.operators.explore import top_pickup_zones
    from farewise.operators.window import time_window
    from farewise.plans import catalog as cat
    from farewise.plans.explain import plan_text
    from farewise.plans.hotspots import zone_minute_stats, zone_window_stats
    from farewise.session import scratch_path
    from farewise.sources.trips import load_trips, read_store

    trips, zones = cat.trips(spark, sf), cat.zones(spark, sf)
    curated = load_trips(raw_trips(spark, sf), scratch_path(spark, "plans-curated"))
    items = [
        ("Hotspots, distributed part, raw trips: window first → cleaning → broadcast "
         "zone join → partial/final aggregate by point",
         zone_window_stats(raw_trips(spark, sf), zones, "15:00:00")),
        ("Hotspots over the curated store (partition pruning + pushed minute range)",
         zone_window_stats(read_store(spark, curated), zones, "15:00:00")),
        ("Top pickup zones: aggregate per location before the zone join", top_pickup_zones(trips, zones)),
        ("Row-level left join of trips to zones", attach_zones(trips, zones)),
        ("Per-zone, per-minute statistics (landed once for many requests)", zone_minute_stats(trips)),
        ("Time window over the curated store", time_window(read_store(spark, curated), "15:00:00")),
    ]
    # The fallback beyond the broadcast bound: a salted shuffle join (auto-broadcast
    # off while planning it, so Spark does not broadcast the small fixture table).
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    saved = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    salted = plan_text(attach_zones(trips, zones, salt_buckets=16))
    for k, v in saved.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)

    out = ["# Physical plans", "",
           f"Generated by `scripts/plans.py` at `{sf}` on local[8]; AQE is on, so the",
           "final plans may coalesce shuffle partitions further at run time.", ""]
    for title, df in items:
        out += [f"## {title}", "", "```", plan_text(df).strip(), "```", ""]
    out += ["## Row-level trip → zone join beyond the broadcast bound (salted shuffle join)", "",
            "```", salted.strip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    print("wrote PLANS.md")


if __name__ == "__main__":
    main()
