"""How the flagship's cost grows with the trip volume.

The sf0.1 ``events`` table is replicated ×N inside Spark (``explode`` of a
sequence, ids made unique), landed under the checkpoint folder, and the
flagship is timed three ways on the same data: zone-level k-means over raw
trips, zone-level over the curated store, and the trip-level shape.

usage: python scripts/scale_experiment.py 10 50
"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main():
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "16").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    import bench

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    def timed(make):
        run(make())
        t0 = time.perf_counter()
        run(make())
        return time.perf_counter() - t0

    for rep in [int(x) for x in sys.argv[1:]] or [10]:
        t = bench.scaled_flagship(spark, sf, rep, lambda make, *_: round(timed(lambda: make(spark, sf)), 2))
        print(f"x{rep}: zone-level {t['hotspots']}s, zone-level on curated "
              f"{t['hotspots_curated']}s, trip-level {t['hotspots_trip_level']}s", flush=True)


if __name__ == "__main__":
    main()
