"""farewise: pickup-hotspot analytics on Spark DataFrames.

The library takes a caller-owned ``SparkSession`` and returns ``DataFrame``
objects; it never creates or stops a session.  Joins, windows and counts are
lazy.  What fits k-means (``hotspots`` and the cluster statistics) runs its one
pass over trips when called, and lands the zone points it fits on; loads write
when called.  Only values bounded by a parameter reach the driver (``k`` cluster
centres, a 10-row profile sample, the files of one micro-batch, one row per load of the
store).
"""

from farewise.functions.geo import (  # noqa: F401
    haversine_miles,
    register_sql_functions,
    vertex_center,
    wkt_vertices,
)
from farewise.functions.price import expected_price  # noqa: F401
from farewise.operators.account import drop_account, quarantined  # noqa: F401
from farewise.operators.lloyd import lloyd  # noqa: F401
from farewise.operators.nearest import (  # noqa: F401
    assign_to_centres,
    nearest_centres,
    nearest_hotspots,
)
from farewise.plans.batch import hotspots_batch  # noqa: F401
from farewise.plans.hotspots import (  # noqa: F401
    HOTSPOT_SCHEMA,
    add_minute_stats,
    cluster_stats,
    hotspots,
    hotspots_from_minute_stats,
    hotspots_json,
    hotspots_reply,
    nearest_clusters,
    zone_minute_stats,
    zone_window_stats,
)
from farewise.sources.profile import record_profile, schema_profile  # noqa: F401
from farewise.sources.store import vacuum as vacuum_store  # noqa: F401
from farewise.sources.trips import (  # noqa: F401
    clean_trips,
    compact_store,
    load_trip_files,
    load_trips,
    read_store,
    read_trip_files,
)
from farewise.sources.zones import read_zones_csv, zone_points  # noqa: F401
from farewise.streaming.ingest import start_trip_ingest  # noqa: F401

__all__ = [
    "HOTSPOT_SCHEMA",
    "add_minute_stats",
    "assign_to_centres",
    "clean_trips",
    "cluster_stats",
    "compact_store",
    "drop_account",
    "expected_price",
    "haversine_miles",
    "hotspots",
    "hotspots_batch",
    "hotspots_from_minute_stats",
    "hotspots_json",
    "hotspots_reply",
    "lloyd",
    "load_trip_files",
    "load_trips",
    "nearest_centres",
    "nearest_clusters",
    "nearest_hotspots",
    "quarantined",
    "read_store",
    "read_trip_files",
    "read_zones_csv",
    "record_profile",
    "register_sql_functions",
    "schema_profile",
    "start_trip_ingest",
    "vacuum_store",
    "vertex_center",
    "wkt_vertices",
    "zone_minute_stats",
    "zone_points",
    "zone_window_stats",
]
