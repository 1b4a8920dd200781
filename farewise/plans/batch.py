"""Hotspots for a whole table of requests.

The single request (``hotspots``) costs a scan and a fit.  Clusters depend only on the
time and the borough, so a table of requests shares them:

1. ``minute_prefix``: the per-minute statistics as running sums over the 1440 minutes of
   the day, one row per location and minute.  Any window is the difference of two rows
   (a window over midnight the sum of two such), found by an equi-join on the minute.
2. the distinct minutes asked for, at most 1440 whatever the number of requests,
   join the running sums; their differences join the zone points.
3. the distinct (minute, borough) pairs are clustered as grouped work
   (``lloyd_groups``), at most as many points each as there are zones.
4. each request meets the at most ``k`` clusters of its pair as one array, by an
   equi-join, and ranks them in its own row: nothing is shuffled by request, and a
   minute that a third of all requests ask for costs one fit.

The number of Spark jobs does not depend on the number of requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewise.functions.geo import haversine_miles
from farewise.functions.price import expected_price
from farewise.functions.timeofday import MINUTES_PER_DAY
from farewise.operators.enrich import normalise_borough, with_point
from farewise.operators.kmeans import DEFAULT_K
from farewise.operators.lloyd import MONEY_PARTS, STARTS, lloyd_groups

SUMS = ("n", "sum_total", "sum_tip")


def minute_column(time: Column | str) -> Column:
    """``HH:MM[:SS]`` as minutes after midnight; null for anything else."""
    c = F.trim(F.col(time) if isinstance(time, str) else time)
    part = lambda i: F.regexp_extract(c, r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", i).try_cast("int")
    seconds = F.coalesce(part(3), F.lit(0))
    return F.when((part(1) <= 23) & (part(2) <= 59) & (seconds <= 59), part(1) * 60 + part(2))


def minute_prefix(minute_stats: DataFrame) -> DataFrame:
    """``pulocationid, minute (0 to 1440), n, sum_total, sum_tip``: sums over the minutes before ``minute``.

    Money is summed as decimals (millionths), so differences of running sums are exact."""
    money = f"decimal(38,{MONEY_PARTS})"
    minute_stats = minute_stats.withColumns({c: F.col(c).cast(money) for c in ("sum_total", "sum_tip")})
    days = minute_stats.select("pulocationid").distinct().withColumn(
        "minute", F.explode(F.sequence(F.lit(0), F.lit(MINUTES_PER_DAY)))
    )
    moved = minute_stats.groupBy("pulocationid", (F.col("pickup_minute") + 1).alias("minute")).agg(
        *[F.sum(c).alias(c) for c in SUMS]
    )
    # at most 1441 rows for each location
    w = Window.partitionBy("pulocationid").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    full = days.join(moved, ["pulocationid", "minute"], "left")
    kinds = {"n": "long", "sum_total": money, "sum_tip": money}
    return full.select(
        "pulocationid", "minute", *[F.coalesce(F.sum(c).over(w), F.lit(0)).cast(kinds[c]).alias(c) for c in SUMS]
    )


def window_bounds(asked: Column, window_minutes: int, wrap_midnight: bool) -> Column:
    """The signed rows of ``minute_prefix`` whose sum is the window round ``asked``."""
    last = F.lit(MINUTES_PER_DAY)
    low, high = asked - window_minutes, asked + window_minutes + 1
    bound = lambda minute, sign: F.struct(minute.cast("int").alias("minute"), F.lit(sign).alias("sign"))
    plain = F.array(bound(F.least(high, last), 1), bound(F.greatest(low, F.lit(0)), -1))
    if not wrap_midnight:
        return plain
    if 2 * window_minutes + 1 >= MINUTES_PER_DAY:
        return F.array(bound(last, 1))
    return (
        F.when(low < 0, F.array(bound(high, 1), bound(last, 1), bound(low + MINUTES_PER_DAY, -1)))
        .when(high > last, F.array(bound(last, 1), bound(low, -1), bound(high - MINUTES_PER_DAY, 1)))
        .otherwise(plain)
    )


def window_points(
    asked: DataFrame, prefix: DataFrame, zone_pts: DataFrame, window_minutes: int = 30, wrap_midnight: bool = False
) -> DataFrame:
    """``minute, borough, long, lat, n, sum_total, sum_tip`` of each pair in ``asked``
    (``minute, borough``; an empty borough stands for all of them)."""
    bounds = asked.select("minute").distinct().select(
        F.col("minute").alias("asked"), F.explode(window_bounds(F.col("minute"), window_minutes, wrap_midnight)).alias("b")
    ).select("asked", "b.minute", "b.sign")
    per_location = bounds.join(prefix, "minute").groupBy("asked", "pulocationid").agg(
        *[F.sum(F.col("sign") * F.col(c)).alias(c) for c in SUMS]
    ).filter(F.col("n") > 0)
    zones = with_point(zone_pts.select("locationid", normalise_borough(F.col("borough")).alias("of"), "long", "lat"))
    points = per_location.join(zones, per_location["pulocationid"] == zones["locationid"]).groupBy("asked", "of", "long", "lat").agg(
        *[F.sum(c).alias(c) for c in SUMS]
    )
    pairs = asked.select("minute", "borough").distinct()
    mine = points.join(pairs, (points["asked"] == pairs["minute"]) & ((pairs["borough"] == "") | (pairs["borough"] == points["of"])))
    return mine.groupBy("minute", "borough", "long", "lat").agg(*[F.sum(c).alias(c) for c in SUMS])


def hotspots_batch(
    requests: DataFrame,
    minute_stats: DataFrame,
    zone_pts: DataFrame,
    *,
    k: int = DEFAULT_K,
    window_minutes: int = 30,
    top_n: int = 3,
    wrap_midnight: bool = False,
    starts: int = STARTS,
) -> DataFrame:
    """The rows that ``hotspots(fit="lloyd")`` gives for each request, after its ``request_id``.

    ``requests``: ``request_id, time, lat, long, borough``; ``minute_stats`` from
    ``zone_minute_stats``.  A request without trips in its window, with a time that is
    none, or without a position has no rows."""
    asked = requests.select(
        "request_id", "lat", "long", minute_column("time").alias("minute"),
        F.coalesce(normalise_borough(F.col("borough")), F.lit("")).alias("borough"),
    ).filter(F.col("minute").isNotNull() & F.col("lat").isNotNull() & F.col("long").isNotNull())
    points = window_points(asked, minute_prefix(minute_stats), zone_pts, window_minutes, wrap_midnight)
    clusters = lloyd_groups(points, ["minute", "borough"], k, starts=starts)
    # at most k clusters in a row
    per_pair = clusters.groupBy("minute", "borough").agg(
        F.collect_list(F.struct("centroid_long", "centroid_lat", "avg_revenue", "avg_tip", "trips")).alias("clusters")
    )

    def with_distance(c: Column) -> Column:
        far = haversine_miles(c["centroid_lat"], c["centroid_long"], F.col("lat"), F.col("long"))
        # array_sort orders structs field by field: distance, then centre
        return F.struct(
            far.alias("distance_mi"), c["centroid_long"].alias("centroid_long"), c["centroid_lat"].alias("centroid_lat"),
            c["avg_revenue"].alias("avg_revenue"), c["avg_tip"].alias("avg_tip"), c["trips"].alias("trips"),
        )

    near = F.slice(F.array_sort(F.transform("clusters", with_distance)), 1, top_n)
    ranked = asked.join(per_pair, ["minute", "borough"]).select("request_id", F.posexplode(near).alias("at", "h"))
    return ranked.select(
        "request_id", (F.col("at") + 1).alias("rank"), "h.centroid_long", "h.centroid_lat", "h.avg_revenue", "h.avg_tip",
        "h.trips", "h.distance_mi", expected_price("h.avg_revenue", "h.avg_tip").alias("expected_price"),
    )
