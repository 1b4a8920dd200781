"""Weighted k-means by Lloyd's iterations with stated starting centres.

``pyspark.ml`` draws its starting centres at random, so its answer depends on the
layout of the data wherever clusters overlap.  Here the same points give the same
clusters in any layout, and many small fits run side by side:

* ``lloyd``: one fit as a DataFrame loop over a landed table of points, from a table
  of starting centres.  Each step is one pass with partial aggregates; only the ``k``
  centres pass the driver.
* ``lloyd_groups``: one fit per key, each over at most as many points as there are
  zones, as grouped work in one job.  The cheapest of ``starts`` fits
  from ``spread_centres`` is kept.

Distances are planar, as in ``pyspark.ml``; a point equally near to two centres goes to
the first; a centre without points stays where it is; points with a null or NaN
coordinate or weight, or without a positive weight, take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from farewise.session import cut_lineage

# The step count is that of ``pyspark.ml``'s default.
MAX_STEPS = 20
# Centres that moved less than this (degrees, about a micrometre) stand still.
TOLERANCE = 1e-11
STARTS = 32
SEED = 42
# Centres are literals of the assignment expression.
MOST_CENTRES = 256

# Digits after the point that places and money are summed with.
DEGREE_PARTS, MONEY_PARTS = 9, 6

CLUSTERS = "centroid_long double, centroid_lat double, avg_revenue double, avg_tip double, trips long"


def _usable(points: DataFrame, weight: str) -> DataFrame:
    good = F.col(weight) > 0
    for c in ("long", "lat", weight):
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return points.filter(good)


def nearest_of(centres: list[tuple[float, float]], long: str = "long", lat: str = "lat") -> Column:
    """Number of the centre nearest to the point, the first of several."""
    x, y = F.col(long), F.col(lat)
    far = [((x - F.lit(a)) * (x - F.lit(a)) + (y - F.lit(b)) * (y - F.lit(b))).alias("d") for a, b in centres]
    return F.array_min(F.array(*[F.struct(d, F.lit(i).alias("i")) for i, d in enumerate(far)]))["i"]


def lloyd(
    points: DataFrame, start: DataFrame, weight: str = "n", max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE
) -> DataFrame:
    """Centres after Lloyd's iterations: ``cluster, center_long, center_lat, trips`` (the
    summed weight of its points, 0 for a centre without any).

    ``points`` have ``long``, ``lat`` and ``weight``; ``start`` has ``cluster, center_long,
    center_lat``, one row per centre.  Ends when no centre moves, or after ``max_steps``."""
    spark = points.sparkSession
    some = _usable(points.select("long", "lat", F.col(weight).alias("_w")), "_w")
    # points at one place move together; the loop reads this table only
    landed = cut_lineage(some.groupBy("long", "lat").agg(F.sum("_w").cast("double").alias("_w")))
    first = start.select("cluster", "center_long", "center_lat").orderBy("cluster").limit(MOST_CENTRES + 1).collect()
    if len(first) > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} starting centres")
    centres = [(r["center_long"], r["center_lat"]) for r in first]
    trips = [0.0] * len(centres)
    for _ in range(max_steps if centres else 0):
        moved = landed.groupBy(nearest_of(centres).alias("i")).agg(
            (F.sum(F.col("long") * F.col("_w")) / F.sum("_w")).alias("x"),
            (F.sum(F.col("lat") * F.col("_w")) / F.sum("_w")).alias("y"), F.sum("_w").alias("w"),
        )
        after, trips = list(centres), [0.0] * len(centres)
        for r in moved.collect():  # at most k rows
            after[r["i"]], trips[r["i"]] = (r["x"], r["y"]), r["w"]
        still = max(max(abs(a - c), abs(b - d)) for (a, b), (c, d) in zip(centres, after)) <= tolerance
        centres = after
        if still:
            break
    rows = [Row(cluster=r["cluster"], center_long=a, center_lat=b, trips=int(w)) for r, (a, b), w in zip(first, centres, trips)]
    kind = start.schema["cluster"].dataType.simpleString()
    return spark.createDataFrame(rows, f"cluster {kind}, center_long double, center_lat double, trips long")


def spread_centres(xy: np.ndarray, w: np.ndarray, k: int, draw: np.random.Generator | None) -> np.ndarray:
    """``k`` (or fewer) starting points.  Without ``draw``: the heaviest, then each time the one
    with the largest weighted squared distance to those taken.  With it: drawn by these shares
    (k-means++)."""
    pick = (lambda share: int(np.argmax(share))) if draw is None else (lambda share: int(draw.choice(len(share), p=share / share.sum())))
    taken = [pick(w)]
    far = ((xy - xy[taken[0]]) ** 2).sum(axis=1)
    while len(taken) < k and (far * w).max() > 0:
        taken.append(pick(far * w))
        far = np.minimum(far, ((xy - xy[taken[-1]]) ** 2).sum(axis=1))
    return xy[taken].copy()


def fit(xy: np.ndarray, w: np.ndarray, k: int, max_steps: int = MAX_STEPS, starts: int = STARTS) -> np.ndarray:
    """Cluster number of each point (rows in a fixed order): the cheapest of ``starts`` fits, the
    first from the points farthest apart, the others from seeded draws."""
    best, labels = None, np.zeros(len(xy), dtype=np.int64)
    draw = np.random.default_rng(SEED)
    for i in range(starts if len(xy) > k else 1):
        centres = spread_centres(xy, w, k, draw if i else None)
        for _ in range(max_steps):
            near = ((xy[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            weights = np.bincount(near, w, minlength=len(centres))
            after = centres.copy()
            some = weights > 0
            for c in (0, 1):
                after[some, c] = np.bincount(near, w * xy[:, c], minlength=len(centres))[some] / weights[some]
            still = np.abs(after - centres).max() <= TOLERANCE
            centres = after
            if still:
                break
        far = ((xy[:, None] - centres) ** 2).sum(axis=2)
        cost = float((far.min(axis=1) * w).sum())
        if best is None or cost < best * (1 - 1e-12):
            best, labels = cost, far.argmin(axis=1)
    return labels


def lloyd_groups(points: DataFrame, keys: list[str], k: int, max_steps: int = MAX_STEPS, starts: int = STARTS) -> DataFrame:
    """Clusters of the weighted zone points of every key: ``keys`` and ``CLUSTERS``.

    ``points``: ``keys, long, lat, n, sum_total, sum_tip``, one row per key and point, so a
    group is at most as large as the zone table.  Places are summed in billionths of a degree
    and money in millionths, as whole numbers: the same points give the same averages to the
    last bit, whatever their order and however the sums before came about."""
    schema = points.select(*keys).schema
    parts = {"long": DEGREE_PARTS, "lat": DEGREE_PARTS, "sum_total": MONEY_PARTS, "sum_tip": MONEY_PARTS}

    def per_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("long", "ascending"), ("lat", "ascending")])
        n = np.array(table.column("n").to_pylist(), dtype=object)
        whole = {c: np.array([int(v.scaleb(p)) for v in table.column(c).to_pylist()], dtype=object) for c, p in parts.items()}
        x, y = (whole[c].astype(float) / 10**DEGREE_PARTS for c in ("long", "lat"))
        labels = fit(np.column_stack([x, y]), n.astype(float), k, max_steps, starts)
        members = [np.flatnonzero(labels == i) for i in np.unique(labels)]
        trips = [int(n[m].sum()) for m in members]

        def mean(values: np.ndarray, digits: int) -> list[float]:
            return [int(values[m].sum()) / 10**digits / t for m, t in zip(members, trips)]

        lead = [pa.array([table.column(c)[0].as_py()] * len(trips), table.schema.field(c).type) for c in keys]
        found = [mean(whole[c] * n, p) if p == DEGREE_PARTS else mean(whole[c], p) for c, p in parts.items()]
        return pa.table([*lead, *(pa.array(f, pa.float64()) for f in found), pa.array(trips, pa.int64())],
                        names=[*keys, "centroid_long", "centroid_lat", "avg_revenue", "avg_tip", "trips"])

    some = _usable(points.select(*keys, "long", "lat", "n", "sum_total", "sum_tip"), "n")
    exact = some.withColumns({c: F.col(c).cast(f"decimal({38 if p == MONEY_PARTS else 18},{p})") for c, p in parts.items()})
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return exact.groupBy(*keys).applyInArrow(per_group, f"{fields}, {CLUSTERS}")
