"""The nearest of a table of centres, for every row of a table of points.

``pyspark.ml`` assigns points to the centres of a model it has just fitted.  Here the
centres are a table of any size, ``k`` of them are wanted, and the distance is planar or
on the globe.  No pair of a point and a far centre is ever made:

* the places of centres are laid in a tree of grid cells: a cell of more than ``LEAF`` places
  is split in 4 x 4 (or 4 x 4 x 4), so leaves are as deep as centres are dense there.  A
  cell's row holds, of each child, how many places it has and their bounding box; a leaf's
  row holds its centres;
* every distinct place of a point first goes down the tree alone, always to the child whose
  box is nearest of those with ``k`` centres.  The ``k``-th distance in the leaf it ends at
  (or that leaf's far corner) is a radius that surely holds its ``k`` nearest;
* then it goes down again, to every child whose box is within the radius: a few leaves.  Of
  each the ``k`` best are taken where the place meets the leaf, and a place's are merged.

All joins are equi-joins on the cell, and what is done with a cell's children or centres is
done within a row.  On the globe the boxes lie in space (places as points of the unit
sphere), so the poles and the date line need no care; the distance is the great circle's.

Scale: work per place is a few cells a level, and levels grow with the logarithm of the
number of centres, however far or dense they lie.  A place is one row on its way to the
radius, and as many rows as leaves are within it after that: what is shuffled grows with the
places and the centres, not with pairs of them.  Rows at one place (trips of a zone) go down
once and meet the answer by an equi-join.  Levels of few cells are broadcast.

Points and centres with a null or NaN coordinate take no part.  Equal distances rank by
``center_id``; several centres may share a place, or an id.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farewise.functions.geo import haversine_miles
from farewise.session import cut_lineage

LEAF = 64
STEP = 2  # levels taken at once: a cell has up to 4 children a dimension
LEVELS = 48  # a cell may be 2 ** -48 of the extent: one far centre does not heap up the others
# Cells of a level, children counted, that may be broadcast.
BROADCAST_ROWS = 1 << 16
# Rounding of boxes and distances never leaves out a centre that counts.
SLACK = 1e-9
METRICS = ("plane", "sphere")
NEAREST = "long double, lat double, rank int, center_id {}, center_long double, center_lat double, distance double"


def _axes(metric: str, long: str, lat: str) -> list[Column]:
    """A place as coordinates in which nearer is nearer: the plane, or the unit sphere in space."""
    if metric == "plane":
        return [F.col(long), F.col(lat)]
    a, b = F.radians(lat), F.radians(long)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def _distance(metric: str, centre: Column) -> Column:
    if metric == "plane":
        x, y = F.col("long") - centre["center_long"], F.col("lat") - centre["center_lat"]
        return x * x + y * y
    return haversine_miles("lat", "long", centre["center_lat"], centre["center_long"])


def _total(terms: list[Column]) -> Column:
    return reduce(add, (t * t for t in terms))


def _least_to(xs: list[str], box: Column) -> Column:
    """Square of the distance from a place to the nearest point of a box."""
    return _total([F.greatest(box[f"a{i}"] - F.col(x), F.col(x) - box[f"b{i}"], F.lit(0.0)) for i, x in enumerate(xs)])


def _most_to(xs: list[str], box: Column) -> Column:
    """The same to its farthest corner."""
    return _total([F.greatest(F.abs(box[f"a{i}"] - F.col(x)), F.abs(F.col(x) - box[f"b{i}"])) for i, x in enumerate(xs)])


def _tree(known: DataFrame, xs: list[str], most: int) -> tuple[Column, list[DataFrame], DataFrame]:
    """(children of the root, tables of the split cells of each level below, leaves).

    ``known`` has ``_f0, _f1, ..``: a place's cell at the deepest level.  Tables have ``_node``
    and ``_kids``, leaves ``_node`` and ``_centres``."""
    n = len(xs)

    def node(level: int) -> Column:
        return F.struct(F.lit(level).alias("l"), *[F.shiftright(f"_f{i}", LEVELS - level).alias(f"c{i}") for i in range(n)]).alias("_node")

    boxes = [F.min(x).alias(f"a{i}") for i, x in enumerate(xs)] + [F.max(x).alias(f"b{i}") for i, x in enumerate(xs)]
    top, tables, ends, split = None, [], [], None
    for level in range(STEP, LEVELS + 1, STEP):
        # only centres in cells that were split are counted at the next level
        inside = known if split is None else known.withColumn("_node", node(level - STEP)).join(*split, "left_semi")
        cells = cut_lineage(inside.groupBy(node(level)).agg(F.count(F.lit(1)).alias("n"), *boxes))
        large = F.col("n") > (most if level < LEVELS else float("inf"))
        count, more = cells.agg(F.count(F.lit(1)), F.count_if(large)).first()
        if top is None:
            # every place meets the root's children: at most 4 ** n boxes, as literals
            kids = [(r, F.struct(F.lit(level).alias("l"), *[F.lit(r["_node"][f"c{i}"]).cast("long").alias(f"c{i}") for i in range(n)])) for r in cells.collect()]
            top = F.array(*[F.struct(own.alias("_node"), *[F.lit(r[c]).alias(c) for c in cells.columns[1:]]) for r, own in kids])
        else:
            up = F.struct(F.lit(level - STEP).alias("l"), *[F.shiftright(F.col(f"_node.c{i}"), STEP).alias(f"c{i}") for i in range(n)])
            kids = cells.groupBy(up.alias("_up")).agg(F.collect_list(F.struct(*cells.columns)).alias("_kids"))
            tables.append(_small(kids.withColumnRenamed("_up", "_node"), count))
        if count > more:
            leaf = _small(cells.filter(~large).select("_node"), count - more)
            ends.append(known.withColumn("_node", node(level)).join(leaf, "_node", "left_semi"))
        if not more:
            break
        split = _small(cells.filter(large).select("_node"), more), "_node"
    centre = F.struct("center_id", "center_long", "center_lat", *xs)
    leaves = reduce(DataFrame.unionByName, ends).groupBy("_node").agg(F.collect_list(centre).alias("_centres"))
    return top, tables, cut_lineage(leaves)


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _placed(df: DataFrame, long: str, lat: str) -> DataFrame:
    """Rows with a usable place, as doubles (-0.0 is 0.0, as in grouping)."""
    df = df.withColumns({c: F.col(c).cast("double") + F.lit(0.0) for c in (long, lat)})
    good = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (long, lat)]
    return df.filter(good[0] & good[1])


def nearest_centres(points: DataFrame, centres: DataFrame, k: int = 1, metric: str = "plane") -> DataFrame:
    """The ``k`` (or all, if fewer) centres nearest to each distinct place of ``points``:
    ``long, lat, rank, center_id, center_long, center_lat, distance``.

    ``points`` have ``long, lat``; ``centres`` have ``center_id, center_long, center_lat``.
    ``distance``: miles on the sphere, degrees in the plane."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k!r}")
    places = _placed(points.select("long", "lat"), "long", "lat").distinct()
    # of centres at one place only the k smallest ids can count
    here = Window.partitionBy("center_long", "center_lat").orderBy("center_id")
    known = _placed(centres.select("center_id", "center_long", "center_lat"), "center_long", "center_lat")
    known = known.withColumn("_r", F.row_number().over(here)).filter(F.col("_r") <= k).drop("_r")
    axes = _axes(metric, "center_long", "center_lat")
    n = len(axes)
    xs = [f"_x{i}" for i in range(n)]
    known = cut_lineage(known.withColumns(dict(zip(xs, axes))))
    all_ = known.agg(
        F.count(F.lit(1)).alias("n"), *[F.min(x).alias(f"a{i}") for i, x in enumerate(xs)], *[F.max(x).alias(f"b{i}") for i, x in enumerate(xs)]
    ).first()
    if not all_["n"]:
        kind = known.schema["center_id"].dataType.simpleString()
        return points.sparkSession.createDataFrame([], NEAREST.format(kind))
    extent = max(all_[f"b{i}"] - all_[f"a{i}"] for i in range(n)) or 1.0
    # a power of two of the extent, so a cell of a level is the shifted cell of a deeper one
    deepest = [F.floor((F.col(x) - F.lit(all_[f"a{i}"])) / F.lit(extent) * F.lit(2.0**LEVELS)).cast("long") for i, x in enumerate(xs)]
    known = known.withColumns({f"_f{i}": F.least(c, F.lit((1 << LEVELS) - 1)) for i, c in enumerate(deepest)})
    top, tables, leaves = _tree(known, xs, max(LEAF, 2 ** (2 * STEP) * k))

    def within(square: Column) -> Column:
        return F.col("_reach").isNull() | (square <= F.col("_reach") * (1 + SLACK) + SLACK * SLACK)

    # one row a place, down to the radius
    at = places.withColumns(dict(zip(xs, _axes(metric, "long", "lat"))))
    for table in [None, *tables]:
        kids = top if table is None else F.col("_kids")
        enough = F.filter(kids, lambda c: c["n"] >= k)
        nearest = F.array_min(F.transform(enough, lambda c: F.struct(_least_to(xs, c).alias("near"), _most_to(xs, c).alias("far"), c["_node"].alias("node"))))
        if table is None:
            at = at.withColumn("_to", nearest).withColumns({"_node": F.col("_to.node"), "_reach": F.col("_to.far")}).drop("_to")
        else:
            at = at.join(table, "_node", "left").withColumn("_to", nearest).drop("_kids")
            at = at.withColumns({"_node": F.coalesce("_to.node", "_node"), "_reach": F.coalesce("_to.far", "_reach")}).drop("_to")
    squares = F.sort_array(F.transform("_centres", lambda c: _total([F.col(x) - c[x] for x in xs])))
    at = at.join(leaves, "_node", "left").withColumn("_reach", F.least("_reach", F.get(squares, F.lit(k - 1)))).drop("_centres")
    # to every leaf within the radius
    met = at
    for table in [None, *tables]:
        kids = top if table is None else F.col("_kids")
        near = F.transform(F.filter(kids, lambda c: within(_least_to(xs, c))), lambda c: c["_node"])
        if table is None:
            met = met.withColumn("_node", F.explode(near))
        else:
            met = met.join(table, "_node", "left").withColumn("_to", F.explode(F.coalesce(near, F.array("_node"))))
            met = met.withColumn("_node", F.col("_to")).drop("_kids", "_to")
    near = F.filter("_centres", lambda c: within(_total([F.col(x) - c[x] for x in xs])))
    found = F.transform(near, lambda c: F.struct(_distance(metric, c).alias("far"), *[c[x].alias(x) for x in ("center_id", "center_long", "center_lat")]))
    best = met.join(leaves, "_node").select("long", "lat", F.slice(F.sort_array(found), 1, k).alias("_best")).filter(F.size("_best") > 0)
    merged = best.groupBy("long", "lat").agg(F.slice(F.sort_array(F.flatten(F.collect_list("_best"))), 1, k).alias("_best"))
    ranked = merged.select("long", "lat", F.posexplode("_best").alias("_at", "_c"))
    distance = F.sqrt("_c.far") if metric == "plane" else F.col("_c.far")
    return ranked.select(
        "long", "lat", (F.col("_at") + 1).alias("rank"), "_c.center_id", "_c.center_long", "_c.center_lat", distance.alias("distance")
    )


def assign_to_centres(points: DataFrame, centres: DataFrame, metric: str = "plane") -> DataFrame:
    """Every row of ``points`` with its nearest centre: ``center_id, center_long, center_lat``.
    Rows without a place are skipped, as in feature assembly."""
    near = nearest_centres(points, centres, 1, metric).select("long", "lat", "center_id", "center_long", "center_lat")
    return _placed(points, "long", "lat").join(near, ["long", "lat"])


def nearest_hotspots(users: DataFrame, clusters: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` clusters nearest to each user on the globe, as rows: the users' columns,
    ``rank, center_id, center_long, center_lat, distance_mi``.

    ``users`` have ``lat, long``; ``clusters`` have ``center_id, center_long, center_lat``.
    A user without a place has no rows."""
    near = nearest_centres(users, clusters, k, "sphere")
    found = F.struct("rank", "center_id", "center_long", "center_lat", F.col("distance").alias("distance_mi"))
    # one row a place, so a place that many users share is split like any skewed key
    per_place = near.groupBy("long", "lat").agg(F.sort_array(F.collect_list(found)).alias("_found"))
    return _placed(users, "long", "lat").join(per_place, ["long", "lat"]).withColumn("_h", F.explode("_found")).select(
        *users.columns, "_h.rank", "_h.center_id", "_h.center_long", "_h.center_lat", "_h.distance_mi"
    )
