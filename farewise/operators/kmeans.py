"""k-means operators (``pyspark.ml``): feature assembly, fit, assignment and
per-cluster aggregates.

Cluster labels are arbitrary; results expose centres and statistics, never the
label, so they are comparable between runs and engines."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Number of clusters and random seed of the original fit (the
# ±30-minute window, top 3 hotspots and top 10 tables are the keyword
# defaults of ``time_window``, ``hotspots`` and the explore functions).
DEFAULT_K = 5
DEFAULT_SEED = 42


def assemble_features(
    df: DataFrame, cols: tuple[str, ...] = ("long", "lat"), output: str = "features"
) -> DataFrame:
    """Vector column from ``cols``; rows with a null/NaN input are skipped."""
    return VectorAssembler(
        inputCols=list(cols), outputCol=output, handleInvalid="skip"
    ).transform(df)


def fit_kmeans(
    points: DataFrame,
    k: int = DEFAULT_K,
    seed: int = DEFAULT_SEED,
    weight_col: str | None = None,
    features_col: str = "features",
) -> KMeansModel:
    """k-means‖ with Spark's defaults for everything but ``k`` and ``seed``."""
    km = KMeans(k=k, seed=seed, featuresCol=features_col)
    if weight_col:
        km = km.setWeightCol(weight_col)
    return km.fit(points)


def assign_clusters(points: DataFrame, model: KMeansModel, output: str = "cluster") -> DataFrame:
    """Nearest-centre label for every point (``model.transform``)."""
    return model.copy().setPredictionCol(output).transform(points)


def cluster_aggregates(assigned: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Per cluster, over weighted zone points (``n`` trips at a point):
    member-mean centre, average revenue, average tip and trip count.

    Equal to the trip-level averages: every trip of a zone sits at its zone
    point, so a mean over trips is a weighted mean over points."""
    n = F.col("n")
    total = F.sum(n)
    return assigned.groupBy(cluster_col).agg(
        (F.sum(F.col("long") * n) / total).alias("centroid_long"),
        (F.sum(F.col("lat") * n) / total).alias("centroid_lat"),
        (F.sum("sum_total") / total).alias("avg_revenue"),
        (F.sum("sum_tip") / total).alias("avg_tip"),
        total.cast("bigint").alias("trips"),
    )


def joined_cluster_stats(assigned: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """The same statistics as three separate aggregates joined on the cluster
    key (left ``USING`` joins).  All inputs are bounded by the number of zone
    points, so the joins are tiny."""
    n = F.col("n")
    centres = assigned.groupBy(cluster_col).agg(
        (F.sum(F.col("long") * n) / F.sum(n)).alias("centroid_long"),
        (F.sum(F.col("lat") * n) / F.sum(n)).alias("centroid_lat"),
    )
    revenue = assigned.groupBy(cluster_col).agg(
        (F.sum("sum_total") / F.sum(n)).alias("avg_revenue")
    )
    tip = assigned.groupBy(cluster_col).agg((F.sum("sum_tip") / F.sum(n)).alias("avg_tip"))
    return centres.join(revenue, on=cluster_col, how="left").join(tip, on=cluster_col, how="left")


def model_centres(model: KMeansModel, spark) -> DataFrame:
    """The fitted centres as ``cluster, center_long, center_lat`` (at most ``k``
    rows, so building them on the driver is bounded by a parameter)."""
    rows = [(i, float(c[0]), float(c[1])) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster int, center_long double, center_lat double")
