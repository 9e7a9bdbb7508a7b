"""Profiles of coordinate columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.columns import normal, numeric, per_column, ref
from millrace.functions.geo import haversine_km

# Fixed values
FAR = 3.0  # standard deviations beyond the mean distance

# Names that suggest coordinates; fixed values, matched as substrings.
LAT_NAMES = ["lat", "latitude", "y_coord", "y"]
LNG_NAMES = ["lng", "lon", "long", "longitude", "x_coord", "x"]


def coordinate_columns(df: DataFrame) -> list[tuple[str, str]]:
    """All pairs of a latitude and a longitude column, by name and by the range of over 80 % of their values; the others are what ``validity`` counts."""
    df = normal(df)
    within = lambda most: lambda c: F.avg((F.abs(ref(c.name).cast("double")) <= most).cast("double"))
    found = per_column(df, numeric(df), {"lat": within(90), "lng": within(180)}).orderBy("pos").collect()

    def fits(share: str, patterns: list[str]) -> list[str]:
        return [r.column for r in found if any(p in r.column.lower() for p in patterns) and (r[share] or 0) > 0.8]

    return [(a, b) for a in fits("lat", LAT_NAMES) for b in fits("lng", LNG_NAMES) if a != b]


def points(df: DataFrame, lat: str, lng: str) -> DataFrame:
    return normal(df).select(ref(lat).cast("double").alias("lat"), ref(lng).cast("double").alias("lng"))


def usable(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """Points in range, without the null island."""
    return points(df, lat, lng).where("abs(lat) <= 90 AND abs(lng) <= 180 AND NOT (lat = 0 AND lng = 0)")


def validity(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """total, out_of_range_lat, out_of_range_lng, null_island, usable and invalid."""
    count = lambda c: F.coalesce(F.sum(F.when(F.expr(c), 1).otherwise(0)), F.lit(0))
    ok = "abs(lat) <= 90 AND abs(lng) <= 180 AND NOT (lat = 0 AND lng = 0)"
    a = points(df, lat, lng).agg(F.count("*").alias("total"), count("abs(lat) > 90").alias("out_of_range_lat"), count("abs(lng) > 180").alias("out_of_range_lng"), count("lat = 0 AND lng = 0").alias("null_island"), count(ok).alias("usable"))
    return a.withColumn("invalid", F.col("total") - F.col("usable"))


def extent(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """Centroid and bounding box of the usable points."""
    return usable(df, lat, lng).agg(F.avg("lat").alias("center_lat"), F.avg("lng").alias("center_lng"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lng").alias("min_lng"), F.max("lng").alias("max_lng"), F.count("*").alias("n"))


def distances(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """Usable points with their distance to the centroid, km."""
    box = extent(df, lat, lng)
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("center_lat"), F.col("center_lng"))
    return usable(df, lat, lng).crossJoin(F.broadcast(box)).withColumn("km", km)


def spread(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """spread_km: population deviation of the distance to the centroid; density: points by square km of the box."""
    far = distances(df, lat, lng).agg(F.stddev_pop("km").alias("spread_km"), F.avg("km").alias("mean_km"))
    box = extent(df, lat, lng)
    height = haversine_km(F.col("min_lat"), F.col("center_lng"), F.col("max_lat"), F.col("center_lng"))
    width = haversine_km(F.col("center_lat"), F.col("min_lng"), F.col("center_lat"), F.col("max_lng"))
    return box.crossJoin(far).select(F.round("spread_km", 4).alias("spread_km"), F.round("mean_km", 4).alias("mean_km"), F.round(F.col("n") / F.greatest(height * width, F.lit(0.01)), 4).alias("density"))


def remote(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """The points beyond mean + 3 deviations from the centroid."""
    far = distances(df, lat, lng)
    cut = far.agg((F.avg("km") + FAR * F.stddev_pop("km")).alias("cut"))
    return far.crossJoin(F.broadcast(cut)).where("km > cut")


def outliers(df: DataFrame, lat: str, lng: str, limit: int = 20) -> DataFrame:
    """The farthest of the remote points."""
    return remote(df, lat, lng).orderBy(F.desc("km"), "lat", "lng").limit(limit).select("lat", "lng", F.round("km", 4).alias("km"))


def clusters(df: DataFrame, lat: str, lng: str, seeds: int = 5, seed: int = 42) -> DataFrame:
    """k-means over the usable points (k follows their number, 2 to 5): the best of some seeds; size, centroid and mean distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    own = usable(df, lat, lng)
    n = own.count()
    if n < 10:
        return df.sparkSession.createDataFrame([], "cluster int, size long, center_lat double, center_lng double, mean_km double")
    vectors = VectorAssembler(inputCols=["lat", "lng"], outputCol="features").transform(own).persist()
    k = min(5, max(2, n // 20))
    fits = [KMeans(k=k, seed=seed + i, initMode="k-means||").fit(vectors) for i in range(seeds)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    dealt = best.transform(vectors).select(F.col("prediction").alias("cluster"), "lat", "lng")
    centers = df.sparkSession.createDataFrame([(i, float(c[0]), float(c[1])) for i, c in enumerate(best.clusterCenters())], "cluster int, center_lat double, center_lng double")
    km = haversine_km(F.col("lat"), F.col("lng"), F.col("center_lat"), F.col("center_lng"))
    return dealt.join(F.broadcast(centers), "cluster").groupBy("cluster").agg(F.count("*").alias("size"), F.first("center_lat").alias("center_lat"), F.first("center_lng").alias("center_lng"), F.avg(km).alias("mean_km"))


def report(df: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each pair of coordinate columns."""
    from functools import reduce

    parts = []
    for lat, lng in pairs or coordinate_columns(df):
        far = remote(df, lat, lng).agg(F.count("*").alias("outliers"))
        row = validity(df, lat, lng).crossJoin(extent(df, lat, lng).drop("n")).crossJoin(spread(df, lat, lng)).crossJoin(far)
        parts.append(row.select(F.lit(lat).alias("lat_column"), F.lit(lng).alias("lng_column"), "*"))
    if not parts:
        raise ValueError("no pair of coordinate columns")
    return reduce(DataFrame.unionByName, parts)
