"""Tracks made of the events table, in integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions.tilemath import place_of, tile_of_pixel
from trackweave.operators import tilehits

# The raster window of the derived tracks and the factors that spread events in it.
X0, Y0, SPAN = 4295168, 2815488, 640
FACTORS = {"x": (7919, 31), "y": (104729, 17)}


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, ts, contribution_id (day and user), gx, gy (pixel at zoom 14, 512 a tile) and its centre lon, lat."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    spread = {k: F.pmod(F.col("event_id") * a + F.col("user_id") * b, F.lit(SPAN)) for k, (a, b) in FACTORS.items()}
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    e = e.select(
        "event_id", "user_id", "ts", (day * 10_000_000 + F.col("user_id")).alias("contribution_id"), (X0 + spread["x"]).alias("gx"), (Y0 + spread["y"]).alias("gy")
    )
    t = tile_of_pixel(F.col("gx"), F.col("gy"), 512)
    place = place_of(t["x"], t["y"], 14, t["cx"] + 0.5, t["cy"] + 0.5, 512)
    return e.withColumn("place", place).select("*", "place.lon", "place.lat").drop("place")


def event_count(spark: SparkSession, sf_dir: str) -> int:
    """The number of events, which Parquet's footers tell."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").count()


def event_shares(spark: SparkSession, sf_dir: str) -> int:
    """Partitions in which tracks of the events are drawn."""
    return tilehits.shares_of_points(spark, event_count(spark, sf_dir))


def event_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contribution_id, user_id, points: the events of a user and day by (ts, event_id).

    More than a task's share of events are dealt out before they are collected, in a number of partitions that follows theirs:
    partial lists where they are read would save nothing, and lists of so many tracks are made by sorting a task's events.
    """
    points = F.array_sort(F.collect_list(F.struct("ts", "event_id", "lon", "lat")))
    path = F.transform(points, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    events, n = event_points(spark, sf_dir), event_count(spark, sf_dir)
    if n > tilehits.POINTS:
        events = events.repartition(tilehits.shares_of_points(spark, n), "contribution_id", "user_id")
    return events.groupBy("contribution_id", "user_id").agg(path.alias("points"))
