"""Hits per user and pixel, then users and trips per pixel, with the privacy threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.config import UINT32, Raster, Semantics
from trackweave.functions.codec import wrapped32
from trackweave.functions.tilemath import quotient
from trackweave.operators import tilehits
from trackweave.operators.raster import pieces, pixel_hits, segments, tile_hits


def told_apart(tracks: DataFrame, partitions: int) -> DataFrame:
    """tracks with salt and salts: a user with more than half a partition's share of all points has several salts, one for each of its
    tracks, so that no task draws much more than others; all other users have one.

    A segment draws at most a tile's side in a tile, so points bound what a user draws there. The 2 * partitions users of most
    points hold all such users, whatever the table's size; only they are broadcast.
    """
    top = tracks.groupBy("user_id").agg(F.sum(F.size("points")).alias("points")).orderBy(F.desc("points")).limit(2 * partitions)
    share = F.col("points") * partitions / F.sum("points").over(Window.partitionBy(F.lit(0)))
    hot = top.withColumn("share", share).where("share > 0.5").select(F.col("user_id").alias("hot_user"), F.ceil(F.col("share") * 8).cast("int").alias("salts"))
    out = tracks.join(F.broadcast(hot), F.col("user_id") == F.col("hot_user"), "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    track = "contribution_id" if "contribution_id" in tracks.columns else "points"
    return out.withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64(track), F.col("salts"))).otherwise(0).cast("int")).drop("hot_user")


def user_cells(
    tracks: DataFrame,
    raster: Raster = Raster(),
    cost: int = 1,
    include=None,
    semantics: Semantics = Semantics(),
    split_users: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """user_id, px, py, hits: what each user's tracks add to each pixel of the base zoom.

    split_users: for tables in which few users have most of the points in a tile (told_apart). It reads the tracks twice more, and
    only partial sums of such users are exchanged after they are drawn.
    """
    keys = ("user_id", "salt", "salts") if split_users else ("user_id",)
    if split_users:
        tracks = told_apart(tracks, partitions or int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = pixel_hits(segments(tracks, raster, include, keys=keys), keys, raster.resolution, weight=cost, partitions=partitions)
    if split_users:
        split = cells.where("salts > 1").groupBy("user_id", "px", "py").agg(F.sum("hits").alias("hits"))
        cells = cells.where("salts = 1").select("user_id", "px", "py", "hits").unionByName(split)
    return cells.withColumn("hits", wrapped32(F.col("hits"))) if semantics.compat else cells


def user_hits(tracks: DataFrame, raster: Raster = Raster(), partitions: int | None = None) -> DataFrame:
    """user_id, x, y, n, at, hits: user cells as a row for each user and base tile (raster.tile_hits)."""
    return tile_hits(segments(tracks, raster, keys=("user_id",)), ("user_id",), raster.resolution, partitions=partitions)


def user_lines(tracks: DataFrame, raster: Raster = Raster(), partitions: int | None = None) -> DataFrame:
    """user_id, x, y, n, at, hits, lines: user_hits whose longer lines are left undrawn (tilehits.lined), which takes far less room."""
    parts = pieces(segments(tracks, raster, keys=("user_id",)), ("user_id",), raster.resolution, partitions)
    return tilehits.lined(parts, ("user_id",), raster.resolution)


def track_cells(tracks: DataFrame, min_users: int = 1, raster: Raster = Raster(), tiles: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """global_cells of the user cells of tracks, which never leave the tasks that draw them. tiles: of these base tiles (x, y) only."""
    parts = pieces(segments(tracks, raster, keys=("user_id",)), ("user_id",), raster.resolution, partitions, tiles)
    out = tilehits.drawn(parts, ("user_id",), raster.resolution, count=True, partitions=partitions)
    return out.where(F.col("users") >= min_users) if min_users > 1 else out


def tiles_of(tracks: DataFrame, raster: Raster = Raster()) -> DataFrame:
    """x, y: the base tiles that tracks draw in, each once; nothing is drawn for that."""
    parts = pieces(segments(tracks, raster, keys=("user_id",)), ("user_id",), raster.resolution)
    return parts.where("tx >= 0 and ty >= 0").select(F.col("tx").alias("x"), F.col("ty").alias("y")).distinct()


def global_cells(cells: DataFrame, min_users: int = 1, semantics: Semantics = Semantics()) -> DataFrame:
    """px, py, users, trips of user cells (one row per user and pixel); pixels of fewer than min_users users are left out."""
    trips = F.sum("hits")
    out = cells.where("hits <> 0").groupBy("px", "py").agg(F.count(F.lit(1)).alias("users"), (wrapped32(trips) if semantics.compat else trips).alias("trips"))
    return out.where(F.col("users") >= min_users) if min_users > 1 else out


def tile_users(cells: DataFrame, resolution: int = 512) -> DataFrame:
    """x, y, user_id: the users of each base tile, each once."""
    return cells.select(quotient(F.col("px"), resolution).alias("x"), quotient(F.col("py"), resolution).alias("y"), "user_id").distinct()


def tile_user_counts(cells: DataFrame, resolution: int = 512) -> DataFrame:
    """x, y, users: distinct users of each base tile."""
    return tile_users(cells, resolution).groupBy("x", "y").agg(F.count(F.lit(1)).alias("users"))


def tiles_over_threshold(cells: DataFrame, min_users: int, resolution: int = 512) -> DataFrame:
    """x, y, users of the base tiles that have min_users users at least; only they can hold a pixel that has."""
    return tile_user_counts(cells, resolution).where(F.col("users") >= min_users)


def merged(stored: DataFrame, diff: DataFrame, semantics: Semantics = Semantics()) -> DataFrame:
    """px, py, value: a stored level plus a diff.

    intended: the sum. compat: a cell that the diff has becomes (old + min(old + v, 2**32 - 1)) mod 2**32, so history doubles.
    """
    if not semantics.compat:
        return stored.unionByName(diff).groupBy("px", "py").agg(F.sum("value").alias("value"))
    old = stored.select("px", "py", F.col("value").alias("old"), F.lit(0).cast("long").alias("v"))
    new = diff.select("px", "py", F.lit(0).cast("long").alias("old"), F.col("value").alias("v"))
    both = old.unionByName(new).groupBy("px", "py").agg(F.sum("old").alias("old"), F.sum("v").alias("v"))
    value = F.when(F.col("v") == 0, F.col("old")).otherwise(wrapped32(F.col("old") + F.least(F.col("old") + F.col("v"), F.lit(UINT32))))
    return both.select("px", "py", value.alias("value"))


def batches_merged(diffs: DataFrame, semantics: Semantics = Semantics()) -> DataFrame:
    """px, py, value after merging diffs (batch, px, py, value) one after the other in order of batch.

    compat: while nothing overflows, the i-th of n batches of a cell counts 2**(n - i) times.
    """
    cells = diffs.where("value <> 0").groupBy("batch", "px", "py").agg(F.sum("value").alias("value"))
    if not semantics.compat:
        return cells.groupBy("px", "py").agg(F.sum("value").alias("value"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("batch", "value"))), lambda x: x["value"])
    fold = F.aggregate("merged", F.lit(0).cast("long"), lambda old, v: wrapped32(old + F.least(old + v, F.lit(UINT32))))
    return cells.groupBy("px", "py").agg(values.alias("merged")).select("px", "py", fold.alias("value"))


def last_contributions(tracks: DataFrame) -> DataFrame:
    """user_id, last_contribution_id."""
    return tracks.groupBy("user_id").agg(F.max("contribution_id").alias("last_contribution_id"))


def cell_ranks(cells: DataFrame, n: int) -> DataFrame:
    """The n pixels of most users, then trips, then px, py."""
    order = Window.orderBy(F.desc("users"), F.desc("trips"), "px", "py")
    return cells.orderBy(F.desc("users"), F.desc("trips"), "px", "py").limit(n).withColumn("rank", F.row_number().over(order))
