"""The raster queries over the events table, and SQL with the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.config import Semantics
from trackweave.functions import codec
from trackweave.functions import tilemath as tm
from trackweave.operators import cells as ct
from trackweave.operators import density, pyramid, ranges, raster
from trackweave.sources import tracks as ts
from trackweave.sources.events import event_points, event_shares, event_tracks
from trackweave.sources.vector_tiles import features, tile_points, vector_tiles
from trackweave.streaming.job import apply_batch
from trackweave.streaming.store import Store

Z, R = 14, 512
COMPAT = Semantics("compat")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """event_id and its projected tile and pixel."""
    e = event_points(spark, d)
    t = tm.tile_of(F.col("lon"), F.col("lat"), Z)
    e = e.withColumn("p", tm.pixel_of(F.col("lon"), F.col("lat"), Z, R)).withColumn("t", t)
    return e.select("event_id", "user_id", "contribution_id", "ts", "lon", "lat", "t.x", "t.y", "p.px", "p.py")


def cells(spark: SparkSession, d: str, batches: int = 0) -> DataFrame:
    """z, px, py, value: hits per pixel over all tracks, or of contributions of one remainder."""
    tracks = event_tracks(spark, d)
    if batches:
        tracks = tracks.where(F.col("user_id") % 2 == batches - 1)
    drawn = raster.draw(raster.pieces(raster.segments(tracks), partitions=event_shares(spark, d)))
    hits = drawn.groupBy("px", "py").agg(F.count(F.lit(1)).alias("value"))
    return hits.select(F.lit(Z).alias("z"), "px", "py", "value")


def some_tiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(14, 8389, 5499), (14, 8390, 5500), (14, 1, 1)], "z int, x long, y long")


def kept(spark: SparkSession, d: str, k: int = 3, n: int | None = None) -> DataFrame:
    return density.track_cells(event_tracks(spark, d), k, partitions=n or event_shares(spark, d))


def levels(spark: SparkSession, d: str, **how) -> DataFrame:
    n = event_shares(spark, d)
    return pyramid.pyramid(kept(spark, d, n=n), partitions=n, **how)


def project_points(spark, d):
    p = pixels(spark, d)
    local = tm.pixel_in_tile(F.col("x"), F.col("y"), Z, F.col("lon"), F.col("lat"), R)
    return p.withColumn("l", local).select("event_id", "x", "y", tm.tile_id(F.col("x"), F.col("y"), Z).alias("tile_id"), "l.cx", "l.cy", "px", "py")


def tile_ids(spark, d):
    p = pixels(spark, d)
    i = tm.tile_id(F.col("x"), F.col("y"), Z)
    back = tm.tile_from_id(i, Z)
    return p.select("event_id", i.alias("tile_id"), back["x"].alias("x"), back["y"].alias("y"))


def tile_max_id(spark, d):
    zooms = event_points(spark, d).select((F.col("event_id") % 17).cast("int").alias("z")).distinct()
    return zooms.select("z", tm.max_tile_id(F.col("z")).alias("max_id"))


def tile_parent(spark, d):
    p = pixels(spark, d)
    up = lambda v, z: tm.parent(F.col(v), Z, z)
    return p.select("event_id", up("x", 13).alias("x13"), up("y", 13).alias("y13"), up("x", 7).alias("x7"), up("y", 7).alias("y7"), up("x", 0).alias("x0"))


def tile_children(spark, d):
    t = pixels(spark, d).select("x", "y").distinct()
    kids = t.select("x", "y", F.posexplode(tm.children(F.col("x"), F.col("y"))).alias("i", "c"))
    return kids.select("x", "y", "i", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


def tile_descendants(spark, d):
    t = pixels(spark, d).select("x", "y").distinct()
    r = tm.child_range(F.col("x"), F.col("y"), Z, 16)
    below = ranges.tiles_below(t.select("x", "y", r["x1"].alias("x_end"), r["y1"].alias("y_end")), Z, 16)
    return below.select(*[F.col(f"p_{c}").alias(c) for c in ("x", "y", "x_end", "y_end")], F.col("x").alias("cx"), F.col("y").alias("cy"))


def tile_neighbours(spark, d):
    t = pixels(spark, d).select(tm.tile_id(F.col("x"), F.col("y"), Z).alias("a")).distinct()
    near = t.select("a", F.explode(F.array(*[F.lit(v).cast("long") for v in (0, 1, -1, 16384, -16384, 16385, 2)])).alias("step"))
    b = F.col("a") + F.col("step")
    return near.select("a", b.alias("b"), tm.direct_neighbours(F.col("a"), b, Z).alias("near"))


def tiles_for_bbox(spark, d):
    p = pixels(spark, d).groupBy("user_id").agg(F.min("lon").alias("l"), F.max("lat").alias("t"), F.max("lon").alias("r"), F.min("lat").alias("b"))
    return ranges.tiles_for_boxes(p, 15, "l", "t", "r", "b").select("user_id", "x", "y")


def tile_position(spark, d):
    p = pixels(spark, d)
    b, o = tm.block_of_pixel(F.col("px"), F.col("py"), Z, R), tm.tile_origin(F.col("x"), F.col("y"), R)
    return p.select("event_id", b["tile_id"].alias("tile_id"), b["offset"].alias("offset"), o["px"].alias("left"), o["py"].alias("top"))


def _rounded(cols, digits=6):
    return [F.round(v, digits).alias(k) for k, v in cols.items()]


def tile_box(spark, d):
    t = pixels(spark, d).select("x", "y").distinct()
    b = tm.tile_box(F.col("x"), F.col("y"), Z)
    return t.select("x", "y", *_rounded({k: b[k] for k in ("left", "top", "right", "bottom")}))


def pixel_to_lonlat(spark, d):
    p = pixels(spark, d)
    t = tm.tile_of_pixel(F.col("px"), F.col("py"), R)
    q = tm.place_of(t["x"], t["y"], Z, t["cx"], t["cy"], R)
    return p.select("event_id", *_rounded({"lon": q["lon"], "lat": q["lat"]}))


def sub_coordinates(spark, d):
    p = pixels(spark, d)
    s = tm.sub_coordinates(F.col("x"), F.col("y"), Z, F.col("lon"), F.col("lat"))
    return p.select("event_id", *_rounded({"sx": s["x"], "sy": s["y"]}))


def tile_polygon(spark, d):
    t = pixels(spark, d).select("x", "y").distinct()
    ring = t.select("x", "y", F.posexplode(tm.tile_polygon(F.col("x"), F.col("y"), Z)).alias("i", "p"))
    return ring.select("x", "y", "i", *_rounded({"lon": F.col("p.lon"), "lat": F.col("p.lat")}))


def pixel_deltas(spark, d):
    out = raster.deltas(pixels(spark, d), ("contribution_id",), ("ts", "event_id"))
    return out.select("event_id", "dpx", "dpy")


def segments(spark, d):
    return raster.segments(event_tracks(spark, d))


def raster_pixels(spark, d):
    return raster.pixel_hits(raster.segments(event_tracks(spark, d)), ("contribution_id",), partitions=event_shares(spark, d))


def raster_include_tile(spark, d):
    west = lambda i: F.pmod(i, F.lit(2)) == 1
    return raster.pixel_hits(raster.segments(event_tracks(spark, d), include=west), ("contribution_id",), partitions=event_shares(spark, d))


def user_cells(spark, d):
    return density.user_cells(event_tracks(spark, d), partitions=event_shares(spark, d))


def user_cells_cost(spark, d):
    return density.user_cells(event_tracks(spark, d), cost=7, partitions=event_shares(spark, d))


def tile_users(spark, d):
    return density.tile_users(user_cells(spark, d))


def tile_user_counts(spark, d):
    return density.tile_user_counts(user_cells(spark, d))


def tile_threshold(spark, d):
    return density.tiles_over_threshold(user_cells(spark, d), 100)


def global_cells(spark, d):
    return kept(spark, d, 1)


def global_cells_k3(spark, d):
    return kept(spark, d)


def pyramid_cells(spark, d):
    return levels(spark, d)


def pyramid_compat(spark, d):
    return levels(spark, d, min_zoom=11, semantics=COMPAT)


def pyramid_tile_totals(spark, d):
    return pyramid.tile_totals(levels(spark, d))


def parent_tiles(spark, d):
    t = pixels(spark, d).select(F.lit(Z).alias("z"), "x", "y").distinct()
    return pyramid.parent_tiles(t)


def tiles_at_zoom(spark, d):
    t = pixels(spark, d).select("x", "y").distinct()
    parts = [pyramid.tiles_at(t, Z, z).select(F.lit(z).alias("z"), "x", "y") for z in (12, 14, 15)]
    return parts[0].union(parts[1]).union(parts[2])


def diff_pyramid_saturating(spark, d):
    diff = cells(spark, d).select("px", "py", (F.col("value") * 100_000_000).alias("value"))
    return pyramid.diff_pyramid(diff, Z, 8)


def _diffs(spark, d):
    drawn = raster.draw(raster.pieces(raster.segments(event_tracks(spark, d)), partitions=event_shares(spark, d)))
    return drawn.groupBy((F.col("contribution_id") % 4).alias("batch"), "px", "py").agg(F.count(F.lit(1)).alias("value"))


def apply_diff(spark, d):
    return density.batches_merged(_diffs(spark, d))


def apply_diff_compat(spark, d):
    return density.batches_merged(_diffs(spark, d), COMPAT)


def encode_decode(spark, d):
    v = codec.packed(F.col("users"), F.col("trips"))
    u = codec.unpacked(v)
    return kept(spark, d, 1).select("px", "py", v.alias("packed"), u["users"].alias("users"), u["trips"].alias("trips"))


def sign_magnitude(spark, d):
    v = F.col("event_id") - 500
    s = codec.sign_magnitude(v)
    return event_points(spark, d).select("event_id", s.alias("coded"), codec.from_sign_magnitude(s).alias("back"))


def varint_bytes(spark, d):
    e = event_points(spark, d)
    v = F.col("gx") * F.col("event_id")
    code = codec.varint(v)
    return e.select("event_id", F.hex(code).alias("bytes"), codec.unvarint(code).alias("back"), F.hex(codec.varint_nullable(F.nullif(v % 5, F.lit(0)))).alias("nullable"))


def copy_tiles(spark, d):
    return ct.copy_tiles(cells(spark, d, 1), cells(spark, d, 2), some_tiles(spark), lambda t, p, v: v * 2)


def add_tiles(spark, d):
    return ct.add_tiles(cells(spark, d, 1), cells(spark, d, 2), some_tiles(spark))


def add_tiles_fold(spark, d):
    return ct.fold_tiles(cells(spark, d, 1), cells(spark, d, 2), some_tiles(spark), lambda t, p, old, new: F.greatest(old, new) + 1)


def update_values(spark, d):
    return ct.update_values(cells(spark, d), lambda p, v: F.when(v > 1, v - 1 + p["cx"] % 2).otherwise(0))


def remove_tiles(spark, d):
    return ct.remove_where(cells(spark, d), lambda t: t["x"] % 2 == 1)


def cell_lookup(spark, d):
    points = event_points(spark, d).select(F.lit(Z).alias("z"), (F.col("gx") + F.col("event_id") % 3).alias("px"), F.col("gy").alias("py"), "event_id")
    return ct.lookup(cells(spark, d), points)


def list_tiles(spark, d):
    return ct.list_tiles(cells(spark, d))


def tile_values(spark, d):
    return ct.offsets(ct.in_tiles(cells(spark, d), some_tiles(spark)))


def _relations(spark, d):
    t = event_tracks(spark, d)
    c = t.select(F.col("contribution_id").alias("ContributionId"), F.col("points").alias("PointsGeom"))
    uc = t.select(F.col("contribution_id").alias("ContributionId"), F.col("user_id").alias("UserId"))
    u = t.select(F.col("user_id").alias("Id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("UserIdentifier")).distinct()
    return c, uc, u


WINDOW = (0, 198_000_000_000)


def contribution_window(spark, d):
    out = ts.contribution_window(*_relations(spark, d), *WINDOW)
    return out.select("contribution_id", "user_id", F.size("geom").cast("long").alias("points"))


def latest_contribution(spark, d):
    return ts.latest_contribution(_relations(spark, d)[0])


def admission_prefix(spark, d):
    out = ts.admitted(ts.contribution_window(*_relations(spark, d), 0, 10**15), 20)
    return out.select("contribution_id", "user_id")


def per_user_last(spark, d):
    return density.last_contributions(event_tracks(spark, d))


def modified_tiles(spark, d):
    t = event_tracks(spark, d).where(F.col("contribution_id") % 7 == 0)
    touched = density.user_cells(t, partitions=event_shares(spark, d))
    return touched.select(F.lit(Z).alias("z"), tm.quotient(F.col("px"), R).alias("x"), tm.quotient(F.col("py"), R).alias("y")).distinct()


def incremental_equals_batch(spark, d):
    """Cells after a first batch, then only the second one's tiles rebuilt and put in."""
    t = event_tracks(spark, d)
    first, second = (t.where(c) for c in (F.col("contribution_id") % 7 != 0, F.col("contribution_id") % 7 == 0))
    tiles = density.tiles_of(second).select(F.lit(Z).alias("z"), "x", "y").persist()  # three joins count and read it
    n = event_shares(spark, d)
    new = density.track_cells(first.unionByName(second), 3, tiles=ct.few_tiles(tiles), partitions=n).withColumn("z", F.lit(Z))
    old = density.track_cells(first, 3, partitions=n).withColumn("z", F.lit(Z))
    return ct.replaced(old, new, tiles).select("px", "py", "users", "trips")


def incremental_job(spark, d):
    """Cells of the job's store after three batches, each of which rebuilds only the tiles that it touches, with a compaction in between."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    store = Store(spark, f"{root.rstrip('/')}/trackweave-store-{uuid.uuid4().hex[:12]}", merged=2)
    t, n = event_tracks(spark, d), event_shares(spark, d)
    for k in range(3):
        touched = apply_batch(store, t.where(F.col("contribution_id") % 3 == k), f"part-{k}", partitions=n)
        store.compact(touched)
    return store.cells()


def top_cells(spark, d):
    return density.cell_ranks(kept(spark, d), 100)


def vector_features(spark, d):
    out = features(levels(spark, d, min_zoom=12))
    return out.select("z", "x", "y", "cx", "cy", *_rounded({"lon": F.col("lon"), "lat": F.col("lat")}), "users", "trips")


def pyramid_compat_all(spark, d):
    return levels(spark, d, semantics=COMPAT)


def diff_pyramid_saturating_all(spark, d):
    diff = cells(spark, d).select("px", "py", (F.col("value") * 100_000_000).alias("value"))
    return pyramid.diff_pyramid(diff, Z, 0)


def vector_features_all(spark, d):
    out = features(levels(spark, d))
    return out.select("z", "x", "y", "cx", "cy", *_rounded({"lon": F.col("lon"), "lat": F.col("lat")}), "users", "trips")


def modified_tiles_all(spark, d):
    """Tiles that each batch touches, the contributions' remainder modulo 7 being the batch."""
    drawn = raster.draw(raster.pieces(raster.segments(event_tracks(spark, d)), partitions=event_shares(spark, d)))
    x, y = (tm.quotient(F.col(v), R).alias(k) for v, k in (("px", "x"), ("py", "y")))
    return drawn.select((F.col("contribution_id") % 7).alias("batch"), F.lit(Z).alias("z"), x, y).distinct()


def tile_values_all(spark, d):
    hits = cells(spark, d)
    return ct.offsets(ct.in_tiles(hits, ct.list_tiles(hits)))


def vector_tiles_mvt(spark, d):
    return vector_tiles(levels(spark, d), partitions=event_shares(spark, d))


def vector_tile_points(spark, d):
    """The points that a reader finds in the bytes of all tiles."""
    return tile_points(vector_tiles_mvt(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        project_points, tile_ids, tile_max_id, tile_parent, tile_children, tile_descendants, tile_neighbours, tiles_for_bbox, tile_position, tile_box,
        pixel_to_lonlat, sub_coordinates, tile_polygon, pixel_deltas, segments, raster_pixels, raster_include_tile, user_cells, user_cells_cost, tile_users,
        tile_user_counts, tile_threshold, global_cells, global_cells_k3, pyramid_cells, pyramid_compat, pyramid_tile_totals, parent_tiles, tiles_at_zoom,
        diff_pyramid_saturating, apply_diff, apply_diff_compat, encode_decode, sign_magnitude, varint_bytes, copy_tiles, add_tiles, add_tiles_fold,
        update_values, remove_tiles, cell_lookup, list_tiles, tile_values, contribution_window, latest_contribution, admission_prefix, per_user_last,
        modified_tiles, incremental_equals_batch, incremental_job, top_cells, vector_features, vector_tiles_mvt, vector_tile_points,
        pyramid_compat_all, diff_pyramid_saturating_all, vector_features_all, modified_tiles_all, tile_values_all,
    )
}
