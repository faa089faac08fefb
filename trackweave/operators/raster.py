"""Tracks to pixels: segments of consecutive points, rasterised by an integer line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.config import Raster
from trackweave.functions.tilemath import pixel_of, quotient
from trackweave.operators import tilehits


def segments(
    tracks: DataFrame,
    raster: Raster = Raster(),
    include: Callable[[Column], Column] | None = None,
    on_invalid: str = "bridge",
    keys: tuple[str, ...] = ("contribution_id", "user_id"),
) -> DataFrame:
    """keys and x0, y0, x1, y1: the global pixels of each pair of consecutive points of tracks (keys, points, geom_type if there).

    Only line strings of two points at least draw. Points outside of the world, or in tiles that include(tile id) rejects,
    are left out; on_invalid says whether the line then goes on from the last good point (bridge) or breaks (split).
    A track's points stay in its row, so nothing is shuffled.
    """
    if "geom_type" in tracks.columns:
        tracks = tracks.where(F.col("geom_type") == "LineString")
    pixels = F.transform("points", lambda p: pixel_of(p["lon"], p["lat"], raster.zoom, raster.resolution, include))
    if on_invalid == "bridge":
        pixels = F.filter(pixels, lambda p: p.isNotNull())
    elif on_invalid != "split":
        raise ValueError("on_invalid must be bridge or split")
    drawn = tracks.where(F.size("points") >= 2).select(*keys, pixels.alias("pixels"))
    from_, to = F.slice("pixels", 1, F.greatest(F.size("pixels") - 1, F.lit(0))), F.slice("pixels", 2, F.size("pixels"))
    pairs = drawn.select(*keys, F.explode(F.arrays_zip(from_.alias("a"), to.alias("b"))).alias("s"))
    pairs = pairs.where(F.col("s.a").isNotNull() & F.col("s.b").isNotNull())
    return pairs.select(
        *keys, F.col("s.a.px").alias("x0"), F.col("s.a.py").alias("y0"), F.col("s.b.px").alias("x1"), F.col("s.b.py").alias("y1")
    )


def deltas(points: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], values: tuple[str, ...] = ("px", "py")) -> DataFrame:
    """points with d<value for each of values: what it adds to that of the point before, by order within keys; the first one's own value."""
    before = Window.partitionBy(*keys).orderBy(*order)
    return points.select("*", *[(F.col(v) - F.coalesce(F.lag(v).over(before), F.lit(0).cast("long"))).alias(f"d{v}") for v in values])


def shape(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Struct of a segment: flat (longer in x), direction by axis, steps l along the longer side, steps s along the shorter one."""
    w, h = x1 - x0, y1 - y0
    return F.struct(
        (F.abs(w) > F.abs(h)).alias("flat"), F.signum(w).cast("long").alias("sx"), F.signum(h).cast("long").alias("sy"),
        F.greatest(F.abs(w), F.abs(h)).alias("l"), F.least(F.abs(w), F.abs(h)).alias("s"),
    )


def floored(x: Column, y: int) -> Column:
    return quotient(x - F.pmod(x, F.lit(y)), y)


def pieces(
    parts: DataFrame, keys: tuple[str, ...] = ("contribution_id", "user_id"), resolution: int = 512, partitions: int | None = None, tiles: DataFrame | None = None
) -> DataFrame:
    """Segments (keys, x0, y0, x1, y1) cut at the borders of tiles and dealt out by keys and tile: with tx, ty, and i0 to i1, the
    steps of the segment in there.

    Along the longer side every step is a pixel, so that side's borders are steps; in between the shorter side's pixel grows
    with the step, and the first step at which it reaches k is (k * L - (L >> 1)) / S, rounded up. A piece has `resolution`
    steps at most, whatever the length of its segment, and all pixels of a key in a tile meet in one task before they are drawn:
    what sums them by key and pixel needs no exchange of pixels. The number of partitions (that of shuffles, if not given) is stated,
    since bytes of pieces say little of the pixels that they become; where tables grow it should follow the number of points
    (tilehits.shares_of_points), since tasks sort their pieces. tiles: only pieces in these tiles (x, y).
    """
    r = resolution
    one = parts.select(*keys, "x0", "y0", "x1", "y1", shape(*[F.col(k) for k in ("x0", "y0", "x1", "y1")]).alias("_g"))
    side = lambda x, y: F.when(F.col("_g.flat"), x).otherwise(y)
    one = one.withColumns({"_m0": side(F.col("x0"), F.col("y0")), "_m1": side(F.col("x1"), F.col("y1")), "_n0": side(F.col("y0"), F.col("x0"))})
    one = one.withColumns({"_sn": side(F.col("_g.sy"), F.col("_g.sx")), "_l": F.col("_g.l"), "_s": F.col("_g.s")})
    up = F.col("_m1") >= F.col("_m0")
    cut = one.withColumn("_q", F.explode(F.sequence(floored(F.col("_m0"), r), floored(F.col("_m1"), r))))
    first, last = F.col("_q") * r, F.col("_q") * r + (r - 1)
    cut = cut.withColumns({
        "_a": F.greatest(F.lit(0).cast("long"), F.when(up, first - F.col("_m0")).otherwise(F.col("_m0") - last)),
        "_b": F.least(F.col("_l"), F.when(up, last - F.col("_m0")).otherwise(F.col("_m0") - first)),
    })
    at = lambda i: floored(F.col("_n0") + F.col("_sn") * F.expr(f"(shiftright(_l, 1) + {i} * _s) div greatest(_l, 1)"), r)
    cut = cut.withColumn("_u", F.explode(F.sequence(at("_a"), at("_b"))))
    low, high = F.col("_u") * r, F.col("_u") * r + (r - 1)
    rising = F.col("_sn") >= 0

    def step(k: Column) -> Column:
        """The first step at which the shorter side has moved k pixels."""
        rest = F.expr("shiftright(_l, 1)") - k * F.col("_l")
        return -quotient(rest - F.pmod(rest, F.col("_s")), F.col("_s"))

    from_ = F.when(rising, low - F.col("_n0")).otherwise(F.col("_n0") - high)
    to = F.when(rising, high - F.col("_n0")).otherwise(F.col("_n0") - low)
    moves = F.col("_s") > 0
    out = cut.select(
        *keys, "x0", "y0", "x1", "y1",
        F.when(F.col("_g.flat"), F.col("_q")).otherwise(F.col("_u")).alias("tx"),
        F.when(F.col("_g.flat"), F.col("_u")).otherwise(F.col("_q")).alias("ty"),
        F.when(moves, F.greatest(F.col("_a"), step(from_))).otherwise(F.col("_a")).alias("i0"),
        F.when(moves, F.least(F.col("_b"), step(to + 1) - 1)).otherwise(F.col("_b")).alias("i1"),
    ).where("i0 <= i1")
    if tiles is not None:
        out = out.join(tiles.select(F.col("x").alias("tx"), F.col("y").alias("ty")), ["tx", "ty"], "left_semi").select(*out.columns)
    n = partitions or int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(n, *keys, "tx", "ty")


def draw(parts: DataFrame, keys: tuple[str, ...] = ("contribution_id", "user_id"), max_length: int | None = None) -> DataFrame:
    """keys, px, py: a row for every pixel of every segment, both ends included, so inner points of a track come twice.

    Step i of L = max(|w|, |h|) moves one pixel along the longer side and ((L >> 1) + i * S) div L along the shorter one, S
    long; which pixel is taken at a tie depends on the direction. Of pieces (with i0, i1) only those steps are drawn. max_length
    leaves out longer segments. Pixels below zero are dropped.
    """
    names = ("flat", "sx", "sy", "l", "s")
    whole = "i0" not in parts.columns
    ends = (F.lit(0).cast("long").alias("_a"), F.col("_size.l").alias("_b")) if whole else (F.col("i0").alias("_a"), F.col("i1").alias("_b"))
    sized = parts.withColumn("_size", shape(*[F.col(k) for k in ("x0", "y0", "x1", "y1")])).select(
        *keys, F.col("x0").alias("_x"), F.col("y0").alias("_y"), *[F.col(f"_size.{k}").alias(f"_{k}") for k in names], *ends
    )
    if max_length is not None:
        sized = sized.where(F.col("_l") <= max_length)
    steps = sized.withColumn("_i", F.explode(F.sequence("_a", "_b")))
    k = F.expr("(shiftright(_l, 1) + _i * _s) div greatest(_l, 1)")
    x = F.col("_x") + F.col("_sx") * F.when(F.col("_flat"), F.col("_i")).otherwise(k)
    y = F.col("_y") + F.col("_sy") * F.when(F.col("_flat"), k).otherwise(F.col("_i"))
    return steps.select(*keys, x.alias("px"), y.alias("py")).where("px >= 0 and py >= 0")


def tile_hits(
    parts: DataFrame, keys: tuple[str, ...], resolution: int = 512, max_length: int | None = None, weight: int = 1, partitions: int | None = None
) -> DataFrame:
    """keys, x, y, n, at, hits: the hits of a key in a tile in one row, as arrays of offsets in the tile and of numbers; n: their length."""
    if max_length is not None:
        parts = parts.where(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))) <= max_length)
    return tilehits.drawn(pieces(parts, keys, resolution, partitions), keys, resolution, weight)


def pixel_hits(
    parts: DataFrame, keys: tuple[str, ...], resolution: int = 512, max_length: int | None = None, weight: int = 1, partitions: int | None = None
) -> DataFrame:
    """keys, px, py, hits: how often the segments of a key come to a pixel, times weight."""
    return tilehits.cells(tile_hits(parts, keys, resolution, max_length, weight, partitions), keys, resolution)
