"""Tile and pixel arithmetic as Column expressions. Tiles are XYZ, y grows south; pixels count from a tile's top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LATITUDE = 85.0511287798066

Number = Column | int | float


def col(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def long(x: Number) -> Column:
    return col(x).cast("long")


def shift_left(x: Number, n: Number) -> Column:
    return F.call_function("shiftleft", long(x), col(n).cast("int"))


def shift_right(x: Number, n: Number) -> Column:
    return F.call_function("shiftright", long(x), col(n).cast("int"))


def quotient(x: Number, y: Number) -> Column:
    return F.call_function("div", long(x), long(y))


def side(zoom: Number) -> Column:
    """Tiles along the side of the world: 2**zoom."""
    return shift_left(1, zoom)


def whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def located(lon: Column, lat: Column) -> Column:
    """Whether a place lies in the projected world."""
    return F.coalesce((lon >= -180.0) & (lon < 180.0) & (lat > -MAX_LATITUDE) & (lat < MAX_LATITUDE), F.lit(False))


def tile_of(lon: Column, lat: Column, zoom: Number) -> Column:
    """Struct {x, y} of the tile that holds a place; null outside of the projected world."""
    n = side(zoom).cast("double")
    phi = F.radians(lat)
    x = whole((lon + 180.0) / 360.0 * n)
    y = whole((1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / F.pi()) / 2.0 * n)
    return F.when(located(lon, lat), F.struct(x.alias("x"), y.alias("y")))


def tile_id(x: Number, y: Number, zoom: Number) -> Column:
    """Row-major id of a tile within its zoom."""
    return long(y) * side(zoom) + long(x)


def tile_from_id(i: Number, zoom: Number) -> Column:
    """Struct {x, y} of an id."""
    return F.struct(F.pmod(long(i), side(zoom)).alias("x"), quotient(i, side(zoom)).alias("y"))


def max_tile_id(zoom: Number) -> Column:
    """4**zoom + 2**zoom, an upper end of the ids of a zoom."""
    return side(zoom) * side(zoom) + side(zoom)


def _latitude(y: Column, n: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() - 2.0 * F.pi() * y.cast("double") / n)))


def tile_box(x: Number, y: Number, zoom: Number) -> Column:
    """Struct {left, top, right, bottom} in degrees."""
    n = side(zoom).cast("double")
    x, y = long(x), long(y)
    return F.struct(
        (x.cast("double") / n * 360.0 - 180.0).alias("left"),
        _latitude(y, n).alias("top"),
        ((x + 1).cast("double") / n * 360.0 - 180.0).alias("right"),
        _latitude(y + 1, n).alias("bottom"),
    )


def sub_coordinates(x: Number, y: Number, zoom: Number, lon: Column, lat: Column) -> Column:
    """Struct {x, y}: the tile's numbers plus the share of its width from the left and of its height from the bottom."""
    box = tile_box(x, y, zoom)
    return F.struct(
        (long(x) + (lon - box["left"]) / (box["right"] - box["left"])).alias("x"),
        (long(y) + (lat - box["bottom"]) / (box["top"] - box["bottom"])).alias("y"),
    )


def direct_neighbours(a: Number, b: Number, zoom: Number) -> Column:
    """Whether two tile ids share a side; the date line does not join, and a tile is no neighbour of itself."""
    n = side(zoom)
    dx = F.abs(F.pmod(long(a), n) - F.pmod(long(b), n))
    dy = F.abs(quotient(a, n) - quotient(b, n))
    return dx + dy == 1


def pixel_in_tile(x: Number, y: Number, zoom: Number, lon: Column, lat: Column, resolution: int) -> Column:
    """Struct {cx, cy}: the pixel of a place within a tile, linear in longitude and latitude between its sides."""
    box = tile_box(x, y, zoom)
    return F.struct(
        whole((lon - box["left"]) / ((box["right"] - box["left"]) / resolution)).alias("cx"),
        whole((box["top"] - lat) / ((box["top"] - box["bottom"]) / resolution)).alias("cy"),
    )


def pixel_of(lon: Column, lat: Column, zoom: Number, resolution: int, include=None) -> Column:
    """Struct {px, py}: the global pixel of a place; null outside of the world or if include(tile id) is not true."""
    tile = tile_of(lon, lat, zoom)
    local = pixel_in_tile(tile["x"], tile["y"], zoom, lon, lat, resolution)
    pixel = F.struct((tile["x"] * resolution + local["cx"]).alias("px"), (tile["y"] * resolution + local["cy"]).alias("py"))
    ok = located(lon, lat)
    if include is not None:
        ok = ok & F.coalesce(include(tile_id(tile["x"], tile["y"], zoom)), F.lit(False))
    return F.when(ok, pixel)


def place_of(x: Number, y: Number, zoom: Number, cx: Number, cy: Number, resolution: int) -> Column:
    """Struct {lon, lat} of a pixel's top left; fractions of pixels are allowed, so cx + 0.5 is its centre."""
    box = tile_box(x, y, zoom)
    return F.struct(
        (box["left"] + (box["right"] - box["left"]) / resolution * col(cx)).alias("lon"),
        (box["top"] - (box["top"] - box["bottom"]) / resolution * col(cy)).alias("lat"),
    )


def tile_of_pixel(px: Number, py: Number, resolution: int) -> Column:
    """Struct {x, y, cx, cy} of a global pixel."""
    return F.struct(
        quotient(px, resolution).alias("x"),
        quotient(py, resolution).alias("y"),
        F.pmod(long(px), F.lit(resolution)).cast("int").alias("cx"),
        F.pmod(long(py), F.lit(resolution)).cast("int").alias("cy"),
    )


def tile_origin(x: Number, y: Number, resolution: int) -> Column:
    """Struct {px, py} of a tile's first global pixel."""
    return F.struct((long(x) * resolution).alias("px"), (long(y) * resolution).alias("py"))


def block_of_pixel(px: Number, py: Number, zoom: Number, resolution: int) -> Column:
    """Struct {tile_id, offset}: a global pixel's tile and its row-major place in there."""
    t = tile_of_pixel(px, py, resolution)
    return F.struct(tile_id(t["x"], t["y"], zoom).alias("tile_id"), (t["cy"].cast("long") * resolution + t["cx"]).alias("offset"))


def parent(v: Number, zoom: Number, to: Number) -> Column:
    """A tile number of a zoom at a coarser one; null if `to` is finer."""
    return F.when(col(zoom) >= col(to), shift_right(v, col(zoom) - col(to)))


def child_range(x: Number, y: Number, zoom: Number, to: Number) -> Column:
    """Struct {x0, y0, x1, y1}: the tiles of a finer zoom below a tile, the ends excluded."""
    d = col(to) - col(zoom)
    return F.struct(*[shift_left(v, d).alias(k) for k, v in (("x0", long(x)), ("y0", long(y)), ("x1", long(x) + 1), ("y1", long(y) + 1))])


def grid(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Array of {x, y} from x0, y0 to x1, y1, both included, x outermost; empty if an end comes first."""
    cells = F.flatten(F.transform(F.sequence(x0, x1), lambda x: F.transform(F.sequence(y0, y1), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return F.when((x0 <= x1) & (y0 <= y1), cells).otherwise(F.array().cast("array<struct<x:bigint,y:bigint>>"))


def descendants(x: Number, y: Number, zoom: Number, to: Number) -> Column:
    """Array of {x, y}: all tiles of a finer zoom below a tile."""
    r = child_range(x, y, zoom, to)
    return grid(r["x0"], r["y0"], r["x1"] - 1, r["y1"] - 1)


def children(x: Number, y: Number) -> Column:
    """Array of the four tiles {x, y} below a tile, the upper two first."""
    x, y = long(x) * 2, long(y) * 2
    return F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dy in (0, 1) for dx in (0, 1)])


def tiles_for_box(left: Column, top: Column, right: Column, bottom: Column, zoom: Number) -> Column:
    """Array of the tiles {x, y} of a box in degrees, those of both corners included; empty if left is beyond right."""
    a, b = tile_of(left, top, zoom), tile_of(right, bottom, zoom)
    return grid(a["x"], a["y"], b["x"], b["y"])


def tile_polygon(x: Number, y: Number, zoom: Number, margin: int = 5) -> Column:
    """Closed ring of five {lon, lat} around a tile that is grown by margin percent on each side."""
    box = tile_box(x, y, zoom)
    dx, dy = (box["right"] - box["left"]) * (margin / 100), (box["top"] - box["bottom"]) * (margin / 100)
    l, r, t, b = box["left"] - dx, box["right"] + dx, box["top"] + dy, box["bottom"] - dy
    return F.array(*[F.struct(lon.alias("lon"), lat.alias("lat")) for lon, lat in ((l, t), (r, t), (r, b), (l, b), (l, t))])
