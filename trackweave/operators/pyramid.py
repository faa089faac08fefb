"""Coarser zooms from the base zoom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.config import UINT32, Semantics
from trackweave.functions.tilemath import quotient, shift_right
from trackweave.operators import tilehits
from trackweave.operators.ranges import tiles_below

#: Levels below which the cells of one ancestor stay together: 4**6 base pixels at most.
NEAR = 6


def rebuilt(children: DataFrame, semantics: Semantics = Semantics()) -> DataFrame:
    """px, py, users, trips one zoom up: sums over the four pixels below, users as well as trips.

    compat: trips beyond 32 bits carry into users, as sums of packed pairs do.
    """
    up = children.groupBy(shift_right(F.col("px"), 1).alias("px"), shift_right(F.col("py"), 1).alias("py"))
    out = up.agg(F.sum("users").alias("users"), F.sum("trips").alias("trips"))
    if not semantics.compat:
        return out
    users = (F.col("users") + shift_right(F.col("trips"), 32)).bitwiseAND(F.lit(UINT32))
    return out.select("px", "py", users.alias("users"), F.col("trips").bitwiseAND(F.lit(UINT32)).alias("trips"))


def rolled_up(base: DataFrame, zoom: int, min_zoom: int, values: tuple[str, ...], partitions: int | None = None) -> DataFrame:
    """z, px, py and the sums of values for all zooms from zoom to min_zoom of rows (px, py, ...) at zoom.

    The base is dealt out once, by the ancestor NEAR zooms up, which holds a bounded number of pixels. Levels up to there
    are summed where they lie, the upper half of them from the middle level, which is a few times smaller than the base;
    levels above come from that ancestor's level, and only its sums are exchanged. partitions: those of the base at least. If
    they are more than shuffles have, so are those of the levels above (for as many levels as are summed of the base at once):
    where tracks lie far from each other, an ancestor holds few pixels, and its level grows with the table. A pixel has
    4**(zoom - near) / 4**z such ancestors at most.
    """
    depth = zoom - min_zoom
    near, names = min(NEAR, depth), list(values)
    half = min(near, NEAR // 2)
    sums = [F.sum(v).alias(v) for v in names]
    up = lambda d: (shift_right(F.col("px"), d).alias("px"), shift_right(F.col("py"), d).alias("py"))
    level = (F.lit(zoom) - F.col("d")).alias("z")

    def levels(rows: DataFrame, at: int, first: int, last: int, *within: str) -> DataFrame:
        """Levels first to last above the base, of rows that lie `at` levels above it."""
        each = rows.withColumn("d", F.explode(F.sequence(F.lit(first), F.lit(last))))
        if not within and tilehits.is_more(base, partitions):
            each = each.select("d", *up(F.col("d") - at), *names).repartition(partitions * -(-(last - first + 1) // (half + 1)), "d", "px", "py")
            return each.groupBy("d", "px", "py").agg(*sums).select(level, "px", "py", *names)
        return each.groupBy(*within, "d", *up(F.col("d") - at)).agg(*sums).select(level, "px", "py", *names)

    rows = base.select("px", "py", *names, shift_right(F.col("px"), near).alias("ax"), shift_right(F.col("py"), near).alias("ay"))
    dealt = tilehits.dealt(rows, partitions, "ax", "ay")
    out = levels(dealt, 0, 0, half, "ax", "ay")
    middle = dealt.groupBy("ax", "ay", *up(half)).agg(*sums)
    if near > half:
        out = out.unionByName(levels(middle, half, half + 1, near, "ax", "ay"))
    if depth > near:
        top = middle.groupBy("ax", "ay").agg(*sums).select(F.col("ax").alias("px"), F.col("ay").alias("py"), *names)
        out = out.unionByName(levels(top, near, near + 1, depth))
    return out


def pyramid(base: DataFrame, zoom: int = 14, min_zoom: int = 0, semantics: Semantics = Semantics(), partitions: int | None = None) -> DataFrame:
    """z, px, py, users, trips for all zooms from zoom to min_zoom of base cells (px, py, users, trips).

    compat: at every zoom users and trips are sums of packed pairs of 32 bits, so trips carry into users, and users wrap. Such
    a sum is one of integers modulo 2**64: the order of additions does not matter, and wrapping once at the end is the same.
    """
    out = rolled_up(base, zoom, min_zoom, ("users", "trips"), partitions)
    if not semantics.compat:
        return out
    users = (F.col("users") + shift_right(F.col("trips"), 32)).bitwiseAND(F.lit(UINT32))
    trips = F.col("trips").bitwiseAND(F.lit(UINT32))
    given = F.col("z") == zoom  # the base stays as it is
    return out.select("z", "px", "py", F.when(given, F.col("users")).otherwise(users).alias("users"), F.when(given, F.col("trips")).otherwise(trips).alias("trips"))


def rebuilt_above(fresh: DataFrame, beside: DataFrame, zoom: int) -> DataFrame:
    """z, px, py, users, trips at all zooms above zoom: sums of fresh cells at that zoom and of the cells beside them (z, ...) at it and
    above it, in tiles without fresh cells below, that share a parent with tiles that have some.

    A cell is the sum of the fresh ones and of all those beside them that lie below, so all zooms are worked out at once.
    """
    columns, sums = ["z", "px", "py", "users", "trips"], (F.sum("users").alias("users"), F.sum("trips").alias("trips"))
    low = rolled_up(fresh.select(columns).unionByName(beside.where(F.col("z") == zoom)), zoom, 0, ("users", "trips")).where(F.col("z") < zoom)
    d = F.explode(F.sequence(F.lit(1), F.col("z"))).alias("d")
    up = beside.where((F.col("z") < zoom) & (F.col("z") > 0)).select("*", d)
    up = up.select((F.col("z") - F.col("d")).alias("z"), *[shift_right(F.col(c), F.col("d")).alias(c) for c in ("px", "py")], "users", "trips")
    return low.select(columns).unionByName(up.select(columns)).groupBy("z", "px", "py").agg(*sums)


def diff_pyramid(diff: DataFrame, zoom: int, min_zoom: int = 0, saturate: bool = True) -> DataFrame:
    """z, px, py, value: a diff (px, py, value) of one zoom and its sums at all coarser ones, held at 2**32 - 1 if saturate.

    Values are not negative, so one clamp after the sum equals clamping at each addition.
    """
    out = rolled_up(diff, zoom, min_zoom, ("value",))
    return out.withColumn("value", F.least("value", F.lit(UINT32))) if saturate else out


def tile_totals(cells: DataFrame, resolution: int = 512) -> DataFrame:
    """z, x, y, cells, users, trips of each tile."""
    tile = (quotient(F.col("px"), resolution).alias("x"), quotient(F.col("py"), resolution).alias("y"))
    return cells.groupBy("z", *tile).agg(F.count(F.lit(1)).alias("cells"), F.sum("users").alias("users"), F.sum("trips").alias("trips"))


def parent_tiles(tiles: DataFrame, min_zoom: int = 0) -> DataFrame:
    """z, x, y: every ancestor of tiles (z, x, y), each once, the tiles themselves left out."""
    up = tiles.where(F.col("z") > min_zoom).select(
        F.explode(F.sequence(F.lit(min_zoom), F.col("z") - 1)).alias("to"), "z", "x", "y"
    )
    d = F.col("z") - F.col("to")
    return up.select(F.col("to").alias("z"), shift_right(F.col("x"), d).alias("x"), shift_right(F.col("y"), d).alias("y")).distinct()


def tiles_at(tiles: DataFrame, zoom: int, to: int) -> DataFrame:
    """x, y: tiles (x, y) of a zoom as they are, their distinct ancestors, or all their descendants at zoom `to`."""
    if to == zoom:
        return tiles.select("x", "y")
    if to < zoom:
        return tiles.select(shift_right(F.col("x"), zoom - to).alias("x"), shift_right(F.col("y"), zoom - to).alias("y")).distinct()
    return tiles_below(tiles.select("x", "y"), zoom, to).select("x", "y")
