"""Tables of tiles from boxes of tile numbers, without an array of a whole box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.functions.tilemath import child_range, shift_left, shift_right, tile_of

#: A square is 2**SQUARE tiles wide.
SQUARE = 6


def tiles_in(boxes: DataFrame, partitions: int | None = None) -> DataFrame:
    """The other columns of boxes (x0, y0, x1, y1, ends included) and x, y: a row for each tile; none where an end comes first or is null.

    A box is cut into aligned squares, which are dealt out before they are expanded: so one row may be the whole world, its
    tiles come from all tasks, and nothing holds more than a column of squares or a row of a square.
    """
    n = partitions or int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in boxes.columns if c not in ("x0", "y0", "x1", "y1")]
    squares = boxes.where("x0 <= x1 and y0 <= y1")
    for v in "xy":
        squares = squares.withColumn(f"_s{v}", F.explode(F.sequence(*[shift_right(F.col(f"{v}{i}"), SQUARE) for i in (0, 1)])))
    out = squares.repartition(n, "_sx", "_sy")
    for v in "xy":
        first = shift_left(F.col(f"_s{v}"), SQUARE)
        out = out.withColumn(v, F.explode(F.sequence(F.greatest(f"{v}0", first), F.least(F.col(f"{v}1"), first + ((1 << SQUARE) - 1)))))
    return out.select(*others, "x", "y")


def tiles_below(tiles: DataFrame, zoom: int, to: int, x: str = "x", y: str = "y") -> DataFrame:
    """The columns of tiles as p_..., and x, y: all tiles of a finer zoom below each."""
    r = child_range(F.col(x), F.col(y), zoom, to)
    boxes = tiles.select(*[F.col(c).alias(f"p_{c}") for c in tiles.columns], r.alias("r"))
    ends = [F.col("r.x0").alias("x0"), F.col("r.y0").alias("y0"), (F.col("r.x1") - 1).alias("x1"), (F.col("r.y1") - 1).alias("y1")]
    return tiles_in(boxes.select(*[f"p_{c}" for c in tiles.columns], *ends))


def tiles_for_boxes(boxes: DataFrame, zoom: int, left: str = "left", top: str = "top", right: str = "right", bottom: str = "bottom") -> DataFrame:
    """The other columns of boxes in degrees and x, y: the tiles of each, those of both corners included; none if left is beyond right."""
    a, b = tile_of(F.col(left), F.col(top), zoom), tile_of(F.col(right), F.col(bottom), zoom)
    others = [c for c in boxes.columns if c not in (left, top, right, bottom)]
    return tiles_in(boxes.select(*others, a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
