"""Operations on cell tables (z, px, py, value): absent rows are zero, and zero is stored nowhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.codec import wrapped32
from trackweave.functions.tilemath import quotient

#: Tile lists of so many rows are broadcast; longer ones are shuffled.
BROADCAST_TILES = 100_000

KEYS = ["z", "px", "py"]

Translate = Callable[[Column, Column, Column], Column]  # tile, pixel in the tile, value


def with_tile(cells: DataFrame, resolution: int) -> DataFrame:
    return cells.withColumns({"x": quotient(F.col("px"), resolution), "y": quotient(F.col("py"), resolution)})


def few_tiles(tiles: DataFrame) -> DataFrame:
    """tiles, marked for broadcast if they are few."""
    return F.broadcast(tiles) if tiles.limit(BROADCAST_TILES + 1).count() <= BROADCAST_TILES else tiles


def in_tiles(cells: DataFrame, tiles: DataFrame, resolution: int = 512) -> DataFrame:
    """The cells of the listed tiles (z, x, y); tiles without cells are passed over."""
    kept = with_tile(cells, resolution).join(few_tiles(tiles.select("z", "x", "y")), ["z", "x", "y"], "left_semi")
    return kept.select(*cells.columns)


def not_in_tiles(cells: DataFrame, tiles: DataFrame, resolution: int = 512) -> DataFrame:
    """The cells of all other tiles: those listed are removed."""
    kept = with_tile(cells, resolution).join(few_tiles(tiles.select("z", "x", "y")), ["z", "x", "y"], "left_anti")
    return kept.select(*cells.columns)


def replaced(cells: DataFrame, fresh: DataFrame, tiles: DataFrame, resolution: int = 512) -> DataFrame:
    """cells with the listed tiles removed and their fresh cells put in."""
    return not_in_tiles(cells, tiles, resolution).unionByName(in_tiles(fresh, tiles, resolution))


def remove_where(cells: DataFrame, gone: Callable[[Column], Column], resolution: int = 512) -> DataFrame:
    """Without the cells of tiles {z, x, y} for which gone is true."""
    tile = F.struct("z", quotient(F.col("px"), resolution).alias("x"), quotient(F.col("py"), resolution).alias("y"))
    return cells.where(~F.coalesce(gone(tile), F.lit(False)))


def update_values(cells: DataFrame, change: Callable[[Column, Column], Column], resolution: int = 512) -> DataFrame:
    """Each value becomes change(pixel in the tile, value); cells that become zero or null vanish."""
    pixel = F.struct(F.pmod("px", F.lit(resolution)).alias("cx"), F.pmod("py", F.lit(resolution)).alias("cy"))
    out = cells.withColumn("value", change(pixel, F.col("value")))
    return out.where("value <> 0").select(*cells.columns)


def translated(cells: DataFrame, translate: Translate | None, resolution: int) -> DataFrame:
    if translate is None:
        return cells
    tile = F.struct("z", quotient(F.col("px"), resolution).alias("x"), quotient(F.col("py"), resolution).alias("y"))
    pixel = F.struct(F.pmod("px", F.lit(resolution)).alias("cx"), F.pmod("py", F.lit(resolution)).alias("cy"))
    return cells.withColumn("value", translate(tile, pixel, F.col("value")))


def copy_tiles(source: DataFrame, target: DataFrame, tiles: DataFrame, translate: Translate | None = None, resolution: int = 512) -> DataFrame:
    """target with the source's cells of the listed tiles written over its own where their translated value is above zero."""
    new = translated(in_tiles(source, tiles, resolution), translate, resolution).where("value > 0")
    both = target.select(*KEYS, F.col("value").alias("old"), F.lit(None).cast("long").alias("new"))
    both = both.unionByName(new.select(*KEYS, F.lit(None).cast("long").alias("old"), F.col("value").cast("long").alias("new")))
    return both.groupBy(*KEYS).agg(F.max("old").alias("old"), F.max("new").alias("new")).select(*KEYS, F.coalesce("new", "old").alias("value"))


def add_tiles(
    source: DataFrame, target: DataFrame, tiles: DataFrame, translate: Translate | None = None, resolution: int = 512, wrap: bool = False
) -> DataFrame:
    """target plus the source's translated cells of the listed tiles that are above zero; wrap: modulo 2**32."""
    new = translated(in_tiles(source, tiles, resolution), translate, resolution).where("value > 0")
    total = F.sum("value")
    out = target.select(*KEYS, "value").unionByName(new.select(*KEYS, F.col("value").cast("long").alias("value")))
    return out.groupBy(*KEYS).agg((wrapped32(total) if wrap else total).alias("value")).where("value <> 0")


def fold_tiles(
    source: DataFrame, target: DataFrame, tiles: DataFrame, fold: Callable[[Column, Column, Column, Column], Column], resolution: int = 512
) -> DataFrame:
    """target with fold(tile, pixel in the tile, target's value or 0, source's value) at each cell of the source's listed tiles."""
    new = in_tiles(source, tiles, resolution).select(*KEYS, F.col("value").alias("new"))
    both = target.select(*KEYS, F.col("value").alias("old")).join(new, KEYS, "full")
    tile = F.struct("z", quotient(F.col("px"), resolution).alias("x"), quotient(F.col("py"), resolution).alias("y"))
    pixel = F.struct(F.pmod("px", F.lit(resolution)).alias("cx"), F.pmod("py", F.lit(resolution)).alias("cy"))
    value = fold(tile, pixel, F.coalesce("old", F.lit(0).cast("long")), F.col("new"))
    return both.select(*KEYS, F.when(F.col("new").isNull(), F.col("old")).otherwise(value).alias("value")).where("value <> 0")


def lookup(cells: DataFrame, points: DataFrame) -> DataFrame:
    """points (z, px, py) with the value of their cell, 0 where there is none."""
    return points.join(cells.select(*KEYS, "value"), KEYS, "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))


def list_tiles(cells: DataFrame, resolution: int = 512) -> DataFrame:
    """z, x, y: the tiles that hold cells."""
    return with_tile(cells.where("value <> 0") if "value" in cells.columns else cells, resolution).select("z", "x", "y").distinct()


def offsets(cells: DataFrame, resolution: int = 512) -> DataFrame:
    """z, x, y, cx, cy, value of the non-zero cells, as a tile lists them."""
    out = with_tile(cells.where("value <> 0"), resolution)
    return out.select(
        "z", "x", "y", F.pmod("px", F.lit(resolution)).cast("int").alias("cx"), F.pmod("py", F.lit(resolution)).cast("int").alias("cy"), "value"
    )
