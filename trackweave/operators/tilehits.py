"""Hits of a key in a tile as one row with arrays: drawn from pieces of lines, merged, and counted into users and trips per pixel.

Spark deals the rows out and sorts them; numpy works on a bounded number of pixels of a task at once. An offset `at` is row * resolution + column in the tile.
Rows that are stored may also hold `lines`, pieces that are drawn when they are read: six numbers (ENDS, from the tile's corner) for as many pixels as a tile is wide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels that a task works on at once, besides those of one key in one tile.
CHUNK = 1 << 18
#: Pixels of stored hits that a task reads at most, about; a line counts as WEIGHT of them, by its bytes and the time to draw it.
SHARE, WEIGHT = 4_000_000, 24
#: Pixels from which on a piece is stored as a line.
LINE = 6
#: Points of tracks that a task sorts and draws at most, about.
POINTS = 200_000

HITS = "n long, at array<int>, hits array<long>"

ENDS = ["x0", "y0", "x1", "y1", "i0", "i1"]

COUNTS = "px long, py long, users long, trips long"

Values = tuple[np.ndarray, np.ndarray | None]  # group * cells + offset of each pixel, and its hits (None: one each)


def schema_of(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)


def shares(rows: DataFrame, pixels: int) -> int:
    """Partitions for rows of so many pixels."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pixels // SHARE))


def shares_of_points(spark: SparkSession, points: int) -> int:
    """Partitions for tracks of so many points, so that what a task sorts does not grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-points // POINTS))


def is_more(rows: DataFrame, partitions: int | None) -> bool:
    """Whether so many partitions are more than shuffles have."""
    return bool(partitions) and partitions > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(rows: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """rows dealt out by keys into so many partitions, if that is more than shuffles have (small tables are left to AQE)."""
    return rows.repartition(partitions, *keys) if is_more(rows, partitions) else rows.repartition(*keys)


def sums(at: np.ndarray, hits: np.ndarray | None, weight: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places in order and the sum of hits at each."""
    if hits is None:
        at = np.sort(at)
    else:
        order = np.argsort(at)
        at, hits = at[order], hits[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, at.size), bool), at[1:] != at[:-1])))
    total = np.diff(np.append(first, at.size)) * weight if hits is None else np.add.reduceat(hits, first) if first.size else hits
    return at[first], total


def pixels_of(rows: dict[str, np.ndarray], group: np.ndarray, r: int) -> Values:
    """The pixels of pieces: step i of a line is i pixels along its longer side and ((l >> 1) + i * s) div l along the other."""
    w, h = rows["x1"] - rows["x0"], rows["y1"] - rows["y0"]
    flat, n = np.abs(w) > np.abs(h), rows["i1"] - rows["i0"] + 1
    l, s = np.maximum(np.abs(w), np.abs(h)), np.minimum(np.abs(w), np.abs(h))  # noqa: E741
    along, across = (np.where(flat, a, b) for a, b in ((np.sign(w), np.sign(h) * r), (np.sign(h) * r, np.sign(w))))
    start = group * (r * r) + (rows["y0"] - rows["ty"] * r) * r + rows["x0"] - rows["tx"] * r
    of = np.repeat(np.arange(n.size), n)
    i = np.arange(of.size) - (np.cumsum(n) - n - rows["i0"])[of]
    return start[of] + along[of] * i + across[of] * (((l >> 1)[of] + i * s[of]) // np.maximum(l, 1)[of]), None


def hits_of(batch: pa.RecordBatch, group: np.ndarray, r: int) -> Values:
    """The pixels of rows that hold hits already."""
    at, hits = (batch.column(c) for c in ("at", "hits"))
    of = np.repeat(group, at.value_lengths().to_numpy(zero_copy_only=False))
    return of * (r * r) + at.flatten().to_numpy(zero_copy_only=False), hits.flatten().to_numpy(zero_copy_only=False)


def lines_of(batch: pa.RecordBatch, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lines of rows (ENDS of each), and the group of each."""
    lines = batch.column("lines")
    numbers = lines.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(ENDS))
    return numbers, np.repeat(group, lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) // len(ENDS))


def steps_of(lines: np.ndarray) -> np.ndarray:
    return lines[:, 5] - lines[:, 4] + 1


def drawn_lines(lines: np.ndarray, of: np.ndarray, r: int) -> np.ndarray:
    """The pixels of lines of groups."""
    return pixels_of({"tx": 0, "ty": 0} | dict(zip(ENDS, lines.T)), of, r)[0]


def with_lines(at: np.ndarray, hits: np.ndarray, more: np.ndarray) -> Values:
    """Pixels with hits and those of lines."""
    return (np.concatenate((at, more)), np.concatenate((hits, np.ones(more.size, np.int64)))) if at.size else (more, None)


def pixels_in(batch: pa.RecordBatch) -> np.ndarray:
    """How many pixels the hits and lines of each row are."""
    lines, of = lines_of(batch, np.arange(batch.num_rows))
    more = np.bincount(of, steps_of(lines), batch.num_rows).astype(np.int64)
    return batch.column("at").value_lengths().to_numpy(zero_copy_only=False) + more


def stored(batch: pa.RecordBatch, group: np.ndarray, r: int) -> Values:
    """The pixels of rows that hold hits and lines."""
    return with_lines(*hits_of(batch, group, r), drawn_lines(*lines_of(batch, group), r))


def starts_of(keys: pa.RecordBatch) -> np.ndarray:
    """Whether a row's keys differ from those of the row before (the first one: false)."""
    new = np.zeros(keys.num_rows, bool)
    for c in keys.columns:
        code = c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def chunks(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows, so many at once that they have about CHUNK pixels."""
    for batch in batches:
        ends = np.cumsum(size(batch))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            yield batch.slice(at, end - at)
            at = end


def summed(batches: Iterator[pa.RecordBatch], names: list[str], r: int, size: Callable, values: Callable[[pa.RecordBatch, np.ndarray], Values], weight: int) -> Iterator[pa.RecordBatch]:
    """names, n, at, hits of rows in order of names: a row for each. The last one waits for the next rows, which may be of the same."""
    held = None

    def made(keys: pa.RecordBatch, ends: np.ndarray, at: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((at, pa.int32()), (hits, pa.int64()))]
        return pa.RecordBatch.from_arrays([*keys.columns, pa.array(np.diff(ends), pa.int64()), *lists], names=[*names, "n", "at", "hits"])

    for batch in chunks(batches, size):
        keys = batch.select(names)
        new = starts_of(keys)
        place, hits = sums(*values(batch, np.cumsum(new)), weight)
        starts = np.flatnonzero(np.append(True, new[1:]))
        keys = keys.take(pa.array(starts))
        ends = np.searchsorted(place, np.arange(starts.size + 1) * (r * r))
        at = place - np.repeat(np.arange(starts.size), np.diff(ends)) * (r * r)
        if held and held[0].equals(keys.slice(0, 1)):
            one, more = sums(np.concatenate((held[1], at[: ends[1]])), np.concatenate((held[2], hits[: ends[1]])))
            at, hits = np.concatenate((one, at[ends[1] :])), np.concatenate((more, hits[ends[1] :]))
            ends = np.append(0, ends[1:] + (one.size - ends[1]))
        elif held:
            yield made(held[0], np.array([0, held[1].size]), *held[1:])
        last = starts.size - 1
        if last:
            yield made(keys.slice(0, last), ends[:-1], at[: ends[last]], hits[: ends[last]])
        held = keys.slice(last, 1), at[ends[last] :], hits[ends[last] :]
    if held:
        yield made(held[0], np.array([0, held[1].size]), *held[1:])


def folded(batches: Iterator[pa.RecordBatch], names: list[str], r: int, size: Callable, parts: Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """names, n, at, hits, lines of rows in order of names: a row for each. parts: pixels, their hits, lines and their groups.

    Lines stay lines until they are of more pixels than a tile has; then they are drawn, so no row outgrows its tile. n: the row's weight."""
    held = None

    def made(keys: pa.RecordBatch, place: np.ndarray, hits: np.ndarray, lines: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        groups = np.arange(keys.num_rows + 1)
        ends, line_ends = np.searchsorted(place, groups * (r * r)), np.searchsorted(of, groups)
        at = place - np.repeat(groups[:-1], np.diff(ends)) * (r * r)
        n = np.diff(ends) + WEIGHT * np.diff(line_ends)
        lists = ((ends, at, pa.int32()), (ends, hits, pa.int64()), (line_ends * len(ENDS), lines.ravel(), pa.int64()))
        arrays = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v, t)) for e, v, t in lists]
        return pa.RecordBatch.from_arrays([*keys.columns, pa.array(n, pa.int64()), *arrays], names=[*names, "n", "at", "hits", "lines"])

    for batch in chunks(batches, size):
        keys = batch.select(names)
        new = starts_of(keys)
        place, hits, lines, of = parts(batch, np.cumsum(new))
        keys = keys.take(pa.array(np.flatnonzero(np.append(True, new[1:]))))
        if held and held[0].equals(keys.slice(0, 1)):
            place, hits, lines = (np.concatenate(v) for v in zip(held[1:4], (place, hits, lines)))
            of = np.append(held[4], of)
        elif held:
            yield made(*held)
        last = keys.num_rows - 1
        dense = (np.bincount(of, steps_of(lines), last + 1) > r * r)[of]
        more = drawn_lines(lines[dense], of[dense], r)
        place, hits = sums(np.concatenate((place, more)), np.concatenate((hits, np.ones(more.size, np.int64))))
        lines, of = lines[~dense], of[~dense]
        a, b = np.searchsorted(place, last * (r * r)), np.searchsorted(of, last)
        if last:
            yield made(keys.slice(0, last), place[:a], hits[:a], lines[:b], of[:b])
        held = keys.slice(last, 1), place[a:] - last * (r * r), hits[a:], lines[b:], of[b:] - last
    if held:
        yield made(*held)


def lined(pieces: DataFrame, keys: tuple[str, ...], resolution: int) -> DataFrame:
    """keys, x, y, n, at, hits, lines of pieces (raster.pieces) that were dealt out by keys and tile: a row for each key and tile, in
    which pieces of LINE pixels or more are lines and others are hits."""
    names, r = ["tx", "ty", *keys], resolution
    column = lambda b, c: b.column(c).to_numpy(zero_copy_only=False)

    def parts(batch: pa.RecordBatch, group: np.ndarray) -> tuple[np.ndarray, ...]:
        lines = np.stack([column(batch, c) for c in ENDS], 1)
        for k, v in enumerate(("tx", "ty", "tx", "ty")):
            lines[:, k] -= column(batch, v) * r
        short = steps_of(lines) < LINE
        place = drawn_lines(lines[short], group[short], r)
        return place, np.ones(place.size, np.int64), lines[~short], group[~short]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return folded(batches, names, r, lambda b: column(b, "i1") - column(b, "i0") + 1, parts)

    rows = pieces.where("tx >= 0 and ty >= 0").select(*names, *ENDS).sortWithinPartitions(*names)
    out = rows.mapInArrow(keep, f"{schema_of(rows, names)}, {HITS}, lines array<long>")
    return out.select(*keys, F.col("tx").alias("x"), F.col("ty").alias("y"), "n", "at", "hits", "lines")


def drawn(pieces: DataFrame, keys: tuple[str, ...], resolution: int, weight: int = 1, count: bool = False, partitions: int | None = None) -> DataFrame:
    """keys, x, y, n, at, hits of pieces (raster.pieces) that were dealt out by keys and tile: a row for each key and tile.

    count: px, py, users, trips instead, the number of keys and the sum of hits of each pixel, summed in so many
    partitions at least; rows of keys never leave a task."""
    names, r = ["tx", "ty", *keys], resolution
    column = lambda b, c: b.column(c).to_numpy(zero_copy_only=False)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = lambda b, group: pixels_of({c: column(b, c) for c in ("tx", "ty", *ENDS)}, group, r)
        out = summed(batches, names, r, lambda b: column(b, "i1") - column(b, "i0") + 1, values, weight)
        return tile_sums(out, ["tx", "ty"], list(keys), r) if count else out

    rows = pieces.where("tx >= 0 and ty >= 0").select(*names, *ENDS).sortWithinPartitions(*names)
    if count:
        return totals(rows.mapInArrow(draw, COUNTS), partitions)
    out = rows.mapInArrow(draw, f"{schema_of(rows, names)}, {HITS}")
    return out.select(*keys, F.col("tx").alias("x"), F.col("ty").alias("y"), "n", "at", "hits")


def lines_or_none(rows: DataFrame) -> DataFrame:
    """rows with lines, none where there is no such column."""
    return rows if "lines" in rows.columns else rows.withColumn("lines", F.lit(None).cast("array<long>"))


def merged(rows: DataFrame, keys: list[str], resolution: int, partitions: int, lines: bool = False) -> DataFrame:
    """keys, x, y, n, at, hits: the hits of all rows of a key in a tile in one row. lines: and lines, which are left undrawn (folded)."""
    names, r = ["x", "y", *keys], resolution

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if lines:
            return folded(batches, names, r, pixels_in, lambda b, group: (*hits_of(b, group, r), *lines_of(b, group)))
        return summed(batches, names, r, pixels_in, lambda b, group: stored(b, group, r), 1)

    shared = lines_or_none(rows).select(*names, "n", "at", "hits", "lines").repartition(partitions, *names).sortWithinPartitions(*names)
    schema, more = f"{schema_of(shared, names)}, {HITS}", ["lines"] * lines
    return shared.mapInArrow(merge, schema + ", lines array<long>" * lines).select(*keys, "x", "y", "n", "at", "hits", *more)


def cells(rows: DataFrame, keys: tuple[str, ...], resolution: int) -> DataFrame:
    """keys, px, py, hits: a row for each pixel."""
    each = rows.select(*keys, "x", "y", "hits", F.posexplode("at").alias("_i", "_at"))
    px, py = F.col("x") * resolution + F.col("_at") % resolution, F.col("y") * resolution + F.expr(f"_at div {resolution}")
    return each.select(*keys, px.alias("px"), py.alias("py"), F.col("hits")[F.col("_i")].alias("hits"))


def packed(cells: DataFrame, keys: list[str], resolution: int) -> DataFrame:
    """keys, x, y, n, at, hits of cells (keys, px, py, hits), which may come in several rows."""
    tile = [F.expr(f"p{v} div {resolution}").alias(v) for v in "xy"]
    at = (F.pmod("py", F.lit(resolution)) * resolution + F.pmod("px", F.lit(resolution))).cast("int")
    sums = cells.groupBy(*keys, *tile, at.alias("at")).agg(F.sum("hits").alias("hits"))
    one = sums.groupBy(*keys, "x", "y").agg(F.array_sort(F.collect_list(F.struct("at", "hits"))).alias("c"))
    return one.select(*keys, "x", "y", F.size("c").cast("long").alias("n"), F.col("c.at").alias("at"), F.col("c.hits").alias("hits"))


def tile_sums(batches: Iterator[pa.RecordBatch], tile: list[str], keys: list[str], r: int) -> Iterator[pa.RecordBatch]:
    """px, py, users, trips of rows in order of tile (its x and y first) and keys: of one tile at a time, in two arrays of its size."""
    users, trips = np.zeros(r * r, np.int64), np.zeros(r * r, np.int64)
    here, who, seen = None, None, []

    def end_key() -> None:
        for at in seen[:1] if len(seen) < 2 else [np.unique(np.concatenate(seen))]:
            users[at] += 1
        seen.clear()

    def end_tile() -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(users)
        columns = (here[0] * r + at % r, here[1] * r + at // r, users[at], trips[at]) if at.size else ()
        for k in range(0, at.size, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + CHUNK]) for c in columns], names=["px", "py", "users", "trips"])
        users[at] = trips[at] = 0

    for batch in batches:
        tiles, owners = (zip(*[batch.column(c).to_pylist() for c in names]) for names in (tile, keys))
        (at, at_ends), (hits, ends) = ((x.values.to_numpy(), x.offsets.to_numpy()) for x in (batch.column("at"), batch.column("hits")))
        for k, (to, owner) in enumerate(zip(tiles, owners)):
            if (to, owner) != (here, who):
                end_key()
                if to != here:
                    yield from end_tile()
                here, who = to, owner
            seen.append(at[at_ends[k] : at_ends[k + 1]])
            trips[seen[-1]] += hits[ends[k] : ends[k + 1]]
    end_key()
    yield from end_tile()


def totals(parts: DataFrame, partitions: int | None = None) -> DataFrame:
    """Sums of what tasks have counted. A task has a pixel once, so hash tables of its share would sum nothing before the exchange."""
    return dealt(parts, partitions, "px", "py").groupBy("px", "py").agg(F.sum("users").alias("users"), F.sum("trips").alias("trips"))


def counted(rows: DataFrame, resolution: int, total: int) -> DataFrame:
    """px, py, users, trips of rows (user_id, x, y, n, at, hits, maybe lines), of which a user may have several in a tile; total: of n, about.

    A tile's users are dealt out to as many tasks as its pixels need. Only tiles that need several are broadcast, total / SHARE at most,
    so rows are exchanged once.
    """
    names, r = ["x", "y", "_salt"], resolution
    load = rows.groupBy("x", "y").agg(F.ceil(F.sum("n") / SHARE).cast("int").alias("_salts")).where("_salts > 1")
    n = shares(rows, total)
    salted = lines_or_none(rows).join(F.broadcast(load), ["x", "y"], "left").withColumn("_salt", F.pmod(F.xxhash64("user_id"), F.coalesce("_salts", F.lit(1))))
    shared = salted.select(*names, "user_id", "at", "hits", "lines").repartition(n, *names).sortWithinPartitions(*names, "user_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = summed(batches, [*names, "user_id"], r, pixels_in, lambda b, group: stored(b, group, r), 1)
        return tile_sums(one, names, ["user_id"], r)

    return totals(shared.mapInArrow(count, COUNTS), n)
