"""Point features of cells, vector tiles in protobuf, and their files."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.codec import read_varint, write_varint
from trackweave.functions.tilemath import place_of, quotient
from trackweave.operators import tilehits

# The layer, its attributes, and the extent of the vector tile specification.
LAYER, ATTRIBUTES, EXTENT = "heatmap", ("users", "trips"), 4096


def features(cells: DataFrame, resolution: int = 512, attributes=None) -> DataFrame:
    """z, x, y, cx, cy, lon, lat, users, trips: a point at the top left of each pixel that has users.

    attributes(users, trips) may replace the two (a struct); null drops the feature.
    """
    x, y = quotient(F.col("px"), resolution), quotient(F.col("py"), resolution)
    cx, cy = F.pmod("px", F.lit(resolution)).cast("int"), F.pmod("py", F.lit(resolution)).cast("int")
    values: Column = F.struct("users", "trips") if attributes is None else attributes(F.col("users"), F.col("trips"))
    rows = cells.where("users <> 0").select("z", x.alias("x"), y.alias("y"), cx.alias("cx"), cy.alias("cy"), values.alias("a")).where("a is not null")
    place = place_of(F.col("x"), F.col("y"), F.col("z"), F.col("cx"), F.col("cy"), resolution)
    return rows.withColumn("place", place).select("z", "x", "y", "cx", "cy", "place.lon", "place.lat", "a.*")


def _field(number: int, data: bytes) -> bytes:
    return write_varint(number << 3 | 2) + write_varint(len(data)) + data


def varint_sizes(values: np.ndarray) -> np.ndarray:
    """Bytes of each as a varint."""
    out, most = np.ones(values.shape, np.int64), int(values.max(initial=0))
    for k in range(1, 10):
        if most >> 7 * k:
            out += values >= np.uint64(1 << 7 * k)
    return out


def varints(columns: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
    """The bytes of rows of varints (unsigned 64 bits), one row behind the other: each byte goes to its place at once."""
    within = np.cumsum(np.stack(sizes), axis=0)
    ends = np.cumsum(within[-1])
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for column, size, until in zip(columns, sizes, within, strict=True):
        start = ends - within[-1] + until - size
        for k in range(int(size.max(initial=0))):
            some = slice(None) if k == 0 else np.flatnonzero(size > k)
            rest = column[some] >> np.uint64(7 * k)
            out[start[some] + k] = (rest & np.uint64(127) | (rest > 127).astype(np.uint64) << np.uint64(7)).astype(np.uint8)
    return out


def framed(n: int, *columns: np.ndarray | int | tuple) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of n varints each, and of their sizes, from columns of numbers; a tuple (tag, columns...) is a field of that tag,
    its length before it."""
    values, sizes = [], []
    for x in columns:
        if isinstance(x, tuple):
            inner, inner_sizes = framed(n, *x[1:])
            values.append(np.full(n, x[0], np.uint64))
            values.append(sum(inner_sizes, np.zeros(n, np.int64)).astype(np.uint64))
            sizes += [np.ones(n, np.int64), varint_sizes(values[-1]), *inner_sizes]
            values += inner
        else:
            values.append(np.full(n, x, np.uint64) if isinstance(x, int) else x.astype(np.uint64))
            sizes.append(varint_sizes(values[-1]))
    return values, sizes


def encode_columns(x: np.ndarray, y: np.ndarray, numbers: list[np.ndarray], names: tuple[str, ...] = ATTRIBUTES, layer: str = LAYER, extent: int = EXTENT) -> bytes:
    """A vector tile of one layer with a point for each row of x, y and numbers, unsigned integers named names.

    Values are interned in the order in which they first come. A feature is a row of varints, so lengths of tags, shapes and
    features are sums of sizes, and every byte of all features is put in its place at once.
    """
    head, end = b"\x78\x02" + _field(1, layer.encode()), b"\x28" + write_varint(extent)
    keys = b"".join(_field(3, name.encode()) for name in names)
    if not len(x):
        return _field(3, head + keys + end)
    table = np.stack([np.asarray(v) for v in numbers], axis=1).astype(np.uint64) if numbers else np.empty((len(x), 0), np.uint64)
    values, first, place = np.unique(table, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[place].reshape(table.shape)
    tags = [c for k in range(table.shape[1]) for c in (k, place[:, k])]
    double = lambda v: np.asarray(v).astype(np.int64) << 1
    features = varints(*framed(len(x), (2 << 3 | 2, (2 << 3 | 2, *tags), 3 << 3, 1, (4 << 3 | 2, 9, double(x), double(y)))))
    found = varints(*framed(len(values), (4 << 3 | 2, 5 << 3, values[order]))) if len(values) else np.empty(0, np.uint8)
    return _field(3, b"".join((head, features.tobytes(), keys, found.tobytes(), end)))


def encode_tile(points: list[tuple], names: tuple[str, ...] = ATTRIBUTES, layer: str = LAYER, extent: int = EXTENT) -> bytes:
    """The same of points (x, y, value...)."""
    x, y, *numbers = [np.array(v, np.int64 if i < 2 else np.uint64) for i, v in enumerate(zip(*points, strict=True))] or [np.empty(0)] * 2
    return encode_columns(x, y, numbers, names, layer, extent)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        if key & 7 == 0:
            value, at = read_varint(data, at)
        elif key & 7 == 2:
            size, at = read_varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            width = {1: 8, 5: 4}[key & 7]
            value, at = struct.unpack("<q" if width == 8 else "<i", data[at : at + width])[0], at + width
        yield key >> 3, value


def decode_tile(data: bytes) -> dict:
    """name, extent and points {x, y, attribute...} of the first layer of a tile of points."""
    layer = next(v for k, v in _fields(data) if k == 3)
    out: dict = {"name": None, "extent": 4096}
    keys, values, shapes = [], [], []
    for k, v in _fields(layer):
        if k == 1:
            out["name"] = v.decode()
        elif k == 2:
            shapes.append(dict(_fields(v)))
        elif k == 3:
            keys.append(v.decode())
        elif k == 4:
            values.append(next(_fields(v))[1])
        elif k == 5:
            out["extent"] = v

    def numbers(data: bytes) -> list[int]:
        found, at = [], 0
        while at < len(data):
            v, at = read_varint(data, at)
            found.append(v)
        return found

    out["points"] = []
    for shape in shapes:
        tags, (_, x, y) = numbers(shape[2]), numbers(shape[4])
        at = {"x": (x >> 1) ^ -(x & 1), "y": (y >> 1) ^ -(y & 1)}
        out["points"].append(at | {keys[i]: values[j] for i, j in zip(tags[::2], tags[1::2], strict=True)})
    return out


def vector_tiles(cells: DataFrame, resolution: int = 512, extent: int = EXTENT, attributes=None, names: tuple[str, ...] = ATTRIBUTES, partitions: int | None = None) -> DataFrame:
    """z, x, y, mvt, features: the bytes of each tile. A tile holds resolution**2 cells at most, so a group is bounded.

    attributes(users, trips), as for features(), gives a struct of unsigned integers called names; null drops the feature. partitions: so many
    tasks at least sort the cells.
    """
    x, y = quotient(F.col("px"), resolution), quotient(F.col("py"), resolution)
    scale = lambda c: F.expr(f"cast(pmod({c}, {resolution}) * {extent} div {resolution} as int)")
    values = F.struct("users", "trips") if attributes is None else attributes(F.col("users"), F.col("trips"))
    rows = cells.where("users <> 0").select("z", x.alias("x"), y.alias("y"), scale("px").alias("cx"), scale("py").alias("cy"), values.alias("a"))
    rows = rows.where("a is not null").select("z", "x", "y", "cx", "cy", *[F.col("a")[k].cast("long").alias(k) for k in names])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cx, cy, *numbers = [table.column(k).to_numpy() for k in ("cx", "cy", *names)]
        order = np.lexsort((cy, cx))
        mvt = encode_columns(cx[order], cy[order], [v[order] for v in numbers], names, extent=extent)
        kinds = (pa.int32(), pa.int64(), pa.int64())
        head = [pa.array([k.as_py()], t) for k, t in zip(key, kinds, strict=True)]
        return pa.Table.from_arrays([*head, pa.array([mvt]), pa.array([len(cx)], pa.int64())], names=["z", "x", "y", "mvt", "features"])

    return tilehits.dealt(rows, partitions, "z", "x", "y").groupBy("z", "x", "y").applyInArrow(run, "z int, x long, y long, mvt binary, features long")


def tile_points(tiles: DataFrame) -> DataFrame:
    """z, x, y, cx, cy (in the tile's extent), users, trips: the points in the bytes of tiles (z, x, y, mvt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z, x, y, mvt in zip(*[batch.column(i) for i in range(4)], strict=True):
                points = decode_tile(mvt.as_py())["points"]
                n, of = len(points), lambda k, points=points: [p[k] for p in points]
                head = [pa.array([v.as_py()] * n, t) for v, t in ((z, pa.int32()), (x, pa.int64()), (y, pa.int64()))]
                rest = [pa.array(of("x"), pa.int32()), pa.array(of("y"), pa.int32()), *[pa.array(of(k), pa.int64()) for k in ATTRIBUTES]]
                yield pa.RecordBatch.from_arrays([*head, *rest], names=["z", "x", "y", "cx", "cy", *ATTRIBUTES])

    return tiles.select("z", "x", "y", "mvt").mapInArrow(run, "z int, x long, y long, cx int, cy int, users long, trips long")


def write_tiles(tiles: DataFrame, folder: str) -> DataFrame:
    """Writes {folder}/{z}/{x}/{y}.mvt from the executors, over what is there, and returns z, x, y, bytes. folder: a URI they all reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            sizes = []
            for z, x, y, mvt in zip(*[batch.column(i) for i in range(4)], strict=True):
                store.create_dir(f"{root}/{z}/{x}", recursive=True)
                with store.open_output_stream(f"{root}/{z}/{x}/{y}.mvt") as out:
                    sizes.append(out.write(mvt.as_py()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64())], names=["z", "x", "y", "bytes"])

    return tiles.select("z", "x", "y", "mvt").mapInArrow(run, "z int, x long, y long, bytes long")


def remove_tile_files(tiles: DataFrame, folder: str) -> DataFrame:
    """Deletes the files of tiles (z, x, y) that lost all their cells; returns z, x, y, removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            removed = []
            for z, x, y in zip(*[batch.column(i) for i in range(3)], strict=True):
                path = f"{root}/{z}/{x}/{y}.mvt"
                there = store.get_file_info(path).type == fs.FileType.File
                if there:
                    store.delete_file(path)
                removed.append(there)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(removed)], names=["z", "x", "y", "removed"])

    return tiles.select(F.col("z").cast("int"), F.col("x").cast("long"), F.col("y").cast("long")).mapInArrow(run, "z int, x long, y long, removed boolean")


def tilejson(zoom: int = 14, url: str = "{z}/{x}/{y}.mvt") -> str:
    """The descriptor that goes beside the tiles."""
    layer = {"id": LAYER, "minzoom": 0, "maxzoom": zoom, "fields": {k: "Number" for k in ATTRIBUTES}}
    return json.dumps({"tilejson": "2.2.0", "name": LAYER, "format": "pbf", "scheme": "xyz", "minzoom": 0, "maxzoom": zoom, "tiles": [url], "vector_layers": [layer]}, indent=2)


def write_tilejson(folder: str, zoom: int = 14, name: str = "mvt.json") -> None:
    """The descriptor as a file in the folder of the tiles."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}") as out:
        out.write(tilejson(zoom).encode())
