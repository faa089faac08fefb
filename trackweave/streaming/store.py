"""Tables of the incremental job on plain Parquet: user cells in sorted runs (a row for each user and tile, with arrays of hits and of lines), current cells by bucket, and the state, under one log."""

from __future__ import annotations

import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions.tilemath import quotient, shift_right
from trackweave.operators import tilehits
from trackweave.operators.cells import BROADCAST_TILES
from trackweave.streaming.log import Conflict, Log, Run

USER_CELLS = "user_id string, x long, y long, n long, at array<int>, hits array<long>, lines array<long>"
CELLS = "px long, py long, users long, trips long"
SCHEMAS = {"users": USER_CELLS, "cells": CELLS}
#: A bucket is 2**BUCKET tiles wide; a replacement rewrites the buckets that it touches.
BUCKET = 4


@dataclass(frozen=True)
class Touched:
    """Base tiles (x, y) of a zoom, whether they are few enough to be broadcast, their buckets and their bounds. No coarser zoom has more
    tiles or buckets, and a shift takes both to it. Buckets are names only: 2**20 of them cover the world at zoom 14."""

    base: DataFrame
    zoom: int
    few: bool
    buckets: frozenset[tuple[int, int]]
    box: tuple[int, int, int, int]

    def at(self, zoom: int) -> DataFrame:
        """x, y: the tiles at a coarser zoom."""
        d = self.zoom - zoom
        tiles = self.base.select(*[shift_right(F.col(c), d).alias(c) for c in ("x", "y")]).distinct()
        return F.broadcast(tiles) if self.few else tiles

    def all(self) -> DataFrame:
        """z, x, y: the tiles of all zooms."""
        d = F.explode(F.sequence(F.lit(0), F.lit(self.zoom))).alias("d")
        tiles = self.base.select("x", "y", d).select((F.lit(self.zoom) - F.col("d")).alias("z"), *[shift_right(F.col(c), F.col("d")).alias(c) for c in ("x", "y")])
        return F.broadcast(tiles.distinct()) if self.few else tiles.distinct()

    def keys(self, zoom: int) -> set[str]:
        """The buckets at a zoom, as runs name them."""
        d = self.zoom - zoom
        return {f"{zoom}/{x >> d}-{y >> d}" for x, y in self.buckets}

    def all_keys(self, finest: int) -> set[str]:
        """Those at all zooms up to finest."""
        return set().union(*[self.keys(z) for z in range(finest + 1)])

    def meets(self, run: Run) -> bool:
        """Whether a run may hold cells of the tiles."""
        d = self.zoom - int(run.key.split("/")[0])
        x0, x1, y0, y1 = (v >> d for v in self.box)
        return run.x0 <= x1 and run.x1 >= x0 and run.y0 <= y1 and run.y1 >= y0


def finest_common(a: list, b: list, zoom: int) -> int | None:
    """The finest zoom at which two sets of base buckets share one."""
    for d in range(zoom + 1):
        if {(x >> d, y >> d) for x, y in a} & {(x >> d, y >> d) for x, y in b}:
            return zoom - d
    return None


class View:
    """A store at one version: what it reads stays the same, whoever commits or compacts meanwhile."""

    def __init__(self, store: Store, version: int) -> None:
        self.store, self.version = store, version

    def _rows(self, kind: str, runs: list[Run]) -> DataFrame:
        spark, schema = self.store.spark, f"{SCHEMAS[kind]}, z int, bucket string"
        if not runs:
            return spark.createDataFrame([], schema)
        read = spark.read.schema(schema).option("basePath", f"{self.store.root}/{kind}")
        return read.parquet(*[f"{self.store.root}/{r.path}" for r in runs]).select(*[x.split()[0] for x in schema.split(", ")])

    def user_runs(self, touched: Touched | None = None) -> list[Run]:
        if touched is None:
            return self.store.log.runs(self.version, "users")
        return [r for r in self.store.log.runs(self.version, "users", touched.keys(touched.zoom)) if touched.meets(r)]

    def user_hits(self, touched: Touched | None = None, more: Sequence[Run] = ()) -> tuple[DataFrame, int]:
        """user_id, x, y, n, at, hits, lines of all runs, or of the base tiles' and further runs: only their buckets' are opened. Also the weight of these runs."""
        runs = [*self.user_runs(touched), *more]
        rows, pixels = self._rows("users", runs), sum(r.rows for r in runs)
        return (rows if touched is None else rows.join(touched.at(touched.zoom), ["x", "y"], "left_semi")), pixels

    def user_cells(self, touched: Touched | None = None, more: Sequence[Run] = ()) -> DataFrame:
        """user_id, px, py, hits over all batches."""
        rows, pixels = self.user_hits(touched, more)
        out = tilehits.merged(rows, ["user_id"], self.store.resolution, tilehits.shares(rows, pixels))
        return tilehits.cells(out, ("user_id",), self.store.resolution)

    def user_cells_of(self, touched: Touched, more: Sequence[Run] = ()) -> DataFrame:
        """The same for the base tiles only, with further runs, filtered before anything is summed."""
        return self.user_cells(touched, more)

    def counted(self, touched: Touched, more: Sequence[Run] = ()) -> DataFrame:
        """px, py, users, trips of the base tiles, with further runs."""
        rows, pixels = self.user_hits(touched, more)
        return tilehits.counted(rows, self.store.resolution, pixels)

    def cell_runs(self, keys: set[str] | None = None) -> list[Run]:
        return self.store.log.runs(self.version, "cells", keys)

    def cells(self, zoom: int | None = None) -> DataFrame:
        """z, px, py, users, trips; of one zoom only if given."""
        runs = [r for r in self.cell_runs() if zoom is None or r.key.startswith(f"{zoom}/")]
        return self._rows("cells", runs).select("z", "px", "py", "users", "trips")

    def cells_of(self, touched: Touched, finest: int | None = None) -> DataFrame:
        """The cells of the touched tiles of all zooms (up to finest), read from their buckets only."""
        keys = touched.all_keys(touched.zoom if finest is None else finest)
        rows = self.store.tiled(self._rows("cells", [r for r in self.cell_runs(keys) if touched.meets(r)]))
        return rows.join(touched.all(), ["z", "x", "y"], "left_semi").select("z", "px", "py", "users", "trips")

    def beside(self, touched: Touched, finest: int) -> DataFrame:
        """z, px, py, users, trips of stored cells up to a zoom in tiles that share a parent with touched ones but are not among them; a
        bucket holds whole families."""
        rows = self.store.tiled(self._rows("cells", self.cell_runs(touched.all_keys(finest))))
        rows = rows.withColumns({"uz": F.col("z") - 1, "ux": shift_right(F.col("x"), 1), "uy": shift_right(F.col("y"), 1)})
        rows = rows.join(touched.all().toDF("uz", "ux", "uy"), ["uz", "ux", "uy"], "left_semi").join(touched.all(), ["z", "x", "y"], "left_anti")
        return rows.select("z", "px", "py", "users", "trips")


class Store:
    """Folder root: users/c=ID/z=Z/bucket=B are sorted runs of user cells that batches add and compact() merges,
    cells/c=ID/z=Z/bucket=B the current cells of each bucket, touched/c=ID the base tiles of a batch; log says what lives (Log).

    Any number of writers may work at once. A writer reads at one version and writes aside; its commit is one entry with user
    cells, cells and the last contribution id. If batches that came first replaced cells of the same buckets, it works out anew only the
    zooms at which they meet, at the newer version, and tries again. A crash at any moment leaves the last version,
    and files that nothing names (vacuum() removes them). merged: runs of a tier that compact() merges.
    """

    def __init__(self, spark: SparkSession, root: str, resolution: int = 512, merged: int = 4, snapshots: int = 64) -> None:
        self.spark, self.root, self.resolution, self.merged = spark, root.rstrip("/"), resolution, merged
        self.log = Log(spark, self.root, snapshots)
        self.files = self.log.files

    def view(self, version: int | None = None) -> View:
        return View(self, self.log.head() if version is None else version)

    def user_cells(self) -> DataFrame:
        return self.view().user_cells()

    def user_cells_of(self, touched: Touched) -> DataFrame:
        return self.view().user_cells_of(touched)

    def cells(self, zoom: int | None = None) -> DataFrame:
        return self.view().cells(zoom)

    def cells_of(self, touched: Touched) -> DataFrame:
        return self.view().cells_of(touched)

    def tiled(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"x": quotient(F.col("px"), self.resolution), "y": quotient(F.col("py"), self.resolution)})

    def bucket(self) -> Column:
        return F.concat_ws("-", *[shift_right(F.col(c), BUCKET).cast("string") for c in "xy"])

    # Writing aside

    def write_runs(self, kind: str, rows: DataFrame, tier: Callable[[str], int] = lambda key: 0) -> list[Run]:
        """Rows (with z) as new sorted runs, one for each bucket; nothing shows until they are committed. Large buckets are
        written by several tasks. kind users takes cells as well as rows with arrays; a run's rows are their weight (pixels, and WEIGHT for a line)."""
        at, users = f"{kind}/c={uuid.uuid4().hex}", kind == "users"
        columns = [x.split()[0] for x in SCHEMAS[kind].split(", ")]
        if users and "px" in rows.columns:
            rows = tilehits.packed(rows, ["user_id", "z"], self.resolution)
        rows, tiled = (tilehits.lines_or_none(rows), lambda x: x) if users else (rows, self.tiled)
        rows = tiled(rows).withColumn("bucket", self.bucket()).select(*columns, "z", "bucket").hint("rebalance", "z", "bucket")
        order = ("y", "x", "user_id") if users else ("py", "px")
        rows.sortWithinPartitions("z", "bucket", *order).write.partitionBy("z", "bucket").parquet(f"{self.root}/{at}")
        written = tiled(self.spark.read.schema(f"{SCHEMAS[kind]}, z int, bucket string").parquet(f"{self.root}/{at}"))
        bounds = [f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))]
        found = written.groupBy("z", "bucket").agg((F.sum("n") if users else F.count(F.lit(1))).alias("rows"), *bounds).collect()  # buckets
        key = lambda r: f"{r.z}/{r.bucket}"
        return [Run(kind, key(r), f"{at}/z={r.z}/bucket={r.bucket}", r.rows, tier(key(r)), r.x0, r.x1, r.y0, r.y1) for r in found]

    def put_aside(self, rows: DataFrame, name: str) -> DataFrame:
        """rows, written below the root and read again."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}")

    def touched(self, base: DataFrame, zoom: int) -> Touched:
        """What is known of base tiles (x, y) of a zoom, counted once for all reads of a batch."""
        few = base.count() <= BROADCAST_TILES
        buckets = base.select(*[shift_right(F.col(c), BUCKET).alias(c) for c in ("x", "y")]).distinct().collect()
        box = base.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        return Touched(base, zoom, few, frozenset(tuple(r) for r in buckets), tuple(v or 0 for v in box))

    def replaced(self, view: View, touched: Touched, fresh: DataFrame, finest: int) -> list[Run]:
        """New runs of the touched buckets at zooms up to finest, in which the touched tiles hold the fresh cells (z, px, py, users, trips)."""
        old = self.tiled(view._rows("cells", view.cell_runs(touched.all_keys(finest)))).join(touched.all(), ["z", "x", "y"], "left_anti").select("z", "px", "py", "users", "trips")
        rows = old.unionByName(fresh.select("z", "px", "py", "users", "trips"))
        return self.write_runs("cells", rows)

    # Commits

    def batch(self, name: str, zoom: int) -> Touched | None:
        """The tiles that a batch of that name touched, if it is in."""
        found = self.log.runs(self.log.head(), "batch", {name})
        return self.touched(self.spark.read.parquet(f"{self.root}/{found[0].path}"), zoom) if found else None

    def commit_batch(self, name: str, base: int, touched: Touched, at: str, users: list[Run], cells: list[Run], before: list[Run], **more) -> int:
        """One version with a batch's user cells, cells, tiles and state. Raises Conflict with the finest zoom at which a later
        version replaced cells of the same buckets, without one if the batch is in already."""
        mine = sorted(touched.buckets)

        def check(entry: dict) -> int | None:
            if entry["kind"] != "batch":
                return None
            if entry["batch"] == name:
                raise Conflict()
            return finest_common(mine, entry["buckets"], touched.zoom)

        adds = [*users, *cells, Run("batch", name, at)]
        return self.log.commit("batch", base, adds, [r.path for r in before], check, batch=name, touched=at, zoom=touched.zoom, buckets=mine, **more)

    def compact(self, touched: Touched | None = None) -> int:
        """Merges runs of user cells of the same key, hits summed, where a tier has as many as merged says; the key's runs up to
        that tier become one of the next. Batches may run meanwhile: it changes no content. Returns how many runs were
        merged; none if another compaction took one of them first."""
        view = self.view()
        tiers: dict[str, dict[int, list[Run]]] = defaultdict(lambda: defaultdict(list))
        for r in view.user_runs() if touched is None else self.log.runs(view.version, "users", touched.keys(touched.zoom)):
            tiers[r.key][r.tier].append(r)
        full = {key: max(t for t, runs in by.items() if len(runs) >= self.merged) for key, by in tiers.items() if any(len(x) >= self.merged for x in by.values())}
        chosen = [r for key, top in full.items() for t, runs in tiers[key].items() if t <= top for r in runs]
        if not chosen:
            return 0
        rows = view._rows("users", chosen)
        rows = tilehits.merged(rows, ["user_id", "z"], self.resolution, tilehits.shares(rows, sum(r.rows for r in chosen)), lines=True)
        merged, gone = self.write_runs("users", rows, lambda key: full[key] + 1), {r.path for r in chosen}

        def check(entry: dict) -> None:
            if gone & set(entry["removes"]):
                raise Conflict()

        try:
            self.log.commit("compact", view.version, merged, sorted(gone), check)
        except Conflict:
            return 0
        return len(chosen)

    def pending(self) -> list[int]:
        """Versions whose tiles are not published yet."""
        return self.log.entry(self.log.head())["pending"]

    def touched_by(self, version: int) -> Touched:
        entry = self.log.entry(version)
        return self.touched(self.spark.read.parquet(f"{self.root}/{entry['touched']}"), entry["zoom"])

    def overtaken(self, touched: Touched, since: int) -> int | None:
        """The finest zoom at which a version after since replaced cells of the same buckets."""
        later = (self.log.entry(v) for v in range(since + 1, self.log.head() + 1))
        met = [finest_common(sorted(touched.buckets), e["buckets"], touched.zoom) for e in later if e["kind"] == "batch"]
        return max((z for z in met if z is not None), default=None)

    def last_contribution(self) -> int:
        """-1 before the first batch."""
        return int(self.log.entry(self.log.head())["LastContributionId"])

    def put_last_contribution(self, value: int, expects: int | None = None) -> None:
        """Raises Conflict if expects is given and is not the last one."""
        self.log.commit("state", self.log.head(), last=value, expects=expects)

    def vacuum(self, keep: int = 2, orphan_hours: float | None = None) -> int:
        """Removes runs that no version later than the last keep ones reads, and returns how many. orphan_hours: also folders that no
        version names and that are as old, left by writers that failed; for longer than any batch takes."""
        head = self.log.head()
        done = int(self.files.read("log/vacuumed")) if self.files.exists("log/vacuumed") else 0
        gone = self.log.removed(range(done + 1, head - keep + 1))
        for path in gone:
            self.files.remove(path)
        if head - keep > done:
            self.files.write("log/vacuumed", str(head - keep))
        if orphan_hours is not None:
            named = {p.path for v in {max(head - keep, 0), head} for kind in ("users", "cells", "batch") for p in self.log.runs(v, kind)}
            named |= {r["path"] for v in range(max(head - keep, 0) + 1, head + 1) for r in self.log.entry(v)["adds"]}
            folders = {"/".join(p.split("/")[:2]) for p in named}
            before = (time.time() - orphan_hours * 3600) * 1000
            for kind in ("users", "cells", "touched", "staged"):
                for name in self.files.names(kind):
                    if f"{kind}/{name}" not in folders and self.files.fs.getFileStatus(self.files.path(f"{kind}/{name}")).getModificationTime() <= before:
                        self.files.remove(f"{kind}/{name}")
        return len(gone)

