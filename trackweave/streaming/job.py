"""The incremental job: polled id windows, or a stream of tracks, merged into the store tile by tile and published."""

from __future__ import annotations

import itertools
import logging
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackweave.config import JobConfig, Raster
from trackweave.functions.tilemath import quotient
from trackweave.operators.density import user_lines
from trackweave.operators.pyramid import rebuilt_above
from trackweave.sources.tracks import Relations, admitted, next_window
from trackweave.sources.vector_tiles import remove_tile_files, vector_tiles, write_tilejson, write_tiles
from trackweave.streaming.log import Conflict
from trackweave.streaming.store import Store, Touched

log = logging.getLogger(__name__)


def apply_batch(
    store: Store,
    tracks: DataFrame,
    batch: str,
    config: JobConfig = JobConfig(),
    raster: Raster = Raster(),
    publish: bool = False,
    window: tuple[int, int] | None = None,
    partitions: int | None = None,
) -> Touched:
    """Merges tracks (contribution_id, user_id, points) into the store and returns the base tiles that they touch.

    Only base tiles that the batch touches and their ancestors are worked out anew, from their buckets. User cells, cells and, if
    window is given (the last contribution id before and after), the state show at once, in one commit. A batch that is in
    already is left as it is. Where other writers came first, the zooms at which they met are worked out again; raises Conflict
    if they moved the last contribution id. publish: the batch counts as pending until it is published. partitions: in which tracks are
    drawn, those of shuffles if not given.
    """
    if found := store.batch(batch, raster.zoom):
        return found
    zoom, work = raster.zoom, uuid.uuid4().hex
    tracks = tracks.dropDuplicates(["contribution_id", "user_id"]).withColumn("user_id", F.col("user_id").cast("string"))
    users = store.write_runs("users", user_lines(tracks, raster, partitions).withColumn("z", F.lit(zoom)))
    base = store.view()._rows("users", users).select("x", "y").distinct()
    touched = store.touched(store.put_aside(base, f"touched/c={work}"), zoom)
    more = {"publish": publish} if window is None else {"publish": publish, "expects": window[0], "last": window[1]}
    fresh, runs, finest = None, {}, zoom
    view = store.view()
    for attempt in itertools.count():
        if finest == zoom:
            base = view.counted(touched, users).where(F.col("users") >= config.min_users).select(F.lit(zoom).alias("z"), "px", "py", "users", "trips")
            fresh = store.put_aside(base, f"staged/c={work}/a={attempt}/base")
        fresh = fresh.where(F.col("z") >= finest)
        coarse = store.put_aside(rebuilt_above(fresh.where(F.col("z") == finest), view.beside(touched, finest), finest), f"staged/c={work}/a={attempt}/coarse")
        fresh = fresh.unionByName(coarse)
        redone = touched.all_keys(finest)
        runs = {k: r for k, r in runs.items() if k not in redone} | {r.key: r for r in store.replaced(view, touched, fresh.where(F.col("z") <= finest), finest)}
        try:
            store.commit_batch(batch, view.version, touched, f"touched/c={work}", users, list(runs.values()), view.cell_runs(touched.all_keys(zoom)), **more)
            break
        except Conflict as conflict:
            if conflict.zoom is None:
                if found := store.batch(batch, zoom):
                    return found
                raise
            # Cells of finer zooms hold, and so do the fresh ones of this one; what others put beside them is new.
            finest, view = conflict.zoom, store.view(conflict.version)
            log.info("batch %s: another writer came first, again from zoom %d", batch, finest)
    store.files.remove(f"staged/c={work}")
    return touched


def publish(store: Store, touched: Touched, folder: str) -> int:
    """Writes the vector tiles of the touched tiles and their ancestors and their descriptor, and deletes those that are empty now; returns how many were written.
    Zooms at which another writer's commit came meanwhile are published once more, since its tiles may have been written over."""
    r, finest, written = store.resolution, touched.zoom, 0
    while finest is not None:
        view = store.view()
        cells = view.cells_of(touched, finest)
        written += write_tiles(vector_tiles(cells, r), folder).count()
        full = cells.select("z", quotient(F.col("px"), r).alias("x"), quotient(F.col("py"), r).alias("y")).distinct()
        remove_tile_files(touched.all().where(F.col("z") <= finest).join(full, ["z", "x", "y"], "left_anti"), folder).count()
        finest = store.overtaken(touched, view.version)
    write_tilejson(folder, touched.zoom)
    return written


def publish_pending(store: Store, folder: str) -> int:
    """Publishes what is committed and not yet published, also by a writer that has failed; returns the tiles written."""
    tiles = 0
    for version in store.pending():
        tiles += publish(store, store.touched_by(version), folder)
        store.log.commit("published", store.log.head(), published=[version])
    return tiles


def merge(store: Store, tracks: DataFrame, batch: str, config: JobConfig, raster: Raster, output: str | None, window: tuple[int, int] | None = None) -> None:
    """apply_batch, then publish if there is a folder to publish to, then compact."""
    began = time.monotonic()
    touched = apply_batch(store, tracks, batch, config, raster, bool(output), window)
    tiles = publish_pending(store, output) if output else 0
    merged = store.compact(touched)
    log.info("batch %s: %d tiles written, %d runs merged in %.1f s", batch, tiles, merged, time.monotonic() - began)


def run_once(store: Store, source: Relations, config: JobConfig = JobConfig(), raster: Raster = Raster(), output: str | None = None) -> int:
    """One polled batch; returns the rows that it took. The state advances with the commit of the batch's cells, to the end
    of the window even if nothing usable lies in it. Tiles that an earlier batch left unpublished are published first. Raises
    Conflict if another writer took the window."""
    if output:
        publish_pending(store, output)
    last = store.last_contribution()
    window = next_window(*source.latest_and_next(last), last, config.max_contributions)
    if window is None:
        log.debug("nothing after %d", last)
        return 0
    aside = f"window/c={uuid.uuid4().hex}"
    rows = store.put_aside(source.tracks(*window), aside)
    taken = admitted(rows, config.max_users)
    stats = taken.agg(F.count(F.lit(1)).alias("n"), F.max("contribution_id").alias("last")).first()
    cut = stats["n"] < rows.count()
    log.info("window (%d, %d]: %d rows%s", *window, stats["n"], ", cut at the most users" if cut else "")
    end = stats["last"] if cut and stats["n"] else window[1]
    if stats["n"]:
        merge(store, taken, f"poll-{window[0] + 1}", config, raster, output, (last, end))
    else:
        store.put_last_contribution(end, expects=last)
    store.files.remove(aside)
    return stats["n"]


def run(
    store: Store,
    read: Callable[[], Relations],
    config: JobConfig = JobConfig(),
    raster: Raster = Raster(),
    stop: Callable[[], bool] = lambda: False,
    output: str | None = None,
) -> None:
    """Polls read() until stop(): at once again after a batch with rows, else after refresh_ms; 0 runs once.

    An error is logged and ends that batch only.
    """
    while not stop():
        n = 0
        try:
            n = run_once(store, read(), config, raster, output)
        except Exception:
            log.exception("a batch failed and will be tried again")
        if config.refresh_ms == 0:
            return
        if not n:
            time.sleep(config.refresh_ms / 1000)


def start_stream(
    store: Store, tracks: DataFrame, checkpoint: str, config: JobConfig = JobConfig(), raster: Raster = Raster(), output: str | None = None, name: str = "stream"
) -> StreamingQuery:
    """A streaming query over tracks (contribution_id, user_id, points) that merges and publishes each micro-batch. Replayed batches
    are left as they are; name tells the batches of several streams apart."""
    writer = tracks.writeStream.foreachBatch(lambda df, i: merge(store, df, f"{name}-{i}", config, raster, output)).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if config.refresh_ms == 0 else {"processingTime": f"{config.refresh_ms} milliseconds"}
    return writer.trigger(**trigger).start()
