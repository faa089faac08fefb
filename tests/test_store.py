import itertools
import logging

import pytest
from pyspark.sql import functions as F

from trackweave.config import JobConfig, Raster
from trackweave.operators import density, pyramid, tilehits
from trackweave.sources import tracks as ts
from trackweave.sources import vector_tiles as vt
from trackweave.streaming import job
from trackweave.streaming.log import Conflict, Log, Run
from trackweave.streaming.store import Store, finest_common

SMALL, CONFIG = Raster(6, 64), JobConfig(min_users=1, max_contributions=1, max_users=5)
TRACKS = "contribution_id long, user_id string, points array<struct<lon:double,lat:double>>"


def track(i, user, lon, lat=40.0):
    return i, user, [{"lon": lon, "lat": lat}, {"lon": lon + 0.4, "lat": lat}]


def serial(spark, rows, raster=SMALL, users=1):
    cells = density.user_cells(spark.createDataFrame(rows, TRACKS), raster)
    return {tuple(r) for r in pyramid.pyramid(density.global_cells(cells, users), raster.zoom).collect()}


def found(store):
    return {tuple(r) for r in store.cells().collect()}


@pytest.mark.parametrize(("lon", "zoom"), [(-100.2, 6), (80.0, 4)])
def test_two_writers_at_once_equal_one_after_the_other(spark, tmp_path, caplog, lon, zoom):
    """The second writer commits after the first one has worked out everything; they meet in the same tile, or in coarse zooms only."""
    one, two = [track(1, "a", -100.2), track(2, "b", -100.1)], [track(3, "a", lon), track(4, "c", lon)]
    a, b = (Store(spark, f"file://{tmp_path}/store", 64, merged=2) for _ in range(2))
    job.apply_batch(a, spark.createDataFrame([track(0, "z", -100.2)], TRACKS), "start", CONFIG, SMALL)
    commit = a.commit_batch

    def late(*args, **more):
        a.commit_batch = commit
        touched = job.apply_batch(b, spark.createDataFrame(two, TRACKS), "two", CONFIG, SMALL)
        b.compact(touched)
        return commit(*args, **more)

    a.commit_batch = late
    with caplog.at_level(logging.INFO):
        job.apply_batch(a, spark.createDataFrame(one, TRACKS), "one", CONFIG, SMALL)
    assert f"again from zoom {zoom}" in caplog.text
    want = serial(spark, [track(0, "z", -100.2), *one, *two])
    assert found(a) == found(b) == want
    users = {tuple(r) for r in density.user_cells(spark.createDataFrame([track(0, "z", -100.2), *one, *two], TRACKS), SMALL).collect()}
    a.compact()
    assert found(a) == want and {tuple(r) for r in a.user_cells().collect()} == users
    assert job.apply_batch(b, spark.createDataFrame(one, TRACKS), "one", CONFIG, SMALL) and b.log.head() == a.log.head()


def test_a_crash_after_each_step_loses_and_doubles_nothing(spark, tmp_path):
    raster, n = Raster(1, 32), 14
    rows = [track(i, f"u{i % 3}", -100.0 + 3 * (i % 4)) for i in range(n)]
    contributions = spark.createDataFrame([(i, p) for i, _, p in rows], "ContributionId long, PointsGeom array<struct<lon:double,lat:double>>")
    links = spark.createDataFrame([(i, i % 3) for i in range(n)], "ContributionId long, UserId int")
    source = ts.Relations(contributions, links, spark.createDataFrame([(i, f"u{i}") for i in range(3)], "Id int, UserIdentifier string"))
    root, output = f"file://{tmp_path}/store", f"file://{tmp_path}/tiles"
    crashes = 0
    for step in itertools.count(1, 2):
        store, calls = Store(spark, root, 32, merged=2), itertools.count(1)

        def fails(f, calls=calls, step=step):
            def run(*args, **more):
                out = f(*args, **more)
                if next(calls) == step:
                    raise OSError(f"step {step}")
                return out

            return run

        for name in ("write_runs", "put_aside", "replaced", "compact"):
            setattr(store, name, fails(getattr(store, name)))
        store.log.commit = fails(store.log.commit)
        try:
            taken = job.run_once(store, source, CONFIG, raster, output)
        except OSError:
            crashes += 1
            continue
        if not taken or next(calls) <= step:
            break
    assert crashes > 4
    while job.run_once(Store(spark, root, 32), source, CONFIG, raster, output):
        pass
    store = Store(spark, root, 32)
    assert store.last_contribution() == n - 1 and store.pending() == []
    assert found(store) == serial(spark, rows, raster)
    assert {tuple(r) for r in store.user_cells().collect()} == {tuple(r) for r in density.user_cells(spark.createDataFrame(rows, TRACKS), raster).collect()}
    tiles = {(r.z, r.x, r.y): bytes(r.mvt) for r in vt.vector_tiles(store.cells(), 32).collect()}
    written = {tuple(int(v) for v in (p.parts[-3], p.parts[-2], p.stem)): p.read_bytes() for p in (tmp_path / "tiles").glob("*/*/*.mvt")}
    assert written == tiles
    folders = lambda: {p.name for kind in ("users", "cells", "touched", "staged") for p in (tmp_path / "store" / kind).glob("c=*")}
    before = len(folders())
    assert store.vacuum(keep=1, orphan_hours=0) > 0 and len(folders()) < before
    assert found(store) == serial(spark, rows, raster) and store.user_cells().count() == density.user_cells(spark.createDataFrame(rows, TRACKS), raster).count()


def test_a_window_goes_to_one_of_two_pollers(spark, tmp_path):
    a, b = (Store(spark, f"file://{tmp_path}/store", 64) for _ in range(2))
    a.put_last_contribution(5)
    with pytest.raises(Conflict):
        job.apply_batch(b, spark.createDataFrame([track(1, "a", 0.0)], TRACKS), "poll-0", CONFIG, SMALL, window=(-1, 1))
    assert b.cells().count() == 0 and b.last_contribution() == 5


def test_a_thousand_batches_and_compactions(spark, tmp_path):
    """Entries of 1,000 batches over 40 buckets: a key's runs are found without reading the log from its start."""
    log = Log(spark, f"file://{tmp_path}", every=250)
    live: dict[str, list[Run]] = {}
    for i in range(1000):
        key = f"14/{i % 40}-0"
        run = Run("users", key, f"users/c={i}/z=14/bucket={i % 40}-0", 10)
        gone = live.get(key, []) if len(live.get(key, [])) >= 4 else []
        live[key] = [run] if gone else [*live.get(key, []), run]
        log.commit("compact" if gone else "batch", log.head(), [run, Run("batch", f"b{i}", f"touched/c={i}")], [r.path for r in gone], batch=f"b{i}", buckets=[[i % 40, 0]], last=i)
    again = Log(spark, f"file://{tmp_path}", every=250)
    assert again.head() == 1000 and again.entry(1000)["LastContributionId"] == 999
    for key in ("14/3-0", "14/39-0"):
        assert sorted(r.path for r in again.runs(1000, "users", {key})) == sorted(r.path for r in live[key])
    assert len(again.runs(1000, "users")) == sum(map(len, live.values())) and len(again.runs(1000, "batch", {"b17"})) == 1
    assert len(again._entries) <= 250
    old = again.runs(300, "users", {"14/3-0"})
    assert old and max(int(r.path.split("=")[1].split("/")[0]) for r in old) < 300


def test_only_the_runs_of_touched_buckets_are_opened(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", 64, merged=3)
    rows = [track(i, f"u{i}", -170.0 + 85 * (i % 4)) for i in range(12)]
    t = spark.createDataFrame(rows, TRACKS)
    touched = store.touched(density.user_cells(t, SMALL).select((F.col("px") / 64).cast("long").alias("x"), (F.col("py") / 64).cast("long").alias("y")).distinct(), 6)
    for i in range(3):
        cells = density.user_cells(t.where(F.col("contribution_id") % 3 == i), SMALL).withColumn("z", F.lit(6))
        store.log.commit("batch", store.log.head(), store.write_runs("users", cells), batch=str(i), buckets=[])
    here = store.touched(touched.base.where("x < 16"), 6)
    opened = store.view().user_cells_of(here).inputFiles()
    assert (len(here.buckets), len(touched.buckets), len(opened), len(store.view().user_cells().inputFiles())) == (1, 3, 3, 9)
    assert all(f"bucket={x}-{y}/" in f for f in opened for x, y in here.buckets)
    view, want = store.view(), {tuple(r) for r in density.user_cells(t, SMALL).collect()}
    assert store.compact(here) == 3 and store.compact() == 6 and store.compact() == 0
    assert len(store.view().user_cells().inputFiles()) == 3 and {tuple(r) for r in store.user_cells().collect()} == want
    assert {tuple(r) for r in view.user_cells().collect()} == want  # an older version reads what it read


def test_finest_common():
    assert finest_common([(5, 9)], [(5, 9), (1, 1)], 14) == 14 and finest_common([(4, 8)], [(5, 9)], 14) == 13
    assert finest_common([(0, 0)], [(1 << 9, 0)], 14) == 4 and finest_common([], [(1, 1)], 14) is None


def test_a_batch_is_stored_as_lines_and_not_as_their_pixels(spark, tmp_path):
    """Files of user cells, and what is exchanged to count and to merge them, grew with the pixels of lines: 12 bytes for each, six times over."""
    store, root = Store(spark, f"file://{tmp_path}/store", 64, merged=2), f"file://{tmp_path}/store"
    rows = [(i, f"u{i % 4}", [{"lon": -100.0 + 9 * (i % 5), "lat": 40.0}, {"lon": 20.0 - i, "lat": -30.0 + i}]) for i in range(12)]
    t, config = spark.createDataFrame(rows, TRACKS), JobConfig(min_users=2)
    size = lambda df: df.agg(sum(F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0)) for c in ("at", "hits", "lines") if c in df.columns)).first()[0]
    cells = lambda df: {tuple(r) for r in df.collect()}
    for k in range(3):
        touched = job.apply_batch(store, t.where(F.col("contribution_id") % 3 == k), f"part-{k}", config, SMALL)
        kept = store.view()._rows("users", store.view().user_runs())
        drawn = density.user_cells(t.where(F.col("contribution_id") % 3 <= k), SMALL)
        assert size(kept) < 2 * drawn.count() / 4 and cells(store.user_cells()) == cells(drawn)
        store.compact(touched)
        assert cells(store.user_cells()) == cells(drawn)
    assert found(store) == serial(spark, rows, users=2)
    # Runs of a store whose rows hold no lines are read as they are.
    old = density.user_hits(t, SMALL).withColumn("z", F.lit(6)).withColumn("bucket", store.bucket())
    old.write.partitionBy("z", "bucket").parquet(f"{root}/users/c=old")
    keys = [r.bucket for r in old.select("bucket").distinct().collect()]
    rows = store.view()._rows("users", [Run("users", f"6/{k}", f"users/c=old/z=6/bucket={k}") for k in keys])
    assert cells(tilehits.counted(rows, 64, 10)) == cells(density.global_cells(density.user_cells(t, SMALL)))
