import json
import struct

import pytest
from pyspark.sql import functions as F

from trackweave.config import JobConfig
from trackweave.operators import density, pyramid
from trackweave.sources import tracks as ts
from trackweave.sources import vector_tiles as vt
from trackweave.sources.events import event_tracks
from trackweave.streaming import job
from trackweave.streaming.store import Store

SF = "/root/testdata/sf0.001"


def wkb(points, order="<", srid=False):
    kind = 2 | (0x20000000 if srid else 0)
    head = bytes([order == "<"]) + struct.pack(order + "I", kind) + (struct.pack(order + "I", 4326) if srid else b"")
    return head + struct.pack(order + "I", len(points)) + b"".join(struct.pack(order + "2d", *p) for p in points)


def test_wkb(spark):
    path = [(4.5, 50.5), (4.6, 50.25)]
    for data in (wkb(path), wkb(path, ">"), wkb(path, srid=True)):
        assert ts.decode_wkb(data) == ("LineString", path)
    assert ts.decode_wkb(b"\1" + struct.pack("<Idd", 1, 1, 2)) == ("Point", [])
    assert ts.decode_wkb(None) == ts.decode_wkb(b"") == ts.decode_wkb(wkb(path)[:20]) == (None, [])
    df = spark.createDataFrame([(1, "a", wkb(path)), (2, "b", None)], "contribution_id long, user_id string, wkb binary")
    rows = ts.decode_tracks(df).collect()
    assert len(rows) == 1 and [tuple(p) for p in rows[0].points] == path


@pytest.mark.parametrize(
    "rows,most,want",
    [
        ([(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "a")], 2, [0, 1, 2]),
        ([(0, "a"), (1, "b")], 2, [0, 1]),
        ([(5, "a"), (5, "b"), (5, "c"), (6, "a")], 2, [5, 5, 5]),
        ([(1, "a"), (2, "b"), (2, "c")], 2, [1]),
        ([], 2, []),
    ],
)
def test_admission(spark, rows, most, want):
    df = spark.createDataFrame(rows, "contribution_id long, user_id string")
    assert sorted(r.contribution_id for r in ts.admitted(df, most).collect()) == want


def test_windows_skip_gaps():
    assert ts.next_window(None, None, -1, 10) is None and ts.next_window(5, None, 5, 10) is None
    assert ts.next_window(100, 40, 9, 10) == (39, 49) and ts.next_window(42, 40, 9, 10) == (39, 42)


def test_vector_tiles_decode(spark, tmp_path):
    cells = spark.createDataFrame([(14, 5, 7, 3, 300), (14, 511, 511, 4, 3), (14, 512, 0, 3, 3), (14, 9, 9, 0, 1)], "z int, px long, py long, users long, trips long")
    tiles = vt.vector_tiles(cells)
    rows = {(r.x, r.y): r for r in tiles.collect()}
    got = vt.decode_tile(bytes(rows[(0, 0)].mvt))
    assert got["name"] == "heatmap" and got["extent"] == 4096
    assert got["points"] == [{"x": 40, "y": 56, "users": 3, "trips": 300}, {"x": 4088, "y": 4088, "users": 4, "trips": 3}]
    out = {(r.x, r.y): r.bytes for r in vt.write_tiles(tiles, f"file://{tmp_path}").collect()}
    assert (tmp_path / "14/0/0.mvt").read_bytes() == bytes(rows[(0, 0)].mvt) and out[(1, 0)] == len(rows[(1, 0)].mvt)
    gone = spark.createDataFrame([(14, 0, 0), (14, 7, 7)], "z int, x long, y long")
    assert {(r.x, r.removed) for r in vt.remove_tile_files(gone, f"file://{tmp_path}").collect()} == {(0, True), (7, False)}
    assert vt.features(cells).count() == 3
    most = vt.vector_tiles(cells, attributes=lambda u, t: F.when(u > 3, F.struct((u * 2).alias("twice"))), names=("twice",)).collect()
    assert [vt.decode_tile(bytes(r.mvt))["points"] for r in most] == [[{"x": 4088, "y": 4088, "twice": 8}]]
    assert json.loads(vt.tilejson())["maxzoom"] == 14


def test_incremental_job_equals_batch(spark, tmp_path):
    tracks = event_tracks(spark, SF).where("user_id < 9 and contribution_id % 3 = 0").withColumn("user_id", F.col("user_id").cast("string")).cache()
    store = Store(spark, f"file://{tmp_path}/store")
    config = JobConfig(min_users=2)
    job.apply_batch(store, tracks.where("contribution_id % 2 = 0"), "0", config)
    odd = tracks.where("contribution_id % 2 = 1")
    job.apply_batch(store, odd, "1", config)
    updated = job.apply_batch(store, odd, "1", config)  # again: it is in already
    want = {tuple(r) for r in pyramid.pyramid(density.global_cells(density.user_cells(tracks), 2)).collect()}
    assert {tuple(r) for r in store.cells().collect()} == want and want
    assert job.publish(store, updated, f"file://{tmp_path}/tiles") > 0
    store.merged = 2
    assert store.compact() > 0 and store.compact() == 0
    assert {tuple(r) for r in store.user_cells().collect()} == {tuple(r) for r in density.user_cells(tracks).collect()}


def test_polling_advances_over_gaps(spark, tmp_path):
    point = [{"lon": 4.35, "lat": 50.85}, {"lon": 4.3502, "lat": 50.85}]
    contributions = spark.createDataFrame([(0, point), (40, point), (41, None)], "ContributionId long, PointsGeom array<struct<lon:double,lat:double>>")
    links = spark.createDataFrame([(0, 1), (40, 1), (40, 2), (41, 2)], "ContributionId long, UserId int")
    users = spark.createDataFrame([(1, "u1"), (2, "u2")], "Id int, UserIdentifier string")
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.last_contribution() == -1
    config = JobConfig(min_users=1)
    taken = [job.run_once(store, ts.Relations(contributions, links, users), config) for _ in range(3)]
    assert taken == [1, 2, 0] and store.last_contribution() == 41
    assert {r.users for r in store.cells(14).collect()} == {2}


def test_stream_merges_each_batch_once(spark, tmp_path):
    point = [{"lon": 4.35, "lat": 50.85}, {"lon": 4.3502, "lat": 50.85}]
    kinds = "contribution_id long, user_id string, points array<struct<lon:double,lat:double>>"
    store, config = Store(spark, f"file://{tmp_path}/store"), JobConfig(min_users=1, refresh_ms=0)
    for i, user in enumerate("ab"):
        spark.createDataFrame([(i, user, point)], kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        tracks = spark.readStream.schema(kinds).parquet(f"{tmp_path}/in")
        query = job.start_stream(store, tracks, f"{tmp_path}/checkpoint", config)
        query.awaitTermination(180)
        assert query.exception() is None
    assert {r.users for r in store.cells(14).collect()} == {2} and {r.users for r in store.cells(0).collect()} != set()


def test_the_loop_polls_publishes_and_survives_errors(spark, tmp_path):
    from trackweave.streaming.__main__ import main

    path = wkb([(4.35, 50.85), (4.3502, 50.85)])
    spark.createDataFrame([(0, path), (40, path), (41, None)], "ContributionId long, PointsGeom binary").write.parquet(f"{tmp_path}/data/relations/contributions")
    spark.createDataFrame([(0, 1), (40, 1), (40, 2), (41, 2)], "ContributionId long, UserId int").write.parquet(f"{tmp_path}/data/relations/user_contributions")
    spark.createDataFrame([(1, "u1"), (2, "u2")], "Id int, UserIdentifier string").write.parquet(f"{tmp_path}/data/relations/users")
    assert main(["--data"], spark) == 2
    settings = ["--data", f"{tmp_path}/data", "--output", f"{tmp_path}/out", "--refresh-time", "0", "--min-users", "1", "--max-contributions", "100"]
    assert main(settings, spark) == 0
    store = Store(spark, f"file://{tmp_path}/data/store")
    assert store.last_contribution() == 41 and {r.users for r in store.cells(14).collect()} == {2}
    assert json.loads((tmp_path / "out/mvt.json").read_text())["maxzoom"] == 14
    (tile,) = (tmp_path / "out/14").glob("*/*.mvt")
    assert {p["users"] for p in vt.decode_tile(tile.read_bytes())["points"]} == {2} and (tmp_path / "out/0/0/0.mvt").exists()
    turns = iter([False, False, True])

    def broken():
        raise OSError("no relations")

    job.run(store, broken, JobConfig(refresh_ms=1), stop=lambda: next(turns))  # logged, twice
    opened = store.user_cells_of(store.touched(spark.createDataFrame([(8389, 5495)], "x long, y long"), 14)).inputFiles()
    assert opened and all("z=14/bucket=524-343/" in f for f in opened)
    store.vacuum()
    assert {r.users for r in store.cells(14).collect()} == {2}


def test_relations_in_a_database(spark, tmp_path):
    url, jvm = f"jdbc:derby:{tmp_path}/db;create=true", spark.sparkContext._jvm
    connection = jvm.java.sql.DriverManager.getConnection(url)
    path = wkb([(4.5, 50.5), (4.6, 50.25)])
    run = connection.createStatement().execute
    run('CREATE TABLE "Contributions" ("ContributionId" BIGINT, "PointsGeom" VARCHAR(1000) FOR BIT DATA)')
    run('CREATE TABLE "UserContributions" ("ContributionId" BIGINT, "UserId" INT)')
    run('CREATE TABLE "Users" ("Id" INT, "UserIdentifier" VARCHAR(40))')
    run(f'INSERT INTO "Contributions" VALUES (3, X\'{path.hex()}\'), (7, X\'{path.hex()}\'), (9, NULL)')
    run('INSERT INTO "UserContributions" VALUES (3, 1), (7, 1), (7, 2), (9, 2)')
    run("INSERT INTO \"Users\" VALUES (1, 'u1'), (2, 'u2')")
    source = ts.JdbcRelations(spark, url, {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}, 2, 'c."PointsGeom"')
    assert source.latest_and_next(-1) == (9, 3) and source.latest_and_next(9) == (None, None)
    rows = sorted((r.contribution_id, r.user_id, [tuple(p) for p in r.points]) for r in source.tracks(3, 9).collect())
    assert rows == [(7, "u1", [(4.5, 50.5), (4.6, 50.25)]), (7, "u2", [(4.5, 50.5), (4.6, 50.25)])]
