import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import line, project
from trackweave.config import JobConfig, Raster, Semantics
from trackweave.functions import codec
from trackweave.functions import tilemath as tm
from trackweave.operators import cells as ct
from trackweave.operators import density, pyramid, raster

TRACK = "contribution_id long, user_id string, points array<struct<lon:double,lat:double>>"


def centre(spark, pixels):
    """Places of the centres of zoom-14 pixels."""
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pixels)], "i int, px long, py long")
    t = tm.tile_of_pixel(F.col("px"), F.col("py"), 512)
    p = tm.place_of(t["x"], t["y"], 14, t["cx"] + 0.5, t["cy"] + 0.5, 512)
    return [(r.lon, r.lat) for r in df.select("i", p.alias("p")).orderBy("i").select("p.*").collect()]


def test_lines_equal_the_walk_and_keep_their_direction(spark):
    random.seed(3)
    ends = [(0, 0, 3, 1), (0, 0, 4, 2), (4, 2, 0, 0), (0, 0, 1, 3), (5, 5, 5, 5)] + [tuple(random.randrange(60) for _ in range(4)) for _ in range(300)]
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "i int, x0 long, y0 long, x1 long, y1 long")
    got = {}
    for r in raster.draw(df, keys=("i",)).collect():
        got.setdefault(r.i, []).append((r.px, r.py))
    for i, e in enumerate(ends):
        assert sorted(got[i]) == sorted(line(*e)), e
    assert sorted(got[1]) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)] and sorted(got[2]) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]


def test_negative_pixels_are_dropped(spark):
    df = spark.createDataFrame([(0, 0, -2, -2)], "x0 long, y0 long, x1 long, y1 long")
    assert [(r.px, r.py) for r in raster.draw(df, keys=()).collect()] == [(0, 0)]


@pytest.mark.parametrize(
    "lon,lat,z,r,tile,local",
    [(4.35, 50.85, 14, 512, (8389, 5495), (498, 422)), (-73.98, 40.75, 14, 512, (4825, 6157), (45, 427)), (151.2, -33.86, 14, 512, (15073, 9831), (143, 219)), (4.35, 50.85, 12, 1024, (2097, 1373), (505, 979)), (4.35, 50.85, 0, 512, (0, 0), (262, 102))],
)
def test_projection(spark, lon, lat, z, r, tile, local):
    p = spark.range(1).select(tm.pixel_of(F.lit(lon), F.lit(lat), z, r).alias("p")).first().p
    assert (p.px // r, p.py // r) == tile and (p.px % r, p.py % r) == local
    assert project(lon, lat, z, r) == (*tile, *local)


def test_places_outside_of_the_world_are_null(spark):
    df = spark.createDataFrame([(180.0, 0.0), (-180.0, 0.0), (0.0, 86.0), (0.0, -86.0), (None, 1.0), (float("nan"), 1.0)], "lon double, lat double")
    got = [r.p for r in df.select(tm.pixel_of(F.col("lon"), F.col("lat"), 14, 512).alias("p")).collect()]
    assert [x is not None for x in got] == [False, True, False, False, False, False]


def test_segments_and_hits(spark):
    pts = centre(spark, [(4295168, 2815488), (4295170, 2815488), (4295170, 2815490)])
    rows = [(1, "a", pts), (2, "b", pts[:1]), (3, "c", []), (4, "d", None)]
    tracks = spark.createDataFrame([(i, u, p and [{"lon": x, "lat": y} for x, y in p] if p else p) for i, u, p in rows], TRACK)
    cells = {(r.px - 4295168, r.py - 2815488): r.hits for r in density.user_cells(tracks).collect()}
    assert cells == {(0, 0): 1, (1, 0): 1, (2, 0): 2, (2, 1): 1, (2, 2): 1}
    other = tracks.withColumn("geom_type", F.lit("Point"))
    assert raster.segments(other).count() == 0


def test_rejected_tiles_are_bridged_or_split(spark):
    pts = centre(spark, [(4295168, 2815488), (4295168 + 512, 2815488), (4295172, 2815488)])
    tracks = spark.createDataFrame([(1, "a", [{"lon": x, "lat": y} for x, y in pts])], TRACK)
    first = 4295168 // 512
    ok = lambda i: F.pmod(i, F.lit(16384)) == first
    assert [(r.x0, r.x1) for r in raster.segments(tracks, include=ok).collect()] == [(4295168, 4295172)]
    assert raster.segments(tracks, include=ok, on_invalid="split").count() == 0
    with pytest.raises(ValueError):
        raster.segments(tracks, on_invalid="other")


def test_merging_batches(spark):
    diffs = spark.createDataFrame([(1, 0, 0, 3), (2, 0, 0, 4), (3, 0, 0, 5), (2, 1, 1, 0)], "batch int, px long, py long, value long")
    assert [tuple(r) for r in density.batches_merged(diffs).collect()] == [(0, 0, 12)]
    assert [tuple(r) for r in density.batches_merged(diffs, Semantics("compat")).collect()] == [(0, 0, 25)]
    old = spark.createDataFrame([(0, 0, 4294967290)], "px long, py long, value long")
    new = spark.createDataFrame([(0, 0, 10)], "px long, py long, value long")
    assert density.merged(old, new).first().value == 4294967300
    assert density.merged(old, new, Semantics("compat")).first().value == (4294967290 + 4294967295) % 2**32


def test_threshold_and_pyramid(spark):
    rows = [("a", 0, 0, 1), ("b", 0, 0, 2), ("a", 1, 0, 1), ("b", 1, 0, 1), ("c", 1, 0, 3)]
    cells = spark.createDataFrame(rows, "user_id string, px long, py long, hits long")
    assert [tuple(r) for r in density.global_cells(cells, 3).collect()] == [(1, 0, 3, 5)]
    base = spark.createDataFrame([(0, 0, 3, 4), (1, 0, 3, 5), (0, 1, 4, 4)], "px long, py long, users long, trips long")
    got = {(r.z, r.px, r.py): (r.users, r.trips) for r in pyramid.pyramid(base).collect()}
    assert got[(13, 0, 0)] == got[(0, 0, 0)] == got[(7, 0, 0)] == (10, 13) and len(got) == 17
    carry = spark.createDataFrame([(0, 0, 3, 4294967295), (1, 0, 3, 1)], "px long, py long, users long, trips long")
    assert tuple(pyramid.rebuilt(carry).first())[2:] == (6, 4294967296)
    assert tuple(pyramid.rebuilt(carry, Semantics("compat")).first())[2:] == (7, 0)
    deep = {(r.z, r.px, r.py): r.value for r in pyramid.diff_pyramid(base.select("px", "py", F.lit(4294967290).alias("value")), 2).collect()}
    assert deep[(1, 0, 0)] == 4294967295


def test_tile_relations(spark):
    one = spark.range(1)
    got = one.select(tm.parent(F.lit(5), 4, 3).alias("x"), tm.parent(F.lit(9), 4, 3).alias("y"), tm.child_range(5, 9, 4, 5).alias("r"), tm.children(5, 9).alias("c"), tm.max_tile_id(3).alias("m")).first()
    assert (got.x, got.y) == (2, 4) and tuple(got.r) == (10, 18, 12, 20) and got.m == 72
    assert [tuple(c) for c in got.c] == [(10, 18), (11, 18), (10, 19), (11, 19)]
    ring = one.select(tm.tile_polygon(0, 0, 1).alias("p")).first().p
    assert len(ring) == 5 and ring[0] == ring[4] and ring[0].lon == -189.0
    empty = one.select(F.size(tm.tiles_for_box(F.lit(10.0), F.lit(1.0), F.lit(-10.0), F.lit(0.0), 8)).alias("n")).first()
    assert empty.n == 0


@pytest.mark.parametrize("users,trips,value", [(0, 0, 0), (0, 100, 100), (100, 0, 429496729600)])
def test_packed_pairs(spark, users, trips, value):
    row = spark.range(1).select(codec.packed(F.lit(users), F.lit(trips)).alias("v"), codec.unpacked(F.lit(value)).alias("u")).first()
    assert row.v == value and tuple(row.u) == (users, trips)


def test_codecs(spark):
    values = [0, 1, -1, 2, -2, 300, 2**40, -(2**40)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    coded = codec.sign_magnitude(F.col("v"))
    rows = df.select("v", coded.alias("s"), codec.from_sign_magnitude(coded).alias("b"), codec.signed_varint(F.col("v")).alias("bytes"), codec.unvarint(codec.signed_varint(F.col("v"))).alias("u")).collect()
    assert [r.s for r in rows[:5]] == [0, 2, 3, 4, 5] and all(r.b == r.v and r.u == r.s for r in rows)
    assert all(bytes(r.bytes) == codec.write_varint(r.s) and codec.read_varint(bytes(r.bytes))[0] == r.s for r in rows)
    null = spark.createDataFrame([(None,), (0,)], "v long").select(codec.varint_nullable(F.col("v")).alias("x"), codec.unvarint_nullable(codec.varint_nullable(F.col("v"))).alias("y")).collect()
    assert [bytes(r.x) for r in null] == [b"\0", b"\1"] and [r.y for r in null] == [None, 0]
    assert [codec.write_varint(v).hex() for v in (0, 127, 128, 300)] == ["00", "7f", "8001", "ac02"]
    assert codec.unfixed(codec.fixed(-5, "i8"), "i8") == -5
    with pytest.raises(EOFError):
        codec.read_varint(b"\x80")


def test_cell_tables(spark):
    kinds = "z int, px long, py long, value long"
    source = spark.createDataFrame([(14, 0, 0, 5), (14, 600, 0, 7), (14, 1, 1, 3)], kinds)
    target = spark.createDataFrame([(14, 0, 0, 1), (14, 2, 2, 9)], kinds)
    tiles = spark.createDataFrame([(14, 0, 0), (14, 9, 9)], "z int, x long, y long")
    as_set = lambda df: {(r.px, r.py, r.value) for r in df.collect()}
    assert as_set(ct.copy_tiles(source, target, tiles)) == {(0, 0, 5), (1, 1, 3), (2, 2, 9)}
    assert as_set(ct.copy_tiles(source, target, tiles, lambda t, p, v: v - 5)) == {(0, 0, 1), (2, 2, 9)}
    assert as_set(ct.add_tiles(source, target, tiles)) == {(0, 0, 6), (1, 1, 3), (2, 2, 9)}
    assert as_set(ct.fold_tiles(source, target, tiles, lambda t, p, a, b: a * 10 + b)) == {(0, 0, 15), (1, 1, 3), (2, 2, 9)}
    assert as_set(ct.update_values(source, lambda p, v: v - 3)) == {(0, 0, 2), (600, 0, 4)}
    assert as_set(ct.remove_where(source, lambda t: t["x"] == 0)) == {(600, 0, 7)}
    assert as_set(ct.replaced(target, source, tiles)) == {(0, 0, 5), (1, 1, 3)}
    assert {(r.x, r.y) for r in ct.list_tiles(source).collect()} == {(0, 0), (1, 0)}
    points = spark.createDataFrame([(14, 0, 0), (14, 5, 5)], "z int, px long, py long")
    assert as_set(ct.lookup(source, points)) == {(0, 0, 5), (5, 5, 0)}


def test_settings(tmp_path):
    with pytest.raises(ValueError):
        Raster(resolution=511)
    with pytest.raises(ValueError):
        Semantics("other")
    got = JobConfig.load({"MIN_USERS": "5", "refresh-time": "0"}, {"TRACKWEAVE_MAX_USERS": "9"})
    assert (got.min_users, got.refresh_ms, got.max_users, got.max_contributions) == (5, 0, 9, 10)
    (tmp_path / "db").write_text("host=x\n")
    assert JobConfig(db=str(tmp_path / "db")).connection_string() == "host=x"


def test_pieces_draw_what_segments_do(spark):
    rng = random.Random(5)
    ends = [(0, 0, 0, 0), (5, 7, 5, 40), (40, 7, 5, 7), (15, 15, 16, 16), (16, 16, 15, 15), (-9, 3, 20, -4), (0, 31, 31, 0), (3, 0, 200, 1), (1, 200, 0, 3)]
    ends += [tuple(rng.randrange(-20, 90) for _ in range(4)) for _ in range(300)]
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "i int, x0 long, y0 long, x1 long, y1 long")
    for size in (2, 16, 48):
        cut = raster.pieces(df, ("i",), size, 3)
        assert cut.where(F.col("i1") - F.col("i0") >= size).count() == 0 and cut.rdd.getNumPartitions() == 3
        tiled = raster.draw(cut, ("i", "tx", "ty"))
        assert tiled.where((F.col("px") < F.col("tx") * size) | (F.col("px") >= (F.col("tx") + 1) * size) | (F.col("py") < F.col("ty") * size) | (F.col("py") >= (F.col("ty") + 1) * size)).count() == 0
        assert sorted(map(tuple, tiled.select("i", "px", "py").collect())) == sorted(map(tuple, raster.draw(df, ("i",)).collect()))


def test_pixels_are_summed_without_another_exchange(spark):
    df = spark.createDataFrame([(1, 0, 0, 9, 9)], "user_id int, x0 long, y0 long, x1 long, y1 long")
    plan = raster.pixel_hits(df, ("user_id",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_compat_pyramid_equals_level_by_level(spark):
    rows = [(x, y, 3_000_000_000 + x, 4_294_967_295 - y) for x in range(13) for y in range(9)]
    base = spark.createDataFrame(rows, "px long, py long, users long, trips long")
    level, want = base, {(9, *r) for r in rows}
    for z in range(8, -1, -1):
        level = spark.createDataFrame(pyramid.rebuilt(level, Semantics("compat")).collect(), base.schema)
        want |= {(z, *r) for r in level.collect()}
    assert {tuple(r) for r in pyramid.pyramid(base, 9, semantics=Semantics("compat")).collect()} == want
    held = {(r.z, r.px, r.py): r.value for r in pyramid.diff_pyramid(base.select("px", "py", F.col("trips").alias("value")), 9).collect()}
    assert held[0, 0, 0] == 4_294_967_295 and held[9, 0, 8] == 4_294_967_287 and len(held) == len(want)
    plan = pyramid.diff_pyramid(base.select("px", "py", F.col("trips").alias("value")), 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") - plan.count("ReusedExchange") <= 3 and "CartesianProduct" not in plan


def test_a_user_with_half_of_all_traces_is_split(spark):
    tracks = [(i, "courier" if i % 2 else f"u{i}", [{"lon": 4.35 + i % 7 * 1e-5, "lat": 50.85}, {"lon": 4.352, "lat": 50.85 + i % 5 * 1e-5}]) for i in range(400)]
    df = spark.createDataFrame(tracks, "contribution_id long, user_id string, points array<struct<lon:double,lat:double>>")
    told = density.told_apart(df, 8)
    assert told.where("salts > 1").select("user_id").distinct().collect() == [("courier",)] and told.count() == 400
    loads = [r["count"] for r in told.repartition(8, "user_id", "salt").groupBy(F.spark_partition_id()).count().collect()]
    assert max(loads) < 2 * 400 / 8
    want = {tuple(r) for r in density.user_cells(df).collect()}
    assert {tuple(r) for r in density.user_cells(df, split_users=True).collect()} == want and want
