import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import line
from trackweave.operators import density, raster, tilehits
from trackweave.plans import oracle, queries
from trackweave.streaming.store import Store

R = 16


def lines(n, seed=3, far=60):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), *(rng.randrange(-5, far) for _ in range(4))) for _ in range(n)]


def test_pixels_need_no_hash_table_and_equal_the_lines(spark):
    """Memory of a task follows a chunk of pixels, not those that its share of the table draws."""
    df = spark.createDataFrame(lines(400), "user_id string, x0 long, y0 long, x1 long, y1 long")
    got = raster.pixel_hits(df, ("user_id",), R, max_length=50, weight=3)
    want = raster.draw(df, ("user_id",), 50).groupBy("user_id", "px", "py").agg((F.count(F.lit(1)) * 3).alias("hits"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk", [1, 7, 100, 10**6])
def test_rows_of_a_key_may_lie_in_several_chunks(monkeypatch, chunk):
    monkeypatch.setattr(tilehits, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = sorted((rng.randrange(4), rng.randrange(2), sorted(rng.sample(range(R * R), rng.randrange(1, 9)))) for _ in range(60))
    table = pa.table({"k": [r[0] for r in rows], "x": [r[1] for r in rows], "at": pa.array([r[2] for r in rows], pa.list_(pa.int32())), "hits": pa.array([[2] * len(r[2]) for r in rows], pa.list_(pa.int64()))})
    out = tilehits.summed(iter(table.to_batches(13)), ["k", "x"], R, lambda b: b.column("at").value_lengths().to_numpy(), lambda b, g: tilehits.hits_of(b, g, R), 1)
    got = [r for b in out for r in b.to_pylist()]
    want = Counter((k, x, v) for k, x, at in rows for v in at)
    assert len({(r["k"], r["x"]) for r in got}) == len(got) and all(r["at"] == sorted(r["at"]) and r["n"] == len(r["at"]) for r in got)
    assert {(r["k"], r["x"], v): h for r in got for v, h in zip(r["at"], r["hits"])} == {k: 2 * n for k, n in want.items()}


def tracks(spark):
    rng = random.Random(8)
    rows = [(i, f"u{i % 5}", [{"lon": 4.35 + rng.random() / 20, "lat": 50.85 + rng.random() / 20} for _ in range(3)]) for i in range(30)]
    return spark.createDataFrame(rows, "contribution_id long, user_id string, points array<struct<lon:double,lat:double>>")


def test_users_are_counted_where_they_are_drawn(spark):
    t = tracks(spark)
    rows = lambda df: {tuple(r) for r in df.collect()}
    cells = density.user_cells(t)
    got = density.track_cells(t, 2)
    assert rows(got) == rows(density.global_cells(cells, 2)) and got.count()
    tiles = density.tiles_of(t)
    assert rows(tiles) == rows(density.tile_users(cells).select("x", "y").distinct())
    one = tiles.orderBy("x", "y").limit(1)
    x, y = one.first()
    assert rows(density.track_cells(t, 1, tiles=one)) == {r for r in rows(density.global_cells(cells)) if (r[0] // 512, r[1] // 512) == (x, y)}


def test_a_run_has_a_row_for_each_user_and_tile(spark, tmp_path):
    store, hits = Store(spark, f"file://{tmp_path}/store"), density.user_hits(tracks(spark))
    runs = store.write_runs("users", hits.withColumn("z", F.lit(14)))
    rows = store.view()._rows("users", runs)
    assert rows.count() == hits.count() and sum(r.rows for r in runs) == density.user_cells(tracks(spark)).count()
    twice = tilehits.counted(rows.union(rows), 512, 10)
    want = density.global_cells(density.user_cells(tracks(spark))).withColumn("trips", F.col("trips") * 2)
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in want.collect()}


def test_tasks_that_sort_and_draw_follow_the_number_of_events(spark, monkeypatch):
    """With a fixed number of tasks, what one of them sorts grew with the table."""
    folder = "/root/testdata/sf0.001"
    n = -(-spark.read.parquet(f"{folder}/events.parquet").count() // 90)
    want = sorted(map(tuple, queries.global_cells(spark, folder).collect()))
    monkeypatch.setattr(tilehits, "POINTS", 90, raising=False)
    got = queries.global_cells(spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    stated = [(re.findall(r"(\w+)#", keys), int(k)) for keys, k in re.findall(r"hashpartitioning\(([^)]*), (\d+)\), REPARTITION_BY_NUM", plan)]
    assert n > 4 and (["user_id", "tx", "ty"], n) in stated and (["contribution_id", "user_id"], n) in stated
    assert "HashAggregate" not in plan[plan.index("MapInArrow") :].replace("ObjectHashAggregate", "")  # no table of a task's pixels beside its sort
    assert sorted(map(tuple, got.collect())) == want and want


SHARED = ("global_cells_k3", "top_cells", "vector_features", "vector_features_all", "vector_tile_points", "vector_tiles_mvt", "pyramid_cells", "pyramid_compat")


@pytest.mark.parametrize("name", SHARED)
def test_tasks_that_sum_pixels_and_levels_follow_the_number_of_events(spark, monkeypatch, name):
    """With a fixed number of tasks, hash tables of pixels and of the pyramid grew with the table wherever tracks cover more ground."""
    folder = "/root/testdata/sf0.001"
    n = -(-spark.read.parquet(f"{folder}/events.parquet").count() // 90)
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(queries.QUERIES[name](spark, folder))
    monkeypatch.setattr(tilehits, "POINTS", 90)
    got = queries.QUERIES[name](spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    stated = [re.findall(r"(\w+)#", keys) for keys, k in re.findall(r"hashpartitioning\(([^)]*), (\d+)\), REPARTITION_BY_NUM", plan) if int(k) == n]
    asked = [["px", "py"]] + [["ax", "ay"]] * ("pyramid" in name or "vector" in name) + [["z", "x", "y"]] * ("tile" in name)
    assert n > 4 and "REPARTITION_BY_COL" not in plan and all(keys in stated for keys in asked)
    assert rows(got) == want and want


@pytest.mark.parametrize("name", ("vector_features_all", "vector_tile_points", "pyramid_cells"))
def test_tasks_that_sum_the_upper_levels_follow_the_number_of_events(spark, monkeypatch, name):
    """With as many tasks as shuffles have, ancestors of cells that lie far from each other met in hash tables that grew with the table."""
    folder = "/root/testdata/sf0.001"
    n = -(-spark.read.parquet(f"{folder}/events.parquet").count() // 90)
    monkeypatch.setattr(tilehits, "POINTS", 90)
    plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    keys = {tuple(re.findall(r"([a-z]+)#", k)): (int(tasks), how) for k, tasks, how in re.findall(r"hashpartitioning\(([^)]*), (\d+)\), (\w+)", plan)}
    assert n > 4 and keys["d", "px", "py"] == (2 * n, "REPARTITION_BY_NUM") and "ENSURE_REQUIREMENTS" not in {how for _, how in keys.values()}


def test_features_of_three_zooms_sum_no_levels_above_them(spark):
    """All fifteen levels were summed and twelve thrown away, in hash tables of the base and of its ancestors."""
    plans = {k: queries.QUERIES[k](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for k in ("vector_features", "vector_features_all")}
    above = {k: len(re.findall(r"hashpartitioning\(d#", plan)) for k, plan in plans.items()}
    assert above["vector_features_all"] and not above["vector_features"]


@pytest.mark.parametrize("name", ("vector_features", "pyramid_compat"))
def test_shallow_pyramids_are_summed_in_one_pass(spark, name):
    """A middle level for one or two levels above it took two more hash tables in the same task."""
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "Union" not in got._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.001/events.parquet'")
    want = con.execute(oracle.ORACLE[name]).fetchdf()[got.columns]
    assert sorted(map(tuple, got.toPandas().values.tolist())) == sorted(map(tuple, want.values.tolist()))


@pytest.mark.parametrize("chunk", [1, 40, 700, 10**6])
def test_lines_of_a_key_stay_lines_up_to_the_pixels_of_a_tile(monkeypatch, chunk):
    """However rows lie in chunks, folding them changes no pixel, leaves one row for each key and never more lines than the tile has pixels."""
    monkeypatch.setattr(tilehits, "CHUNK", chunk)
    rng, rows, want = random.Random(chunk), [], Counter()
    for k, n in (("a", 2), ("b", 60), ("c", 5), ("d", 0), ("e", 9)):
        for _ in range(4):
            at, ends = sorted(rng.sample(range(R * R), rng.randrange(4))), [[rng.randrange(R) for _ in range(4)] for _ in range(n)]
            walked = [line(*e) for e in ends]
            rows.append((k, 3, at, [2] * len(at), [v for e, w in zip(ends, walked) for v in (*e, 0, len(w) - 1)] if n or at else None))
            want += Counter({(k, v): 2 for v in at}) + Counter((k, y * R + x) for w in walked for x, y in w)
    kinds = {"k": pa.string(), "x": pa.int64(), "at": pa.list_(pa.int32()), "hits": pa.list_(pa.int64()), "lines": pa.list_(pa.int64())}
    table = pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds.items())})
    parts = lambda b, g: (*tilehits.hits_of(b, g, R), *tilehits.lines_of(b, g))
    folded = list(tilehits.folded(iter(table.to_batches(3)), ["k", "x"], R, tilehits.pixels_in, parts))
    got = [r for b in folded for r in b.to_pylist()]
    assert sorted(r["k"] for r in got) == list("abcde") and all(r["n"] == len(r["at"]) + tilehits.WEIGHT * (len(r["lines"]) // 6) for r in got)
    held = {r["k"]: sum(r["lines"][5::6]) + len(r["lines"]) // 6 for r in got}
    assert held["a"] and held["c"] and all(n <= R * R for n in held.values())
    for batches in (table.to_batches(3), folded):
        out = tilehits.summed(iter(batches), ["k", "x"], R, tilehits.pixels_in, lambda b, g: tilehits.stored(b, g, R), 1)
        assert {(r["k"], v): h for b in out for r in b.to_pylist() for v, h in zip(r["at"], r["hits"])} == want


def test_rows_with_lines_draw_the_same_pixels(spark):
    rows = lines(400) + [(u, 3, 3, 5, 4) for u in "ab" for _ in range(9)]
    df = spark.createDataFrame(rows, "user_id string, x0 long, y0 long, x1 long, y1 long")
    stored = tilehits.lined(raster.pieces(df, ("user_id",), R), ("user_id",), R)
    want = sorted(map(str, raster.draw(df, ("user_id",)).groupBy("user_id", "px", "py").agg(F.count(F.lit(1)).alias("hits")).collect()))
    for lined in (stored, tilehits.merged(stored.union(stored).union(stored), ["user_id"], R, 3, lines=True)):
        assert lined.where("size(lines) > 0 and size(at) > 0").count() and lined.count() == lined.select("user_id", "x", "y").distinct().count()
    assert sorted(map(str, tilehits.cells(tilehits.merged(stored, ["user_id"], R, 3), ("user_id",), R).collect())) == want
    thrice = tilehits.cells(tilehits.merged(lined, ["user_id"], R, 3), ("user_id",), R).withColumn("hits", F.expr("hits div 3"))
    assert sorted(map(str, thrice.collect())) == want


def test_rows_are_exchanged_once_to_be_counted(spark):
    """Where tiles were not broadcast, rows were exchanged by tile, of which a few may hold all rows, and then again by user."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tilehits.counted(density.user_hits(tracks(spark)), 512, 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
