import random

from trackweave.config import JobConfig, Raster
from trackweave.sources import stream
from trackweave.sources import tracks as ts
from trackweave.streaming import job
from trackweave.streaming.store import Store

POINTS = "array<struct<lon:double,lat:double>>"
LINE = [{"lon": 4.35, "lat": 50.85}, {"lon": 4.3502, "lat": 50.85}]


def write(spark, folder, rows):
    """rows: id, users, whether there is a geometry."""
    spark.createDataFrame([(i, LINE if drawn else None) for i, _, drawn in rows], f"ContributionId long, PointsGeom {POINTS}").coalesce(1).write.mode("append").parquet(f"{folder}/contributions")
    spark.createDataFrame([(i, u) for i, users, _ in rows for u in users], "ContributionId long, UserId int").coalesce(1).write.mode("append").parquet(f"{folder}/user_contributions")


def polled(rows, last, most, users):
    """(end, pairs) of each batch that polling takes after last: the same rules, step by step."""
    out, ids = [], sorted(i for i, _, _ in rows)
    while later := [i for i in ids if i > last]:
        high = min(later[-1], later[0] - 1 + most)
        pairs = sorted((i, f"u{u}") for i, us, drawn in rows if last < i <= high and drawn for u in us)
        seen, cut = set(), None
        for i, u in pairs:
            seen.add(u)
            if len(seen) > users:
                cut = i
                break
        if cut is not None:
            first = pairs[0][0]
            pairs = [p for p in pairs if p[0] < (cut + 1 if cut == first else cut)]
            high = pairs[-1][0]
        out.append((high, pairs))
        last = high
    return out, last


def test_ends_of_batches_equal_polling(spark, tmp_path):
    random.seed(21)
    rows = [(i, random.sample(range(6), random.choice((1, 1, 2, 4))), random.random() > 0.1) for i in sorted(random.sample(range(3000), 60))]
    rows += [(10_000_000, [1], True), (10_000_003, [2, 3, 4, 5], True), (10_000_004, [], True), (10_000_005, [1], False)]
    write(spark, tmp_path, rows)
    spark.createDataFrame([(i, f"u{i}") for i in range(6)], "Id int, UserIdentifier string").write.parquet(f"{tmp_path}/users")
    source = stream.ParquetRelations(f"file://{tmp_path}")
    for most, users in ((10, 2), (500, 3), (1, 1), (10**6, 50)):
        want, last = polled(rows, -1, most, users)[0], -1
        for end, pairs in want:
            reached = stream.end_of_batch(source, last, most, users)
            assert reached == end and [(i, u) for i, u, _ in source.tracks(last, reached)] == pairs
            last = reached
        assert stream.end_of_batch(source, last, most, users) == last == rows[-1][0]
    relations = ts.Relations.read(spark, f"file://{tmp_path}")
    assert sorted((r.contribution_id, r.user_id) for r in relations.tracks(-1, 2999).collect()) == [(i, u) for i, u, _ in source.tracks(-1, 2999)]


def test_a_stream_goes_on_where_its_checkpoint_ends(spark, tmp_path):
    first = [(3, [1], True), (4, [2], True), (5, [3, 4], True), (900, [1], False), (901, [1, 2, 3], True)]
    second = [(950, [2], True), (5000, [4], True)]
    spark.createDataFrame([(i, f"u{i}") for i in range(1, 5)], "Id int, UserIdentifier string").write.parquet(f"{tmp_path}/data/users")
    store, config, raster = Store(spark, f"file://{tmp_path}/store", 64), JobConfig(min_users=1, refresh_ms=1), Raster(2, 64)
    batches, merge = [], job.merge

    def noted(store, df, name, *more):
        batches.append((name, sorted((r.contribution_id, r.user_id) for r in df.collect())))
        return merge(store, df, name, *more)

    job.merge = noted
    try:
        for rows in (first, second):
            write(spark, f"{tmp_path}/data", rows)
            query = job.start_stream(store, stream.contribution_stream(spark, f"file://{tmp_path}/data"), f"{tmp_path}/checkpoint", config, raster)
            try:
                query.processAllAvailable()
            finally:
                query.stop()
            assert query.exception() is None
    finally:
        job.merge = merge
    one, last = polled(first, -1, 10, 2)
    two, _ = polled(first + second, last, 10, 2)
    assert [b for _, b in batches] == [pairs for _, pairs in one + two]
    assert [n for n, _ in batches] == [f"stream-{i}" for i in range(len(batches))]
    assert {r.users for r in store.cells(2).collect()} == {4}
