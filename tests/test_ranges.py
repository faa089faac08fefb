import random

from trackweave.operators import ranges


def test_tiles_of_boxes_equal_brute_force(spark):
    random.seed(31)
    boxes = []
    for i in range(60):
        x, y = random.randrange(300), random.randrange(300)
        boxes.append((i, x, y, x + random.choice((-1, 0, 1, 5, 63, 64, 130)), y + random.choice((-1, 0, 2, 64, 100))))
    boxes += [(60, None, 1, 2, 3), (61, 0, 0, 63, 63), (61, 64, 64, 64, 64)]
    df = spark.createDataFrame(boxes, "i int, x0 long, y0 long, x1 long, y1 long")
    want = sorted((i, x, y) for i, x0, y0, x1, y1 in boxes if x0 is not None for x in range(x0, x1 + 1) for y in range(y0, y1 + 1))
    assert sorted(map(tuple, ranges.tiles_in(df).collect())) == want
    below = ranges.tiles_below(spark.createDataFrame([(3, 5), (0, 0)], "x long, y long"), 4, 12).collect()
    assert {(r.x, r.y) for r in below if r.p_x == 3} == {(x, y) for x in range(768, 1024) for y in range(1280, 1536)} and len(below) == 2 * 65536


def test_the_world_in_one_row_comes_from_all_tasks(spark):
    world = spark.createDataFrame([(-180.0, 85.0511, 179.9999, -85.0511)], "left double, top double, right double, bottom double")
    tiles = ranges.tiles_for_boxes(world, 12)
    loads = tiles.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    assert sum(r["count"] for r in loads) == 1 << 24 and len(loads) == 4 and max(r["count"] for r in loads) < 1.2 * (1 << 22)
