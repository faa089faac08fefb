"""DuckDB SQL with the rows of the raster queries. Lines are rasterised by a recursive walk of the error term's closed form."""

from __future__ import annotations

E = """e AS (
  SELECT event_id, user_id, ts, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) * 10000000 + user_id AS contribution_id,
    CAST(4295168 + (event_id * 7919 + user_id * 31) % 640 AS BIGINT) AS px, CAST(2815488 + (event_id * 104729 + user_id * 17) % 640 AS BIGINT) AS py
  FROM events
), t AS (
  SELECT *, px // 512 AS x, py // 512 AS y, CAST(px % 512 AS INTEGER) AS cx, CAST(py % 512 AS INTEGER) AS cy FROM e
)"""


def seg(where: str = "true") -> str:
    return (
        E
        + f""", s AS (
  SELECT * FROM (SELECT contribution_id, user_id, px AS x0, py AS y0,
    lead(px) OVER (PARTITION BY contribution_id ORDER BY ts, event_id) AS x1, lead(py) OVER (PARTITION BY contribution_id ORDER BY ts, event_id) AS y1
    FROM t WHERE {where}) WHERE x1 IS NOT NULL
), l AS (
  SELECT *, x1 - x0 AS w, y1 - y0 AS h, greatest(abs(x1 - x0), abs(y1 - y0)) AS n, least(abs(x1 - x0), abs(y1 - y0)) AS m FROM s
), i AS (
  SELECT *, unnest(range(n + 1)) AS i FROM l
), k AS (
  SELECT *, (n // 2 + i * m) // greatest(n, 1) AS k FROM i
), p AS (
  SELECT contribution_id, user_id, CAST(CASE WHEN abs(w) > abs(h) THEN x0 + sign(w) * i ELSE x0 + sign(w) * k END AS BIGINT) AS px,
    CAST(CASE WHEN abs(w) > abs(h) THEN y0 + sign(h) * k ELSE y0 + sign(h) * i END AS BIGINT) AS py FROM k
), u AS (
  SELECT user_id, px, py, CAST(count(*) AS BIGINT) AS hits FROM p GROUP BY ALL
), g AS (
  SELECT px, py, CAST(count(*) AS BIGINT) AS users, CAST(sum(hits) AS BIGINT) AS trips FROM u GROUP BY ALL
), g3 AS (
  SELECT * FROM g WHERE users >= 3
), v AS (
  SELECT 14 AS z, px, py, CAST(sum(hits) AS BIGINT) AS value FROM u GROUP BY px, py
), v0 AS (
  SELECT 14 AS z, px, py, CAST(sum(hits) AS BIGINT) AS value FROM u WHERE user_id % 2 = 0 GROUP BY px, py
), v1 AS (
  SELECT 14 AS z, px, py, CAST(sum(hits) AS BIGINT) AS value FROM u WHERE user_id % 2 = 1 GROUP BY px, py
), some_tiles AS (
  SELECT * FROM (VALUES (8389, 5499), (8390, 5500), (1, 1)) AS q(x, y)
)"""
    )


PYR = """, pyr AS (
  SELECT CAST(14 - d AS INTEGER) AS z, px >> d AS px, py >> d AS py, CAST(sum(users) AS BIGINT) AS users, CAST(sum(trips) AS BIGINT) AS trips
  FROM g3, (SELECT CAST(unnest(range(15)) AS INTEGER) AS d) GROUP BY ALL
)"""

LAT = "degrees(atan(sinh(pi() - 2.0e0 * pi() * ({y}) / {n}e0)))"


def lat(y: str, n: int = 16384) -> str:
    return LAT.format(y=y, n=n)


def in_some(a: str) -> str:
    return f"EXISTS (SELECT 1 FROM some_tiles q WHERE q.x = {a}.px // 512 AND q.y = {a}.py // 512)"


TILES = f"WITH {E}, d AS (SELECT DISTINCT x, y FROM t) "

ORACLE = {
    "project_points": f"WITH {E} SELECT event_id, x, y, y * 16384 + x AS tile_id, CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, px, py FROM t",
    "tile_ids": f"WITH {E} SELECT event_id, y * 16384 + x AS tile_id, x, y FROM t",
    "tile_max_id": "SELECT CAST(z AS INTEGER) AS z, CAST(pow(4, z) + pow(2, z) AS BIGINT) AS max_id FROM range(17) AS r(z)",
    "tile_parent": f"WITH {E} SELECT event_id, x // 2 AS x13, y // 2 AS y13, x // 128 AS x7, y // 128 AS y7, x // 16384 AS x0 FROM t",
    "tile_children": TILES + "SELECT x, y, CAST(i AS INTEGER) AS i, 2 * x + i % 2 AS cx, 2 * y + i // 2 AS cy FROM d, range(4) AS r(i)",
    "tile_descendants": TILES + "SELECT x, y, 4 * x + 4 AS x_end, 4 * y + 4 AS y_end, 4 * x + i AS cx, 4 * y + j AS cy FROM d, range(4) AS r(i), range(4) AS q(j)",
    "tile_neighbours": TILES
    + """, a AS (SELECT y * 16384 + x AS a FROM d), b AS (SELECT a, a + unnest([0, 1, -1, 16384, -16384, 16385, 2]) AS b FROM a)
      SELECT a, b, abs(a % 16384 - b % 16384) + abs(a // 16384 - b // 16384) = 1 AS near FROM b""",
    "tiles_for_bbox": f"""WITH {E}, b AS (SELECT user_id, min(2 * px // 512) AS l, max(2 * px // 512) AS r, px // px AS one FROM t GROUP BY user_id, one),
      c AS (SELECT user_id, min(x * 2 + cx // 256) AS l, max(x * 2 + cx // 256) AS r, min(lat) AS lo, max(lat) AS hi FROM
        (SELECT *, {lat("y")} - ({lat("y")} - {lat("y + 1")}) / 512 * (cy + 0.5e0) AS lat FROM t) GROUP BY user_id),
      q AS (SELECT user_id, l, r, CAST(floor((1 - ln(tan(radians(hi)) + 1 / cos(radians(hi))) / pi()) / 2 * 32768) AS BIGINT) AS top,
        CAST(floor((1 - ln(tan(radians(lo)) + 1 / cos(radians(lo))) / pi()) / 2 * 32768) AS BIGINT) AS bottom FROM c),
      xs AS (SELECT user_id, unnest(range(l, r + 1)) AS x, top, bottom FROM q) SELECT user_id, x, unnest(range(top, bottom + 1)) AS y FROM xs""",
    "tile_position": f"""WITH {E} SELECT event_id, y * 16384 + x AS tile_id, CAST(cy * 512 + cx AS BIGINT) AS "offset", x * 512 AS "left", y * 512 AS top FROM t""",
    "tile_box": TILES
    + f"""SELECT x, y, round(x / 16384.0e0 * 360 - 180, 6) AS "left", round({lat("y")}, 6) AS top, round((x + 1) / 16384.0e0 * 360 - 180, 6) AS "right",
      round({lat("y + 1")}, 6) AS bottom FROM d""",
    "pixel_to_lonlat": f"""WITH {E} SELECT event_id, round((x + cx / 512.0e0) / 16384.0e0 * 360 - 180, 6) AS lon,
      round({lat("y")} - ({lat("y")} - {lat("y + 1")}) / 512 * cy, 6) AS lat FROM t""",
    "sub_coordinates": f"""WITH {E} SELECT event_id, round(x + (cx + 0.5e0) / 512, 6) AS sx, round(y + 1 - (cy + 0.5e0) / 512, 6) AS sy FROM t""",
    "tile_polygon": TILES
    + f""", b AS (SELECT x, y, x / 16384.0e0 * 360 - 180 - 360 / 16384.0e0 * 0.05e0 AS l, (x + 1) / 16384.0e0 * 360 - 180 + 360 / 16384.0e0 * 0.05e0 AS r,
        {lat("y")} + ({lat("y")} - {lat("y + 1")}) * 0.05e0 AS t, {lat("y + 1")} - ({lat("y")} - {lat("y + 1")}) * 0.05e0 AS b FROM d)
      SELECT x, y, CAST(i AS INTEGER) AS i, round(CASE WHEN i IN (1, 2) THEN r ELSE l END, 6) AS lon, round(CASE WHEN i IN (2, 3) THEN b ELSE t END, 6) AS lat
      FROM b, range(5) AS q(i)""",
    "pixel_deltas": f"""WITH {E} SELECT event_id, px - coalesce(lag(px) OVER w, 0) AS dpx, py - coalesce(lag(py) OVER w, 0) AS dpy FROM t
      WINDOW w AS (PARTITION BY contribution_id ORDER BY ts, event_id)""",
    "segments": f"WITH {seg()} SELECT * FROM s",
    "raster_pixels": f"WITH {seg()} SELECT contribution_id, px, py, count(*) AS hits FROM p GROUP BY ALL",
    "raster_include_tile": f"WITH {seg('(y * 16384 + x) % 2 = 1')} SELECT contribution_id, px, py, count(*) AS hits FROM p GROUP BY ALL",
    "user_cells": f"WITH {seg()} SELECT * FROM u",
    "user_cells_cost": f"WITH {seg()} SELECT user_id, px, py, 7 * hits AS hits FROM u",
    "tile_users": f"WITH {seg()} SELECT DISTINCT px // 512 AS x, py // 512 AS y, user_id FROM u",
    "tile_user_counts": f"WITH {seg()} SELECT px // 512 AS x, py // 512 AS y, count(DISTINCT user_id) AS users FROM u GROUP BY ALL",
    "tile_threshold": f"WITH {seg()} SELECT px // 512 AS x, py // 512 AS y, count(DISTINCT user_id) AS users FROM u GROUP BY ALL HAVING users >= 100",
    "global_cells": f"WITH {seg()} SELECT * FROM g",
    "global_cells_k3": f"WITH {seg()} SELECT * FROM g3",
    "pyramid_cells": f"WITH {seg()}{PYR} SELECT * FROM pyr",
    "pyramid_compat": f"WITH {seg()}{PYR} SELECT * FROM pyr WHERE z >= 11",
    "pyramid_tile_totals": f"""WITH {seg()}{PYR} SELECT z, px // 512 AS x, py // 512 AS y, count(*) AS cells, CAST(sum(users) AS BIGINT) AS users,
      CAST(sum(trips) AS BIGINT) AS trips FROM pyr GROUP BY ALL""",
    "parent_tiles": TILES + "SELECT DISTINCT CAST(13 - i AS INTEGER) AS z, x >> CAST(i + 1 AS INTEGER) AS x, y >> CAST(i + 1 AS INTEGER) AS y FROM d, range(14) AS r(i)",
    "tiles_at_zoom": TILES
    + """SELECT DISTINCT 12 AS z, x // 4 AS x, y // 4 AS y FROM d UNION ALL SELECT 14, x, y FROM d
      UNION ALL SELECT 15, 2 * x + i, 2 * y + j FROM d, range(2) AS r(i), range(2) AS q(j)""",
    "diff_pyramid_saturating": f"""WITH {seg()} SELECT CAST(14 - d AS INTEGER) AS z, px >> d AS px, py >> d AS py, CAST(least(sum(value) * 100000000, 4294967295) AS BIGINT) AS value
      FROM v, (SELECT CAST(unnest(range(7)) AS INTEGER) AS d) GROUP BY ALL""",
    "apply_diff": f"WITH {seg()} SELECT px, py, value FROM v",
    "apply_diff_compat": f"""WITH {seg()}, b AS (SELECT contribution_id % 4 AS batch, px, py, count(*) AS n FROM p GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY batch DESC) - 1 AS later FROM b)
      SELECT px, py, CAST(sum(n * CAST(pow(2, later) AS BIGINT)) AS BIGINT) AS value FROM r GROUP BY ALL""",
    "encode_decode": f"WITH {seg()} SELECT px, py, users * 4294967296 + trips AS packed, users, trips FROM g",
    "sign_magnitude": f"WITH {E} SELECT event_id, 2 * abs(event_id - 500) + CASE WHEN event_id < 500 THEN 1 ELSE 0 END AS coded, event_id - 500 AS back FROM t",
    "copy_tiles": f"""WITH {seg()} SELECT 14 AS z, coalesce(a.px, b.px) AS px, coalesce(a.py, b.py) AS py, CAST(coalesce(a.value * 2, b.value) AS BIGINT) AS value
      FROM (SELECT * FROM v0 WHERE {in_some("v0")}) a FULL JOIN v1 b ON a.px = b.px AND a.py = b.py""",
    "add_tiles": f"""WITH {seg()} SELECT 14 AS z, coalesce(a.px, b.px) AS px, coalesce(a.py, b.py) AS py, coalesce(a.value, 0) + coalesce(b.value, 0) AS value
      FROM (SELECT * FROM v0 WHERE {in_some("v0")}) a FULL JOIN v1 b ON a.px = b.px AND a.py = b.py""",
    "add_tiles_fold": f"""WITH {seg()} SELECT 14 AS z, coalesce(a.px, b.px) AS px, coalesce(a.py, b.py) AS py,
      CASE WHEN a.value IS NULL THEN b.value ELSE greatest(a.value, coalesce(b.value, 0)) + 1 END AS value
      FROM (SELECT * FROM v0 WHERE {in_some("v0")}) a FULL JOIN v1 b ON a.px = b.px AND a.py = b.py""",
    "update_values": f"WITH {seg()} SELECT z, px, py, value - 1 + px % 512 % 2 AS value FROM v WHERE value > 1",
    "remove_tiles": f"WITH {seg()} SELECT * FROM v WHERE px // 512 % 2 <> 1",
    "cell_lookup": f"""WITH {seg()}, q AS (SELECT event_id, px + event_id % 3 AS px, py FROM t) SELECT 14 AS z, q.px, q.py, event_id, coalesce(value, 0) AS value
      FROM q LEFT JOIN v ON v.px = q.px AND v.py = q.py""",
    "list_tiles": f"WITH {seg()} SELECT DISTINCT z, px // 512 AS x, py // 512 AS y FROM v",
    "tile_values": f"WITH {seg()} SELECT z, px // 512 AS x, py // 512 AS y, CAST(px % 512 AS INTEGER) AS cx, CAST(py % 512 AS INTEGER) AS cy, value FROM v WHERE {in_some('v')}",
    "contribution_window": f"""WITH {E} SELECT contribution_id, 'user-' || user_id AS user_id, count(*) AS points FROM t
      WHERE contribution_id > 0 AND contribution_id <= 198000000000 GROUP BY ALL""",
    "latest_contribution": f"WITH {E} SELECT max(contribution_id) AS latest, min(contribution_id) AS earliest FROM t",
    "admission_prefix": f"""WITH {E}, c AS (SELECT DISTINCT contribution_id, 'user-' || user_id AS user_id FROM t),
      f AS (SELECT user_id, min(contribution_id) AS first FROM c GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY first, user_id) AS n FROM f)
      SELECT c.* FROM c WHERE contribution_id < coalesce((SELECT first FROM r WHERE n = 21), 9223372036854775807)""",
    "per_user_last": f"WITH {E} SELECT user_id, max(contribution_id) AS last_contribution_id FROM t GROUP BY user_id",
    "modified_tiles": f"WITH {seg()} SELECT DISTINCT 14 AS z, px // 512 AS x, py // 512 AS y FROM p WHERE contribution_id % 7 = 0",
    "incremental_equals_batch": f"WITH {seg()} SELECT * FROM g3",
    "varint_bytes": f"""WITH {E}, n AS (SELECT event_id, px * event_id AS v, list_min(list_filter(range(1, 11), lambda n: n = 10 OR (px * event_id) >> (7 * n) = 0)) AS n FROM t)
      SELECT event_id, array_to_string(list_transform(range(n), lambda i: printf('%02X', ((v >> (7 * i)) & 127) + CASE WHEN i + 1 < n THEN 128 ELSE 0 END)), '') AS bytes,
        v AS back, printf('%02X', CASE WHEN v % 5 = 0 THEN 0 ELSE v % 5 + 1 END) AS nullable FROM n""",
    "vector_tile_points": f"""WITH {seg()}{PYR} SELECT z, px // 512 AS x, py // 512 AS y, CAST(px % 512 * 8 AS INTEGER) AS cx, CAST(py % 512 * 8 AS INTEGER) AS cy,
      users, trips FROM pyr""",
    "incremental_job": f"WITH {seg()}{PYR} SELECT * FROM pyr",
    "top_cells": f"""WITH {seg()}, r AS (SELECT *, CAST(row_number() OVER (ORDER BY users DESC, trips DESC, px, py) AS INTEGER) AS rank FROM g3)
      SELECT * FROM r WHERE rank <= 100""",
    "vector_features": f"""WITH {seg()}{PYR}, q AS (SELECT *, px // 512 AS x, py // 512 AS y, CAST(px % 512 AS INTEGER) AS cx, CAST(py % 512 AS INTEGER) AS cy,
        pow(2.0e0, z) AS n FROM pyr WHERE z >= 12),
      b AS (SELECT *, degrees(atan(sinh(pi() - 2.0e0 * pi() * y / n))) AS t, degrees(atan(sinh(pi() - 2.0e0 * pi() * (y + 1) / n))) AS b FROM q)
      SELECT z, x, y, cx, cy, round((x + cx / 512.0e0) / n * 360 - 180, 6) AS lon, round(t - (t - b) / 512 * cy, 6) AS lat, users, trips FROM b""",
}

# The same over all zooms, batches and tiles.
ORACLE |= {
    "pyramid_compat_all": ORACLE["pyramid_compat"].replace(" WHERE z >= 11", ""),
    "diff_pyramid_saturating_all": ORACLE["diff_pyramid_saturating"].replace("range(7)", "range(15)"),
    "vector_features_all": ORACLE["vector_features"].replace(" WHERE z >= 12", ""),
    "modified_tiles_all": f"WITH {seg()} SELECT DISTINCT contribution_id % 7 AS batch, 14 AS z, px // 512 AS x, py // 512 AS y FROM p",
    "tile_values_all": f"WITH {seg()} SELECT z, px // 512 AS x, py // 512 AS y, CAST(px % 512 AS INTEGER) AS cx, CAST(py % 512 AS INTEGER) AS cy, value FROM v",
}
