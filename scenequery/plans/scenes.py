"""Queries of scenes of different grids, and of image geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import scenes as ops
from ..sources import adapters as src
from .registry import query

R = lambda c, n=6: F.round(c, n)
MOST = 16

#: Every 5,000 events are five scenes of 1,000 pixels, of five widths; every second one has an uneven grid, every fifth another CRS.
_PX = """sp AS (SELECT CAST((event_id // 5000) * 5 + event_id % 5 AS INTEGER) AS scene_id, (event_id % 5000) // 5 AS i, 17 + 6 * (event_id % 5) AS width, CASE WHEN event_type <> 'error' THEN value END AS v FROM events),
  sx AS (SELECT scene_id, CAST(i // width AS INTEGER) AS "row", CAST(i % width AS INTEGER) AS col, v, width FROM sp),
  sc AS (SELECT scene_id, CAST(max("row") + 1 AS INTEGER) AS height, CAST(any_value(width) AS INTEGER) AS width FROM sx GROUP BY 1),
  sd AS (SELECT *, 60.0 * (scene_id % 5) + CASE WHEN scene_id % 5 = 3 THEN 200 ELSE 0 END AS x0, 0.0 AS y0, CASE WHEN scene_id % 5 = 4 THEN 'EPSG:4326' ELSE 'EPSG:32610' END AS crs FROM sc),
  se AS (SELECT *, x0 + width * 10 AS x1, y0 + height * 10 AS y1 FROM sd),
  sn AS (SELECT *, CASE WHEN scene_id % 2 = 1 THEN list_transform(range(width), lambda i: x0 + 5 + 10 * i + 0.25 * (i % 3)) END AS xs, CASE WHEN scene_id % 2 = 1 THEN list_transform(range(height), lambda i: y1 - 5 - 10 * i - 0.25 * (i % 4)) END AS ys FROM se)"""


def _scenes(spark, sf_dir):
    """(pixels, scenes)"""
    e, k = src.table(spark, sf_dir, "events"), F.col("event_id")
    flat = e.select((F.floor(k / 5000) * 5 + F.pmod(k, F.lit(5))).cast("int").alias("scene_id"), F.floor(F.pmod(k, F.lit(5000)) / 5).alias("i"), (17 + 6 * F.pmod(k, F.lit(5))).cast("int").alias("width"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    px = flat.select("scene_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("row"), F.pmod("i", "width").cast("int").alias("col"), "v", "width")
    sized = px.groupBy("scene_id").agg((F.max("row") + 1).alias("height"), F.first("width").alias("width"))
    m = F.pmod("scene_id", F.lit(5))
    sized = sized.withColumns({"x0": 60.0 * m + F.when(m == 3, 200).otherwise(0), "y0": F.lit(0.0), "crs": F.when(m == 4, "EPSG:4326").otherwise("EPSG:32610")})
    sized = sized.withColumns({"x1": F.col("x0") + F.col("width") * 10, "y1": F.col("y0") + F.col("height") * 10})
    uneven = F.pmod("scene_id", F.lit(2)) == 1
    xs = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.col("x0") + 5 + 10 * i + 0.25 * (i % 3))
    ys = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda i: F.col("y1") - 5 - 10 * i - 0.25 * (i % 4))
    return px.drop("width"), sized.withColumns({"xs": F.when(uneven, xs), "ys": F.when(uneven, ys)})


@query(f"""WITH {_PX}, k AS (SELECT scene_id, height, width, greatest(1, CAST(ceil(greatest(height, width) / {MOST}.0) AS INTEGER)) AS n FROM sc)
  SELECT scene_id, CAST("row" // n AS INTEGER) AS "row", CAST(col // n AS INTEGER) AS col, round(avg(v), 6) AS v, count(*) AS n, any_value(n) AS looks, CAST(ceil(any_value(height) / any_value(n)) AS INTEGER) AS height, CAST(ceil(any_value(k.width) / any_value(n)) AS INTEGER) AS width
  FROM sx JOIN k USING (scene_id) WHERE v > 0 GROUP BY 1, 2, 3""")
def scene_multilook(spark, sf_dir):
    """Scenes of different sizes, each made smaller by its own number of looks."""
    px, scenes = _scenes(spark, sf_dir)
    return ops.capped(px, scenes, MOST).withColumn("v", R(F.col("v"))).join(ops.capped_size(scenes, MOST), "scene_id")


_BOX = (100.0, 50.0, 260.0, 303.0)
_REGION = f"""rq AS (SELECT *, greatest({_BOX[0]}, x0) AS w, least({_BOX[2]}, x1) AS e, greatest({_BOX[1]}, y0) AS s, least({_BOX[3]}, y1) AS n FROM sn),
  ri AS (SELECT *, greatest(0, CASE WHEN len(xs) > 2 THEN len(list_filter(xs, lambda v: v < w)) ELSE floor((w - x0) / (x1 - x0) * width) END) AS c0, least(width - 1, CASE WHEN len(xs) > 2 THEN len(list_filter(xs, lambda v: v <= e)) - 1 ELSE ceil((e - x0) / (x1 - x0) * width) END) AS c1,
    greatest(0, CASE WHEN len(ys) > 2 THEN len(list_filter(ys, lambda v: v > n)) ELSE floor((y1 - n) / (y1 - y0) * height) END) AS r0, least(height - 1, CASE WHEN len(ys) > 2 THEN len(list_filter(ys, lambda v: v >= s)) - 1 ELSE ceil((y1 - s) / (y1 - y0) * height) END) AS r1 FROM rq),
  rp AS (SELECT *, CASE WHEN crs <> 'EPSG:32610' THEN 'CRS ' || crs || ' is not EPSG:32610' WHEN {_BOX[2]} <= x0 OR {_BOX[0]} >= x1 OR {_BOX[3]} <= y0 OR {_BOX[1]} >= y1 THEN 'region misses the scene' WHEN r1 < r0 OR c1 < c0 THEN 'no pixel in the region' END AS problem FROM ri)"""


def _requests(scenes):
    return scenes.select(F.lit(1).alias("request"), "scene_id", *(F.lit(v).alias(n) for n, v in zip(("rx0", "ry0", "rx1", "ry1"), _BOX, strict=True)), F.lit("EPSG:32610").alias("rcrs"))


@query(f"""WITH {_PX}, {_REGION}, ok AS (SELECT *, problem IS NULL AS good FROM rp)
  SELECT scene_id, CASE WHEN good THEN CAST(r0 AS INTEGER) END AS first_row, CASE WHEN good THEN CAST(c0 AS INTEGER) END AS first_col, CASE WHEN good THEN CAST(r1 - r0 + 1 AS INTEGER) END AS "rows", CASE WHEN good THEN CAST(c1 - c0 + 1 AS INTEGER) END AS cols,
    CASE WHEN good THEN CASE WHEN len(xs) > 2 THEN xs[CAST(c0 AS INTEGER) + 1] ELSE x0 + c0 / width * (x1 - x0) END END AS bx0, CASE WHEN good THEN CASE WHEN len(ys) > 2 THEN ys[CAST(r1 AS INTEGER) + 1] ELSE y1 + (r1 + 1) / height * (y0 - y1) END END AS by0,
    CASE WHEN good THEN CASE WHEN len(xs) > 2 THEN xs[CAST(c1 AS INTEGER) + 1] ELSE x0 + (c1 + 1) / width * (x1 - x0) END END AS bx1, CASE WHEN good THEN CASE WHEN len(ys) > 2 THEN ys[CAST(r0 AS INTEGER) + 1] ELSE y1 + r0 / height * (y0 - y1) END END AS by1, problem FROM ok""")
def scene_regions(spark, sf_dir):
    """One region in scenes of different grids: pixel ranges and their bounds, by coordinate arrays or even grids, errors as rows."""
    _, scenes = _scenes(spark, sf_dir)
    return ops.regions(scenes, _requests(scenes)).drop("request")


@query(f"""WITH {_PX}, {_REGION}, m AS (SELECT scene_id, avg(v) AS mean, count(*) AS n FROM sx JOIN rp USING (scene_id) WHERE problem IS NULL AND v > 0 AND "row" BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 GROUP BY 1)
  SELECT rp.scene_id, round(mean, 6) AS mean, coalesce(n, 0) AS n, coalesce(problem, CASE WHEN n IS NULL THEN 'no valid pixel' END) AS problem FROM (SELECT scene_id, problem FROM rp) rp LEFT JOIN m USING (scene_id)""")
def scene_series(spark, sf_dir):
    """The mean of one region in each scene, a row a scene whatever happened to it."""
    px, scenes = _scenes(spark, sf_dir)
    return ops.series(px, ops.regions(scenes, _requests(scenes))).select("scene_id", R(F.col("mean")).alias("mean"), "n", "problem")


_ROWS, _COLS = (0.8, 0.6, 0.0), (-0.36, 0.48, 0.8)


@query(f"""WITH {src.GRANULES_SQL}, c AS (SELECT id, {geo.A} / sqrt(1 - {geo.E2!r} * sin(radians(y0)) ** 2) AS nn, radians(y0) AS p, radians(x0) AS q FROM granules),
  k AS (SELECT id, nn * cos(p) * cos(q) AS sx, nn * cos(p) * sin(q) AS sy, nn * {1 - geo.E2!r} * sin(p) AS sz FROM c),
  i AS (SELECT *, (r - 400 + 10) * 2.5 AS dr, (c - 300 + 20) * 4.0 AS dc FROM k, (VALUES (0, 0), (0, 599), (799, 599), (799, 0)) v(r, c)),
  e AS (SELECT id, sx + dr * {_ROWS[0]} + dc * ({_COLS[0]}) AS x, sy + dr * {_ROWS[1]} + dc * {_COLS[1]} AS y, sz + dr * {_ROWS[2]} + dc * {_COLS[2]} AS z FROM i),
  t AS (SELECT *, sqrt(x * x + y * y) AS h, atan2(z * {geo.A}, sqrt(x * x + y * y) * {geo.B!r}) AS th FROM e),
  l AS (SELECT id, degrees(atan2(z + {geo.EP2!r} * {geo.B!r} * sin(th) ** 3, h - {geo.E2!r} * {geo.A} * cos(th) ** 3)) AS lat, degrees(atan2(y, x)) AS lon FROM t)
  SELECT id, round(min(lon), 7) AS west, round(min(lat), 7) AS south, round(max(lon), 7) AS east, round(max(lat), 7) AS north FROM l GROUP BY 1""")
def image_boxes(spark, sf_dir):
    """The geographic box of an image around each granule's corner: its corner pixels brought to the ground."""
    g = src.granules(spark, sf_dir)
    centre = geo.to_ecef(F.col("y0"), F.col("x0"), F.lit(0.0))
    frame = geo.Frame(centre, _ROWS, _COLS, 2.5, 4.0, 400, 300, 10, 20)
    west, south, east, north = frame.box(800, 600)
    return g.select("id", *(R(c, 7).alias(n) for n, c in (("west", west), ("south", south), ("east", east), ("north", north))))
