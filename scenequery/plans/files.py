"""Queries on raster files: written as GeoTIFF, read back by tiles, their grids compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import radiometry as rad
from ..sources import adapters as src
from ..sources import geotiff, shared
from .registry import query

SIDE, TILE = 128, 16
LIMITS = {"r": (45.0, 55.0), "g": (30.0, 45.0), "b": (28.0, 42.0)}


def _regridded(spark, sf_dir):
    """The bands on scenes of 128 x 128, a file each, as a table: files, sizes and pixels all read it."""
    at = F.col("scene_id").cast("long") * src.BAND_SCENE + F.col("row") * src.BAND_WIDTH + F.col("col")
    place = src.band_raster(spark, sf_dir).select(at.alias("at"), "hh", "hv", "vv")
    return shared.staged(place.select(F.concat(F.lit("scene-"), F.floor(F.col("at") / SIDE**2).cast("string"), F.lit(".tif")).alias("file"), F.floor(F.pmod("at", F.lit(SIDE**2)) / SIDE).cast("int").alias("row"), F.pmod("at", F.lit(SIDE)).cast("int").alias("col"), "hh", "hv", "vv"), "regridded")


_AT = f"""{src.BAND_RASTER_SQL}, rg AS (SELECT 'scene-' || (pos // {SIDE**2}) || '.tif' AS file, CAST((pos % {SIDE**2}) // {SIDE} AS INTEGER) AS "row", CAST(pos % {SIDE} AS INTEGER) AS col, hh, hv, vv
  FROM (SELECT CAST(scene_id AS BIGINT) * {src.BAND_SCENE} + "row" * {src.BAND_WIDTH} + col AS pos, hh, hv, vv FROM mb))"""


def _files(pixels, side=SIDE):
    k = F.regexp_extract("file", r"(\d+)\.tif", 1).cast("double")
    return pixels.select("file").distinct().select("file", F.lit(side).alias("width"), F.lit(side).alias("height"), (500000 + k * 1280).alias("x0"), F.lit(4000000.0).alias("y0"), (500000 + k * 1280 + 1280).alias("x1"), F.lit(4001280.0).alias("y1"), F.lit(32610).alias("epsg"))


_BOX = (10, 20, 90, 100)


@query(f"""WITH {_AT} SELECT file, "row", col, CAST(CAST(hh AS FLOAT) AS DOUBLE) AS hh, CAST(CAST(hv AS FLOAT) AS DOUBLE) AS hv FROM rg
  WHERE "row" BETWEEN {_BOX[0]} AND {_BOX[2]} AND col BETWEEN {_BOX[1]} AND {_BOX[3]}""")
def geotiff_float32(spark, sf_dir):
    """Two bands written as float32 GeoTIFF files and a window of them read back."""
    px, path = _regridded(spark, sf_dir), shared.new_folder(spark, "float32")
    geotiff.write_float32(px, _files(px), path, ["hh", "hv"], TILE)
    window = spark.read.format("geotiff").option("bands", "hh,hv").option("box", ",".join(map(str, _BOX))).load(path)
    there = px.select("file", "row", "col")  # the last file is not full: what is beyond its rows is no data
    return window.join(there, ["file", "row", "col"], "left_semi").select("file", "row", "col", "hh", "hv")


_BYTE = lambda c, v: f"CASE WHEN {v} > 0 THEN CAST(floor(least(1.0, greatest(0.0, (10 * log10({v}) - {LIMITS[c][0]}) / {LIMITS[c][1] - LIMITS[c][0]})) * 255 + 0.5) AS INTEGER) ELSE 0 END AS {c}"
_MEAN = lambda c: f"CAST(floor(least(1.0, greatest(0.0, (10 * log10(greatest(avg(pow(10, (coalesce({c}, 0) / 255.0 * {LIMITS[c][1] - LIMITS[c][0]} + {LIMITS[c][0]}) / 10)), 1e-10)) - {LIMITS[c][0]}) / {LIMITS[c][1] - LIMITS[c][0]})) * 255 + 0.5) AS INTEGER) AS {c}"


@query(f"""WITH {_AT}, px AS (SELECT file, "row", col, {_BYTE("r", "hh")}, {_BYTE("g", "hv")}, {_BYTE("b", "vv")}, CASE WHEN hh > 0 THEN 255 ELSE 0 END AS a FROM rg),
  f AS (SELECT DISTINCT file FROM px), grid AS (SELECT file, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM f, range({SIDE}) t(r), range({SIDE}) u(c)),
  allpx AS (SELECT file, "row", col, r, g, b, a FROM grid LEFT JOIN px USING (file, "row", col))
  SELECT file, CAST(k AS INTEGER) AS level, CAST("row" // s AS INTEGER) AS "row", CAST(col // s AS INTEGER) AS col, {_MEAN("r")}, {_MEAN("g")}, {_MEAN("b")}, CAST(floor(avg(coalesce(a, 0)) + 0.5) AS INTEGER) AS a
  FROM allpx, (VALUES (1, 2), (2, 4), (3, 8)) o(k, s) GROUP BY 1, 2, 3, 4""")
def geotiff_overviews(spark, sf_dir):
    """RGBA files with three overviews, averaged as powers, read back level by level."""
    byte = lambda v, c: F.when(F.col(v) > 0, rad.half_up(rad.normalise(rad.db(F.col(v)), *LIMITS[c]) * 255)).otherwise(0).cast("int").alias(c)
    px = _regridded(spark, sf_dir)
    shown = px.select("file", "row", "col", byte("hh", "r"), byte("hv", "g"), byte("vv", "b"), F.when(F.col("hh") > 0, 255).otherwise(0).alias("a"))
    path = shared.new_folder(spark, "rgba")
    geotiff.write_rgba(shown, _files(px), path, LIMITS, TILE)
    back = spark.read.format("geotiff").option("bands", "r,g,b,a").option("level", "overviews").load(path)
    return back.select("file", "level", "row", "col", *(F.col(c).cast("int").alias(c) for c in "rgba"))


@query(f"""WITH {_AT}, f AS (SELECT file, CAST(regexp_extract(file, '(\\d+)\\.tif', 1) AS INTEGER) AS k, max("row") + 1 AS height FROM rg GROUP BY 1, 2),
  b AS (SELECT 'hh-' || file AS file, k, {SIDE} AS width, {SIDE} AS height FROM f UNION ALL SELECT 'hv-' || file, k, {SIDE}, height FROM f)
  SELECT b.file, CAST(b.width AS INTEGER) AS width, CAST(b.height AS INTEGER) AS height, 'EPSG:32610' AS crs, -1 AS max_zoom, true AS projected,
    CASE WHEN b.height <> {SIDE} THEN 'error' END AS problem, CASE WHEN b.height <> {SIDE} THEN 'grid {SIDE}x' || b.height || ' is not {SIDE}x{SIDE}' END AS text FROM b""")
def geotiff_grids(spark, sf_dir):
    """Single-band files put together by scene: the second band, cut below its last row, must have the grid of the first."""
    px, path = _regridded(spark, sf_dir), shared.new_folder(spark, "grids")
    files = _files(px)
    cut = px.groupBy("file").agg((F.max("row") + 1).alias("_rows"))
    named = lambda df, band: df.withColumn("file", F.concat(F.lit(f"{band}-"), F.col("file")))
    geotiff.write_float32(named(px.withColumnRenamed("hh", "v"), "hh"), named(files, "hh"), path, ["v"], TILE)
    short = files.join(cut, "file").withColumn("height", F.col("_rows")).withColumn("y0", F.col("y1") - F.col("_rows") * 10.0).drop("_rows")
    geotiff.write_float32(named(px.withColumnRenamed("hv", "v"), "hv"), named(short, "hv"), path, ["v"], TILE)
    images = spark.read.format("geotiff").option("what", "images").load(path)
    scene = geotiff.describe(images).withColumn("scene", F.regexp_extract("file", r"(\d+)\.tif", 1))
    return geotiff.check_grids(scene, "scene", "file", strict=True).select("file", "width", "height", "crs", "max_zoom", "projected", "problem", "text")
