"""Queries of text ranking, byte rendering and map arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import radiometry as rad
from ..sources import adapters as src
from .registry import query

PX, G = src.EVENT_RASTER_SQL, src.GRANULES_SQL
ASKED = "brn2"


def fuzzy_score(label: Column, other: Column, asked: str) -> Column:
    """1000 less the place of ``asked`` in a label; else up to 150 for its letters in order, denser and earlier is better; else 50 in the other text."""
    low, at = F.lower(label), F.locate(asked, F.lower(label))
    head = re.escape(asked[0])
    # the shortest prefix of the label that holds all letters in order, from the first letter on
    tail = F.regexp_extract(low, f"{head}" + "".join(f".*?{re.escape(c)}" for c in asked[1:]), 0)
    first = F.locate(asked[0], low) - 1
    spread = 100 + F.floor(len(asked) / F.length(tail) * 50 + 0.5) - first
    return F.when(at > 0, 1001 - at).when(F.length(tail) > 0, spread).when(F.locate(asked, F.lower(other)) > 0, 50).otherwise(0).cast("int")


@query(f"""WITH p AS (SELECT p_partkey, lower(p_brand || ' ' || p_name) AS label, lower(p_type) AS other FROM part), t AS (SELECT *, regexp_extract(label, 'b.*?r.*?n.*?2') AS tail FROM p)
  SELECT p_partkey, CAST(CASE WHEN instr(label, '{ASKED}') > 0 THEN 1001 - instr(label, '{ASKED}') WHEN length(tail) > 0 THEN 100 + floor(4 / length(tail) * 50 + 0.5) - (instr(label, 'b') - 1)
  WHEN instr(other, '{ASKED}') > 0 THEN 50 ELSE 0 END AS INTEGER) AS score FROM t""")
def fuzzy_scores(spark, sf_dir):
    """How well labels fit typed letters."""
    p = src.table(spark, sf_dir, "part")
    return p.select("p_partkey", fuzzy_score(F.concat_ws(" ", "p_brand", "p_name"), F.col("p_type"), ASKED).alias("score"))


@query(f"""WITH {PX}, l AS (SELECT scene_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1) SELECT scene_id, "row", col, CAST(CASE WHEN v IS NULL OR hi = lo THEN 0 ELSE floor((v - lo) / (hi - lo) * 255 + 0.5) END AS INTEGER) AS byte FROM px JOIN l USING (scene_id)""")
def byte_normalise(spark, sf_dir):
    """Values as bytes over each scene's range; what is missing, and all of a flat scene, is 0."""
    px = src.event_raster(spark, sf_dir)
    limits = px.groupBy("scene_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = F.col("hi") - F.col("lo")
    byte = F.when(F.col("v").isNull() | (span == 0), 0).otherwise(rad.half_up((F.col("v") - F.col("lo")) / F.when(span != 0, span) * 255))
    return px.join(limits, "scene_id").select("scene_id", "row", "col", byte.cast("int").alias("byte"))


@query(f"""WITH {G} SELECT id, round(radians(x0) * {geo.A}, 3) AS first_x, round(ln(tan(pi() / 4 + radians(y0) / 2)) * {geo.A}, 3) AS first_y, round(radians(x1) * {geo.A}, 3) AS third_x, 5::INTEGER AS points, round(156543.03392804097 * cos(radians(y0)) / 256, 6) AS metres_per_pixel FROM granules""")
def reproject_features(spark, sf_dir):
    """Rings of footprints in Mercator metres, point by point, and metres a pixel at zoom 8."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1"), point("x0", "y0"))
    moved = F.transform(ring, lambda p: F.struct((F.radians(p["x"]) * geo.A).alias("x"), (F.log(F.tan(F.lit(0.7853981633974483) + F.radians(p["y"]) / 2)) * geo.A).alias("y")))
    g = src.granules(spark, sf_dir).select("id", "y0", moved.alias("ring"))
    metres = 156543.03392804097 * F.cos(F.radians("y0")) / 256
    return g.select("id", F.round(F.col("ring")[0]["x"], 3).alias("first_x"), F.round(F.col("ring")[0]["y"], 3).alias("first_y"), F.round(F.col("ring")[2]["x"], 3).alias("third_x"), F.size("ring").alias("points"), F.round(metres, 6).alias("metres_per_pixel"))


@query("""WITH s AS (SELECT o_orderkey AS id, CAST(o_totalprice * 400 AS BIGINT) AS bytes FROM orders) SELECT id, CASE WHEN bytes <= 25165824 THEN 1 WHEN bytes / 4 <= 25165824 THEN 2 WHEN bytes / 16 <= 25165824 THEN 4 ELSE 8 END AS level FROM s""")
def overview_ladder(spark, sf_dir):
    """The densest overview of each file that fits a tile's budget of 24 MB; the coarsest where none does."""
    size = (F.col("o_totalprice") * 400).cast("decimal(30,6)")
    whole = F.round(size, 0).cast("long")
    level = F.coalesce(*(F.when(whole / (k * k) <= 24 * 1024 * 1024, F.lit(k)) for k in (1, 2, 4)), F.lit(8))
    return src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), level.alias("level"))
