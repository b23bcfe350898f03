"""Rasters and catalogues read from the event, order and line-item tables.

Pixels are long rows (scene_id, row, col, value), null where there is no data. Scenes have a fixed size, so a larger
table means more scenes, and everything that is keyed by scene spreads with them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_WIDTH = 100
EVENT_SCENE = EVENT_WIDTH * EVENT_WIDTH
BAND_WIDTH = 125
BAND_SCENE = BAND_WIDTH * BAND_WIDTH


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single band: 100 x 100 scenes of event values; error events are nodata."""
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(key / EVENT_SCENE).cast("int").alias("scene_id"),
        F.floor(F.pmod(key, F.lit(EVENT_SCENE)) / EVENT_WIDTH).cast("int").alias("row"),
        F.pmod(key, F.lit(EVENT_WIDTH)).cast("int").alias("col"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("v"),
    )


#: The same raster in SQL, for oracles.
EVENT_RASTER_SQL = f"""px AS (SELECT CAST(event_id // {EVENT_SCENE} AS INTEGER) AS scene_id,
  CAST((event_id % {EVENT_SCENE}) // {EVENT_WIDTH} AS INTEGER) AS "row", CAST(event_id % {EVENT_WIDTH} AS INTEGER) AS col,
  CASE WHEN event_type <> 'error' THEN value END AS v FROM events)"""


def band_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three power bands on 125 x 125 scenes, a pixel an order; orders without lines are holes in all bands.

    Sums are decimal, so they do not depend on the order of rows.
    """
    line, key = table(spark, sf_dir, "lineitem"), F.col("o_orderkey")
    exact = lambda c: F.sum(c.cast("decimal(18,4)")).cast("double")
    price = F.col("l_extendedprice")
    bands = line.groupBy("l_orderkey").agg(exact(price).alias("hh"), exact(price * F.col("l_discount")).alias("hv"), exact(price * F.col("l_tax")).alias("vv"))
    grid = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.floor(key / BAND_SCENE).cast("int").alias("scene_id"),
        F.floor(F.pmod(key, F.lit(BAND_SCENE)) / BAND_WIDTH).cast("int").alias("row"),
        F.pmod(key, F.lit(BAND_WIDTH)).cast("int").alias("col"),
    )
    return grid.join(bands, key == F.col("l_orderkey"), "left").select("scene_id", "row", "col", "hh", "hv", "vv")


BAND_RASTER_SQL = f"""bands AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS hh,
    CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS hv,
    CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) AS DOUBLE) AS vv FROM lineitem GROUP BY l_orderkey),
  mb AS (SELECT CAST(o_orderkey // {BAND_SCENE} AS INTEGER) AS scene_id, CAST((o_orderkey % {BAND_SCENE}) // {BAND_WIDTH} AS INTEGER) AS "row",
    CAST(o_orderkey % {BAND_WIDTH} AS INTEGER) AS col, hh, hv, vv FROM orders LEFT JOIN bands ON o_orderkey = l_orderkey)"""


def complex_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complex band: each event as amplitude ``value`` and a phase from its user, on the event scenes.

    Cosines and sines of whole degrees come from two arrays: the JVM's own differ in the last bit from those of other engines, which
    decides whether an amplitude at a limit is above it.
    """
    degree, key = F.pmod(F.col("user_id"), F.lit(360)).cast("int"), F.col("event_id")
    cosine, sine = (F.get(F.lit([f(k * (3.141592653589793 / 180)) for k in range(360)]), degree) for f in (math.cos, math.sin))
    valid = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").select(
        F.floor(key / EVENT_SCENE).cast("int").alias("scene_id"),
        F.floor(F.pmod(key, F.lit(EVENT_SCENE)) / EVENT_WIDTH).cast("int").alias("row"),
        F.pmod(key, F.lit(EVENT_WIDTH)).cast("int").alias("col"),
        F.when(valid, F.col("value") * cosine).alias("re"),
        F.when(valid, F.col("value") * sine).alias("im"),
    )


COMPLEX_RASTER_SQL = f"""cx AS (SELECT CAST(event_id // {EVENT_SCENE} AS INTEGER) AS scene_id,
  CAST((event_id % {EVENT_SCENE}) // {EVENT_WIDTH} AS INTEGER) AS "row", CAST(event_id % {EVENT_WIDTH} AS INTEGER) AS col,
  CASE WHEN event_type <> 'error' THEN value * cos((user_id % 360) * (3.141592653589793 / 180)) END AS re,
  CASE WHEN event_type <> 'error' THEN value * sin((user_id % 360) * (3.141592653589793 / 180)) END AS im FROM events)"""


def stac_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue items: an event each, in the collection of its type, with a one-degree footprint from its user."""
    west, south = F.pmod(F.col("user_id"), F.lit(340)) - 170, F.pmod(F.col("user_id") * 7, F.lit(160)) - 80
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("collection"),
        F.col("ts").alias("datetime"),
        F.array(*(c.cast("double") for c in (west, south, west + 1, south + 1))).alias("bbox"),
        F.col("props").alias("properties"),
    )


STAC_ITEMS_SQL = """items AS (SELECT event_id AS id, event_type AS collection, ts AS datetime,
  CAST(user_id % 340 - 170 AS DOUBLE) AS x0, CAST((user_id * 7) % 160 - 80 AS DOUBLE) AS y0,
  CAST(user_id % 340 - 169 AS DOUBLE) AS x1, CAST((user_id * 7) % 160 - 79 AS DOUBLE) AS y1, props AS properties FROM events)"""


def granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Granules: an order each, with a rectangular footprint from its customer and modes from its other columns."""
    west, south = F.pmod(F.col("o_custkey"), F.lit(20)) - 130, F.pmod(F.col("o_custkey") * 3, F.lit(15)) + 30
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("start_ts"),
        F.when(F.col("o_orderpriority").startswith("1"), "DHDH").otherwise("SHNA").alias("pol_mode"),
        (F.col("o_orderstatus") == "F").alias("full_frame"),
        *(c.cast("double").alias(n) for n, c in (("x0", west), ("y0", south), ("x1", west + 2), ("y1", south + 2))),
    )


GRANULES_SQL = """granules AS (SELECT o_orderkey AS id, o_orderdate AS start_ts,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'DHDH' ELSE 'SHNA' END AS pol_mode, o_orderstatus = 'F' AS full_frame,
  CAST(o_custkey % 20 - 130 AS DOUBLE) AS x0, CAST((o_custkey * 3) % 15 + 30 AS DOUBLE) AS y0,
  CAST(o_custkey % 20 - 128 AS DOUBLE) AS x1, CAST((o_custkey * 3) % 15 + 32 AS DOUBLE) AS y1 FROM orders)"""
