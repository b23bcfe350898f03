"""Queries of neighbourhood filters. Their SQL joins each pixel with all its neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import radiometry as rad
from ..operators import neighbourhood as nb
from ..sources import adapters as src
from .registry import query

KEYS = ["scene_id"]
PX = src.EVENT_RASTER_SQL


def _positive(spark, sf_dir):
    return src.event_raster(spark, sf_dir).withColumn("v", rad.positive(F.col("v")))


def _around(half: int) -> str:
    return f"""WITH {PX}, p AS (SELECT scene_id, "row", col, CASE WHEN v > 0 THEN v END AS v FROM px),
      m AS (SELECT a.scene_id, a."row", a.col, any_value(a.v) AS v, count(b.v) AS n, sum(b.v) AS s, sum(b.v * b.v) AS q, sum(b.v) / count(b.v) AS m,
        greatest(sum(b.v * b.v) / count(b.v) - (sum(b.v) / count(b.v)) ** 2, 0) AS var
        FROM p a LEFT JOIN p b ON a.scene_id = b.scene_id AND b."row" BETWEEN a."row" - {half} AND a."row" + {half} AND b.col BETWEEN a.col - {half} AND a.col + {half} GROUP BY 1, 2, 3),
      l AS (SELECT *, greatest(m + (CASE WHEN var > 0 THEN least(1, greatest(0, (var - m * m / 4) / var)) ELSE 0 END) * (v - m), 0) AS lee,
        CASE WHEN m > 0 THEN sqrt(var) / m ELSE 0 END AS cv FROM m)"""


def _out(expression: str, small: bool = True) -> str:
    few = "WHEN n < 2 THEN v" if small else ""
    return f'SELECT scene_id, "row", col, round(CASE WHEN v IS NULL THEN 0.0 {few} ELSE {expression} END, 8) AS out'


_GAMMA = """g AS (SELECT *, cv * cv AS cv2, (1 + 0.25) / greatest(cv * cv - 0.25, 1e-10) AS al FROM l), h AS (SELECT *, al - 5 AS a, m * m * (al - 5) * (al - 5) + 16 * al * v * m AS d FROM g)"""

_SPECKLE = {
    "boxcar": ("boxcar", _around(3) + " " + _out("s / n", small=False) + " FROM m"),
    "lee": ("lee", _around(3) + " " + _out("lee") + " FROM l"),
    "enhanced_lee": ("enhanced-lee", _around(3) + " " + _out("CASE WHEN cv <= 0.5 THEN m WHEN cv >= sqrt(1.5) THEN v ELSE lee END") + " FROM l"),
    "gamma_map": ("gamma-map", _around(3) + ", " + _GAMMA + " " + _out("CASE WHEN cv2 <= 0.25 THEN m WHEN cv2 >= 2.25 / 4 THEN v WHEN d < 0 THEN lee ELSE greatest((a * m + sqrt(d)) / (2 * al), 0) END") + " FROM h"),
}


def _speckle_query(kind: str):
    def run(spark, sf_dir):
        return nb.speckle(_positive(spark, sf_dir), kind, KEYS).select(*KEYS, "row", "col", F.round("out", 8).alias("out"))

    run.__doc__ = f"7 x 7 {kind} filter."
    return run


for _name, (_kind, _sql) in _SPECKLE.items():
    query(_sql, f"speckle_{_name}")(_speckle_query(_kind))


@query(_around(2) + """, f AS (SELECT m.*, CASE WHEN m > 0 THEN var / (m * m) ELSE 0 END AS alpha FROM m WHERE v IS NOT NULL),
  w AS (SELECT f.scene_id, f."row", f.col, sum(exp(-alpha * sqrt((b."row" - f."row") ** 2 + (b.col - f.col) ** 2)) * b.v) / sum(exp(-alpha * sqrt((b."row" - f."row") ** 2 + (b.col - f.col) ** 2))) AS fr
    FROM f JOIN p b ON f.scene_id = b.scene_id AND b."row" BETWEEN f."row" - 2 AND f."row" + 2 AND b.col BETWEEN f.col - 2 AND f.col + 2 WHERE b.v IS NOT NULL GROUP BY 1, 2, 3)
  SELECT m.scene_id, m."row", m.col, round(CASE WHEN v IS NULL THEN 0.0 WHEN n < 2 THEN v ELSE fr END, 6) AS out FROM m LEFT JOIN w USING (scene_id, "row", col)""")
def speckle_frost(spark, sf_dir):
    """5 x 5 Frost filter; its weights depend on the centre."""
    return nb.speckle(_positive(spark, sf_dir), "frost", KEYS, kernel=5).select(*KEYS, "row", "col", F.round("out", 6).alias("out"))


@query(_around(1) + ' SELECT scene_id, "row", col, round(coalesce(CASE WHEN n > 0 THEN s / n END, v), 6) AS out FROM m')
def smooth_band(spark, sf_dir):
    """3 x 3 mean that fills holes."""
    return nb.smooth(_positive(spark, sf_dir), KEYS).select(*KEYS, "row", "col", F.round("out", 6).alias("out"))


@query(_around(8) + """, g AS (SELECT scene_id, avg(v) AS g FROM p GROUP BY 1)
  SELECT scene_id, "row", col, CAST(CASE WHEN v IS NULL THEN 0 ELSE greatest(0, least(255, floor(ln(v * (1 + 0.3 * (g / m - 1)) + 1) / ln(g * 5 + 1) * 255 + 0.5))) END AS INTEGER) AS byte FROM m JOIN g USING (scene_id)""")
def tone_local_contrast(spark, sf_dir):
    """Local contrast enhancement over 17 x 17 means."""
    return nb.local_contrast(_positive(spark, sf_dir), KEYS).select(*KEYS, "row", "col", "byte")


def _lanczos_sql(n: int, m: int) -> str:
    scale, reach = n / m, -(-3 * n // m)
    weights = f"""SELECT t, s, x, CASE WHEN x = 0 THEN 1 WHEN abs(x) >= 3 THEN 0 ELSE 3 * sin(pi() * x) * sin(pi() * x / 3) / (pi() * x * pi() * x) END AS w
      FROM (SELECT t, s, (s - ((t + 0.5) * {scale} - 0.5)) / {scale} AS x FROM range({m}) a(t), range({n}) b(s)
      WHERE s BETWEEN floor((t + 0.5) * {scale} - 0.5 - {reach}) AND ceil((t + 0.5) * {scale} - 0.5 + {reach}))"""
    step = lambda axis, other, frm: f"""SELECT scene_id, t AS {axis}, {other}, CASE WHEN sum(w) > 0 THEN greatest(0, sum(w * v) / sum(w)) ELSE 0 END AS v FROM {frm} JOIN k ON {axis} = s WHERE v > 0 GROUP BY 1, 2, 3"""
    one, two = step("col", '"row"', "px"), step('"row"', "col", "h")
    return f"WITH {PX}, k AS ({weights}), h AS ({one}), z AS ({two}) SELECT scene_id, CAST(\"row\" AS INTEGER) AS \"row\", CAST(col AS INTEGER) AS col, round(v, 6) AS v FROM z"


@query(_lanczos_sql(100, 40))
def lanczos_downsample(spark, sf_dir):
    """Lanczos-3 reduction of each scene from 100 x 100 to 40 x 40."""
    out = nb.lanczos(src.event_raster(spark, sf_dir), KEYS, (100, 100), (40, 40))
    return out.select(*KEYS, "row", "col", F.round("v", 6).alias("v"))


