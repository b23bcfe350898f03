"""Queries of geodesy and grid arithmetic, over granule footprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..sources import adapters as src
from .registry import query

G = src.GRANULES_SQL
R = lambda c, n=6: F.round(c, n)
_N = f"{geo.A} / sqrt(1 - {geo.E2!r} * sin(radians(y0)) ** 2)"
_H = "(id % 900)"
_ECEF = f"""e AS (SELECT id, ({_N} + {_H}) * cos(radians(y0)) * cos(radians(x0)) AS x, ({_N} + {_H}) * cos(radians(y0)) * sin(radians(x0)) AS y, ({_N} * {1 - geo.E2!r} + {_H}) * sin(radians(y0)) AS z FROM granules)"""


@query(f"WITH {G}, {_ECEF} SELECT e.id, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(y0, 6) AS lat, round(x0, 6) AS lon, round(CAST({_H.replace('id', 'e.id')} AS DOUBLE), 2) AS height FROM e JOIN granules USING (id)")
def ecef_roundtrip(spark, sf_dir):
    """Geodetic to earth-centred coordinates and back; the SQL has the inputs as what must come back."""
    g = src.granules(spark, sf_dir).withColumn("h", F.pmod("id", F.lit(900)).cast("double"))
    x, y, z = geo.to_ecef(F.col("y0"), F.col("x0"), F.col("h"))
    e = g.select("id", x.alias("x"), y.alias("y"), z.alias("z"))
    lat, lon, height = geo.from_ecef(F.col("x"), F.col("y"), F.col("z"))
    return e.select("id", *(R(F.col(c), 3).alias(c) for c in "xyz"), R(lat).alias("lat"), R(lon).alias("lon"), R(height, 2).alias("height"))


_U = (0.8, 0.6, 0.0)
_V = (-0.36, 0.48, 0.8)


@query(f"""WITH {G}, {_ECEF}, o AS (SELECT x AS ox, y AS oy, z AS oz FROM e WHERE id = 0),
  d AS (SELECT id, x - ox AS dx, y - oy AS dy, z - oz AS dz FROM e, o)
  SELECT id, round((dx * {_U[0]} + dy * {_U[1]} + dz * {_U[2]}) / 10 + 500, 3) AS "row", round((dx * {_V[0]} + dy * {_V[1]} + dz * {_V[2]}) / 12.5 + 800, 3) AS col FROM d""")
def sicd_ground_to_image(spark, sf_dir):
    """Ground points to image rows and columns, by unit vectors around a scene centre (the first granule)."""
    g = src.granules(spark, sf_dir).withColumn("h", F.pmod("id", F.lit(900)).cast("double"))
    x, y, z = geo.to_ecef(F.col("y0"), F.col("x0"), F.col("h"))
    e = g.select("id", x.alias("x"), y.alias("y"), z.alias("z"))
    centre = e.where("id = 0").select(*(F.col(c).alias(f"o{c}") for c in "xyz"))
    d = e.join(F.broadcast(centre))  # one row
    dot = lambda u: sum(((F.col(c) - F.col(f"o{c}")) * w for c, w in zip("xyz", u, strict=True)), F.lit(0.0))
    return d.select("id", R(dot(_U) / 10 + 500, 3).alias("row"), R(dot(_V) / 12.5 + 800, 3).alias("col"))


@query(f"""WITH {G}, f AS (SELECT id, (x0 + 130) / 22 * 512 AS a, (x1 + 130) / 22 * 512 AS b, (y0 - 47) / (30.0 - 47) * 400 AS c, (y1 - 47) / (30.0 - 47) * 400 AS d FROM granules)
  SELECT id, CAST(least(511, greatest(0, floor(least(a, b)))) AS INTEGER) AS c0, CAST(least(511, greatest(0, ceil(greatest(a, b)) - 1)) AS INTEGER) AS c1,
  CAST(least(399, greatest(0, floor(least(c, d)))) AS INTEGER) AS r0, CAST(least(399, greatest(0, ceil(greatest(c, d)) - 1)) AS INTEGER) AS r1 FROM f""")
def bbox_pixel_range(spark, sf_dir):
    """Footprints to pixel ranges of a raster whose rows run south."""
    c0, c1 = geo.pixel_range(F.col("x0"), F.col("x1"), -130.0, -108.0, 512)
    r0, r1 = geo.pixel_range(F.col("y0"), F.col("y1"), 47.0, 30.0, 400)
    return src.granules(spark, sf_dir).select("id", c0.alias("c0"), c1.alias("c1"), r0.alias("r0"), r1.alias("r1"))


@query(f"""WITH {G}, w AS (SELECT id, CAST(floor((x0 + 130) / 0.5) AS INTEGER) AS a, CAST(floor((x1 + 130) / 0.5) AS INTEGER) AS b, CAST(floor((y0 - 30) / 0.5) AS INTEGER) AS c, CAST(floor((y1 - 30) / 0.5) AS INTEGER) AS d FROM granules)
  SELECT cx, cy, count(*) AS n FROM (SELECT unnest(range(a // 4, b // 4 + 1)) AS cx, c, d FROM w), LATERAL (SELECT unnest(range(c // 4, d // 4 + 1)) AS cy) GROUP BY 1, 2""")
def chunk_grid_cover(spark, sf_dir):
    """How many footprints touch each chunk of a grid: pixel ranges, then chunk ranges."""
    at = lambda c, o: F.floor(F.floor((F.col(c) - o) / 0.5) / 4).cast("int")
    g = src.granules(spark, sf_dir).select(F.explode(F.sequence(at("x0", -130), at("x1", -130))).alias("cx"), at("y0", 30).alias("a"), at("y1", 30).alias("b"))
    return g.select("cx", F.explode(F.sequence("a", "b")).alias("cy")).groupBy("cx", "cy").agg(F.count("*").alias("n"))


def _utm_sql() -> str:
    e2, ep2 = geo.E2, geo.EP2
    return f"""WITH {G}, q AS (SELECT id, radians(y0) AS p, radians(x0 + 123) AS lam FROM granules),
      k AS (SELECT id, p, {geo.A} / sqrt(1 - {e2!r} * sin(p) ** 2) AS n, tan(p) ** 2 AS t, {ep2!r} * cos(p) ** 2 AS c, lam * cos(p) AS a,
        {geo.A} * ({1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256!r} * p - {3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024!r} * sin(2 * p) + {15 * e2**2 / 256 + 45 * e2**3 / 1024!r} * sin(4 * p) - {35 * e2**3 / 3072!r} * sin(6 * p)) AS m FROM q)
      SELECT id, round(0.9996 * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - {58 * ep2!r}) * a ** 5 / 120) + 500000, 3) AS easting,
        round(0.9996 * (m + n * tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - {330 * ep2!r}) * a ** 6 / 720)), 3) AS northing FROM k"""


@query(_utm_sql())
def utm_forward(spark, sf_dir):
    """Corners of footprints in UTM zone 10."""
    east, north = geo.utm_forward(F.col("x0"), F.col("y0"), 10)
    return src.granules(spark, sf_dir).select("id", R(east, 3).alias("easting"), R(north, 3).alias("northing"))


@query(f"""WITH {G}, w AS (SELECT id, 0.02 * pow(id % 111 + 1, 2) AS span, 0.25 * (id % 37) AS high FROM granules), r AS (SELECT id, span, high, span / 5 AS raw, pow(10, floor(log10(span / 5))) AS base FROM w)
  SELECT id, CAST(CASE WHEN greatest(span, high) > 180 THEN 0 WHEN greatest(span, high) > 90 THEN 1 WHEN greatest(span, high) > 45 THEN 2 WHEN greatest(span, high) > 20 THEN 3 WHEN greatest(span, high) > 10 THEN 4 WHEN greatest(span, high) > 5 THEN 5
    WHEN greatest(span, high) > 2 THEN 6 WHEN greatest(span, high) > 1 THEN 7 WHEN greatest(span, high) > 0.5 THEN 8 WHEN greatest(span, high) > 0.2 THEN 9 WHEN greatest(span, high) > 0.1 THEN 10 ELSE 11 END AS INTEGER) AS zoom, round(base * CASE WHEN raw / base < 1.5 THEN 1 WHEN raw / base < 3.5 THEN 2 WHEN raw / base < 7.5 THEN 5 ELSE 10 END, 8) AS step FROM r""")
def zoom_and_ticks(spark, sf_dir):
    """Map zoom and a nice tick step for boxes of different widths."""
    span, high = 0.02 * F.pow(F.pmod("id", F.lit(111)) + 1, F.lit(2)), 0.25 * F.pmod("id", F.lit(37))
    return src.granules(spark, sf_dir).select("id", geo.zoom_for(span, high).alias("zoom"), R(geo.nice_step(span), 8).alias("step"))


@query(f"""WITH {G}, m AS (SELECT id, 'PROJCS["UTM",AUTHORITY["EPSG","' || CAST(32600 + id % 60 + 1 AS VARCHAR) || '"]]' AS wkt, (id % 1000) * 10000 AS max_y FROM granules)
  SELECT id, CAST(regexp_extract(wkt, 'EPSG","([0-9]+)', 1) AS INTEGER) AS epsg, CASE WHEN max_y > 5500000 THEN 'south' ELSE 'north' END AS hemisphere FROM m""")
def epsg_parse(spark, sf_dir):
    """EPSG codes out of CRS texts, and the hemisphere that a northing suggests."""
    wkt = F.format_string('PROJCS["UTM",AUTHORITY["EPSG","%d"]]', 32600 + F.pmod("id", F.lit(60)) + 1)
    g = src.granules(spark, sf_dir).select("id", wkt.alias("wkt"), (F.pmod("id", F.lit(1000)) * 10000).alias("max_y"))
    return g.select("id", geo.epsg_from_wkt(F.col("wkt")).alias("epsg"), F.when(F.col("max_y") > 5_500_000, "south").otherwise("north").alias("hemisphere"))
