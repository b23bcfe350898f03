"""Queries of multi-band radiometry: indices, composites, rendering, colour, complex phase, series over time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import colour, colormaps
from ..functions import radiometry as rad
from ..operators import cube
from ..sources import adapters as src
from .registry import query

AT = ["scene_id", "row", "col"]
MB = src.BAND_RASTER_SQL
PX = src.EVENT_RASTER_SQL
R = lambda c, n=6: F.round(c, n)
_AT = 'scene_id, "row", col'
_clamp = lambda x: f"least(1.0, greatest(0.0, {x}))"


@query(f'WITH {MB} SELECT {_AT}, round(CASE WHEN hh + vv + 2 * hv > 0 THEN 8 * hv / (hh + vv + 2 * hv) END, 6) AS rvi FROM mb')
def rvi_quad(spark, sf_dir):
    """Radar vegetation index of three bands."""
    return src.band_raster(spark, sf_dir).select(*AT, R(rad.rvi_quad(F.col("hh"), F.col("hv"), F.col("vv"))).alias("rvi"))


@query(f'WITH {MB} SELECT {_AT}, round(CASE WHEN hh + hv > 0 THEN 4 * hv / (hh + hv) END, 6) AS rvi FROM mb')
def rvi_dual(spark, sf_dir):
    """Radar vegetation index of two bands."""
    return src.band_raster(spark, sf_dir).select(*AT, R(rad.rvi_dual(F.col("hh"), F.col("hv"))).alias("rvi"))


@query(f'WITH {MB} SELECT {_AT}, coalesce(hh, 0) AS r, coalesce(hv, 0) AS g, round(coalesce(hh, 0) / greatest(coalesce(hv, 0), 1e-10), 6) AS b FROM mb WHERE hv > 0 OR hv IS NULL')
def composite_dual_pol_h(spark, sf_dir):
    """Co, cross and their ratio; a missing band is zero."""
    bands = src.band_raster(spark, sf_dir).where("hv > 0 OR hv IS NULL")
    r, g, b = rad.dual_pol_composite(F.coalesce("hh", F.lit(0.0)), F.coalesce("hv", F.lit(0.0)))
    return bands.select(*AT, r.alias("r"), g.alias("g"), R(b).alias("b"))


@query(f'WITH {MB} SELECT {_AT}, round(abs(hh - vv), 4) AS r, hv AS g, round(hh + vv, 4) AS b FROM mb')
def composite_pauli_power(spark, sf_dir):
    """Difference, cross band and sum."""
    r, g, b = rad.pauli_power(F.col("hh"), F.col("hv"), F.col("vv"))
    return src.band_raster(spark, sf_dir).select(*AT, R(r, 4).alias("r"), g.alias("g"), R(b, 4).alias("b"))


@query(f"""WITH {MB}, x AS (SELECT *, hh AS c11, hv / 4 AS c22, vv * 10 AS c33, sqrt(hh * vv * 10) * 0.5 AS re, sqrt(hh * vv) * 0.25 AS im FROM mb WHERE hh IS NOT NULL),
  y AS (SELECT *, c11 + 2 * c22 + c33 AS span, c11 - 2 * c22 AS a, c33 - 2 * c22 AS b, re - c22 AS cr FROM x),
  z AS (SELECT *, cr * cr + im * im AS q, a * b AS det, a > 0 AND b > 0 AS ok FROM y),
  p AS (SELECT *, CASE WHEN span <= 1e-20 OR NOT ok THEN 0.0 ELSE greatest(0.0, CASE WHEN cr >= 0 THEN b WHEN det > q THEN b - q / a ELSE 0 END) END AS ps,
    CASE WHEN span <= 1e-20 OR NOT ok THEN 0.0 ELSE greatest(0.0, CASE WHEN cr < 0 THEN a WHEN det > q THEN a - q / b ELSE 0 END) END AS pd FROM z)
  SELECT {_AT}, round(pd, 6) AS r, round(CASE WHEN span <= 1e-20 THEN 0.0 WHEN ok THEN greatest(span - ps - pd, 0.0) ELSE span END, 6) AS g, round(ps, 6) AS b FROM p""")
def freeman_durden(spark, sf_dir):
    """Three-component decomposition: double bounce, volume, surface."""
    hh, hv, vv = F.col("hh"), F.col("hv"), F.col("vv")
    ps, pd, pv = rad.freeman_durden(hh, hv / 4, vv * 10, F.sqrt(hh * vv * 10) * 0.5, F.sqrt(hh * vv) * 0.25)
    safe = src.band_raster(spark, sf_dir).where(hh.isNotNull())
    return safe.select(*AT, R(pd, 6).alias("r"), R(pv, 6).alias("g"), R(ps, 6).alias("b"))


_RGB = {"hh": (30.0, 55.0), "hv": (10.0, 45.0), "vv": (10.0, 42.0)}


def _byte(c: str, curve: str = "{t}") -> str:
    lo, hi = _RGB[c]
    t = _clamp(f"(10 * log10(greatest({c}, 1e-10)) - {lo}) / {hi - lo}")
    return f"CAST(CASE WHEN {c} <> 0 THEN floor({curve.format(t=t)} * 255 + 0.5) ELSE 0 END AS INTEGER)"


@query(f'WITH {MB} SELECT {_AT}, {_byte("hh", "sqrt({t})")} AS r, {_byte("hv", "sqrt({t})")} AS g, {_byte("vv", "sqrt({t})")} AS b, CASE WHEN hh <> 0 OR hv <> 0 OR vv <> 0 THEN 255 ELSE 0 END AS a FROM mb')
def rgba_render(spark, sf_dir):
    """Bytes of a composite: dB, range, square-root stretch; transparent where all bands are missing."""
    shown = {c: F.coalesce(rad.channel_byte(F.col(c), *_RGB[c], kind="sqrt"), F.lit(0)) for c in _RGB}
    seen = F.coalesce(*(rad.nonzero(F.col(c)) for c in _RGB)).isNotNull()
    return src.band_raster(spark, sf_dir).select(*AT, shown["hh"].alias("r"), shown["hv"].alias("g"), shown["vv"].alias("b"), F.when(seen, 255).otherwise(0).alias("a"))


_T = _clamp("(10 * log10(v) - 5.0) / 22.0")


@query(f"""WITH {PX}, t AS (SELECT {_AT}, {_T} AS t FROM px WHERE v > 0) SELECT {_AT}, round(t, 6) AS linear, round(sqrt(t), 6) AS sqrt, round(pow(t, 1.0/3), 6) AS cbrt,
  round(ln(1 + 100 * t) / ln(101), 6) AS log, round(pow(t, 0.7), 6) AS gamma, round({_clamp("(1 / (1 + exp(-8 * (t - 0.5))) - 1 / (1 + exp(4))) / (1 / (1 + exp(-4)) - 1 / (1 + exp(4)))")}, 6) AS sigmoid FROM t""")
def stretch_all(spark, sf_dir):
    """All tone curves of the same normalised value."""
    px = src.event_raster(spark, sf_dir).where("v > 0").withColumn("t", rad.normalise(rad.db(F.col("v")), 5.0, 27.0))
    return px.select(*AT, *(R(rad.stretch(F.col("t"), k, 0.7 if k == "gamma" else 1.0)).alias(k) for k in ("linear", "sqrt", "cbrt", "log", "gamma", "sigmoid")))


@query(f"""WITH {MB}, s AS (SELECT {_AT}, hh / (hh + hv + vv) AS r, hv / (hh + hv + vv) AS g, vv / (hh + hv + vv) AS b FROM mb WHERE hh + hv + vv > 0), l AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS y FROM s)
  SELECT {_AT}, round({_clamp('y + 1.4 * (r - y)')}, 6) AS r, round({_clamp('y + 1.4 * (g - y)')}, 6) AS g, round({_clamp('y + 1.4 * (b - y)')}, 6) AS b FROM l""")
def saturation(spark, sf_dir):
    """Saturation of normalised bands around luma."""
    total = F.col("hh") + F.col("hv") + F.col("vv")
    px = src.band_raster(spark, sf_dir).where(total > 0).select(*AT, *((F.col(c) / total).alias(n) for c, n in (("hh", "r"), ("hv", "g"), ("vv", "b"))))
    return px.select(*AT, *(R(c).alias(n) for c, n in zip(rad.saturate(F.col("r"), F.col("g"), F.col("b"), 1.4), "rgb", strict=True)))


_h = lambda x: f"CASE WHEN {x} > 0 THEN -({x} / t) * ln({x} / t) / ln(3.0) ELSE 0 END"


@query(f"WITH {MB}, e AS (SELECT *, hh + hv + vv AS t FROM mb WHERE hh + hv + vv > 0) SELECT {_AT}, round({_clamp(_h('hh') + ' + ' + _h('hv') + ' + ' + _h('vv'))}, 6) AS entropy, round(CASE WHEN hv + vv > 0 THEN {_clamp('(greatest(hv, vv) - least(hv, vv)) / (hv + vv)')} ELSE 0 END, 6) AS anisotropy FROM e")
def entropy_anisotropy(spark, sf_dir):
    """Entropy and anisotropy with the band powers as eigenvalues."""
    hh, hv, vv = F.col("hh"), F.col("hv"), F.col("vv")
    px = src.band_raster(spark, sf_dir).where(hh + hv + vv > 0)
    return px.select(*AT, R(rad.entropy3(hh, hv, vv)).alias("entropy"), R(rad.anisotropy(F.greatest(hv, vv), F.least(hv, vv))).alias("anisotropy"))


@query(f'WITH {src.COMPLEX_RASTER_SQL} SELECT {_AT}, round(atan2(im, re), 6) AS phase, round(sqrt(re * re + im * im), 6) AS magnitude FROM cx WHERE re IS NOT NULL')
def complex_phase_magnitude(spark, sf_dir):
    """Phase and magnitude of a complex band."""
    re, im = F.col("re"), F.col("im")
    return src.complex_raster(spark, sf_dir).where(re.isNotNull()).select(*AT, R(rad.phase(re, im)).alias("phase"), R(rad.magnitude(re, im)).alias("magnitude"))


_WAVELENGTH = 299792458 / 1.257e9


@query(f"""WITH {src.COMPLEX_RASTER_SQL}, x AS (SELECT {_AT}, atan2(im, re) - (0.001 * "row" + 0.002 * col) AS p, 30 + 15.0 * col / 99 AS inc FROM cx WHERE re IS NOT NULL)
  SELECT {_AT}, round(p * {_WAVELENGTH} / (4 * pi()), 8) AS los, round(p * {_WAVELENGTH} / (4 * pi()) / cos(radians(inc)), 8) AS vertical FROM x WHERE inc BETWEEN 32 AND 43""")
def los_displacement(spark, sf_dir):
    """Corrected phase to line-of-sight and vertical displacement, within an incidence range."""
    px = src.complex_raster(spark, sf_dir).where("re is not null").withColumn("inc", 30 + 15.0 * F.col("col") / 99).where(F.col("inc").between(32, 43))
    corrected = rad.phase(F.col("re"), F.col("im")) - (0.001 * F.col("row") + 0.002 * F.col("col"))
    los = rad.los_displacement(corrected, _WAVELENGTH)
    return px.select(*AT, R(los, 8).alias("los"), R(los / F.cos(F.radians("inc")), 8).alias("vertical"))


@query(f"""WITH {PX}, q AS (SELECT {_AT}, v, coalesce(abs(v - lag(v) OVER w), 1e9) AS jump FROM px WINDOW w AS (PARTITION BY scene_id, "row" ORDER BY col)),
  m AS (SELECT {_AT}, CASE WHEN v IS NULL THEN 0 WHEN v > 450 THEN 2 ELSE 1 END AS mask, CASE WHEN jump < 1e9 THEN 1 - least(1.0, jump / 400) END AS coh FROM q)
  SELECT {_AT}, CASE WHEN mask < 0.5 OR mask > 254.5 THEN 0 WHEN mask > 1.5 AND mask < 254.5 THEN 0 WHEN coh IS NULL OR coh < 0.3 THEN 0 ELSE 255 END AS alpha FROM m""")
def alpha_masks(spark, sf_dir):
    """Alpha from a data mask (invalid, layover) and a coherence threshold; missing coherence hides."""
    v = F.col("v")
    jump = F.abs(v - F.lag("v").over(Window.partitionBy("scene_id", "row").orderBy("col")))
    px = src.event_raster(spark, sf_dir).withColumn("coh", 1 - F.least(F.lit(1.0), jump / 400)).withColumn("mask", F.when(v.isNull(), 0).when(v > 450, 2).otherwise(1))
    return px.select(*AT, colour.alpha(F.col("mask"), F.col("coh"), 0.3).alias("alpha"))


@query(f"""WITH {PX}, i AS (SELECT {_AT}, CAST(floor({_T} * 255 + 0.5) AS INTEGER) AS idx FROM px WHERE v > 0)
  SELECT scene_id, idx, count(*) AS n, any_value(idx) AS r, any_value(CAST(floor(least(1.0, greatest(0.0, 1.5 - abs(4 * idx / 255.0 - 2))) * 255 + 0.5) AS INTEGER)) AS g, 255 - any_value(idx) AS b FROM i GROUP BY 1, 2""")
def colormap_lut(spark, sf_dir):
    """Pixels by entry of a 256-row look-up table that is joined on the rounded display value."""
    lut = F.broadcast(colour.lut_table(spark, {"r": lambda t: t, "g": lambda t: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.5 - F.abs(4 * t - 2))), "b": lambda t: 1 - t}))
    px = src.event_raster(spark, sf_dir).where("v > 0").withColumn("idx", rad.half_up(rad.normalise(rad.db(F.col("v")), 5.0, 27.0) * 255).cast("int"))
    return px.join(lut, "idx").groupBy("scene_id", "idx", "r", "g", "b").agg(F.count("*").alias("n"))


@query(f"""WITH {PX} SELECT {_AT}, CAST(floor({_clamp("0.567 * t + 0.433 * u")} * 255 + 0.5) AS INTEGER) AS r, CAST(floor({_clamp("0.558 * t + 0.442 * u")} * 255 + 0.5) AS INTEGER) AS g
  FROM (SELECT *, {_T} AS t, 1 - {_T} AS u FROM px WHERE v > 0)""")
def colour_vision_matrix(spark, sf_dir):
    """Two channels through a colour-vision matrix."""
    px = src.event_raster(spark, sf_dir).where("v > 0").withColumn("t", rad.normalise(rad.db(F.col("v")), 5.0, 27.0)).withColumn("u", 1 - F.col("t"))
    r, g = colour.mix_channels([F.col("t"), F.col("u")], [[0.567, 0.433], [0.558, 0.442]])
    return px.select(*AT, rad.half_up(r * 255).cast("int").alias("r"), rad.half_up(g * 255).cast("int").alias("g"))


_RAMP = f"""WITH {src.COMPLEX_RASTER_SQL}, f AS (SELECT scene_id, col / 99.0 AS x, "row" / 99.0 AS y, atan2(im, re) AS p FROM cx WHERE re IS NOT NULL AND re * re + im * im > 2500),
  s AS (SELECT scene_id, sum(x*x) AS xx, sum(x*y) AS xy, sum(x) AS x, sum(y*y) AS yy, sum(y) AS y, count(*) AS n, sum(x*p) AS xp, sum(y*p) AS yp, sum(p) AS p FROM f GROUP BY 1),
  d AS (SELECT *, xx * (yy * n - y * y) - xy * (xy * n - y * x) + x * (xy * y - yy * x) AS det FROM s)"""


@query(_RAMP + """ SELECT scene_id, round((xp * (yy * n - y * y) - xy * (yp * n - y * p) + x * (yp * y - yy * p)) / det, 4) AS a,
  round((xx * (yp * n - y * p) - xp * (xy * n - y * x) + x * (xy * p - yp * x)) / det, 4) AS b,
  round((xx * (yy * p - yp * y) - xy * (xy * p - yp * x) + xp * (xy * y - yy * x)) / det, 4) AS c, n AS n_pixels FROM d""")
def planar_ramp(spark, sf_dir):
    """Least-squares plane through the phase of coherent pixels, by nine sums a scene."""
    re, im = F.col("re"), F.col("im")
    px = src.complex_raster(spark, sf_dir).where(re.isNotNull() & (re * re + im * im > 2500)).select("scene_id", (F.col("col") / 99.0).alias("x"), (F.col("row") / 99.0).alias("y"), rad.phase(re, im).alias("p"))
    fit = cube.plane_fit(px, ["scene_id"])
    return fit.select("scene_id", R(F.col("a"), 4).alias("a"), R(F.col("b"), 4).alias("b"), R(F.col("c"), 4).alias("c"), "n_pixels")


_CUBE = f"""WITH {PX}, g AS (SELECT k, j, i, CASE WHEN (7 * i + 3 * j + 5 * k) % 11 < 3 OR (k = 1 AND i < 3 AND j < 3) THEN NULL ELSE 30.0 + 2 * i - j + 0.5 * k + 0.1 * i * j END AS value FROM range(3) a(k), range(5) b(j), range(6) c(i)),
  q AS (SELECT {_AT}, col * 5 / 99.0 AS fi, "row" * 4 / 99.0 AS fj, least(2.0, greatest(0.0, v / 250.0)) AS fk FROM px WHERE v IS NOT NULL),
  c AS (SELECT *, least(4, CAST(floor(fi) AS INTEGER)) AS i0, least(3, CAST(floor(fj) AS INTEGER)) AS j0, least(1, CAST(floor(fk) AS INTEGER)) AS k0 FROM q),
  w AS (SELECT *, (1 - abs(fi - i)) * (1 - abs(fj - j)) AS w FROM c JOIN g ON i IN (i0, i0 + 1) AND j IN (j0, j0 + 1) AND k IN (k0, k0 + 1)),
  l AS (SELECT {_AT}, fk - k0 AS t, k - k0 AS d, sum(value * w) / nullif(sum(CASE WHEN value IS NOT NULL THEN w END), 0) AS v FROM w GROUP BY 1, 2, 3, 4, 5),
  b AS (SELECT {_AT}, t, max(CASE WHEN d = 0 THEN v END) AS v0, max(CASE WHEN d = 1 THEN v END) AS v1 FROM l GROUP BY 1, 2, 3, 4)
  SELECT {_AT}, round(CASE WHEN t = 0 THEN v0 WHEN t = 1 THEN v1 ELSE coalesce(v0 * (1 - t) + v1 * t, v0, v1) END, 6) AS value FROM b"""


@query(_CUBE)
def cube_interpolate(spark, sf_dir):
    """Each pixel's trilinear value of a metadata cube with 3 x 5 x 6 nodes, of which some have no value."""
    missing = lambda i, j, k: (7 * i + 3 * j + 5 * k) % 11 < 3 or (k == 1 and i < 3 and j < 3)
    grid = [[[None if missing(i, j, k) else 30.0 + 2 * i - j + 0.5 * k + 0.1 * i * j for i in range(6)] for j in range(5)] for k in range(3)]
    px = src.event_raster(spark, sf_dir).where("v is not null")
    return cube.interpolated(px, grid, F.col("col") * 5 / 99.0, F.col("row") * 4 / 99.0, F.col("v") / 250.0, "value").select(*AT, R(F.col("value")).alias("value"))


@query("""WITH m AS (SELECT o_orderstatus AS series, date_trunc('month', o_orderdate) AS month, avg(o_totalprice) AS mean FROM orders WHERE o_totalprice > 0 GROUP BY 1, 2)
  SELECT series, CAST(month AS DATE) AS month, round(10 * log10(mean), 6) AS mean_db, round(10 * log10(mean) - lag(10 * log10(mean)) OVER (PARTITION BY series ORDER BY month), 6) AS change_db,
  'T' || row_number() OVER (PARTITION BY series ORDER BY month) AS label FROM m""")
def timeseries_change_db(spark, sf_dir):
    """Mean by month and series, in decibels, with the change from the month before."""
    monthly = src.table(spark, sf_dir, "orders").where("o_totalprice > 0").groupBy(F.col("o_orderstatus").alias("series"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.avg("o_totalprice").alias("mean"))
    over, d = Window.partitionBy("series").orderBy("month"), rad.db(F.col("mean"))
    return monthly.select("series", "month", R(d).alias("mean_db"), R(d - F.lag(d).over(over)).alias("change_db"), F.concat(F.lit("T"), F.row_number().over(over).cast("string")).alias("label"))


@query(f"""WITH {PX}, t AS (SELECT *, 10 * log10(v) AS db FROM px WHERE v > 0), p AS (SELECT a.scene_id, a."row", a.col, a.db AS x, b.db AS y FROM t a JOIN t b ON a.scene_id = b.scene_id AND a."row" = b."row" AND b.col = a.col + 1)
  SELECT scene_id, CAST(floor((x - 0) / 27.0 * 31) AS INTEGER) AS bx, CAST(floor((y - 0) / 27.0 * 31) AS INTEGER) AS "by", count(*) AS n, round(log10(count(*) + 1), 6) AS log_n FROM p WHERE x BETWEEN 0 AND 27 AND y BETWEEN 0 AND 27 GROUP BY 1, 2, 3""")
def scatter_density(spark, sf_dir):
    """2-D density of a pixel and its right neighbour, in decibels; values out of range are left out."""
    right = F.lead("x").over(Window.partitionBy("scene_id", "row").orderBy("col"))
    px = src.event_raster(spark, sf_dir).withColumn("x", rad.db(F.col("v"))).withColumn("y", right).where(F.col("x").between(0, 27) & F.col("y").between(0, 27))
    cell = lambda c: F.floor(F.col(c) / 27.0 * 31).cast("int")
    return px.groupBy("scene_id", cell("x").alias("bx"), cell("y").alias("by")).agg(F.count("*").alias("n")).withColumn("log_n", R(F.log10(F.col("n") + 1)))




@query(f"""WITH {PX}, f AS (SELECT scene_id, 0 AS file, "row", col, v FROM px WHERE "row" < 60 UNION ALL SELECT scene_id, 1, "row" - 20, col, v FROM px WHERE "row" >= 60)
  SELECT scene_id, "row", col, arg_max(v, file) AS v, CAST(max(file) AS INTEGER) AS from_file FROM f WHERE v IS NOT NULL AND v <> 0 GROUP BY 1, 2, 3""")
def raster_mosaic(spark, sf_dir):
    """Two overlapping files on the grid of each scene: the last one with a valid value wins."""
    second = F.col("row") >= 60
    files = src.event_raster(spark, sf_dir).select("scene_id", F.when(second, 1).otherwise(0).alias("file"), F.when(second, F.col("row") - 20).otherwise(F.col("row")).alias("row"), "col", "v")
    return files.where(rad.nonzero(F.col("v")).isNotNull()).groupBy("scene_id", "row", "col").agg(F.max_by("v", "file").alias("v"), F.max("file").alias("from_file"))


@query(f"""WITH {PX}, s AS (SELECT scene_id, avg(v) AS mu, stddev_pop(v) AS sd FROM px WHERE v > 0 GROUP BY 1), l AS (SELECT scene_id, ln(1 + (sd / mu) ** 2) AS s2, ln(mu) - ln(1 + (sd / mu) ** 2) / 2 AS m FROM s)
  SELECT scene_id, CAST(i AS INTEGER) AS bin, round(exp(m - 3.5 * sqrt(s2) + (i + 0.5) * 7 * sqrt(s2) / 128), 6) AS centre, round(exp(-0.5 * ((-3.5 + (i + 0.5) * 7 / 128)) ** 2), 6) AS height,
  round(exp(m - 2.054 * sqrt(s2)), 6) AS p2, round(exp(m + 2.054 * sqrt(s2)), 6) AS p98 FROM l, range(128) t(i)""")
def synthetic_histogram(spark, sf_dir):
    """A log-normal histogram from mean and spread alone, 128 bins over 3.5 sigma."""
    s = src.event_raster(spark, sf_dir).where("v > 0").groupBy("scene_id").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    s2 = F.log(1 + F.pow(F.col("sd") / F.col("mu"), F.lit(2.0)))
    b = s.select("scene_id", s2.alias("s2"), (F.log("mu") - s2 / 2).alias("m"), F.explode(F.sequence(F.lit(0), F.lit(127))).alias("bin"))
    z, sd = -3.5 + (F.col("bin") + 0.5) * 7 / 128, F.sqrt("s2")
    return b.select("scene_id", "bin", R(F.exp(F.col("m") + z * sd)).alias("centre"), R(F.exp(-0.5 * z * z)).alias("height"), R(F.exp(F.col("m") - 2.054 * sd)).alias("p2"), R(F.exp(F.col("m") + 2.054 * sd)).alias("p98"))




def _colormap_sql() -> str:
    polynomials = ", ".join(f"('{n}', {p}, {r}, {g}, {b})" for n, rows in colormaps.POLYNOMIALS.items() for p, (r, g, b) in enumerate(rows))
    stops = ", ".join(f"('{n}', {a[0]}, {b[0]}, {', '.join(str(v) for v in (*a[1:], *b[1:]))})" for n, rows in colormaps.RAMPS.items() for a, b in zip(rows, rows[1:], strict=False))
    byte = lambda x: f"CAST(floor(least(1.0, greatest(0.0, {x})) * 255 + 0.5) AS INTEGER)"
    ramp = lambda c: byte(f"{c}0 + (t - p0) / (p1 - p0) * ({c}1 - {c}0)")
    return f"""WITH {PX}, i AS (SELECT i AS idx, i / 255.0 AS t FROM range(256) x(i)), p AS (SELECT * FROM (VALUES {polynomials}) v(name, k, r, g, b)),
      s AS (SELECT name, {', '.join(f'{c}::DOUBLE AS {c}' for c in ('p0', 'p1', 'r0', 'g0', 'b0', 'r1', 'g1', 'b1'))} FROM (VALUES {stops}) v(name, p0, p1, r0, g0, b0, r1, g1, b1)),
      lut AS (SELECT name, idx, {byte('sum(r * pow(t, k))')} AS r, {byte('sum(g * pow(t, k))')} AS g, {byte('sum(b * pow(t, k))')} AS b FROM p, i GROUP BY name, idx
        UNION ALL SELECT name, idx, {ramp('r')}, {ramp('g')}, {ramp('b')} FROM s, i WHERE t >= p0 AND (t < p1 OR p1 = 1)
        UNION ALL SELECT 'phase', idx, {byte('0.5 + 0.5 * cos(2 * pi() * t)')}, {byte('0.5 + 0.5 * cos(2 * pi() * (t + 1.0 / 3))')}, {byte('0.5 + 0.5 * cos(2 * pi() * (t + 2.0 / 3))')} FROM i),
      n AS (SELECT scene_id, CAST(floor({_T} * 255 + 0.5) AS INTEGER) AS idx, count(*) AS n FROM px WHERE v > 0 GROUP BY 1, 2)
      SELECT scene_id, name AS colormap, round(sum(n * r) / sum(n), 3) AS r, round(sum(n * g) / sum(n), 3) AS g, round(sum(n * b) / sum(n), 3) AS b FROM n JOIN lut USING (idx) GROUP BY 1, 2"""


@query(_colormap_sql())
def colormap_means(spark, sf_dir):
    """The mean colour of each scene in every polynomial, ramp and phase map; pixels are counted before the join."""
    names = [*colormaps.POLYNOMIALS, *colormaps.RAMPS, "phase"]
    px = src.event_raster(spark, sf_dir).where("v > 0").withColumn("idx", rad.half_up(rad.normalise(rad.db(F.col("v")), 5.0, 27.0) * 255).cast("int"))
    counts = px.groupBy("scene_id", "idx").agg(F.count("*").alias("n"))
    met = counts.join(F.broadcast(colormaps.tables(spark, names)), "idx")  # 256 rows a map
    return met.groupBy("scene_id", "colormap").agg(*(R(F.sum(F.col("n") * F.col(c)) / F.sum("n"), 3).alias(c) for c in "rgb"))
