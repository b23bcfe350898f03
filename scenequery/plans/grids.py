"""Queries of resampling, tiling, sampling, stacks and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions import radiometry as rad
from ..operators import grids as ops
from ..operators import stats
from ..sources import adapters as src
from .registry import query

KEYS, PX, MB, G = ["scene_id"], src.EVENT_RASTER_SQL, src.BAND_RASTER_SQL, src.GRANULES_SQL
R = lambda c, n=6: F.round(c, n)


@query(f"""WITH {PX}, r AS (SELECT r2, least(99, CAST(floor((r2 + 0.5) * 100 / 37) AS INTEGER)) AS s FROM range(37) t(r2))
  SELECT scene_id, CAST(a.r2 AS INTEGER) AS "row", CAST(b.r2 AS INTEGER) AS col, v FROM px JOIN r a ON "row" = a.s JOIN r b ON col = b.s""")
def resample_nearest(spark, sf_dir):
    """Scenes reduced to 37 x 37 by the nearest pixel."""
    return ops.nearest_down(src.event_raster(spark, sf_dir), KEYS, 100, 37)


@query(f"""WITH {PX}, f AS (SELECT t, least(99.0, greatest(0.0, (t + 0.5) * 100 / 133 - 0.5)) AS f FROM range(133) x(t)),
  k AS (SELECT t, least(98, CAST(floor(f) AS INTEGER)) AS a, f - least(98, CAST(floor(f) AS INTEGER)) AS w FROM f), u AS (SELECT t, a AS p, 0 AS o, 1 - w AS w FROM k UNION ALL SELECT t, a + 1, 1, w FROM k)
  SELECT scene_id, CAST(r.t AS INTEGER) AS "row", CAST(c.t AS INTEGER) AS col, round(CASE WHEN count(v) = 4 THEN sum(v * r.w * c.w) ELSE arg_min(v, r.o * 2 + c.o) FILTER (WHERE v IS NOT NULL) END, 6) AS v
  FROM px JOIN u r ON "row" = r.p JOIN u c ON col = c.p GROUP BY 1, 2, 3""")
def resample_bilinear(spark, sf_dir):
    """Scenes enlarged to 133 x 133."""
    return ops.bilinear_up(src.event_raster(spark, sf_dir), KEYS, 100, 133).select(*KEYS, "row", "col", R(F.col("v")).alias("v"))


_W = lambda p, s: f"(CASE WHEN least(CASE WHEN {s} = 0 THEN 1000000 ELSE {p} - {s} END, CASE WHEN {s} + 40 >= 100 THEN 1000000 ELSE {s} + 39 - {p} END) < 3 THEN 0.0 ELSE least(1.0, (least(CASE WHEN {s} = 0 THEN 1000000 ELSE {p} - {s} END, CASE WHEN {s} + 40 >= 100 THEN 1000000 ELSE {s} + 39 - {p} END) - 3 + 1) / 4.0) END)"


@query(f"""WITH {PX}, st AS (SELECT unnest([0, 22, 50, 60]) AS s), t AS (SELECT px.*, a.s AS tr, b.s AS tc, {_W('"row"', 'a.s')} * {_W('col', 'b.s')} AS w FROM px JOIN st a ON "row" BETWEEN a.s AND a.s + 39 JOIN st b ON col BETWEEN b.s AND b.s + 39),
  m AS (SELECT scene_id, tr, tc, avg(v) AS m FROM t GROUP BY 1, 2, 3)
  SELECT scene_id, "row", col, round(sum(w * (v - m)) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0), 6) AS v FROM t JOIN m USING (scene_id, tr, tc) GROUP BY 1, 2, 3""")
def tiled_feathered_run(spark, sf_dir):
    """A tile function (value less the tile's mean) run on overlapping 40 x 40 tiles and blended by feathered weights."""
    tiles = ops.in_tiles(src.event_raster(spark, sf_dir), 100, 100, 40, 6)
    out = tiles.withColumn("out", F.col("v") - F.avg("v").over(Window.partitionBy(*KEYS, "tr", "tc")))
    total = F.sum(F.when(F.col("out").isNotNull(), F.col("w")))
    return out.groupBy(*KEYS, "row", "col").agg(R(F.sum(F.col("w") * F.col("out")) / F.when(total != 0, total)).alias("v"))


@query(f"""WITH {PX}, t AS (SELECT *, "row" // 34 AS tr, col // 34 AS tc FROM px WHERE v > 0 AND ("row" * 100 + col) % 4 = 0), d AS (SELECT tr, tc, scene_id, 10 * log10(v) AS v FROM t)
  SELECT scene_id, CAST(tr AS INTEGER) AS tr, CAST(tc AS INTEGER) AS tc, count(*) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM d GROUP BY 1, 2, 3""")
def viewport_stats(spark, sf_dir):
    """Statistics of a 3 x 3 grid of tiles over every fourth pixel (the sample is the operator)."""
    px = src.event_raster(spark, sf_dir).where((F.col("v") > 0) & (F.pmod(F.col("row") * 100 + F.col("col"), F.lit(4)) == 0)).withColumn("v", rad.db(F.col("v")))
    tiles = px.withColumn("tr", F.floor(F.col("row") / 34).cast("int")).withColumn("tc", F.floor(F.col("col") / 34).cast("int"))
    m = stats.moments(tiles, [*KEYS, "tr", "tc"])
    return m.select(*KEYS, "tr", "tc", F.col("count").alias("n"), R(F.col("mean")).alias("mean"), R(F.col("min")).alias("lo"), R(F.col("max")).alias("hi"))


@query(f"""WITH {PX} SELECT scene_id, "row", col, round(30 + 15.0 * col / 99, 6) AS incidence, round(10 * log10(greatest(v, 1e-10)), 6) AS db FROM px WHERE v IS NOT NULL AND ("row" * 100 + col) % 2 = 0""")
def incidence_scatter(spark, sf_dir):
    """Sampled pixels in decibels against their incidence angle."""
    px = src.event_raster(spark, sf_dir).where(F.col("v").isNotNull() & (F.pmod(F.col("row") * 100 + F.col("col"), F.lit(2)) == 0))
    return px.select(*KEYS, "row", "col", R(30 + 15.0 * F.col("col") / 99).alias("incidence"), R(rad.db_clamped(F.col("v"))).alias("db"))


@query(f"""WITH {PX}, d AS (SELECT scene_id, CAST(floor(v / 20 + 0.5) AS INTEGER) AS cls, count(*) AS n FROM px WHERE v IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY cls) AS place, count(*) OVER (PARTITION BY scene_id) AS total FROM d WHERE cls BETWEEN 1 AND 255)
  SELECT scene_id, cls, n, total > 24 AS truncated FROM k WHERE place <= 24""")
def class_legend(spark, sf_dir):
    """The first 24 classes present in each scene, and whether there are more."""
    counts = src.event_raster(spark, sf_dir).where("v is not null").groupBy(*KEYS, rad.half_up(F.col("v") / 20).cast("int").alias("cls")).agg(F.count("*").alias("n")).where(F.col("cls").between(1, 255))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy(*KEYS).orderBy("cls"))).withColumn("total", F.count("*").over(Window.partitionBy(*KEYS)))
    return ranked.where("place <= 24").select(*KEYS, "cls", "n", (F.col("total") > 24).alias("truncated"))


@query(f"""WITH {MB}, m AS (SELECT scene_id, unnest(['hh', 'hv', 'vv']) AS band, unnest([avg(hh), avg(hv), avg(vv)]) AS mean FROM mb GROUP BY 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY mean DESC, band) AS rank, 10 * log10(max(mean) OVER (PARTITION BY scene_id) / mean) AS gap FROM m)
  SELECT scene_id, band, CAST(rank AS INTEGER) AS rank, round(gap, 6) AS gap, CASE WHEN rank > 1 AND gap > 6 THEN 'cross' ELSE 'co' END AS kind FROM r""")
def power_level_classes(spark, sf_dir):
    """Like- and cross-polarised bands told apart by their mean power."""
    means = src.band_raster(spark, sf_dir).groupBy(*KEYS).agg(*(F.avg(b).alias(b) for b in ("hh", "hv", "vv")))
    long = means.select(*KEYS, F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).alias("mean")) for b in ("hh", "hv", "vv")))).alias("b")).select(*KEYS, "b.*")
    return ops.classify_power(long, KEYS).select(*KEYS, "band", "rank", R(F.col("gap")).alias("gap"), "kind")


@query("""WITH f AS (SELECT o_custkey AS series, o_orderkey AS file, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS date FROM orders)
  SELECT series, file, row_number() OVER w AS place, 'T' || row_number() OVER w AS label FROM f WINDOW w AS (PARTITION BY series ORDER BY coalesce(date, TIMESTAMP '1970-01-01'), file)""")
def temporal_stack(spark, sf_dir):
    """Files of each series by date; a missing date counts as the epoch."""
    files = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("file"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("date"))
    return ops.temporal_labels(files, ["series"]).select("series", "file", F.col("place").cast("long").alias("place"), "label")


@query(f"""WITH {PX}, s AS (SELECT DISTINCT scene_id FROM px UNION SELECT max(scene_id) + 1 FROM px), m AS (SELECT scene_id, avg(v) AS m, count(v) AS n FROM px WHERE "row" BETWEEN 10 AND 29 AND col BETWEEN 30 AND 59 AND v > 0 GROUP BY 1)
  SELECT scene_id, round(m, 6) AS mean, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no data in the region' END AS error FROM s LEFT JOIN m USING (scene_id)""")
def roi_time_series(spark, sf_dir):
    """The same region of every file; a file without data keeps its row, with the error."""
    px = src.event_raster(spark, sf_dir)
    scenes = px.select("scene_id").distinct().unionByName(px.agg((F.max("scene_id") + 1).alias("scene_id")))
    m = px.where(F.col("row").between(10, 29) & F.col("col").between(30, 59) & (F.col("v") > 0)).groupBy("scene_id").agg(F.avg("v").alias("m"), F.count("v").alias("n"))
    return scenes.join(m, "scene_id", "left").select("scene_id", R(F.col("m")).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "no data in the region").alias("error"))


@query(f"""WITH {PX}, b AS (SELECT scene_id, CAST(floor((("row" + 0.5) * 0.9 + 3.0) / 1.5) AS INTEGER) AS "row", CAST(floor(((col + 0.5) * 0.9 + 4.5) / 1.5) AS INTEGER) AS col, v FROM px)
  SELECT scene_id, "row", col, round(avg(v), 6) AS v, count(v) AS n FROM b GROUP BY 1, 2, 3""")
def co_registration(spark, sf_dir):
    """Pixels of one grid on the cells of another that shares its reference system."""
    cell = lambda c, o: F.floor(((F.col(c) + 0.5) * 0.9 + o) / 1.5).cast("int")
    return src.event_raster(spark, sf_dir).groupBy(*KEYS, cell("row", 3.0).alias("row"), cell("col", 4.5).alias("col")).agg(R(F.avg("v")).alias("v"), F.count("v").alias("n"))


@query(f"""WITH {G}, e AS (SELECT id, unnest(range(11)) AS k, x0, y0, x1, y1 FROM granules), q AS (SELECT id, x0 + (x1 - x0) * k / 10 AS x, y0 AS y FROM e UNION ALL SELECT id, x0 + (x1 - x0) * k / 10, y1 FROM e UNION ALL SELECT id, x0, y0 + (y1 - y0) * k / 10 FROM e UNION ALL SELECT id, x1, y0 + (y1 - y0) * k / 10 FROM e),
  m AS (SELECT id, radians(x) * {geo.A} AS mx, ln(tan(pi() / 4 + radians(y) / 2)) * {geo.A} AS my FROM q) SELECT id, round(min(mx), 3) AS x0, round(min(my), 3) AS y0, round(max(mx), 3) AS x1, round(max(my), 3) AS y1 FROM m GROUP BY id""")
def bbox_reprojection(spark, sf_dir):
    """Envelopes of boxes in Mercator metres, from eleven points an edge."""
    g = src.granules(spark, sf_dir)
    t = F.col("k") / 10
    along = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * t
    points = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((along("x0", "x1"), F.col("y0")), (along("x0", "x1"), F.col("y1")), (F.col("x0"), along("y0", "y1")), (F.col("x1"), along("y0", "y1")))))
    p = g.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(10)))).select("id", F.explode(points).alias("p"))
    mx, my = F.radians("p.x") * geo.A, F.log(F.tan(F.lit(3.141592653589793 / 4) + F.radians("p.y") / 2)) * geo.A
    return p.groupBy("id").agg(R(F.min(mx), 3).alias("x0"), R(F.min(my), 3).alias("y0"), R(F.max(mx), 3).alias("x1"), R(F.max(my), 3).alias("y1"))


@query("""WITH p AS (SELECT l_orderkey AS ring, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, CASE WHEN l_quantity > 40 THEN 100.0 ELSE l_quantity * 2 END AS x, CASE WHEN l_tax > 0.06 THEN 0.0 ELSE l_discount * 1000 END AS y FROM lineitem),
  e AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY ring ORDER BY k)), c AS (SELECT *, (abs(x - 100) < 0.1 AND abs(x2 - 100) < 0.1) OR (abs(x) < 0.1 AND abs(x2) < 0.1) OR (abs(y) < 0.06 AND abs(y2) < 0.06) OR (abs(y - 60) < 0.06 AND abs(y2 - 60) < 0.06) AS cut FROM e WHERE x2 IS NOT NULL),
  r AS (SELECT *, sum(cut::INT) OVER (PARTITION BY ring ORDER BY k) AS run FROM c) SELECT ring, CAST(run AS BIGINT) AS run, CAST(min(k) AS INTEGER) AS first, count(*) + 1 AS points FROM r WHERE NOT cut GROUP BY 1, 2""")
def coastline_edges(spark, sf_dir):
    """Ring edges without those on the boundary of their tile, joined into runs."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    points = src.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ring"), F.row_number().over(order).alias("k"), F.when(F.col("l_quantity") > 40, 100.0).otherwise(F.col("l_quantity") * 2).alias("x"), F.when(F.col("l_tax") > 0.06, 0.0).otherwise(F.col("l_discount") * 1000).alias("y"))
    return ops.edges_inside(points, ["ring"], (0.0, 0.0, 100.0, 60.0))


@query("""SELECT c_custkey, CAST(c_custkey % 4 + 1 AS INTEGER) AS zoom, 'scene-' || c_nationkey AS scene, list_slice(string_split(CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a,b,c,d,e,f' ELSE 'x,y' END, ','), 1, 4) AS compare FROM customer""")
def share_link_parse(spark, sf_dir):
    """State out of links, by short or long keys; at most four scenes are compared."""
    c = src.table(spark, sf_dir, "customer")
    compare = F.element_at(F.array(*map(F.lit, ("a", "a,b,c,d,e,f", "x,y"))), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    link = F.concat(F.lit("https://example.org/view?"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, "z=").otherwise("zoom="), (F.pmod("c_custkey", F.lit(4)) + 1).cast("string"), F.lit("&scene=scene-"), F.col("c_nationkey").cast("string"), F.lit("&cmp="), compare)
    get = lambda *keys: F.coalesce(*(F.parse_url(F.col("link"), F.lit("QUERY"), F.lit(k)) for k in keys))
    return c.select("c_custkey", link.alias("link")).select("c_custkey", get("z", "zoom").cast("int").alias("zoom"), get("scene").alias("scene"), F.slice(F.split(get("cmp"), ","), 1, 4).alias("compare"))


@query("""SELECT DISTINCT p_brand AS name, p_size AS size FROM part""")
def dedupe_files(spark, sf_dir):
    """Files with the same name and size count once."""
    return src.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("size")).dropDuplicates(["name", "size"])


@query(f"""WITH {G} SELECT id, round(y0 + 1 - 7.5 / 60, 6) AS lat, round(x0 + 1 + 30 / 3600.0, 6) AS lon, x0 < -180 OR x1 > 180 AS projected,
  strftime(start_ts, '%Y-%m-%d') || '/..' AS shown FROM granules""")
def corner_parse(spark, sf_dir):
    """Corner coordinates in degrees, minutes and seconds, whether bounds are projected, and open dates as text."""
    dms = lambda v, plus, minus, width: F.format_string(f"%0{width}d%02d%02d%s", F.floor(F.abs(v)).cast("int"), F.floor(F.pmod(F.abs(v) * 60, F.lit(60.0)) + 1e-9).cast("int"), F.round(F.pmod(F.abs(v) * 3600, F.lit(60.0)), 0).cast("int"), F.when(v < 0, minus).otherwise(plus))
    g = src.granules(spark, sf_dir).select("*", F.concat(dms(F.col("y0") + 1 - 7.5 / 60, "N", "S", 2), dms(F.col("x0") + 1 + 30 / 3600.0, "E", "W", 3)).alias("corner"))

    def angle(start: int, width: int):
        part = lambda a, n: F.substring(F.col("corner"), a, n).cast("double")
        value = part(start, width) + part(start + width, 2) / 60 + part(start + width + 2, 2) / 3600
        return F.when(F.substring("corner", start + width + 4, 1).isin("S", "W"), -value).otherwise(value)

    shown = F.concat(F.date_format("start_ts", "yyyy-MM-dd"), F.lit("/.."))
    return g.select("id", R(angle(1, 2)).alias("lat"), R(angle(8, 3)).alias("lon"), ((F.col("x0") < -180) | (F.col("x1") > 180)).alias("projected"), shown.alias("shown"))


@query("""SELECT collection, count(*) AS n, round(avg(bytes), 6) AS mean FROM (SELECT o_custkey // 500 AS collection, o_totalprice AS bytes, row_number() OVER (PARTITION BY o_custkey // 500 ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey // 500) AS total FROM orders) WHERE k % greatest(1, total // 256) = 0 GROUP BY 1""")
def chunk_byte_average(spark, sf_dir):
    """Mean size of evenly strided chunks of each dataset, some 256 of it where it has more (the sample is the operator)."""
    o = src.table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 500).alias("collection"), F.col("o_orderkey").alias("chunk"), F.col("o_totalprice").alias("bytes"))
    return ops.strided_mean(o, "collection", "chunk", "bytes").select("collection", "n", R(F.col("mean")).alias("mean"))


@query(f"""WITH {G} SELECT id, x0, y0, x1, y1, full_frame FROM granules""")
def geojson_roundtrip(spark, sf_dir):
    """Footprints to GeoJSON features and back to boxes."""
    ring = F.array(*(F.array(F.col(a), F.col(b)) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct("id", "full_frame").alias("properties")))
    schema = "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<id: long, full_frame: boolean>"
    back = src.granules(spark, sf_dir).select(F.from_json(feature, schema).alias("f"))
    axis = lambda k: F.transform(F.flatten("f.geometry.coordinates"), lambda p: p[k])
    return back.select("f.properties.id", F.array_min(axis(0)).alias("x0"), F.array_min(axis(1)).alias("y0"), F.array_max(axis(0)).alias("x1"), F.array_max(axis(1)).alias("y1"), "f.properties.full_frame")
