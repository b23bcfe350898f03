"""Queries of the catalogue: items, collections, granules, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as ops
from ..sources import adapters as src
from .registry import query

ITEMS, GRANULES = src.STAC_ITEMS_SQL, src.GRANULES_SQL
BOX = (-60.0, -40.0, 35.0, 52.0)
_MEET = f"x0 <= {BOX[2]} AND x1 >= {BOX[0]} AND y0 <= {BOX[3]} AND y1 >= {BOX[1]}"
_SEARCH = ops.Search(collections=["view", "click"], bbox=BOX, datetime="2024-01-02T00:00:00/..", query={"k": {"gte": 20}}, limit=40, offset=15)
_WHERE = f"WHERE collection IN ('view', 'click') AND {_MEET} AND datetime >= TIMESTAMP '2024-01-02' AND TRY_CAST(json_extract_string(properties, '$.k') AS DOUBLE) >= 20"


@query(f"WITH {ITEMS} SELECT collection, count(*) AS n, min(datetime) AS start, max(datetime) AS \"end\", min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM items GROUP BY collection")
def stac_collections(spark, sf_dir):
    """Every collection with its extent."""
    return ops.collections(src.stac_items(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT collection, count(*) AS n, min(datetime) AS start, max(datetime) AS \"end\", -180.0::DOUBLE AS x0, -90.0::DOUBLE AS y0, 180.0::DOUBLE AS x1, 90.0::DOUBLE AS y1 FROM items WHERE collection = 'purchase' GROUP BY collection")
def stac_collection_by_id(spark, sf_dir):
    """One collection; its extent is given as the world."""
    one = ops.collections(src.stac_items(spark, sf_dir).where("collection = 'purchase'"))
    return one.select("collection", "n", "start", "end", *(F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), ops.WORLD, strict=True)))


@query(f"WITH {ITEMS} SELECT id, collection, datetime, properties FROM items {_WHERE} ORDER BY datetime DESC, id LIMIT 40 OFFSET 15")
def stac_search_page(spark, sf_dir):
    """A page of a search by collection, box, time and property, newest first."""
    return ops.page(src.stac_items(spark, sf_dir), _SEARCH).select("id", "collection", "datetime", "properties")


@query(f"WITH {ITEMS} SELECT count(*) AS number_matched, count(*) > 55 AS has_next FROM items {_WHERE}")
def stac_count(spark, sf_dir):
    """How many items the same search matches, and whether another page follows."""
    return ops.has_next(src.stac_items(spark, sf_dir), _SEARCH)


@query(f"WITH {ITEMS} SELECT id, collection FROM items WHERE json_extract_string(properties, '$.k') = '7' AND x0 < 120.0 AND x1 > -120.0 AND y0 < 60.0 AND y1 > -60.0")
def stac_property_filter(spark, sf_dir):
    """A property equal to a text (gte is then ignored), in a box whose edges do not count."""
    items = src.stac_items(spark, sf_dir)
    box = tuple(F.col("bbox")[k] for k in range(4))
    return items.where(ops.property_matches(F.col("properties"), "k; '", {"eq": 7, "gte": 99}) & ops.intersects(box, (-120.0, -60.0, 120.0, 60.0), touching=False)).select("id", "collection")


@query(f"WITH {ITEMS} SELECT collection, CAST(datetime AS DATE) AS day, count(*) AS n FROM items WHERE datetime >= TIMESTAMP '2024-01-01' AND datetime <= TIMESTAMP '2024-01-20 23:59:59' GROUP BY 1, 2")
def stac_day_counts(spark, sf_dir):
    """Items by collection and day within bounds that are whole days."""
    items = src.stac_items(spark, sf_dir).where(ops.in_interval(F.col("datetime"), "2024-01-01T00:00:00/2024-01-20T23:59:59"))
    return items.groupBy("collection", F.to_date("datetime").alias("day")).agg(F.count("*").alias("n"))


_GBOX = (-124.5, 33.5, -121.0, 37.25)
_GW = f"least(x1, {_GBOX[2]}) - greatest(x0, {_GBOX[0]})"
_GH = f"least(y1, {_GBOX[3]}) - greatest(y0, {_GBOX[1]})"
_GAREA = (_GBOX[2] - _GBOX[0]) * (_GBOX[3] - _GBOX[1])


@query(f"""WITH {GRANULES}, c AS (SELECT *, least(100.0, ({_GW}) * ({_GH}) / {_GAREA} * 100) AS coverage FROM granules WHERE {_GW} > 0 AND {_GH} > 0)
  SELECT id, round(coverage, 6) AS coverage, CAST(row_number() OVER (ORDER BY floor(coverage * 2 + 0.5) DESC, full_frame DESC, pol_mode = 'DHDH' DESC, start_ts DESC, id) AS INTEGER) AS rank FROM c ORDER BY rank LIMIT 50""")
def granule_rank(spark, sf_dir):
    """The 50 best granules for a box."""
    return ops.rank_granules(src.granules(spark, sf_dir), _GBOX).select("id", F.round("coverage", 6).alias("coverage"), "rank")


@query(f"""WITH {GRANULES}, p AS (SELECT *, CASE WHEN pol_mode = 'DHDH' AND x0 < -129.5 THEN 0 WHEN full_frame THEN 1 ELSE 2 END AS priority FROM granules WHERE y0 >= 42)
  SELECT pol_mode, count(*) AS n FROM p WHERE priority = (SELECT min(priority) FROM p) GROUP BY 1""")
def granule_first_collection(spark, sf_dir):
    """Granules of the first collection that has any."""
    g = src.granules(spark, sf_dir).where("y0 >= 42").withColumn("priority", F.when((F.col("pol_mode") == "DHDH") & (F.col("x0") < -129.5), 0).when(F.col("full_frame"), 1).otherwise(2))
    return ops.first_hit(g, "priority").groupBy("pol_mode").agg(F.count("*").alias("n"))


@query(f"""WITH {GRANULES} SELECT 'pol' AS field, pol_mode AS value FROM granules UNION SELECT 'frame', CASE WHEN full_frame THEN 'full' ELSE 'part' END FROM granules UNION SELECT 'year', CAST(year(start_ts) AS VARCHAR) FROM granules""")
def filter_options(spark, sf_dir):
    """Distinct values of several fields, found in one pass."""
    fields = F.array(*(F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in (("pol", F.col("pol_mode")), ("frame", F.when(F.col("full_frame"), "full").otherwise("part")), ("year", F.year("start_ts").cast("string")))))
    return src.granules(spark, sf_dir).select(F.explode(fields).alias("f")).select("f.*").distinct()


@query("""SELECT source, doc_id AS id, CAST(kept AS BIGINT) AS kept_bytes FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC) AS kept FROM documents) WHERE kept > 60000""")
def lru_eviction(spark, sf_dir):
    """Documents beyond a storage budget of 60,000 characters of each source, the newest (highest id) kept first."""
    entries = src.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("bytes"), F.col("doc_id").alias("at"))
    return ops.beyond_budget(entries, 60_000, ["source"]).select("source", "id", "kept_bytes")


@query(f"""WITH {GRANULES} SELECT CAST(floor((x0 + 180) / 360 * 64) AS INTEGER) AS tx, CAST(floor((1 - ln(tan(radians((y0 + y1) / 2)) + 1 / cos(radians((y0 + y1) / 2))) / pi()) / 2 * 64) AS INTEGER) AS ty, count(*) AS n FROM granules GROUP BY 1, 2""")
def tile_mercator(spark, sf_dir):
    """Granules by slippy map tile at zoom 6."""
    from ..functions import geo

    tx, ty = geo.slippy_tile(F.col("x0"), (F.col("y0") + F.col("y1")) / 2, 6)
    return src.granules(spark, sf_dir).groupBy(tx.alias("tx"), ty.alias("ty")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT dim.name, req.need, NOT EXISTS (SELECT 1 FROM unnest(string_split(req.need, ',')) t(x) WHERE NOT list_contains(dim.have, x)) AS available
  FROM (SELECT l_returnflag AS name, list(DISTINCT l_linestatus) AS have FROM lineitem GROUP BY 1) dim, (SELECT unnest(['O', 'F', 'O,F', 'F,X']) AS need) req""")
def composite_availability(spark, sf_dir):
    """Whether all that a composite needs is among what a source has."""
    have = src.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.collect_set("l_linestatus").alias("have"))
    needs = have.select("name", "have", F.explode(F.array(*map(F.lit, ("O", "F", "O,F", "F,X")))).alias("need"))
    return needs.select("name", "need", (F.size(F.array_except(F.split("need", ","), "have")) == 0).alias("available"))
