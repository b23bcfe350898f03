"""Queries of names, listings, formats and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..sources import adapters as src
from .registry import query

_KIND = "CASE WHEN o_orderkey % 13 = 0 THEN 'x' WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'D' END"
_POL = "CASE WHEN o_orderpriority LIKE '1%' THEN 'DHDH' WHEN o_orderpriority LIKE '2%' THEN 'SHNA' ELSE 'QPNA' END"


def _named(spark, sf_dir):
    """Product names made from orders, some with a path, some malformed, so that parsing has something to give back."""
    o, stamp = src.table(spark, sf_dir, "orders"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss")
    pol = F.when(F.col("o_orderpriority").startswith("1"), "DHDH").when(F.col("o_orderpriority").startswith("2"), "SHNA").otherwise("QPNA")
    key = lambda n: F.pmod("o_orderkey", F.lit(n))
    name = F.format_string(
        "%sSAR_L2_PR_GCOV_%03d_%03d_%s_%03d_2005_%s_A_%s_%s_X05007_N_%s_J_001%s",
        F.when(key(11) == 0, "s3://store/a_b/").otherwise(""), key(400) + 1, F.pmod("o_custkey", F.lit(173)) + 1, F.when(key(13) == 0, "x").when(key(2) == 0, "A").otherwise("D"), key(90), pol, stamp, stamp,
        F.when(F.col("o_orderstatus") == "F", "F").otherwise("P"), F.when(key(17) == 0, "").otherwise(".h5"),
    )
    return o.select(F.col("o_orderkey").alias("id"), name.alias("name"))


_FITS = "o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0"


@query(f"""SELECT o_orderkey AS id, CASE WHEN {_FITS} THEN CAST(o_orderkey % 400 + 1 AS INTEGER) END AS cycle, CASE WHEN {_FITS} THEN CAST(o_custkey % 173 + 1 AS INTEGER) END AS track, CASE WHEN {_FITS} THEN {_KIND} END AS direction,
  CASE WHEN {_FITS} THEN {_POL} END AS pol, CASE WHEN {_FITS} THEN CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'P' END END AS coverage, CASE WHEN {_FITS} THEN date_trunc('second', CAST(o_orderdate AS TIMESTAMP)) END AS start,
  CASE WHEN {_FITS} THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'dual HH/HV + dual HH/HV' WHEN o_orderpriority LIKE '2%' THEN 'single HH' ELSE 'quad' END ELSE '' END AS label, CASE WHEN {_FITS} THEN 'h5' END AS extension FROM orders""")
def filename_parse(spark, sf_dir):
    """Fields, time and polarization label of product names; all null for a name of another form."""
    f = names.parse_product(F.col("name"))
    return _named(spark, sf_dir).select("id", *(f[c].alias(c) for c in ("cycle", "track", "direction", "pol", "coverage")), names.name_time(f["start"]).alias("start"), names.polarization_label(f["pol"]).alias("label"), f["extension"].alias("extension"))


@query(f"""WITH n AS (SELECT *, printf('%sSAR_L2_PR_GCOV_%03d_%03d_%s_%03d_2005', CASE WHEN o_orderkey % 11 = 0 THEN 's3://store/a_b/' ELSE '' END, o_orderkey % 400 + 1, o_custkey % 173 + 1, {_KIND}, o_orderkey % 90) || '_' || {_POL} || '_A_' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || '_' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || '_X05007_N_P_J_001.h5' AS name FROM orders)
  SELECT CASE WHEN {_FITS} THEN {_KIND} END AS direction, CASE WHEN {_FITS} THEN {_POL} END AS pol, count(*) AS n FROM n WHERE contains(lower(name), '_07') AND (NOT ({_FITS}) OR o_orderstatus = 'F') GROUP BY 1, 2""")
def filename_filter(spark, sf_dir):
    """Products by a text and a parsed field; names that cannot be parsed pass."""
    f = names.parse_product(F.col("name"))
    kept = _named(spark, sf_dir).where(F.lower("name").contains("_07") & (f["coverage"].isNull() | (f["coverage"] == "F")))
    return kept.groupBy(f["direction"].alias("direction"), f["pol"].alias("pol")).agg(F.count("*").alias("n"))


_EXT = "CASE p_partkey % 7 WHEN 0 THEN '.h5' WHEN 1 THEN '.TIF' WHEN 2 THEN '.tiff' WHEN 3 THEN '.ntf' WHEN 4 THEN '.he5' WHEN 5 THEN '.json' ELSE '' END"


def _files(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, (".h5", ".TIF", ".tiff", ".ntf", ".he5", ".json", ""))), (F.pmod("p_partkey", F.lit(7)) + 1).cast("int"))
    return src.table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), F.col("p_name"), ext).alias("file"), "p_size")


@query(f"""SELECT CASE WHEN regexp_matches(lower(f), '\\.(h5|hdf5|he5)$') THEN 'hdf5' WHEN regexp_matches(lower(f), '\\.tiff?$') THEN 'geotiff' WHEN regexp_matches(lower(f), '\\.(nitf|ntf)$') THEN 'nitf' ELSE 'other' END AS format, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size
  FROM (SELECT p_brand || '/' || p_name || {_EXT} AS f, p_size FROM part) GROUP BY 1""")
def format_buckets(spark, sf_dir):
    """Files by the format that their name tells."""
    return _files(spark, sf_dir).groupBy(names.format_of(F.col("file")).alias("format")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


_PARTS = ("vv", "VH", "Hh", "hv", "pre", "post", "During", "before", "after", "coh", "phase", "AMP", "int", "mask", "vvx")
_NAMES = "['VV', 'VH', 'HH', 'HV', 'pre', 'post', 'during', 'before', 'after', 'coherence', 'phase', 'amplitude', 'intensity']"


@query(f"""WITH u AS (SELECT p_partkey, p_partkey // 40 AS scene, p_partkey % 15 + 1 AS pick, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) AS place FROM part),
  b AS (SELECT *, CASE WHEN pick <= 13 THEN ({_NAMES})[pick] ELSE 'band_' || place END AS band FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY scene, band ORDER BY p_partkey) AS k FROM b)
  SELECT p_partkey, scene, band || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS band FROM r""")
def band_name_detect(spark, sf_dir):
    """Band names from the URLs of a scene's files; a band that a scene has twice gets a number."""
    pick = F.element_at(F.array(*map(F.lit, _PARTS)), (F.pmod("p_partkey", F.lit(15)) + 1).cast("int"))
    place = F.row_number().over(Window.partitionBy("scene").orderBy("p_partkey"))
    url = F.concat(F.lit("/data/vv/"), "p_brand", F.when(F.pmod("p_partkey", F.lit(2)) == 0, "_").otherwise("-"), pick, F.element_at(F.array(*map(F.lit, ("_x.tif", ".tif", "-1.tif"))), (F.pmod("p_partkey", F.lit(3)) + 1).cast("int")))
    files = src.table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 40).alias("scene"), url.alias("url")).withColumn("place", place)
    named = files.withColumn("band", names.band_of(F.col("url"), F.col("place")))
    k = F.row_number().over(Window.partitionBy("scene", "band").orderBy("p_partkey"))
    return named.select("p_partkey", "scene", F.concat("band", F.when(k > 1, F.concat(F.lit("_"), k.cast("string"))).otherwise("")).alias("band"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+') AS base, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1)) AS raw FROM pages),
  e AS (SELECT page_id, base, replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&') AS href FROM h)
  SELECT page_id, 'at/' || url_decode(href) AS key, url_decode(href) LIKE '%/' AS directory, count(*) AS n, CAST(0 AS BIGINT) AS size FROM e WHERE href NOT IN ('', '../', '/') AND NOT regexp_matches(href, '^[?#]') AND (href NOT LIKE 'http%' OR starts_with(href, base)) GROUP BY 1, 2, 3""")
def html_links(spark, sf_dir):
    """Links of each page within its host, as a directory listing reads them, with how often it has them."""
    found = names.links(F.col("html"), F.regexp_extract("url", "^https?://[^/]+", 0), F.lit("at/"))
    return src.table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("e")).groupBy("page_id", "e.key", "e.directory").agg(F.count("*").alias("n"), F.sum("e.size").alias("size"))


@query("""WITH l AS (SELECT p_partkey, p_partkey % 9 AS k, CASE p_partkey % 9 WHEN 0 THEN CAST(p_size AS BIGINT) * p_size * p_size * 731 * p_partkey * 1.0 ELSE (p_partkey % 1000) / 4.0 END AS x FROM part)
  SELECT p_partkey AS id, 'd/file ' || p_partkey || CASE WHEN k = 8 THEN '/' ELSE '.h5' END AS key, k = 8 AS directory, CAST(floor(CASE k WHEN 8 THEN 0 WHEN 0 THEN x WHEN 1 THEN x * 1024 WHEN 2 THEN x * 1048576 WHEN 3 THEN x * 1073741824 WHEN 4 THEN x * 1099511627776 WHEN 5 THEN 0 WHEN 6 THEN x * 1024 ELSE x END) AS BIGINT) AS size FROM l""")
def listing_entries(spark, sf_dir):
    """Files, directories and sizes of autoindex lines, whose names are encoded."""
    p, k = src.table(spark, sf_dir, "part"), F.pmod("p_partkey", F.lit(9)).cast("int")
    b = F.col("p_size").cast("long") * F.col("p_size") * F.col("p_size") * 731 * F.col("p_partkey")
    number = F.format_string("%.2f", F.pmod("p_partkey", F.lit(1000)) / 4.0)
    shown = F.element_at(F.array(F.concat(b.cast("string"), F.lit("B")), F.concat(number, F.lit("K")), F.concat(number, F.lit(" MB")), F.concat(number, F.lit("g")), F.concat(number, F.lit("TB ")), F.lit("-"), F.concat(number, F.lit(" kb")), number, F.lit("-")), k + 1)
    line = F.concat(F.lit("<img src='i.gif'> <A class=x HREF='file%20"), F.col("p_partkey").cast("string"), F.when(k == 8, "/").otherwise(".h5"), F.lit("'>name</A>  2024-01-02 at  "), shown, F.lit("\n<a href=\"?C=N;O=D\">Name</a> <a href='../'>up</a>"))
    return p.select(F.col("p_partkey").alias("id"), F.explode(names.links(line, F.lit("https://store.example.org"), F.lit("d/"))).alias("e")).select("id", "e.*")


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 0 WHEN p_partkey % 10 = 1 THEN NULL WHEN p_partkey % 10 < 4 THEN p_partkey % 1500 ELSE CAST(p_size AS BIGINT) * p_size * p_size * 731 * p_partkey END AS n FROM part)
  SELECT p_partkey, n, CASE WHEN n IS NULL OR n = 0 THEN chr(8212) WHEN n >= 1073741824 THEN printf('%d.%02d GB', ((n * 200 + 1073741824) // 2147483648) // 100, ((n * 200 + 1073741824) // 2147483648) % 100)
    WHEN n >= 1048576 THEN printf('%d.%d MB', ((n * 20 + 1048576) // 2097152) // 10, ((n * 20 + 1048576) // 2097152) % 10) WHEN n >= 1024 THEN printf('%d KB', (n * 2 + 1024) // 2048) ELSE n || ' B' END AS shown FROM s""")
def size_format(spark, sf_dir):
    """Sizes as text."""
    key, k = F.col("p_partkey"), F.pmod("p_partkey", F.lit(10))
    n = F.when(k == 0, 0).when(k == 1, F.lit(None)).when(k < 4, F.pmod("p_partkey", F.lit(1500))).otherwise(F.col("p_size").cast("long") * F.col("p_size") * F.col("p_size") * 731 * key).cast("long")
    return src.table(spark, sf_dir, "part").select("p_partkey", n.alias("n")).select("p_partkey", "n", names.size_text(F.col("n")).alias("shown"))


@query("""SELECT s_suppkey, 'bucket-' || s_nationkey AS bucket, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'a b/' || s_name END AS key, CAST(CASE s_suppkey % 4 WHEN 0 THEN s_suppkey WHEN 1 THEN s_suppkey * 1024 WHEN 2 THEN s_suppkey * 1048576 END AS BIGINT) AS bytes FROM supplier""")
def uri_and_size_parse(spark, sf_dir):
    """Bucket and key of object URIs, bytes of listing sizes."""
    s = src.table(spark, sf_dir, "supplier")
    uri = F.concat(F.lit("s3://bucket-"), F.col("s_nationkey").cast("string"), F.when(F.pmod("s_suppkey", F.lit(5)) == 0, "").otherwise(F.concat(F.lit("/a b/"), "s_name")))
    size = F.concat(F.col("s_suppkey").cast("string"), F.element_at(F.array(*map(F.lit, ("", "K", "M", "x"))), (F.pmod("s_suppkey", F.lit(4)) + 1).cast("int")))
    bucket, key = names.s3_parts(uri)
    return s.select("s_suppkey", bucket.alias("bucket"), key.alias("key"), names.bytes_of(size).alias("bytes"))


@query("""SELECT event_id, event_type AS kind, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN value > 400 THEN NULL ELSE value END AS value FROM events""")
def sidecar_roundtrip(spark, sf_dir):
    """Records to JSON and back by schema; what is not finite becomes null."""
    e = src.table(spark, sf_dir, "events")
    value = F.when(F.col("value") > 400, float("nan")).otherwise(F.col("value"))
    record = F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.when(~F.isnan(value), value).alias("value")))
    return e.select(F.from_json(record, "event_id long, kind string, k int, value double").alias("r")).select("r.*")


@query("""SELECT doc_id, replace(replace(text, '&', '&amp;'), '<', '&lt;') = text AS plain, md5(text) AS text_md5 FROM documents""")
def xml_entities(spark, sf_dir):
    """Texts through entities and back: the digest is of what came back."""
    d = src.table(spark, sf_dir, "documents")
    coded = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return d.select("doc_id", (coded == F.col("text")).alias("plain"), F.md5(names.xml_text(coded).cast("binary")).alias("text_md5"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS start, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T23:59:59Z' ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T12:00:00Z' END AS "end" FROM orders""")
def day_expansion(spark, sf_dir):
    """Bounds given as days become instants; those with a time stay."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    start, end = names.day_bounds(day, F.when(F.pmod("o_orderkey", F.lit(2)) == 0, day).otherwise(F.concat(day, F.lit("T12:00:00Z"))))
    return src.table(spark, sf_dir, "orders").select("o_orderkey", start.alias("start"), end.alias("end"))
