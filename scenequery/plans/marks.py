"""Queries of markup: marks out to features, features in to marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markup as ops
from ..sources import adapters as src
from .registry import query

R = lambda c, n=6: F.round(c, n)


def _scenes(spark, sf_dir):
    k = F.col("n_nationkey")
    return src.table(spark, sf_dir, "nation").select(k.cast("long").alias("scene_id"), (k * 4 + 100).cast("int").alias("width"), F.when(k != 7, (k * 2 + 80).cast("int")).alias("height"), *(F.when(k % 6 != 5, v).alias(n) for n, v in (("x0", k * 1000.0), ("y0", k * 50.0), ("x1", k * 1000.0 + 400), ("y1", k * 50.0 + 320))), F.lit("EPSG:32610").alias("crs"))


_SCENES = """sc AS (SELECT CAST(n_nationkey AS BIGINT) AS scene_id, n_nationkey * 4 + 100 AS width, CASE WHEN n_nationkey <> 7 THEN n_nationkey * 2 + 80 END AS height, CASE WHEN n_nationkey % 6 <> 5 THEN n_nationkey * 1000.0 ELSE 0 END AS x0, CASE WHEN n_nationkey % 6 <> 5 THEN n_nationkey * 50.0 ELSE 0 END AS y0,
  CASE WHEN n_nationkey % 6 <> 5 THEN n_nationkey * 1000.0 + 400 ELSE n_nationkey * 4 + 100 END AS x1, CASE WHEN n_nationkey % 6 <> 5 THEN n_nationkey * 50.0 + 320 ELSE n_nationkey * 2 + 80 END AS y1 FROM nation)"""
_KIND = ("annotation-text", "annotation-arrow", "roi", "transect", "class-region")


@query(f"""WITH {_SCENES}, m AS (SELECT CAST(c_nationkey AS BIGINT) AS scene_id, c_custkey AS seq, c_custkey % 5 AS k, c_acctbal AS a, c_acctbal / 2 + c_custkey AS b, c_custkey % 50 + 1.5 AS c, c_custkey % 30 + 0.5 AS d, c_name AS label FROM customer),
  w AS (SELECT *, x0 + a / width * (x1 - x0) AS wx, y1 - b / height * (y1 - y0) AS wy, x0 + c / width * (x1 - x0) AS vx, y1 - d / height * (y1 - y0) AS vy, x0 + (a + c) / width * (x1 - x0) AS ux, y1 - (b + d) / height * (y1 - y0) AS uy FROM m JOIN sc USING (scene_id)),
  t AS (SELECT *, k IN (2, 3) AND height IS NULL AS lost FROM w)
  SELECT scene_id, seq, CASE WHEN lost THEN CASE k WHEN 2 THEN 'roi' ELSE 'transect' END || ' of a scene without a size' END AS problem, CASE WHEN NOT lost THEN [{', '.join(repr(k) for k in _KIND)}][k + 1] END AS kind, CASE WHEN NOT lost THEN ['Point', 'LineString', 'Polygon', 'LineString', NULL][k + 1] END AS shape, CASE WHEN NOT lost THEN label END AS label,
    CASE WHEN NOT lost THEN CASE k WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 10 WHEN 3 THEN 4 END END AS numbers,
    CASE WHEN NOT lost THEN round(CASE k WHEN 0 THEN a + b WHEN 1 THEN a + b + c + d WHEN 2 THEN 3 * wx + 2 * ux + 3 * wy + 2 * uy WHEN 3 THEN wx + wy + vx + vy END, 4) END AS total, CASE WHEN NOT lost AND k = 4 THEN round(a + 2 * b + 3 * c + 4 * d, 4) END AS space FROM t""")
def markup_export(spark, sf_dir):
    """A mark a customer, as GeoJSON features; what is in their geometries is summed up to be compared."""
    key = F.col("c_custkey")
    marks = src.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("scene_id"), key.alias("seq"), F.element_at(F.array(*map(F.lit, _KIND)), (F.pmod(key, F.lit(5)) + 1).cast("int")).alias("kind"), key.alias("id"), F.col("c_name").alias("label"), F.lit(None).cast("string").alias("color"), F.lit(None).cast("string").alias("size"),
                                                           F.col("c_acctbal").alias("a"), (F.col("c_acctbal") / 2 + key).alias("b"), (F.pmod(key, F.lit(50)) + 1.5).alias("c"), (F.pmod(key, F.lit(30)) + 0.5).alias("d"), F.lit(None).cast("string").alias("more"))
    out = ops.exported(marks, _scenes(spark, sf_dir)).withColumn("v", F.try_parse_json("feature"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    shape = get("$.geometry.type", "string")
    numbers = F.when(shape == "Point", get("$.geometry.coordinates", "array<double>")).when(shape == "LineString", F.flatten(get("$.geometry.coordinates", "array<array<double>>"))).when(shape == "Polygon", F.flatten(F.flatten(get("$.geometry.coordinates", "array<array<array<double>>>"))))
    out = out.withColumn("n", numbers)
    add = F.aggregate("n", F.lit(0.0), lambda t, x: t + x)
    space = sum((get(f"$.properties.featureSpace.{m}", "double") * w for w, m in enumerate(("xMin", "xMax", "yMin", "yMax"), 1)), F.lit(0.0))
    return out.select("scene_id", "seq", "problem", get("$.properties['markup:kind']", "string").alias("kind"), shape.alias("shape"), get("$.properties.label", "string").alias("label"), F.when(F.col("n").isNotNull(), F.size("n")).alias("numbers"), R(add, 4).alias("total"), R(space, 4).alias("space"))


def _feature(s: str) -> str:
    """A feature an order: kind, shape and defects follow from the order's columns."""
    p = f"concat('[', CAST(o_custkey AS {s}), ',', CAST(o_orderkey % 97 AS {s}), ']')"
    q = f"concat('[', CAST(o_custkey + 12 AS {s}), ',', CASE WHEN o_orderkey % 31 = 0 THEN 'null' ELSE CAST(o_orderkey % 89 AS {s}) END, ']')"
    kind = "CASE o_orderkey % 6 WHEN 0 THEN 'annotation-text' WHEN 1 THEN 'annotation-arrow' WHEN 2 THEN 'roi' WHEN 3 THEN 'transect' WHEN 4 THEN 'class-region' ELSE 'stamp' END"
    geometry = f"""CASE o_orderkey % 6 WHEN 0 THEN concat('{{"type":"Point","coordinates":', {p}, '}}') WHEN 2 THEN concat('{{"type":"Polygon","coordinates":[[', {p}, ',', {q}, ',', {p}, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat(',', {p}) END, ']]}}') WHEN 4 THEN 'null' ELSE concat('{{"type":"', CASE WHEN o_orderkey % 11 = 0 THEN 'Point' ELSE 'LineString' END, '","coordinates":[', {p}, ',', {q}, ']}}') END"""
    return f"""CASE WHEN o_orderkey % 41 = 0 THEN '{{' ELSE concat('{{"type":"', CASE WHEN o_orderkey % 37 = 0 THEN 'Shape' ELSE 'Feature' END, '","id":"o', CAST(o_orderkey AS {s}), '","geometry":', {geometry}, ',"properties":{{', CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE concat('"markup:kind":"', {kind}, '",') END, '"markup:schema":', CASE WHEN o_orderkey % 29 = 0 THEN '2' ELSE '1' END, ',"label":', CASE WHEN o_orderkey % 23 = 0 THEN '5' ELSE concat('"', o_orderstatus, '"') END,
      ',"sourceScene":{{"crs":"', CASE WHEN o_orderkey % 19 = 0 THEN 'EPSG:4326' ELSE 'EPSG:32610' END, '"}},"style":{{', CASE WHEN o_orderkey % 3 = 0 THEN '"color":"red"' ELSE '"size":"large"' END, '}}', CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat(',"featureSpace":{{"xMin":', CAST(o_orderkey % 13 AS {s}), ',"xMax":20,"yMin":-3,"yMax":4}}') END, CASE WHEN o_orderkey % 5 = 0 THEN ',"note":"n"' ELSE '' END, '}}}}') END"""


_X = lambda path: f"TRY_CAST(json_extract_string(j, '$.{path}') AS DOUBLE)"


@query(f"""WITH {_SCENES}, f AS (SELECT CAST(o_custkey % 25 AS BIGINT) AS scene_id, o_orderkey AS seq, {_feature('VARCHAR')} AS t FROM orders), p AS (SELECT scene_id, seq, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM f),
  g AS (SELECT p.*, width, height, x0, y0, x1, y1, json_extract_string(j, '$.properties."markup:kind"') AS kind, json_extract_string(j, '$.geometry.type') AS shape FROM p JOIN sc USING (scene_id)), h AS (SELECT *, CASE kind WHEN 'roi' THEN {_X('geometry.coordinates[0][0][0]')} ELSE {_X('geometry.coordinates[0][0]')} END AS ax, CASE kind WHEN 'roi' THEN {_X('geometry.coordinates[0][0][1]')} ELSE {_X('geometry.coordinates[0][1]')} END AS ay, CASE kind WHEN 'roi' THEN {_X('geometry.coordinates[0][1][0]')} ELSE {_X('geometry.coordinates[1][0]')} END AS bx, CASE kind WHEN 'roi' THEN {_X('geometry.coordinates[0][1][1]')} ELSE {_X('geometry.coordinates[1][1]')} END AS by_ FROM g),
  e AS (SELECT *, CASE WHEN j IS NULL OR json_extract_string(j, '$.type') <> 'Feature' THEN 'not a feature' WHEN kind IS NULL THEN 'no kind' WHEN kind = 'stamp' THEN 'unknown kind stamp' WHEN kind IN ('annotation-arrow', 'transect') AND (shape <> 'LineString' OR by_ IS NULL) THEN 'a line of two points is wanted'
    WHEN kind = 'roi' AND (json_array_length(j, '$.geometry.coordinates[0]') < 4 OR by_ IS NULL) THEN 'a ring is wanted' WHEN kind IN ('roi', 'transect') AND height IS NULL THEN 'the scene has no size' WHEN kind = 'class-region' AND json_type(j, '$.properties.featureSpace') IS NULL THEN 'no feature space' END AS bad FROM h),
  k AS (SELECT *, coalesce(bad, CASE WHEN kind IN ('roi', 'transect') AND row_number() OVER (PARTITION BY scene_id, kind, bad IS NULL ORDER BY seq) > 1 THEN 'more than one ' || kind END) AS problem FROM e),
  n AS (SELECT *, problem IS NULL AS ok, (ax - x0) / (x1 - x0) * width AS ac, (bx - x0) / (x1 - x0) * width AS bc, (y1 - ay) / (y1 - y0) * height AS ar, (y1 - by_) / (y1 - y0) * height AS br FROM k)
  SELECT scene_id, seq, kind, CASE WHEN json_type(j, '$.properties.label') = 'VARCHAR' THEN json_extract_string(j, '$.properties.label') ELSE '' END AS label, coalesce(json_extract_string(j, '$.properties.style.color'), 'cyan') AS color, json_extract_string(j, '$.properties.style.size') AS size, json_extract_string(j, '$.properties.note') AS note, problem,
    CASE WHEN CAST(json_extract_string(j, '$.properties."markup:schema"') AS INTEGER) > 1 THEN 'newer version' WHEN json_extract_string(j, '$.properties.sourceScene.crs') <> 'EPSG:32610' THEN 'CRS EPSG:4326 is not EPSG:32610' END AS warning,
    round(CASE WHEN ok THEN CASE kind WHEN 'annotation-text' THEN {_X('geometry.coordinates[0]')} WHEN 'annotation-arrow' THEN ax WHEN 'roi' THEN least(ac, bc) WHEN 'transect' THEN ac ELSE {_X('properties.featureSpace.xMin')} END END, 6) AS a, round(CASE WHEN ok THEN CASE kind WHEN 'annotation-text' THEN {_X('geometry.coordinates[1]')} WHEN 'annotation-arrow' THEN ay WHEN 'roi' THEN least(ar, br) WHEN 'transect' THEN ar ELSE 20 END END, 6) AS b,
    round(CASE WHEN ok THEN CASE kind WHEN 'annotation-arrow' THEN bx WHEN 'roi' THEN abs(ac - bc) WHEN 'transect' THEN bc WHEN 'class-region' THEN -3 END END, 6) AS c, round(CASE WHEN ok THEN CASE kind WHEN 'annotation-arrow' THEN by_ WHEN 'roi' THEN abs(ar - br) WHEN 'transect' THEN br WHEN 'class-region' THEN 4 END END, 6) AS d FROM n""")
def markup_import(spark, sf_dir):
    """GeoJSON features, an order each, back to marks; what cannot be used is a row with its problem."""
    features = src.table(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(25)).cast("long").alias("scene_id"), F.col("o_orderkey").alias("seq"), F.expr(_feature("STRING")).alias("feature"))
    marks = ops.imported(features, _scenes(spark, sf_dir))
    return marks.select("scene_id", "seq", "kind", "label", "color", "size", F.get_json_object("more", "$.note").alias("note"), "problem", "warning", *(R(F.col(c)).alias(c) for c in "abcd"))
