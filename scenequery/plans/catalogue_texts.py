"""Queries of product terms, granule records and map texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records, terms, texts
from ..sources import adapters as src
from .registry import query

G = src.GRANULES_SQL
_KNOWN = ", ".join(repr(t) for t in (*terms.LINEAR, *terms.COMPACT, *terms.BESIDE))
#: Lists of a product, from columns of an order: listed terms, polarizations, data paths.
_LISTS = {
    "terms": "CASE WHEN o_orderkey % 3 = 0 THEN concat(CASE WHEN o_orderkey % 2 = 0 THEN 'HHHH,HVHV' ELSE 'VVVV,VHVH,x' END, ',', o_orderstatus) WHEN o_orderkey % 3 = 1 THEN 'none,other' END",
    "pols": "CASE WHEN o_orderkey % 5 < 3 THEN concat(CASE WHEN o_custkey % 2 = 0 THEN ' HH,HV ' ELSE 'VV,VH' END, ',', substr(o_orderpriority, 1, 1)) END",
    "paths": "CASE WHEN o_orderkey % 7 < 5 THEN concat('/s/A/', CASE WHEN o_custkey % 3 = 0 THEN 'VVVV' ELSE 'RHRH' END, ',/s/B/HHHH,/s/A/mask,/s/A/', CASE WHEN o_orderkey % 2 = 0 THEN 'VHVH' ELSE 'HHVV' END) ELSE '' END",
}


@query(f"""WITH o AS (SELECT o_orderkey AS id, string_split({_LISTS['terms']}, ',') AS t, string_split({_LISTS['pols']}, ',') AS p, string_split({_LISTS['paths']}, ',') AS d FROM orders),
  a AS (SELECT id, list_filter(t, lambda x: list_contains([{_KNOWN}], x)) AS t, list_transform(list_filter(list_transform(p, lambda x: trim(x)), lambda x: length(x) = 2), lambda x: x || x) AS p, list_filter(list_transform(list_filter(d, lambda x: starts_with(x, '/s/A')), lambda x: substr(x, 6)), lambda x: list_contains([{_KNOWN}], x)) AS d FROM o),
  f AS (SELECT id, CASE WHEN len(t) > 0 THEN t WHEN len(p) > 0 THEN p WHEN len(d) > 0 THEN d ELSE ['HHHH', 'HVHV', 'VHVH', 'VVVV'] END AS f FROM a)
  SELECT id, array_to_string(f, ',') AS terms, CASE WHEN list_contains(f, 'HHHH') AND list_contains(f, 'HVHV') THEN 'dual-pol-h' WHEN list_contains(f, 'VVVV') AND list_contains(f, 'VHVH') THEN 'dual-pol-v' END AS composite FROM f""")
def covariance_terms(spark, sf_dir):
    """Covariance terms of products by what they list, their polarizations or their data, and the composite that is chosen by itself."""
    lists = {k: F.split(F.expr(v), ",") for k, v in _LISTS.items()}
    found = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), terms.detect(lists["terms"], lists["pols"], lists["paths"], F.lit("/s/A")).alias("t"))
    return found.select("id", F.array_join("t", ",").alias("terms"), terms.automatic_composite(F.col("t")).alias("composite"))


def _record(s: str) -> str:
    """A granule record an order: date as a range, a single one, or none; links and sizes as the order has them."""
    return f"""concat('{{"meta":{{"concept-id":"G', CAST(o_orderkey AS {s}), '"', CASE WHEN o_orderkey % 5 = 0 THEN ',"collection-concept-id":"C1"' ELSE '' END, '}},"umm":{{', CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('"GranuleUR":"g', CAST(o_orderkey AS {s}), '",') END, '"TemporalExtent":{{', CASE o_orderkey % 4 WHEN 0 THEN concat('"RangeDateTime":{{"BeginningDateTime":"', CAST(CAST(o_orderdate AS DATE) AS {s}), 'T00:00:00Z"}}') WHEN 1 THEN concat('"SingleDateTime":"', CAST(CAST(o_orderdate AS DATE) AS {s}), '"') WHEN 2 THEN concat('"SingleDateTime":{{"Date":"', CAST(CAST(o_orderdate AS DATE) AS {s}), '"}}') ELSE '' END,
      '}},"RelatedUrls":[', CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('{{"Type":"GET RELATED VISUALIZATION","URL":"b', CAST(o_custkey AS {s}), '.png"}},') END, '{{"Type":"GET DATA","URL":"d.h5"}}]', CASE WHEN o_custkey % 2 = 0 THEN concat(',"DataGranule":{{"ArchiveAndDistributionInformation":[{{"SizeInBytes":', CAST(o_custkey AS {s}), '}},{{"SizeInBytes":1}}]}}') ELSE '' END, '}}}}')"""


_J = lambda path: f"json_extract_string(j, '$.{path}')"


@query(f"""WITH r AS (SELECT o_orderkey AS row_id, CAST({_record('VARCHAR')} AS JSON) AS j FROM orders), u AS (SELECT *, list_filter(CAST(json_extract(j, '$.umm.RelatedUrls') AS JSON[]), lambda x: json_extract_string(x, '$.Type') = 'GET RELATED VISUALIZATION') AS b FROM r)
  SELECT row_id, coalesce({_J('umm.GranuleUR')}, {_J('meta."concept-id"')}, '') AS id, {_J('meta."concept-id"')} AS concept, {_J('meta."collection-concept-id"')} AS collection,
    coalesce({_J('umm.TemporalExtent.RangeDateTime.BeginningDateTime')}, {_J('umm.TemporalExtent.SingleDateTime.Date')}, {_J('umm.TemporalExtent.SingleDateTime')}) AS datetime, json_extract_string(b[1], '$.URL') AS browse, CAST({_J('umm.DataGranule.ArchiveAndDistributionInformation[0].SizeInBytes')} AS BIGINT) AS size FROM u""")
def umm_details(spark, sf_dir):
    """Identifiers, date, browse link and size of granule records."""
    item = F.try_parse_json(F.expr(_record("STRING")))
    return src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.inline(F.array(records.umm_details(item))))


_W = lambda v, n: f"printf('%.{n}f', round(CAST({v} AS DECIMAL(38,12)), {n}))"
_GROUP = lambda v: f"CASE WHEN {v} < 0 THEN '−' ELSE '' END || replace(format('{{:,}}', CAST(floor(abs({v}) + 0.5) AS BIGINT)), ',', ' ')"


@query(f"""WITH {G}, k AS (SELECT *, id % 2 = 0 AS projected, x0 * 7654.5 AS px, y0 * 98765.4 AS py, id % 5000 + 0.25 AS w, id % 997 + 0.75 AS h, pow(10, id % 7 - 4) * (1 + id % 9) AS ppu FROM granules),
  s AS (SELECT *, 150.0 / ppu / 1.5 AS rough FROM k), m AS (SELECT *, pow(10, floor(log10(rough))) AS mag FROM s), b AS (SELECT *, mag * CASE WHEN rough / mag < 1.5 THEN 1 WHEN rough / mag < 3.5 THEN 2 WHEN rough / mag < 7.5 THEN 5 ELSE 10 END AS metres FROM m)
  SELECT id, CASE WHEN projected THEN {_GROUP('px')} || ' E' ELSE {_W('abs(x0)', 2)} || '°' || CASE WHEN x0 >= 0 THEN 'E' ELSE 'W' END END AS x, CASE WHEN projected THEN {_GROUP('py')} || ' N' ELSE {_W('abs(y0)', 2)} || '°' || CASE WHEN y0 >= 0 THEN 'N' ELSE 'S' END END AS y,
    CASE WHEN projected THEN CASE WHEN w >= 1000 OR h >= 1000 THEN {_W('w / 1000', 1)} || ' × ' || {_W('h / 1000', 1)} || ' km' ELSE {_W('w', 0)} || ' × ' || {_W('h', 0)} || ' m' END ELSE {_W('w', 2)} || '° × ' || {_W('h', 2)} || '°' END AS extent,
    round(metres, 6) AS metres, round(metres * ppu, 3) AS bar, CASE WHEN metres >= 10000 THEN {_W('metres / 1000', 0)} || ' km' WHEN metres >= 1000 THEN {_W('metres / 1000', 1)} || ' km' WHEN metres >= 10 THEN {_W('metres', 0)} || ' m' WHEN metres >= 1 THEN {_W('metres', 1)} || ' m' ELSE {_W('metres', 2)} || ' m' END AS label FROM b""")
def map_texts(spark, sf_dir):
    """Coordinates, extents and scale bars as maps show them."""
    k = F.col("id")
    g = src.granules(spark, sf_dir).withColumns({"projected": F.pmod(k, F.lit(2)) == 0, "w": F.pmod(k, F.lit(5000)) + 0.25, "h": F.pmod(k, F.lit(997)) + 0.75, "ppu": F.pow(F.lit(10.0), F.pmod(k, F.lit(7)) - 4) * (1 + F.pmod(k, F.lit(9)))})
    shown = lambda a, b: F.when(F.col("projected"), F.col(a) * b).otherwise(F.col(a))
    metres, bar, label = texts.scale_bar(F.col("ppu"))
    return g.select("id", texts.coordinate(shown("x0", 7654.5), F.col("projected"), "x").alias("x"), texts.coordinate(shown("y0", 98765.4), F.col("projected"), "y").alias("y"), texts.extent(F.col("w"), F.col("h"), F.col("projected")).alias("extent"), F.round(metres, 6).alias("metres"), F.round(bar, 3).alias("bar"), label.alias("label"))
