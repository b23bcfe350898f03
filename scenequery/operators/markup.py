"""Markup on scenes (arrows, texts, a region, a transect, classes in feature space) as GeoJSON features, out and in.

Features are texts; geometries are VARIANT values while they are checked, so points, lines, rings and null geometries go through one
plan. ``marks``: scene_id, seq, kind, id, label, color, size, a, b, c, d, more. The four numbers are x, y (and x, y of the head) of texts and
arrows in the scene's coordinates; left, top, width, height of a region and column, row, column, row of a transect in pixels; x from,
x to, y from, y to of a class. ``more`` holds further properties as a JSON object; they survive a round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VERSION, PREFIX = 1, "markup"
#: The kinds of marks and the geometries that they have.
KINDS = {"annotation-text": "Point", "annotation-arrow": "LineString", "roi": "Polygon", "transect": "LineString", "class-region": None}
COLOUR, SIZE = "cyan", "medium"


def _frame(scenes: DataFrame) -> DataFrame:
    """Scenes (scene_id, width, height, x0, y0, x1, y1, crs) with _x0 to _y1: their bounds, or their pixels where they have none."""
    given = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    pixels = {"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.col("width").cast("double"), "y1": F.col("height").cast("double")}
    return scenes.select("scene_id", "width", "height", "crs", F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)).alias("_sized"), *(F.when(given, F.col(c)).otherwise(v).alias(f"_{c}") for c, v in pixels.items()))


def exported(marks: DataFrame, scenes: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """(scene_id, seq, feature, problem): a GeoJSON feature for each mark, rings counter-clockwise from the north-west corner.

    A region or transect of a scene without a size has no place: its problem says so. Unknown kinds are left out.
    """
    met = marks.filter(F.col("kind").isin(*KINDS)).join(_frame(scenes), "scene_id", "left")
    world = lambda col, row: F.array(F.col("_x0") + col / F.col("width") * (F.col("_x1") - F.col("_x0")), F.col("_y1") - row / F.col("height") * (F.col("_y1") - F.col("_y0")))
    a, b, c, d = (F.col(n).cast("double") for n in "abcd")
    shape = lambda kind, coordinates: F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))
    ring = F.array(F.array(world(a, b), world(a, b + d), world(a + c, b + d), world(a + c, b), world(a, b)))
    kind = F.col("kind")
    geometry = (
        F.when(kind == "annotation-text", shape("Point", F.array(a, b))).when(kind == "annotation-arrow", shape("LineString", F.array(F.array(a, b), F.array(c, d))))
        .when(kind == "roi", shape("Polygon", ring)).when(kind == "transect", shape("LineString", F.array(world(a, b), world(c, d)))).otherwise("null")
    )
    problem = F.when(kind.isin("roi", "transect") & ~F.coalesce("_sized", F.lit(False)), F.concat(kind, F.lit(" of a scene without a size")))
    own = {"observer": F.lit("human"), "method": F.lit("manual")}
    bounds = F.when(F.col("_x0").isNotNull(), F.array("_x0", "_y0", "_x1", "_y1"))
    fixed = F.to_json(F.struct(kind.alias(f"{prefix}:kind"), F.lit(VERSION).alias(f"{prefix}:schema"), F.coalesce("label", F.lit("")).alias("label"), F.struct(F.col("crs").alias("crs"), bounds.alias("bounds")).alias("sourceScene"), F.struct(F.coalesce("color", F.lit(COLOUR)).alias("color"), F.coalesce("size", F.lit(SIZE)).alias("size")).alias("style"), F.when(kind == "class-region", F.struct(a.alias("xMin"), b.alias("xMax"), c.alias("yMin"), d.alias("yMax"))).alias("featureSpace")))
    as_map = lambda text: F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    fixed_map, more_map, own_map = as_map(fixed), as_map(F.col("more")), as_map(F.to_json(F.struct(*(v.alias(k) for k, v in own.items()))))
    lower = lambda low, high: F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)
    properties = F.to_json(lower(lower(own_map, more_map), fixed_map))  # what the mark has of its own beats the defaults, its place in the schema beats both
    listed = F.to_json(F.array(F.col("id").cast("string")))
    text = F.concat(F.lit('{"type":"Feature","id":'), listed.substr(F.lit(2), F.length(listed) - 2), F.lit(',"geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}"))
    return met.select("scene_id", "seq", F.when(problem.isNull(), text).alias("feature"), problem.alias("problem"))


def imported(features: DataFrame, scenes: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Marks of features (scene_id, seq, feature), with problem (and no numbers) where one cannot be used, and warning.

    Of several regions or transects of a scene the first usable one counts. A missing colour is cyan; properties beyond the schema go to
    more. Warnings: a newer version, coordinates of another CRS than the scene's.
    """
    known = [f"{prefix}:kind", f"{prefix}:schema", "label", "style", "sourceScene", "featureSpace"]
    v = F.try_parse_json("feature")
    rows = features.withColumn("_v", v).join(_frame(scenes), "scene_id", "left")
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    rows = rows.withColumns({
        "kind": get(f"$.properties['{prefix}:kind']", "string"), "id": get("$.id", "string"), "label": F.when(F.schema_of_variant(get("$.properties.label", "variant")) == "STRING", get("$.properties.label", "string")).otherwise(""),
        "color": F.coalesce(get("$.properties.style.color", "string"), F.lit(COLOUR)), "size": get("$.properties.style.size", "string"), "_type": get("$.geometry.type", "string"), "_feature": get("$.type", "string"), "_crs": get("$.properties.sourceScene.crs", "string"), "_version": get(f"$.properties['{prefix}:schema']", "double"),
        "_point": get("$.geometry.coordinates", "array<double>"), "_line": get("$.geometry.coordinates", "array<array<double>>"), "_rings": get("$.geometry.coordinates", "array<array<array<double>>>"), "_space": get("$.properties.featureSpace", "variant"),
        "more": F.map_filter(get("$.properties", "map<string,variant>"), lambda k, _: ~k.isin(*known)),
    })
    pair = lambda p: F.coalesce((F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull(), F.lit(False))
    two = F.coalesce((F.size("_line") >= 2) & pair(F.get("_line", 0)) & pair(F.get("_line", 1)), F.lit(False))
    ring = F.get("_rings", 0)
    closed = F.coalesce((F.size(ring) >= 4) & F.forall(ring, pair), F.lit(False))
    kind, shaped = F.col("kind"), lambda name: F.col("_type").eqNullSafe(name)
    problem = (
        F.when(F.col("_v").isNull() | ~F.col("_feature").eqNullSafe("Feature"), "not a feature").when(kind.isNull(), "no kind").when(~kind.isin(*KINDS), F.concat(F.lit("unknown kind "), kind))
        .when((kind == "annotation-text") & ~(shaped("Point") & pair(F.col("_point"))), "a point is wanted").when(kind.isin("annotation-arrow", "transect") & ~(shaped("LineString") & two), "a line of two points is wanted")
        .when((kind == "roi") & ~(shaped("Polygon") & closed), "a ring is wanted").when(kind.isin("roi", "transect") & ~F.coalesce("_sized", F.lit(False)), "the scene has no size")
        .when((kind == "class-region") & ~F.coalesce(F.schema_of_variant("_space").startswith("OBJECT"), F.lit(False)), "no feature space")
    )
    order = Window.partitionBy("scene_id", "kind", F.col("_problem").isNull()).orderBy("seq")
    rows = rows.withColumn("_problem", problem).withColumn("_k", F.row_number().over(order))
    rows = rows.withColumn("problem", F.coalesce("_problem", F.when(kind.isin("roi", "transect") & (F.col("_k") > 1), F.concat(F.lit("more than one "), kind))))
    col = lambda x: (x - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * F.col("width")
    row = lambda y: (F.col("_y1") - y) / (F.col("_y1") - F.col("_y0")) * F.col("height")
    side = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    west, east, south, north = side(F.array_min, 0), side(F.array_max, 0), side(F.array_min, 1), side(F.array_max, 1)
    at = lambda i, k: F.get(F.get("_line", i), k)
    space = lambda name: F.try_variant_get("_space", f"$.{name}", "double")
    numbers = {
        "a": (F.get("_point", 0), at(0, 0), col(west), col(at(0, 0)), space("xMin")), "b": (F.get("_point", 1), at(0, 1), row(north), row(at(0, 1)), space("xMax")),
        "c": (F.lit(None).cast("double"), at(1, 0), col(east) - col(west), col(at(1, 0)), space("yMin")), "d": (F.lit(None).cast("double"), at(1, 1), row(south) - row(north), row(at(1, 1)), space("yMax")),
    }
    chosen = lambda options: F.when(F.col("problem").isNull(), F.coalesce(*(F.when(kind == k, o) for k, o in zip(("annotation-text", "annotation-arrow", "roi", "transect", "class-region"), options, strict=True))))
    warning = F.when(F.col("_version") > VERSION, "newer version").when(F.col("_crs") != F.col("crs"), F.concat(F.lit("CRS "), F.col("_crs"), F.lit(" is not "), F.col("crs")))
    return rows.select("scene_id", "seq", "kind", "id", "label", "color", "size", *(chosen(o).alias(n) for n, o in numbers.items()), F.when(F.size("more") > 0, F.to_json("more")).alias("more"), "problem", warning.alias("warning"))
