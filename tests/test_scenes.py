"""Scenes of different grids and image geometry: golden values."""

import pytest
from pyspark.sql import functions as F

from scenequery.functions import geo
from scenequery.operators import scenes

SCENE = "scene_id int, height int, width int, x0 double, y0 double, x1 double, y1 double, crs string, xs array<double>, ys array<double>"


def regions(spark, rows, box, crs="EPSG:1"):
    df = spark.createDataFrame(rows, SCENE)
    ids = spark.createDataFrame([(r[0],) for r in rows] + [(99,)], "scene_id int")
    asked = ids.select(F.lit("q").alias("request"), "scene_id", *(F.lit(float(v)).alias(n) for n, v in zip(("rx0", "ry0", "rx1", "ry1"), box, strict=True)), F.lit(crs).alias("rcrs"))
    return {r.scene_id: r for r in scenes.regions(df, asked).collect()}


def test_regions_of_even_and_listed_grids(spark):
    xs, ys = [0.5, 1.7, 2.5, 3.5, 4.5], [3.5, 2.6, 1.5, 0.5]
    rows = [(1, 4, 5, 0.0, 0.0, 5.0, 4.0, "EPSG:1", None, None), (2, 4, 5, 0.0, 0.0, 5.0, 4.0, "EPSG:1", xs, ys), (3, 4, 5, 0.0, 0.0, 5.0, 4.0, "EPSG:2", None, None), (4, 4, 5, 9.0, 0.0, 14.0, 4.0, "EPSG:1", None, None), (5, 4, 5, 0.0, 0.0, 5.0, 4.0, None, None, None), (6, 2, 2, 0.0, 0.0, 5.0, 4.0, "EPSG:1", [0.5, 4.5], None)]
    got = regions(spark, rows, (1.6, 0.9, 3.4, 2.6))
    part = lambda r: (r.first_row, r.first_col, r.rows, r.cols, r.bx0, r.by0, r.bx1, r.by1, r.problem)
    assert part(got[1]) == (1, 1, 3, 4, 1.0, 0.0, 5.0, 3.0, None)  # ends one further, as far as there are pixels
    assert part(got[2]) == (1, 1, 2, 2, 1.7, 1.5, 2.5, 2.6, None)
    assert part(got[6]) == (0, 0, 2, 2, 0.0, 0.0, 5.0, 4.0, None)  # two coordinates are no array
    assert [got[k].problem for k in (3, 4, 5, 99)] == ["CRS EPSG:2 is not EPSG:1", "region misses the scene", "CRS unknown is not EPSG:1", "no such scene"]
    assert got[3].rows is None and regions(spark, rows[1:2], (1.8, 1.0, 2.4, 2.0))[2].problem == "no pixel in the region"
    assert regions(spark, rows[:1], (-10, -10, 50, 50))[1].cols == 5 and regions(spark, rows[:1], (5, 0, 6, 4))[1].problem == "region misses the scene"


def test_looks_follow_each_scene(spark):
    sized = spark.createDataFrame([(1, 5, 9, 4), (2, 3, 4, 4)], "scene_id int, height int, width int, most int")
    px = spark.createDataFrame([(s, r, c, float(r * 10 + c)) for s, h, w in ((1, 5, 9), (2, 3, 4), (3, 1, 1)) for r in range(h + 1) for c in range(w)], "scene_id int, row int, col int, v double")
    got = {(r.scene_id, r.row, r.col): (r.v, r.n) for r in scenes.capped(px, sized, 4).collect()}
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, r, c): (float(r * 10 + c), 1) for r in range(3) for c in range(4) if r + c}
    assert got[1, 0, 0] == (sum(r * 10 + c for r in range(3) for c in range(3)) / 8, 8) and got[1, 1, 2] == (42.0, 6) and len([k for k in got if k[0] == 1]) == 6
    assert [(r.looks, r.height, r.width) for r in scenes.capped_size(sized, 4).orderBy("scene_id").collect()] == [(3, 2, 3), (1, 3, 4)]
    assert scenes.capped_size(sized.limit(0)).collect() == [] and scenes.capped(px, sized.limit(0)).collect() == []


def test_series_have_a_row_for_each_scene(spark):
    rows = [(k, 4, 5, 0.0, 0.0, 5.0, 4.0, crs, None, None) for k, crs in ((1, "EPSG:1"), (2, "EPSG:1"), (3, "EPSG:2"))]
    df = spark.createDataFrame(rows, SCENE)
    px = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, 4.0), (1, 3, 4, 100.0), (2, 0, 0, -1.0), (3, 0, 0, 5.0)], "scene_id int, row int, col int, v double")
    asked = df.select(F.lit("q").alias("request"), "scene_id", F.lit(0.0).alias("rx0"), F.lit(3.0).alias("ry0"), F.lit(1.5).alias("rx1"), F.lit(4.0).alias("ry1"), F.lit("EPSG:1").alias("rcrs"))
    got = {r.scene_id: (r["mean"], r.n, r.problem) for r in scenes.series(px, scenes.regions(df, asked)).collect()}
    assert got == {1: (3.0, 2, None), 2: (None, 0, "no valid pixel"), 3: (None, 0, "CRS EPSG:2 is not EPSG:1")}


def test_pixels_to_the_ground_and_back(spark):
    """Published earth-centred points, then a frame around one of them."""
    points = [((0.0, 0.0, 0.0), (6378137.0, 0.0, 0.0)), ((90.0, 0.0, 0.0), (0.0, 0.0, 6356752.314245)), ((45.0, 45.0, 1000.0), (3194919.145, 3194919.145, 4488055.516)), ((0.0, -90.0, -10.0), (0.0, -6378127.0, 0.0))]
    for (lat, lon, h), want in points:
        x, y, z = spark.range(1).select(*geo.to_ecef(F.lit(lat), F.lit(lon), F.lit(h))).first()
        assert (x, y, z) == pytest.approx(want, abs=2e-3)
    centre = tuple(map(F.lit, (3194419.145, 3194419.145, 4487348.409)))  # 45 north, 45 east, on the ellipsoid
    south, east = (0.5, 0.5, -0.7071067811865476), (-0.7071067811865476, 0.7071067811865476, 0.0)
    frame = geo.Frame(centre, south, east, 10.0, 20.0, 500, 400, 100, 50)
    spot = spark.range(1).select(*frame.to_ground(F.lit(400), F.lit(350))).first()
    assert tuple(spot) == pytest.approx((45.0, 45.0, 0.0), abs=1e-3)
    there = spark.range(1).select(*frame.to_image(F.lit(45.0), F.lit(45.0), F.lit(0.0))).first()
    assert tuple(there) == pytest.approx((400, 350), abs=1e-3)
    lower = spark.range(1).select(*frame.to_ground(F.lit(1400), F.lit(350))).first()
    assert lower[0] == pytest.approx(45 - 10_000 / 111_131.8, abs=1e-4) and lower[1] == pytest.approx(45.0, abs=1e-9) and lower[2] == pytest.approx(10_000**2 / 2 / 6_378_000, rel=0.01)
    grid = spark.createDataFrame([(float(r), float(c)) for r in (0, 37, 799) for c in (0, 123, 599)], "r double, c double")
    lat, lon, h = frame.to_ground(F.col("r"), F.col("c"))
    back = grid.select("r", "c", lat.alias("lat"), lon.alias("lon"), h.alias("h")).select("r", "c", *frame.to_image(F.col("lat"), F.col("lon"), F.col("h"))).collect()
    assert all((r[2], r[3]) == pytest.approx((r[0], r[1]), abs=1e-6) for r in back)
    west, s, e, n = spark.range(1).select(*frame.box(800, 600)).first()
    assert west < 45 < e and s < 45 < n and n - 45 == pytest.approx(4_000 / 111_131.8, abs=1e-3)


def test_marks_survive_a_round_trip(spark):
    from scenequery.operators import markup

    scene = spark.createDataFrame([(1, 200, 100, 10.0, 20.0, 50.0, 40.0, "EPSG:1"), (2, 0, 0, None, None, None, None, None)], "scene_id int, width int, height int, x0 double, y0 double, x1 double, y1 double, crs string")
    schema = "scene_id int, seq int, kind string, id string, label string, color string, size string, a double, b double, c double, d double, more string"
    rows = [
        (1, 1, "annotation-text", 't"1', 'a "b" \\ c', "red", "small", 1.5, 2.5, None, None, '{"observer":"agent","n":{"k":[1,null]}}'),
        (1, 2, "annotation-arrow", "2", None, None, None, 1.0, 2.0, 3.0, 4.0, None), (1, 3, "roi", "3", "r", None, None, 10.0, 20.0, 30.0, 40.0, None), (1, 4, "transect", None, "t", None, None, 0.0, 0.0, 200.0, 100.0, None),
        (1, 5, "class-region", "5", "c", None, None, -20.0, -10.0, -30.0, -25.0, None), (2, 6, "roi", "6", "r", None, None, 1.0, 1.0, 1.0, 1.0, None), (2, 7, "annotation-text", "7", "x", None, None, 0.0, 0.0, None, None, "not json"), (1, 8, "stamp", "8", "x", None, None, 0.0, 0.0, None, None, None),
    ]
    out = markup.exported(spark.createDataFrame(rows, schema), scene).cache()
    told = {r.seq: r for r in out.collect()}
    import json

    assert set(told) == {1, 2, 3, 4, 5, 6, 7} and told[6].feature is None and told[6].problem == "roi of a scene without a size"
    roi = json.loads(told[3].feature)
    assert roi["geometry"] == {"type": "Polygon", "coordinates": [[[12.0, 36.0], [12.0, 28.0], [18.0, 28.0], [18.0, 36.0], [12.0, 36.0]]]} and roi["id"] == "3"
    assert roi["properties"]["markup:kind"] == "roi" and roi["properties"]["observer"] == "human" and roi["properties"]["style"] == {"color": "cyan", "size": "medium"} and roi["properties"]["sourceScene"] == {"crs": "EPSG:1", "bounds": [10.0, 20.0, 50.0, 40.0]}
    region = json.loads(told[5].feature)
    assert region["geometry"] is None and region["properties"]["featureSpace"] == {"xMin": -20.0, "xMax": -10.0, "yMin": -30.0, "yMax": -25.0}
    text = json.loads(told[1].feature)
    assert text["id"] == 't"1' and text["properties"]["label"] == 'a "b" \\ c' and text["properties"]["observer"] == "agent" and text["properties"]["method"] == "manual" and text["properties"]["n"] == {"k": [1, None]}
    assert json.loads(told[4].feature)["id"] is None
    back = {r.seq: r for r in markup.imported(out.filter("feature is not null").select("scene_id", "seq", "feature"), scene).collect()}
    for _, seq, kind, id_, label, color, _, a, b, c, d, _ in (r for r in rows if r[1] in back):
        r = back[seq]
        assert (r.kind, r.id, r.label, r.color, r.problem, r.warning) == (kind, id_, label or "", color or "cyan", None, None)
        assert all(x == y or x == pytest.approx(y, abs=1e-9) for x, y in zip((r.a, r.b, r.c, r.d), (a, b, c, d), strict=True))
    assert json.loads(back[1].more)["n"] == {"k": [1, None]}


def test_features_that_are_no_marks(spark):
    import json

    from scenequery.operators import markup

    scene = spark.createDataFrame([(1, 200, 100, 10.0, 20.0, 50.0, 40.0, "EPSG:1")], "scene_id int, width int, height int, x0 double, y0 double, x1 double, y1 double, crs string")
    feature = lambda kind, geometry, **more: json.dumps({"type": "Feature", "geometry": geometry, "properties": {"markup:kind": kind} | more})
    ring = [[12, 36], [12, 28], [18, 28], [12, 36]]
    line = {"type": "LineString", "coordinates": [[10, 40], [50, 20]]}
    cases = [
        ("{", "not a feature"), (None, "not a feature"), ('{"type":"Feature"}', "no kind"), (feature("stamp", None), "unknown kind stamp"), (feature("annotation-text", line), "a point is wanted"), (feature("annotation-text", {"type": "Point", "coordinates": ["x", 1]}), "a point is wanted"),
        (feature("annotation-arrow", {"type": "LineString", "coordinates": [[1, 2]]}), "a line of two points is wanted"), (feature("roi", {"type": "Polygon", "coordinates": [ring[:3]]}), "a ring is wanted"), (feature("roi", None), "a ring is wanted"), (feature("roi", {"type": "Polygon", "coordinates": [ring]}), None),
        (feature("roi", {"type": "Polygon", "coordinates": [ring]}), "more than one roi"), (feature("transect", line), None), (feature("transect", line), "more than one transect"), (feature("class-region", None), "no feature space"), (feature("class-region", None, featureSpace={"xMin": 1}), None),
    ]
    df = spark.createDataFrame([(1, i, t) for i, (t, _) in enumerate(cases)], "scene_id int, seq int, feature string")
    got = markup.imported(df, scene).orderBy("seq").collect()
    assert [r.problem for r in got] == [p for _, p in cases]
    assert (got[9].a, got[9].b, got[9].c, got[9].d) == pytest.approx((10, 20, 30, 40)) and (got[11].a, got[11].b, got[11].c, got[11].d) == pytest.approx((0, 0, 200, 100)) and (got[14].a, got[14].b) == (1.0, None) and got[8].a is None
    newer = spark.createDataFrame([(1, 0, feature("transect", line, **{"markup:schema": 2})), (1, 1, feature("class-region", None, featureSpace={}, sourceScene={"crs": "EPSG:2"}))], "scene_id int, seq int, feature string")
    assert [r.warning for r in markup.imported(newer, scene).orderBy("seq").collect()] == ["newer version", "CRS EPSG:2 is not EPSG:1"]
    assert markup.imported(newer.limit(0), scene).collect() == []


def test_map_texts(spark):
    from scenequery.functions import texts

    one = lambda c: spark.range(1).select(c).first()[0]
    at = lambda v, projected, axis: one(texts.coordinate(F.lit(float(v)), F.lit(projected), axis))
    assert (at(584200, True, "x"), at(4142000.4, True, "y"), at(-1234.6, True, "x"), at(999, True, "y"), at(0, True, "x")) == ("584 200 E", "4 142 000 N", "−1 235 E", "999 N", "0 E")
    assert (at(-122.084, False, "x"), at(37.42, False, "y"), at(0, False, "x"), at(-0.5, False, "y")) == ("122.08°W", "37.42°N", "0.00°E", "0.50°S")
    size = lambda w, h, projected: one(texts.extent(F.lit(float(w)), F.lit(float(h)), F.lit(projected)))
    assert (size(12400, 8700, True), size(999, 1000, True), size(340, 220, True), size(0.34, 0.22, False)) == ("12.4 × 8.7 km", "1.0 × 1.0 km", "340 × 220 m", "0.34° × 0.22°")
    bars = [tuple(spark.range(1).select(*texts.scale_bar(F.lit(p))).first()) for p in (0.01, 0.1, 1.0, 15.0, 200.0)]
    assert [(m, round(b, 6), label) for m, b, label in bars] == [(10000.0, 100.0, "10 km"), (1000.0, 100.0, "1.0 km"), (100.0, 100.0, "100 m"), (5.0, 75.0, "5.0 m"), (0.5, 100.0, "0.50 m")]


def test_terms_of_products(spark):
    from scenequery.functions import terms

    array = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    none = F.lit(None).cast("array<string>")
    found = lambda *lists: spark.range(1).select(terms.detect(*lists, F.lit("/g/A"))).first()[0]
    assert found(array("HHHH", "HHVV", "x"), array("VV"), array("/g/A/VVVV")) == ["HHHH", "HHVV"]
    assert found(array("x"), array(" HH", "HV ", "HHH"), none) == ["HHHH", "HVHV"] and found(none, array(), array("/g/B/HHHH", "/g/A/mask", "/g/A/RHRV")) == ["RHRV"]
    assert found(none, none, none) == ["HHHH", "HVHV", "VHVH", "VVVV"]
    best = lambda *t: spark.range(1).select(terms.automatic_composite(array(*t))).first()[0]
    assert (best("HHHH", "HVHV", "VVVV", "VHVH"), best("VHVH", "VVVV"), best("HHHH", "VVVV")) == ("dual-pol-h", "dual-pol-v", None)


def test_scenes_without_values_are_empty(spark):
    from scenequery.operators import stats

    rows = [(1, None), (1, None), *[(2, float(v)) for v in (1, 2, 300, 400)], *[(3, v) for v in (1.0, 1.1, 1.2)], *[(4, float(v)) for v in (10, 25, 26, 27)], *[(5, float(v)) for v in (1, 2, 30, 31)]]
    got = {r.scene_id: r for r in stats.analyse_scene(spark.createDataFrame(rows, "scene_id int, v double"), ["scene_id"]).collect()}
    assert [got[k].scene_type for k in range(1, 6)] == ["empty", "urban", "water", "uniform", "mixed"]
    assert [got[k].method for k in range(1, 6)] == [None, "adaptiveLog", "percentileGamma", "localContrast", "hybrid"]
    assert (got[3].low, got[3].high, got[5].gamma, got[4].local_contrast, got[1].p10, got[1].gamma) == (0.05, 0.95, 0.45, 0.4, None, None)
