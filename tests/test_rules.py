"""Golden values of rules: tiles, names, listings, zooms, edges, cubes, footprints, records, projections."""

import math

import pytest
from pyspark.sql import functions as F

from scenequery.functions import footprints, geo, names, records
from scenequery.operators import cube, grids, learning, search


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tile_starts_stay_inside():
    assert grids.tile_starts(100, 40, 6) == [0, 22, 50, 60]
    assert grids.tile_starts(40, 40, 6) == [0] and grids.tile_starts(30, 40, 6) == [0]
    assert grids.tile_starts(64, 32, 0) == [0, 32] and grids.tile_starts(65, 32, 0) == [0, 32, 33]
    for bad in (-1, 20, 25):
        with pytest.raises(ValueError):
            grids.tile_starts(100, 40, bad)


def test_tiles_cover_every_pixel_with_weight(spark):
    px = spark.range(50 * 70).select((F.col("id") / 70).cast("int").alias("row"), F.pmod("id", F.lit(70)).cast("int").alias("col"), F.lit(1.0).alias("v"))
    w = grids.in_tiles(px, 50, 70, 32, 5).groupBy("row", "col").agg(F.sum("w").alias("w"))
    assert w.count() == 3500 and w.where("w <= 0").count() == 0
    whole = grids.in_tiles(px, 50, 70, 96, 5)
    assert whole.count() == 3500 and whole.where("w <> 1").count() == 0


def test_bands_of_urls(spark):
    urls = {"a/S1_vv_x.tif": "VV", "S1-HV.tif": "HV", "x_pre-1.tif": "pre", "x-COH.tif": "coherence", "x_Amp_": "amplitude", "vv.tif": "band_3", "a/vv/b.tif": "band_3", "x_vvx.tif": "band_3", "x_int.tif": "intensity", "x_phase_vh_": "VH"}
    for url, band in urls.items():
        assert one(spark, names.band_of(F.lit(url), F.lit(3)))[0] == band, url


def test_sizes_as_text(spark):
    for n, text in {None: "—", 0: "—", 1: "1 B", 1023: "1023 B", 1024: "1 KB", 1536: "2 KB", 2560: "3 KB", 1048575: "1024 KB", 1048576: "1.0 MB", 1310720: "1.3 MB", 1073741824: "1.00 GB", 1234567890123: "1149.78 GB"}.items():
        assert one(spark, names.size_text(F.lit(n).cast("long")))[0] == text


def test_listings(spark):
    html = """<a href="../">Parent</a> <a href="?C=N">Name</a><a href='#top'>top</a> <A HREF=sub%20dir/>sub</A>   -
    <a title="x" href="a+b%26c.h5">f</a> 2024-01-02 10:11  1.5K
    <a href="https://other.org/x.tif">x</a> 5M <a href="https://base.org/y.tif">y</a> 2 MB <a href="q.tif?v=1#z">q</a> 17"""
    got = [tuple(e) for e in one(spark, names.links(F.lit(html), F.lit("https://base.org"), F.lit("p/")))[0]]
    assert got == [("p/sub dir/", True, 0), ("p/a+b&c.h5", False, 1536), ("p/https://base.org/y.tif", False, 2 * 2**20), ("p/q.tif?v=1#z", False, 17)]


def test_zoom_ladder(spark):
    for width, height, zoom in ((181, 1, 0), (180, 1, 1), (1, 91, 1), (46, 0, 2), (21, 0, 3), (11, 0, 4), (6, 0, 5), (3, 0, 6), (1.5, 2, 7), (1, 0, 8), (0.3, 0, 9), (0.2, 0, 10), (0.1, 0, 11), (0.001, 0, 11)):
        assert one(spark, geo.zoom_for(F.lit(float(width)), F.lit(float(height))))[0] == zoom


def test_edges_on_tile_sides_end_runs(spark):
    ring = [(0, 0), (0, 5), (3, 7), (10, 7), (10.0005, 2), (5, 0.01), (6, 0.0)]
    rows = [(1, k, float(x), float(y)) for k, (x, y) in enumerate(ring)]
    got = grids.edges_inside(spark.createDataFrame(rows, "ring int, k int, x double, y double"), ["ring"], (0.0, 0.0, 10.0, 20.0)).orderBy("first").collect()
    assert [(r["first"], r.points) for r in got] == [(1, 3), (4, 2)]  # the last edge lies within 0.1 % of 20


def test_cubes_mix_layers_by_height(spark):
    grid = [[[1.0, None], [3.0, 5.0]], [[None, None], [7.0, 9.0]]]
    points = [(0, 0, 0), (1, 0, 0), (0.5, 0, 0), (0.5, 0.5, 0), (0, 0, 0.5), (0, 1, 0.25), (0, 1, 9), (-0.6, 0, 0), (0.5, 0.5, 0.5), (None, 0, 0)]
    df = spark.createDataFrame([(k, *(None if x is None else float(x) for x in p)) for k, p in enumerate(points)], "n int, i double, j double, k double")
    got = [r.value for r in cube.interpolated(df, grid, F.col("i"), F.col("j"), F.col("k"), "value").orderBy("n").collect()]
    want = [1.0, None, 1.0, 3.0, 1.0, 4.0, 7.0, None, (3.0 + 8.0) / 2, None]  # at (0, 0, 0.5) the upper layer has nothing
    assert all(a == b or a == pytest.approx(b) for a, b in zip(got, want, strict=True))
    one_layer = cube.interpolated(df, [[[2.0], [4.0]]], F.col("i"), F.col("j"), F.col("k"), "value").filter("n in (3, 7, 8)").orderBy("n").collect()
    assert [r.value for r in one_layer] == [None, None, None] or [r.value for r in one_layer][0] == pytest.approx(3.0)


def test_plans_of_cubes_keep_generated_code(spark):
    from scenequery.plans import catalogue

    for name in ("cube_interpolate", "combined_correction"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
        expression = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert len(expression) < 40_000


def test_product_names(spark):
    good = "store/SAR_L2_PR_GCOV_002_109_D_063_4005_DHDH_A_20251012T182508_20251012T182531_X05010_N_F_J_001.h5"
    f = names.parse_product(F.lit(good))
    assert one(spark, f["cycle"], f["track"], f["direction"], f["level"], f["instrument"], f["coverage"], f["counter"], f["extension"]) == (2, 109, "D", 2, "L", "F", 1, "h5")
    for bad in (good.replace("_D_", "_X_"), good.replace("GCOV", "GC"), good[:-3], good.replace("X05010", "X05")):
        assert one(spark, names.parse_product(F.lit(bad))["cycle"])[0] is None


def ring(points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points)) if points else F.array().cast(footprints.RING)


def test_footprints(spark):
    square, box = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], (1.0, 1.0, 3.0, 2.0)
    cover = lambda points, b=box: search.covered(spark.range(1).select(ring(points).alias("ring")), "ring", b).first().coverage
    assert one(spark, footprints.ring_area(ring(square)))[0] == 16.0 and cover(square) == 100.0
    assert cover([(0, 0), (2, 0), (2, 4), (0, 4)]) == 50.0 and cover([(10, 10), (11, 10), (11, 11)]) == 0.0
    assert cover([(1, 1), (3, 1), (1, 2)]) == pytest.approx(50.0) and cover([(0, 0), (1, 1)]) == 0.0 and cover([]) == 0.0
    assert cover([(0, 0), (6, 0), (0, 6)], (0.0, 0.0, 4.0, 4.0)) == pytest.approx(100 * 14 / 16)
    assert cover(square, (1.0, 1.0, 1.0, 2.0)) == 0.0


def test_granules_of_the_first_collection_with_links(spark):
    rows = [(1, None, 0, False), (2, "u2", 1, False), (3, "u3", 1, True), (4, "u4", 2, True)]
    g = spark.createDataFrame(rows, "id long, url string, place int, full_frame boolean").withColumns({"ring": ring([(0, 0), (4, 0), (4, 4), (0, 4)]), "pol_mode": F.lit("DHDH"), "start_ts": F.lit(1)})
    assert [(r.id, r["rank"]) for r in search.resolve_granules(g, "place", (0.0, 0.0, 1.0, 1.0)).orderBy("rank").collect()] == [(3, 1), (2, 2)]
    for box in ((9.0, 9.0, 10.0, 10.0), (1.0, 0.0, 0.0, 1.0)):
        with pytest.raises(ValueError):
            search.resolve_granules(g, "place", box)
    touching = search.resolve_granules(g, "place", (4.0, 0.0, 5.0, 1.0)).collect()
    assert [(r.id, r.coverage) for r in touching] == [(3, 0.0), (2, 0.0)]


def test_batches_of_rings_are_cut_like_single_ones():
    """Random rings, each with its own box, against one ring at a time in plain Python."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(7)
    rings, boxes = [None, [], [(1.0, 1.0)], [(0.0, 0.0), (1.0, 1.0)]], [(0.0, 0.0, 2.0, 2.0)] * 4
    for _ in range(300):
        points = [(rng.randint(0, 6) / 2, rng.randint(0, 6) / 2) for _ in range(rng.randint(3, 7))]
        rings.append(points + points[:1] if rng.random() < 0.5 else points)
        boxes.append((rng.choice([0.5, 1.0]), rng.choice([0.25, 1.0]), rng.choice([2.0, 2.5]), rng.choice([1.0, 2.0])))

    def plain(points, box):
        points = points[:-1] if len(points) > 1 and points[0] == points[-1] else points
        for axis, at, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
            out = []
            for p, q in zip(points, points[1:] + points[:1], strict=True):
                a, b = sign * (p[axis] - at) >= 0, sign * (q[axis] - at) >= 0
                if a:
                    out.append(p)
                if a != b:
                    t = (at - p[axis]) / (q[axis] - p[axis])
                    out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            points = out
        twice = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True))
        whole = (box[2] - box[0]) * (box[3] - box[1])
        return len(points), min(100.0, abs(twice) / 2 / whole * 100) if whole > 0 and len(points) > 2 else 0.0

    column = pa.array([r and [{"x": x, "y": y} for x, y in r] if r is not None else None for r in rings], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    share, corners, _ = footprints.cover(column, np.array(boxes))
    for k, (r, box) in enumerate(zip(rings, boxes, strict=True)):
        n, want = plain(r or [], box)
        assert corners[k] == n and share[k] == pytest.approx(want if len(r or []) > 2 else 0.0, abs=1e-9)
    sliced, _, _ = footprints.cover(column[100:200], np.array(boxes)[100:200])
    assert (sliced == share[100:200]).all()


def test_ranking_with_a_tolerance(spark):
    """Orders that the reference cases give: coverage beats recency, full frame, preferred mode, newest; a tolerance is no order."""
    base = {"coverage": 100.0, "full_frame": True, "lean": True, "start": 1.0}
    order = lambda *cs: search.stable_order([base | c for c in cs], 0.5)
    assert order({"coverage": 50.0, "start": 9.0}, {}) == [1, 0] and order({"full_frame": False, "start": 9.0}, {}) == [1, 0] and order({"lean": False, "start": 9.0}, {}) == [1, 0]
    assert order({"start": 1.0}, {"start": 2.0}) == [1, 0] and order({}, {}) == [0, 1] and order({"coverage": 99.6, "start": 2.0}, {}) == [0, 1] and order({"coverage": 99.4, "start": 2.0}, {}) == [1, 0]
    # 99.2 is beaten by 100 alone, 99.6 ties with both: where it is met first decides
    assert order({"coverage": 99.2, "start": 3.0}, {"coverage": 99.6, "start": 2.0}, {"coverage": 100.0, "start": 1.0}) == [0, 1, 2]
    assert order({"coverage": 100.0, "start": 1.0}, {"coverage": 99.2, "start": 3.0}, {"coverage": 99.6, "start": 2.0}) == [0, 1, 2]  # 99.2 after 100 now
    square = lambda x: ring([(x, 0), (x + 4, 0), (x + 4, 4), (x, 4)])
    g = spark.createDataFrame([(k, f"u{k}" if k != 5 else None, 1 if k < 9 else 0, k % 2 == 0, "DHDH" if k % 3 else "QQ", k) for k in range(12)], "id long, url string, place int, full_frame boolean, pol_mode string, day int")
    g = g.withColumns({"ring": F.when(F.col("id") < 9, square(0)).otherwise(square(50)), "start_ts": F.timestamp_seconds(F.col("day") * 86400)})
    boxes = spark.createDataFrame([("a", 1.0, 1.0, 2.0, 2.0), ("b", 52.0, 0.0, 60.0, 4.0), ("c", 20.0, 0.0, 30.0, 4.0), ("d", 2.0, 0.0, 1.0, 4.0), ("e", 3.0, 0.0, 51.0, 4.0)], "request string, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in search.resolve_requests(g, boxes, "place", page=6).orderBy("request", "rank").collect():
        got.setdefault(r.request, []).append(r.id if r.problem is None else r.problem)
    assert got["a"] == [8, 4, 6, 7, 3] and got["b"] == got["e"] == [10, 11, 9] and got["c"] == ["no granules"] and got["d"] == ["no box"]


def test_assets_by_key_then_kind(spark):
    schema = "array<struct<key: string, href: string, type: string, title: string, roles: array<string>>>"
    resolve = lambda *assets: one(spark, records.resolve_asset(F.from_json(F.lit(str([dict(zip(("key", "href", "type", "title"), a, strict=True)) for a in assets]).replace("'", '"').replace("None", "null")), schema)))[0]
    assert resolve(("vh", "b.tif", None, "t"), ("hdf5", "c.bin", None, None)).key == "hdf5"
    assert tuple(resolve(("other", "x.TIFF?a", None, None), ("hv", "m.txt", "text/plain", None))) == ("x.TIFF?a", "cog", "other", "other")
    assert resolve(("thumbnail", "a.png", "image/png", None)) is None


def test_georeference_of_both_kinds(spark):
    none = F.lit(None).cast("array<double>")
    numbers = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    box = lambda t, p, s: one(spark, records.georeference(F.lit(10), F.lit(20), t, p, s))[0]
    assert tuple(box(numbers(2, 0, 0, 100, 0, -3, 0, 500, *[0] * 7, 1), none, none)) == (100.0, 440.0, 120.0, 500.0)
    assert tuple(box(none, numbers(1, 2, 0, 100, 500, 0), numbers(2, 3, 0))) == (98.0, 446.0, 118.0, 506.0)
    assert box(none, numbers(1, 2, 0, 100, 500, 0), none) is None


def test_projections(spark):
    east, north = geo.utm_forward(F.lit(-122.4194), F.lit(37.7749), 10)
    lon, lat = geo.utm_inverse(east, north, 10)
    assert one(spark, lon, lat) == pytest.approx((-122.4194, 37.7749), abs=1e-8)
    assert one(spark, *geo.utm_inverse(F.lit(500000.0), F.lit(10_000_000.0), 33, south=True)) == pytest.approx((15.0, 0.0), abs=1e-9)
    assert one(spark, *geo.polar_forward(F.lit(-45.0), F.lit(90.0), 3413)) == pytest.approx((0.0, 0.0), abs=1e-6)
    assert one(spark, *geo.polar_forward(F.lit(0.0), F.lit(-71.0), 3031))[0] == pytest.approx(0.0, abs=1e-6)
    # scale is true at its latitude: a small step east there is as long as on the ellipsoid
    x0, y0, x1, y1 = one(spark, *geo.polar_forward(F.lit(10.0), F.lit(70.0), 3413), *geo.polar_forward(F.lit(10.001), F.lit(70.0), 3413))
    n = geo.A * math.cos(math.radians(70)) / math.sqrt(1 - geo.E2 * math.sin(math.radians(70)) ** 2)
    assert math.hypot(x1 - x0, y1 - y0) == pytest.approx(n * math.radians(0.001), rel=1e-6)
    for code, at in ((3413, 75.0), (3031, -80.0), (32661, 88.0), (32761, -85.0)):
        for x in (-170.0, -45.0, 0.0, 33.0, 179.0):
            assert one(spark, *geo.polar_inverse(*geo.polar_forward(F.lit(x), F.lit(at), code), code)) == pytest.approx((x, at), abs=1e-8)
    assert one(spark, *geo.polar_forward(F.lit(0.0), F.lit(90.0), 32661)) == pytest.approx((2e6, 2e6), abs=1e-6)
    box = geo.envelope((F.lit(500000.0), F.lit(4_000_000.0), F.lit(600000.0), F.lit(4_100_000.0)), lambda x, y: geo.utm_inverse(x, y, 10))
    x0, y0, x1, y1 = one(spark, *box)
    assert x0 == pytest.approx(-123.0) and y0 < 36.2 < y1 and x1 > -122.0 and y1 - y0 > 0.9


def test_class_names_and_palettes(spark):
    xml = '<Item name="CATEGORY_NAMES_0">Water</Item><Item sample="3" name="CLASS NAMES">A &amp; B</Item><Item role="description" sample="0" name="CLASS_NAMES">T</Item><Item name="CLASS_4"> </Item>'
    assert one(spark, records.class_names(F.lit(xml)))[0] == {0: "Water", 3: "A & B"}
    assert one(spark, records.class_names(F.lit('<item NAME="CLASS_NAMES">x| y;z</item>')))[0] == {0: "x", 1: "y", 2: "z"}
    table = one(spark, records.colour_table(F.array(*map(F.lit, (0, 65535, 257, 514, 32768, 0)))))[0]
    assert [tuple(c) for c in table] == [(0, 1, 128), (255, 2, 0)]
    assert one(spark, records.colour_table(F.array(F.lit(1), F.lit(2), F.lit(3))))[0] is None


def test_evaluation_summary(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (1, learning.INVALID)], "t int, p int")
    r = learning.summary(rows, "t", "p", 2).first()
    assert (r.n, r.accuracy) == (5, 0.6) and r.macro_f1 == pytest.approx((2 / 3 + 4 / 5) / 2) and r.mean_iou == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert learning.summary(rows.limit(0), "t", "p", 2).first().accuracy == 0.0


def test_models_with_parameters_that_are_not_finite_are_refused(spark):
    with pytest.raises(ValueError, match=r"std\[1\]"):
        learning.softmax_predict([F.lit(1.0), F.lit(2.0)], [0.0, 0.0], [1.0, float("nan")], [[1.0, 2.0, 3.0]])


def test_a_fitted_model_tells_regions_apart(spark):
    rows = spark.range(600).select("id", (F.pmod("id", F.lit(3)) * 4 + F.rand(1)).alias("x"), F.rand(2).alias("y"), F.pmod("id", F.lit(3)).cast("int").alias("label"))
    split = learning.stratified_split(rows, "label", "id")
    assert split.where("held_out").groupBy("label").count().collect() and {r["count"] for r in split.where("held_out").groupBy("label").count().collect()} == {50}
    model = learning.train_logistic(split.where("not held_out"), ["x", "y"], "label", 3)
    found = split.where("held_out").withColumn("prediction", learning.softmax_predict([F.col("x"), F.col("y")], model.mean, model.std, model.weights)[0])
    assert found.where("prediction <> label").count() <= 3


def test_hot_classes_and_budgets_rank_exactly(spark):
    rows = spark.range(5000).select("id", F.when(F.pmod("id", F.lit(10)) == 0, "b").when(F.pmod("id", F.lit(10)) == 1, None).otherwise("a").alias("cls"))
    ranks = learning.seeded_ranks(rows, "cls", "id", "s").collect()
    for cls in ("a", "b", None):
        own = [r for r in ranks if r.cls == cls]
        assert sorted(r._rank for r in own) == list(range(1, len(own) + 1)) and {r._total for r in own} == {len(own)}
    entries = rows.select("cls", "id", F.lit(3).alias("bytes"), F.col("id").alias("at"))
    over = search.beyond_budget(entries, 300, ["cls"], span=100).where("cls = 'a'").collect()
    assert len(over) == 4000 - 100 and min(r.kept_bytes for r in over) == 303
