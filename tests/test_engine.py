"""Golden values of the operators, and every SQL oracle on the smallest tables."""

import glob
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenequery.functions import geo, names
from scenequery.functions import radiometry as rad
from scenequery.operators import learning, multilook, neighbourhood, search, stats
from scenequery.plans import catalogue
from scenequery.streaming import ingest

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def pixels(spark, values, width=None):
    width = width or len(values)
    return spark.createDataFrame([(0, i // width, i % width, v) for i, v in enumerate(values)], "scene_id int, row int, col int, v double")


def normal(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5f}"
    if isinstance(v, (list, tuple)):
        return str([normal(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    for sf in (SF, LARGER):  # the larger tables where the smallest give no rows
        con = duckdb.connect()
        for f in glob.glob(f"{sf}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        df = catalogue.QUERIES[name](spark, sf)
        found = con.execute(catalogue.ORACLE_SQL[name])
        columns, want = [d[0] for d in found.description], found.fetchall()
        assert sorted(columns) == sorted(df.columns)
        assert sorted(tuple(map(normal, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(normal, r)) for r in want)
        if want:
            return
    pytest.fail("no rows to compare")


def test_linear_statistics_skip_zero_and_what_is_not_finite(spark):
    px = pixels(spark, [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 0.0, NAN, INF]).withColumn("v", rad.nonzero(F.col("v")))
    m = stats.moments(px, ["scene_id"]).first()
    assert (m["count"], m["min"], m["max"]) == (8, 1.0, 9.0) and m["mean"] == pytest.approx(3.875) and m["std"] == pytest.approx(np.std([3, 1, 4, 1, 5, 9, 2, 6]))


def test_db_drops_what_is_not_positive(spark):
    got = [r[0] for r in pixels(spark, [1.0, 10.0, 100.0, 0.0, -5.0, NAN]).orderBy("col").select(rad.db(F.col("v"))).collect()]
    assert got == [0.0, 10.0, 20.0, None, None, None]


def test_fixed_histograms_clamp(spark):
    def bins(values):
        px = pixels(spark, values).withColumn("v", rad.nonzero(F.col("v")))
        return [r.n for r in stats.full_histogram(px, ["scene_id"], 4, limits=(0, 4)).orderBy("bin").collect()]

    assert bins([0.5, 1.5, 1.6, 2.5, 3.5, 0.0, NAN]) == [1, 2, 1, 1]
    assert bins([-3.0, 10.0, 2.5]) == [1, 0, 1, 1]


def test_contrast_of_a_ramp_and_of_nothing(spark):
    ramp = pixels(spark, [float(i) for i in range(1, 1001)])
    r = stats.contrast_limits(ramp, ["scene_id"]).first()
    assert abs(r.low_limit - 20) < 5 and abs(r.high_limit - 981) < 5
    nothing = pixels(spark, [0.0, NAN, 0.0]).withColumn("v", rad.nonzero(F.col("v")))
    assert stats.contrast_limits(nothing, ["scene_id"]).count() == 0
    p = stats.ranked_values(ramp, ["scene_id"], {"p02": 0.02, "p98": 0.98}).first()
    assert (p.p02, p.p98) == (21.0, 981.0)


def test_constant_band_has_bins_of_width_one(spark):
    r = stats.binned_median(pixels(spark, [7.0] * 9), ["scene_id"]).first()
    assert r.median == 7.5


def test_multilook_edges(spark):
    px = pixels(spark, [float(i) for i in range(25)], 5)
    assert multilook.multilook(px, 2, ["v"], ["scene_id"]).count() == 9
    assert multilook.multilook(px, 2, ["v"], ["scene_id"], keep_edge=False, height=5, width=5).count() == 4


def test_speckle_filters_on_constant_and_holes(spark):
    values = [5.0] * 49
    values[24] = None
    for kind in ("boxcar", "lee", "enhanced-lee", "gamma-map", "frost"):
        out = {(r.row, r.col): r.out for r in neighbourhood.speckle(pixels(spark, values, 7), kind, ["scene_id"], kernel=3).collect()}
        assert out[3, 3] == 0 and out[0, 0] == pytest.approx(5.0) and len(out) == 49
    filled = {(r.row, r.col): r.out for r in neighbourhood.smooth(pixels(spark, values, 7), ["scene_id"]).collect()}
    assert filled[3, 3] == pytest.approx(5.0)
    assert [neighbourhood.odd_kernel(k) for k in (1, 4, 7, 40)] == [3, 5, 7, 15]
    with pytest.raises(ValueError):
        neighbourhood.speckle(pixels(spark, values, 7), "median", ["scene_id"])


def test_search_limits_and_paths():
    assert [search.Search(limit=x).page_size() for x in (None, 0, NAN, -3, 5000, 40)] == [25, 25, 25, 1, 1000, 40]
    assert search.property_path("sar:pol'; DROP") == "$['sar:polDROP']"


def test_rectangles_touch(spark):
    box = tuple(F.lit(float(v)) for v in (0, 0, 1, 1))
    row = spark.range(1).select(search.intersects(box, (1, 0, 2, 1)).alias("closed"), search.intersects(box, (1, 0, 2, 1), touching=False).alias("open")).first()
    assert row.closed and not row.open


def test_wkt_and_rings():
    assert geo.parse_wkt("POINT (1 2)") == {"type": "Point", "coordinates": [1.0, 2.0]}
    assert geo.parse_wkt("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))")["coordinates"][1][0] == [1.0, 1.0]
    assert len(geo.parse_wkt("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))")["coordinates"]) == 2
    assert geo.parse_wkt("BBOX(0, 1, 2, 3)")["type"] == "Polygon" and geo.parse_wkt("MULTIPOINT ((1 2), (3 4))")["coordinates"] == [[1.0, 2.0], [3.0, 4.0]]
    for bad in ("", "CIRCLE (1 2)", "POINT (1)", None):
        with pytest.raises(ValueError):
            geo.parse_wkt(bad)


def test_names(spark):
    row = spark.range(1).select(names.size_text(F.lit(1536)).alias("a"), names.bytes_of(F.lit("1.5K")).alias("b"), names.bytes_of(F.lit("-")).alias("c"), names.xml_text(F.lit("&amp;lt; &quot;")).alias("d"), names.parse_product(F.lit("x.h5"))["cycle"].alias("e")).first()
    assert tuple(row) == ("2 KB", 1536, None, '&lt; "', None)


def test_rules_meet_missing_bands_in_order(spark):
    df = spark.createDataFrame([(1.0, None), (None, 1.0), (9.0, 9.0)], "x double, y double")
    rules = [("x", "<", 5, 1), ("y", ">", 5, 2)]
    assert [r[0] for r in df.select(learning.by_rules({"x": F.col("x"), "y": F.col("y")}, rules)).collect()] == [1, 255, 2]


def test_streaming_statistics(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(*ingest.EVENTS.names)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = ingest.window_stats(ingest.event_stream(spark, str(tmp_path / "in"), 1), "30 days", "60 days").writeStream.outputMode("complete").format("memory").queryName("window_stats").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type): (r.n, round(r["mean"] or 0, 6)) for r in spark.table("window_stats").collect()}
    want = {(r.start, r.event_type): (r.n, round(r["mean"] or 0, 6)) for r in ingest.window_stats(events, "30 days", "60 days").collect()}
    assert got == want and got


def test_colour_maps(spark):
    from scenequery.functions import colormaps

    rows = {(r.colormap, r.idx): (r.r, r.g, r.b) for r in colormaps.tables(spark).collect()}
    assert len(rows) == 256 * 18 and all(0 <= c <= 255 for v in rows.values() for c in v)
    assert rows["grayscale", 128] == (128, 128, 128) and rows["label", 0] == (0, 0, 0) and rows["cubehelix", 0] == (3, 2, 1)
    import colorsys

    for k in range(1, 256):
        want = colorsys.hsv_to_rgb((k * colormaps.GOLDEN) % 1, 0.7 + 0.3 * ((k * 13) % 7) / 6, 0.75 + 0.25 * ((k * 7) % 5) / 4)
        assert all(abs(a - b * 255) <= 0.51 for a, b in zip(rows["label", k], want, strict=True))
    assert rows["viridis", 0] == (71, 1, 85)
    with pytest.raises(ValueError):
        colormaps.colours("none", F.lit(0.5))
