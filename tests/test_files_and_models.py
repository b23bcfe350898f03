"""GeoTIFF files, mosaics, networks, models as data, the trainer, schemas and samples: golden values and plain versions."""

import json
import math
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenequery.functions import samples, schemas
from scenequery.operators import learning, models, mosaic, networks
from scenequery.plans import tiles as tile_plans
from scenequery.sources import geotiff, tiff

FILES = "file string, width int, height int, x0 double, y0 double, x1 double, y1 double, epsg int"


def raster(spark, grids, names=("v",)):
    """Pixels of files from arrays (bands, rows, columns)."""
    rows = [(f, r, c, *(None if np.isnan(x) else float(x) for x in g[:, r, c])) for f, g in grids.items() for r in range(g.shape[1]) for c in range(g.shape[2])]
    return spark.createDataFrame(rows, "file string, row int, col int, " + ", ".join(f"{n} double" for n in names))


def listed(spark, grids):
    return spark.createDataFrame([(f, g.shape[2], g.shape[1], 500000.0, 4000000.0, 500000.0 + 10 * g.shape[2], 4000000.0 + 10 * g.shape[1], 32610) for f, g in grids.items()], FILES)


def read(spark, path, bands, **options):
    reader = spark.read.format("geotiff").option("bands", bands)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


@pytest.fixture(scope="module")
def floats(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    grids = {"a.tif": rng.normal(size=(2, 37, 50)).astype("f4"), "b.tif": rng.normal(size=(2, 16, 16)).astype("f4")}
    grids["a.tif"][0, 3, 4] = np.nan
    path = str(tmp_path_factory.mktemp("tiff") / "out")
    geotiff.write_float32(raster(spark, grids, ("p", "q")), listed(spark, grids), path, ["p", "q"], 16)
    return grids, path


def test_floats_come_back_whole(spark, floats):
    grids, path = floats
    assert sorted(os.listdir(path)) == ["a.tif", "b.tif"]
    got = {(r.file, r.row, r.col): (r.p, r.q) for r in read(spark, path, "p,q").collect()}
    assert len(got) == 37 * 50 + 256 and got["a.tif", 3, 4][0] is None
    for (f, r, c), (p, q) in got.items():
        assert q == grids[f][1, r, c] and (p == grids[f][0, r, c] or (p is None and (r, c) == (3, 4)))


def test_a_file_by_its_bytes(floats):
    """Read by nothing but struct and zlib."""
    grids, path = floats
    with open(f"{path}/b.tif", "rb") as f:
        data = f.read()
    assert data[:4] == b"II*\0"
    (at,) = struct.unpack_from("<I", data, 4)
    (n,) = struct.unpack_from("<H", data, at)
    tags = {t: (k, c, v) for t, k, c, v in (struct.unpack_from("<HHII", data, at + 2 + 12 * i) for i in range(n))}
    assert list(tags) == sorted(tags) and struct.unpack_from("<I", data, at + 2 + 12 * n)[0] == 0
    assert tags[256][2] == tags[257][2] == 16 and tags[259][2] & 0xFFFF == 8 and tags[277][2] & 0xFFFF == 2
    tile = np.frombuffer(zlib.decompress(data[tags[324][2] : tags[324][2] + tags[325][2]]), "<f4").reshape(16, 16, 2)
    assert (tile == np.moveaxis(grids["b.tif"], 0, 2)).all() and tags[324][2] + tags[325][2] == len(data)
    assert struct.unpack_from("<6d", data, tags[33922][2]) == (0, 0, 0, 500000, 4000160, 0) and struct.unpack_from("<3d", data, tags[33550][2]) == (10, 10, 0)
    assert struct.unpack_from("<16H", data, tags[34735][2]) == (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, 32610)
    assert struct.pack("<I", tags[42113][2]) == b"nan\0"


def test_a_window_reads_its_tiles_only(spark, floats):
    _, path = floats
    got = read(spark, f"{path}/a.tif", "p,q", box="15,0,16,20").collect()
    assert {(r.row, r.col) for r in got} == {(r, c) for r in (15, 16) for c in range(21)}
    reader = geotiff.Reader({"path": f"{path}/a.tif", "box": "15,0,16,20"}, ["p", "q"])
    assert [p.which for p in reader.partitions()] == [[0, 1, 4, 5]]
    pushing = geotiff.PushingReader({"path": path, "pushdown": "true"}, ["p", "q"])
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan

    asked = [GreaterThan(("row",), 31), LessThan(("col",), 16), EqualTo(("file",), "a.tif")]
    assert list(pushing.pushFilters(asked)) == asked and [(p.file[-5:], p.which) for p in pushing.partitions()] == [("a.tif", [8])]


def test_filters_choose_tiles_where_spark_pushes_them(spark, floats):
    _, path = floats
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = read(spark, path, "p,q", pushdown="true").filter("row > 30 and col < 3 and file = 'a.tif'").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert len(got) == 6 * 3


def test_missing_pixels_twice_given_and_outside(spark, tmp_path):
    px = spark.createDataFrame([("x.tif", 0, 0, 1.0), ("x.tif", 1, 1, None), ("x.tif", 9, 9, 5.0), ("y.tif", 0, 0, 2.0), ("z.tif", 0, 0, 7.0)], "file string, row int, col int, v double")
    files = spark.createDataFrame([("x.tif", 2, 2, 0.0, 0.0, 2.0, 2.0, 4326), ("y.tif", 3, 1, 0.0, 0.0, 3.0, 1.0, 4326), ("w.tif", 1, 1, 0.0, 0.0, 1.0, 1.0, 4326)], FILES)
    geotiff.write_float32(px, files, str(tmp_path / "o"), ["v"], 16)
    got = {(r.file, r.row, r.col): r.b1 for r in spark.read.format("geotiff").load(str(tmp_path / "o")).collect()}
    assert got == {("w.tif", 0, 0): None, **{("x.tif", r, c): 1.0 if (r, c) == (0, 0) else None for r in (0, 1) for c in (0, 1)}, **{("y.tif", 0, c): 2.0 if c == 0 else None for c in range(3)}}


def test_overviews_average_powers(spark, tmp_path):
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 256, (4, 130, 128)).astype(float)
    limits = {"r": (-30.0, 0.0), "g": (-20.0, 5.0), "b": (0.0, 10.0)}
    path = str(tmp_path / "o")
    geotiff.write_rgba(raster(spark, {"a.tif": grid}, tuple("rgba")), listed(spark, {"a.tif": grid}), path, limits, 16)
    images = spark.read.format("geotiff").option("what", "images").load(path)
    assert [(r.level, r.width, r.height) for r in images.orderBy("level").collect()] == [(0, 128, 130), (1, 64, 65), (2, 32, 32), (3, 16, 16)]
    for level, s in ((0, 1), (1, 2), (2, 4), (3, 8)):
        got = {(r.row, r.col): (r.r, r.g, r.b, r.a) for r in read(spark, path, "r,g,b,a", level=level).collect()}
        assert len(got) == (130 // s) * (128 // s)
        for (r, c), found in got.items():
            block = grid[:, r * s : r * s + s, c * s : c * s + s].reshape(4, -1)
            want = []
            for k, ch in enumerate("rgb"):
                lo, hi = limits[ch]
                db = 10 * math.log10(max((10 ** ((block[k] / 255 * (hi - lo) + lo) / 10)).mean(), 1e-10))
                want.append(math.floor(min(1, max(0, (db - lo) / (hi - lo))) * 255 + 0.5) if s > 1 else block[k][0])
            assert all(abs(a - b) <= (1 if s > 1 else 0) for a, b in zip(found, [*want, math.floor(block[3].mean() + 0.5)], strict=True))


def test_images_are_described_and_grids_compared(spark, floats, tmp_path):
    _, path = floats
    images = spark.read.format("geotiff").option("what", "images").load(path)
    rows = {r.file: r for r in geotiff.describe(images).collect()}
    assert (rows["a.tif"].crs, rows["a.tif"].is_cog, rows["a.tif"].max_zoom, rows["a.tif"].projected, rows["a.tif"].nodata) == ("EPSG:32610", False, -2, True, "nan")
    assert rows["a.tif"].bounds == [500000.0, 4000000.0, 500500.0, 4000370.0]
    grouped = geotiff.describe(images).withColumn("g", F.lit(1))
    assert [(r.problem, r.text) for r in geotiff.check_grids(grouped, "g", "file", True).orderBy("file").collect()] == [(None, None), ("error", "grid 16x16 is not 50x37")]
    assert [r.problem for r in geotiff.check_grids(grouped, "g", "file", False).orderBy("file").collect()] == [None, "warning"]
    drifted = grouped.filter("file = 'a.tif'").unionByName(grouped.filter("file = 'a.tif'").withColumn("file", F.lit("c.tif")).withColumn("crs", F.lit("EPSG:4326")))
    assert [r.problem for r in geotiff.check_grids(drifted, "g", "file", True).orderBy("file").collect()] == [None, "warning"]


def test_big_endian_untagged_and_other_files():
    """A big-endian tiled image of 16-bit numbers without compression, and what is refused."""
    tile = np.arange(256, dtype=">u2").tobytes()
    entries = [(256, 4, 16), (257, 4, 16), (258, 3, 16 << 16), (259, 3, 1 << 16), (277, 3, 1 << 16), (322, 4, 16), (323, 4, 16), (324, 4, 8), (325, 4, 512), (339, 3, 1 << 16)]
    data = b"MM\0*" + struct.pack(">I", 520) + tile + struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", t, k, 1, v) for t, k, v in entries) + struct.pack(">I", 0)
    (level,) = tiff.read_levels(lambda a, n: data[a : a + n])
    assert (level.width, level.height, level.bits, level.offsets, level.counts) == (16, 16, 16, [8], [512])
    assert tiff.place(level) == {"bounds": None, "crs": "EPSG:4326"}
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.read_levels(lambda a, n: b"PK\3\4"[a : a + n])
    level.compression = 5
    with pytest.raises(ValueError, match="compression 5"):
        tiff.decode_tile(tile, level)
    with pytest.raises(ValueError, match="4 GB"):
        tiff.head([{"width": 10**5, "height": 10**5, "counts": [3 * 10**9, 2 * 10**9]}], 512, 1, False, (0, 0, 1, 1), 4326)


# ---- mosaics ---------------------------------------------------------------------------------------------------------------


def plain_mosaic(chunks, rows, cols, top, left, height, width, size, ch, cw, kernel):
    n = min(16, max(4, -(-size // max(len(rows), len(cols)))))
    bh, bw = ch // n, cw // n
    cells = np.zeros((len(rows) * n, len(cols) * n))
    for i, r in enumerate(rows):
        for j, c in enumerate(cols):
            if (r, c) in chunks:
                for a in range(n):
                    for b in range(n):
                        block = chunks[r, c][a * bh : a * bh + bh, b * bw : b * bw + bw]
                        cells[i * n + a, j * n + b] = block[block > 0].mean() if (block > 0).any() else 0
    sides = [[r * ch + (a + 0.5) * bh for r in rows for a in range(n)], [c * cw + (b + 0.5) * bw for c in cols for b in range(n)]]

    def taps(centres, start, length):
        out = []
        for t in range(size):
            s, k = start + (t + 0.5) * length / size, 0
            while k < len(centres) - 2 and centres[k + 1] <= s:
                k += 1
            f = k + max(0, min(1, (s - centres[k]) / (centres[k + 1] - centres[k])))
            if kernel == "bilinear":
                out.append([(k, 1 - (f - k)), (k + 1, f - k)])
            else:
                m = math.floor(f + 0.5)
                out.append([(i, 1.0 if f == i else 3 * math.sin(math.pi * (f - i)) * math.sin(math.pi * (f - i) / 3) / (math.pi * (f - i)) ** 2) for i in range(m - 2, m + 4) if 0 <= i < len(centres) and abs(f - i) < 3])
        return out

    down, across = taps(sides[0], top, height), taps(sides[1], left, width)
    out = np.zeros((size, size))
    for y in range(size):
        for x in range(size):
            v = w = 0.0
            for i, a in down[y]:
                for j, b in across[x]:
                    if cells[i, j] > 0:
                        v, w = v + cells[i, j] * a * b, w + a * b
            out[y, x] = v / w if w > 0 else 0
    return out


@pytest.mark.parametrize("kernel", ["lanczos", "bilinear"])
def test_mosaics_equal_a_plain_version(spark, kernel):
    rng = np.random.default_rng(3)
    scene = rng.exponential(size=(60, 70))
    scene[rng.random(scene.shape) < 0.2] = 0
    scene[0:20, 0:20] = 0
    listed_chunks = [(0, 0), (0, 2), (2, 0), (2, 2), (2, 1), (0, 1)]  # the row of chunks between is not listed: axes are irregular
    absent = {(0, 1), (2, 2)}
    px = spark.createDataFrame([(0, r, c, float(scene[r, c])) for r in range(60) for c in range(70)], "scene_id int, row int, col int, v double")
    tiles = spark.createDataFrame([(0, 0, 3, 5, 50, 60), (0, 1, 0, 0, 10, 10)], "scene_id int, tile int, top int, left int, height int, width int")
    chunks = spark.createDataFrame([(0, 0, r, c, (r, c) not in absent) for r, c in listed_chunks], "scene_id int, tile int, chunk_row int, chunk_col int, present boolean")
    got = {(r.tile, r.row, r.col): r.v for r in mosaic.mosaic_tiles(px, tiles, chunks, 12, (20, 21), kernel).collect()}
    want = plain_mosaic({(r, c): scene[r * 20 : r * 20 + 20, c * 21 : c * 21 + 21] for r, c in listed_chunks if (r, c) not in absent}, [0, 2], [0, 1, 2], 3, 5, 50, 60, 12, 20, 21, kernel)
    assert len(got) == 288 and all(v == 0 for (t, _, _), v in got.items() if t == 1)
    assert all(got[0, y, x] == pytest.approx(want[y, x], abs=1e-9) for y in range(12) for x in range(12)) and (want > 0).any() and (want == 0).any()


# ---- networks --------------------------------------------------------------------------------------------------------------


def test_tiles_equal_the_whole_raster(spark):
    rng = np.random.default_rng(4)
    scene = rng.normal(size=(2, 50, 61))
    net = [networks.Convolution(rng.normal(size=(3, 2, 3, 3)).tolist(), [0.1, -0.2, 0.3], relu=True), networks.Convolution(rng.normal(size=(4, 3, 5, 5)).tolist(), [0.0] * 4)]
    px = spark.createDataFrame([(7, r, c, float(scene[0, r, c]), float(scene[1, r, c])) for r in range(50) for c in range(61)], "scene_id int, row int, col int, p double, q double")

    def whole(x):
        for layer in net:
            w = np.asarray(layer.weights)
            k = w.shape[2] // 2
            padded = np.pad(x, ((0, 0), (k, k), (k, k)))
            out = np.array([[[sum((padded[i, y : y + 2 * k + 1, z : z + 2 * k + 1] * w[o, i]).sum() for i in range(len(x))) + layer.bias[o] for z in range(x.shape[2])] for y in range(x.shape[1])] for o in range(len(w))])
            x = np.maximum(out, 0) if layer.relu else out
        return x

    want = whole(scene)
    for tile, overlap in ((24, 6), (64, 0)):
        got = networks.run(px, ["scene_id"], ["p", "q"], net, 50, 61, tile, overlap).collect()
        assert len(got) == 50 * 61
        assert all(r.channels == pytest.approx(want[:, r.row, r.col].tolist(), abs=1e-9) for r in got)
    best = networks.classify(networks.run(px, ["scene_id"], ["p", "q"], net, 50, 61, 24, 6)).collect()
    assert all(r["class"] == int(np.argmax(want[:, r.row, r.col])) for r in best)


def test_networks_that_do_not_fit():
    small = networks.Convolution([[[[1.0] * 3] * 3]], [0.0])
    for net, bands, overlap, text in (([small], 2, 6, "does not fit"), ([small] * 4, 1, 6, "reach 4"), ([networks.Convolution([[[[math.nan]]]], [0.0])], 1, 6, "not finite"), ([networks.Convolution([[[[1.0] * 2] * 2]], [0.0])], 1, 6, "does not fit")):
        with pytest.raises(ValueError, match=text):
            networks.check(net, bands, overlap)
    assert tile_plans.NET[0].relu and networks.check(tile_plans.NET, 1, 6) is None


# ---- models ----------------------------------------------------------------------------------------------------------------


def manifest(**changes):
    m = {"model": 2, "id": "m", "mlm:name": "n", "mlm:tasks": ["pixel-classifier"], "model:backend": "builtin-classical", "mlm:input": [{"bands": ["a", "b"], "pre_processing_function": {"format": "model-transform", "expression": "dB"}}], "mlm:output": [{"classification:classes": [{"value": 0, "name": "x"}, {"value": 1, "name": "y"}]}], "model:params": {"weights": [1, 0, 0, 0, 1, 0.5], "mean": [0, 0], "std": [1, 1]}, "license": "CC0-1.0"}
    return json.dumps({k: v for k, v in (m | changes).items() if v is not ...})


def test_manifests_are_checked(spark):
    heuristic = lambda *rules: {"model:backend": "builtin-heuristic", "model:params": {"rules": list(rules)}}
    rule = {"band": 0, "op": "<", "value": -17.5, "class": 1}
    cases = [
        ("[]", ["not a JSON object"]), ("{", ["not a JSON object"]), (None, ["not a JSON object"]), (manifest(), []), (manifest(model=1), ["version 2 is wanted"]), (manifest(model="x"), ["version 2 is wanted"]), (manifest(id=...), ["no id"]), (manifest(**{"mlm:name": ""}), ["no name"]),
        (manifest(**{"mlm:tasks": []}), ["no tasks"]), (manifest(**{"mlm:tasks": ["embedding", "magic"]}), ["unknown task magic"]), (manifest(**{"model:backend": "wasm"}), ["unknown backend"]), (manifest(**{"model:strategy": "half"}), ["unknown strategy"]), (manifest(**{"model:interaction": "shout"}), ["unknown interaction"]),
        (manifest(**{"mlm:input": []}), ["no input"]), (manifest(**{"mlm:input": [{}]}), ["no bands"]), (manifest(**{"mlm:input": [{"bands": ["a", "b"], "pre_processing_function": {"format": "model-transform", "expression": "sqrt"}}]}), ["unknown transform"]), (manifest(**{"mlm:output": []}), ["no output"]),
        (manifest(**{"mlm:output": [{"classification:classes": [{"value": 0, "name": "x"}]}]}), ["a pixel classifier needs two classes"]), (manifest(**{"model:params": {"weights": [1, 2], "mean": [0, 0], "std": [1, 1]}}), ["2 weights, not 6"]), (manifest(**{"model:params": {"weights": [1, None, 0, 0, 1, 1], "mean": [0, 0], "std": [1, 1]}}), ["params.weights[1] is not finite"]),
        (manifest(**{"model:params": {"weights": [1] * 6, "mean": [0, 0]}}), ["weights, mean and std are wanted"]), (manifest(**heuristic(rule)), []), (manifest(**heuristic()), ["no rules"]), (manifest(**heuristic(rule | {"band": 0.5})), ["a rule has no band"]), (manifest(**heuristic(rule | {"op": "!="})), ["a rule has an unknown comparison"]),
        (manifest(**heuristic(rule | {"op": "between"})), ["a rule has no value"]), (manifest(**heuristic(rule | {"op": "between", "value": [1, 2]})), []), (manifest(**heuristic(rule | {"class": None})), ["a rule has no class"]), (manifest(**{"model:backend": "onnx"}), ["no network"]),
        (manifest(**{"model:backend": "onnx", "mlm:artifacts": [{"href": "x"}], "model:strategy": "tiled", "model:tile": {"size": 16}}), ["tiles of 32 pixels or more are wanted"]), (manifest(**{"model:backend": "onnx", "model:params": {"modelBase64": "AA=="}}), []), (manifest(**{"model:backend": "remote"}), ["no endpoint"]), (manifest(**{"model:backend": "remote", "model:endpoint": "u"}), []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, manifest string")
    for r in models.validate(df).orderBy("i").collect():
        assert r.errors == cases[r.i][1] and r.valid == (not cases[r.i][1]), cases[r.i]
    more = spark.createDataFrame([(manifest(model=3, license=..., **{"mlm:input": [{"bands": ["a", "b"], "pre_processing_function": {"format": "own", "expression": "sqrt"}}]}),)], "manifest string")
    r = models.validate(more).first()
    assert r.valid and r.warnings == ["newer version", "transform of another format", "no licence"]
    assert (r.strategy, r.interaction, r.transform, r.bands, r.classes, r.tile_size, r.tile_overlap) == ("whole", "none", "none", ["a", "b"], 2, 256, 16)


def test_many_models_in_one_pass(spark):
    px = spark.createDataFrame([(0, 0, 10.0, 100.0), (0, 1, 0.0, 1.0), (0, 2, None, 1.0), (0, 3, 1000.0, 10.0), (1, 0, 1.0, 1.0)], "scene_id int, row int, a double, b double")
    water = manifest(id="water", **{"model:backend": "builtin-heuristic", "mlm:input": [{"bands": ["a"], "pre_processing_function": {"format": "model-transform", "expression": "dB"}}], "model:params": {"rules": [{"band": 0, "op": "<", "value": 15, "class": 1}, {"band": 0, "op": ">=", "value": 30, "class": 2}], "default": 7}})
    asked = spark.createDataFrame([(0, "m", ["a", "b"]), (0, "water", ["a"]), (0, "none", ["a"]), (1, "m", ["b"]), (1, "far", ["a", "b"])], "scene_id int, model_id string, wanted array<string>")
    texts = [manifest(), water, manifest(id="far", **{"model:backend": "remote", "model:endpoint": "u"}), "{"]
    got = {(r.scene_id, r.row, r.model_id): (r["class"], None if r.confidence is None else round(r.confidence, 6), r.problem) for r in models.run(px, ["scene_id", "row"], ["a", "b"], asked, spark.createDataFrame([(t,) for t in texts], "manifest string")).collect()}
    sure = lambda a, b: round(1 / (1 + math.exp(-abs(a - b))), 6)
    assert got == {
        (0, 0, "m"): (1, sure(10, 20.5), None), (0, 1, "m"): (255, None, None), (0, 2, "m"): (255, None, None), (0, 3, "m"): (0, sure(30, 10.5), None), (0, 0, "water"): (1, None, None), (0, 1, "water"): (255, None, None), (0, 2, "water"): (255, None, None), (0, 3, "water"): (2, None, None),
        (0, None, "none"): (None, None, "no such model"), (1, None, "m"): (None, None, "needs 2 bands, got 1"), (1, None, "far"): (None, None, "backend remote does not run here"),
    }


def test_training_equals_plain_steps(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 1.0, (200, 2)) for m in ((0, 0), (2, 3), (4, 0))])
    y = np.repeat([0, 1, 2], 200)
    rows = spark.createDataFrame([(int(c), float(a), float(b)) for c, (a, b) in zip(y, x, strict=True)] + [(255, 9.0, 9.0)], "cls int, a double, b double")
    model = learning.train_logistic(rows, ["a", "b"], "cls", 3, epochs=40)
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    w, v, losses = np.zeros((3, 3)), np.zeros((3, 3)), []
    for _ in range(40):
        p = np.exp(z @ w.T)
        p /= p.sum(1, keepdims=True)
        losses.append(-np.log(p[np.arange(600), y]).mean())
        p[np.arange(600), y] -= 1
        g = p.T @ z
        g[:, :-1] += 1e-4 * 600 * w[:, :-1]
        v = 0.9 * v - 0.3 / 600 * g
        w = w + v
    assert np.allclose(model.weights, w, atol=1e-9) and np.allclose(model.history, losses, atol=1e-9) and np.allclose(model.mean, x.mean(0)) and np.allclose(model.std, x.std(0))
    early = learning.train_logistic(rows, ["a", "b"], "cls", 3, tolerance=0.05)
    assert 2 < len(early.history) < 60
    batched = learning.train_logistic(rows, ["a", "b"], "cls", 3, epochs=10, batches=3)
    again = learning.train_logistic(rows.repartition(5), ["a", "b"], "cls", 3, epochs=10, batches=3)
    assert np.allclose(batched.weights, again.weights, atol=1e-9) and batched.history[-1] < batched.history[0]
    assert (np.argmax(z @ np.array(batched.weights).T, 1) == y).mean() > 0.9


def test_labels_that_cannot_be_learned(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 2.0), (2, float("nan"))], "cls int, x double")
    with pytest.raises(ValueError, match="values of x"):
        learning.train_logistic(rows, ["x"], "cls", 3)
    with pytest.raises(ValueError, match="no rows"):
        learning.train_logistic(rows.filter("false"), ["x"], "cls", 2)
    with pytest.raises(ValueError, match="two classes"):
        learning.train_logistic(rows, ["x"], "cls", 1)
    with pytest.raises(ValueError, match="no rows of b"):
        learning.require_classes(rows, "cls", ["a", "b", "c"])
    with pytest.raises(ValueError, match="two classes"):
        learning.require_classes(rows, "cls", ["a"])
    constant = learning.train_logistic(spark.createDataFrame([(0, 1.0), (1, 1.0)], "cls int, x double"), ["x"], "cls", 2, epochs=3)
    assert constant.std == [1.0]


# ---- schemas and samples ---------------------------------------------------------------------------------------------------

SCHEMA = {
    "doc": {"type": "object", "required": ["id", "rate"], "additionalProperties": False, "$defs": {"part": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string", "pattern": "^a"}}},
            "properties": {"id": {"type": "string", "minLength": 1}, "rate": {"type": ["number", "null"], "minimum": 0, "maximum": 1}, "parts": {"$ref": "#/$defs/part"}, "kind": {"enum": ["x", 2, None]}, "flag": {"const": True}, "many": {"const": [1, {"b": 2, "a": 1}]}, "either": {"anyOf": [{"type": "integer"}, {"$ref": "./other#/$defs/name"}]}, "tree": {"$ref": "./other"}}},
    "other": {"type": "object", "properties": {"next": {"$ref": "./other"}, "v": {"type": "integer"}}, "$defs": {"name": {"type": "string", "minLength": 2}}},
}


def plain_problems(value, schema, file, at="$"):
    if "$ref" in schema:
        place, _, inner = schema["$ref"].partition("#")
        file = place.removeprefix("./") or file
        target = SCHEMA[file]
        for part in filter(None, inner.split("/")):
            target = target[part]
        return plain_problems(value, target, file, at)
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    kinds = {"object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool), "null": value is None, "number": number, "integer": number and float(value).is_integer()}
    same = lambda a, b: type(a) is type(b) and a == b or (number and isinstance(b, (int, float)) and not isinstance(b, bool) and a == b)
    if "const" in schema and not same(value, schema["const"]):
        return [at]
    if "enum" in schema and not any(same(value, e) for e in schema["enum"]):
        return [at]
    types = schema.get("type", [])
    if types and not any(kinds[k] for k in ([types] if isinstance(types, str) else types)):
        return [at]
    found = []
    if number:
        found += [at] * (value < schema.get("minimum", value)) + [at] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        found += [at] * (len(value) < schema.get("minLength", 0)) + [at] * ("pattern" in schema and not value.startswith(schema["pattern"][1:]))
    if isinstance(value, list):
        found += [at] * (len(value) < schema.get("minItems", 0)) + [at] * (len(value) > schema.get("maxItems", 9**9))
        for i, x in enumerate(value if "items" in schema else []):
            found += plain_problems(x, schema["items"], file, f"{at}[{i}]")
    if isinstance(value, dict):
        found += [at] * sum(k not in value for k in schema.get("required", []))
        for k, inner in schema.get("properties", {}).items():
            if k in value:
                found += plain_problems(value[k], inner, file, f"{at}.{k}")
        if schema.get("additionalProperties") is False:
            found += [f"{at}.{k}" for k in value if k not in schema["properties"]]
    if "anyOf" in schema and all(plain_problems(value, s, file, at) for s in schema["anyOf"]):
        found.append(at)
    return found


def test_schemas_agree_with_a_plain_version(spark):
    rng = np.random.default_rng(6)
    pick = lambda *c: c[int(rng.integers(len(c)))]
    docs = [{}, [], 1, "x", None, True, {"id": "a", "rate": 0.5}]
    for _ in range(150):
        d = {"id": pick("", "a", 3), "rate": pick(None, 0, 0.5, 1, 2, -1, "x", True), "parts": pick([], ["a"], ["b", 3], ["a", "ab", "ac"], "a"), "kind": pick("x", 2, 2.0, None, "z", True), "flag": pick(True, False, 1), "many": pick([1, {"a": 1, "b": 2}], [1], []), "either": pick(1, 1.5, "a", "ab", None), "tree": pick({"v": 1}, {"v": 0.5, "next": {"v": "x", "next": {"v": []}}}, 3), "more": 1}
        docs.append({k: v for k, v in d.items() if rng.random() < 0.6})
    texts = [json.dumps(d) for d in docs] + ["{", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", schemas.problems(F.col("t"), "doc", SCHEMA).alias("p")).collect():
        want = plain_problems(docs[r.i], SCHEMA["doc"], "doc") if r.i < len(docs) else ["$"]
        assert sorted(p.split(": ")[0] for p in r.p) == sorted(want), (texts[r.i], r.p)
    with pytest.raises(ValueError, match="leads nowhere"):
        schemas.problems(F.lit("1"), "s", {"s": {"$ref": "#/$defs/x"}})


def test_every_half_float(spark):
    data = np.arange(65536, dtype="<u2")
    rows = spark.createDataFrame([(i, bytearray(data[i * 4096 : (i + 1) * 4096].tobytes())) for i in range(16)], "i int, b binary")
    got = np.concatenate([r[0] for r in rows.orderBy("i").select(samples.decoded(F.col("b"), "float16")).collect()])
    want = data.view("<f2").astype(float)
    assert ((got == want) | (np.isnan(got) & np.isnan(want))).all()


def test_samples_of_either_order(spark):
    row = spark.createDataFrame([(bytearray(struct.pack(">hhff", -3, 4, 1.5, -2.0) + b"\xff"), bytearray(), None)], "b binary, e binary, n binary")
    one = lambda c: row.select(c).first()[0]
    assert one(samples.decoded(F.col("b"), "int16", True))[:2] == [-3.0, 4.0] and one(samples.decoded(F.col("b"), "uint8"))[-1] == 255.0 and one(samples.decoded(F.col("b"), "int8"))[-1] == -1.0
    assert one(samples.decoded(F.substring("b", 5, 8), "float32", True)) == [1.5, -2.0] and one(samples.decoded(F.col("e"), "int16")) == [] and one(samples.decoded(F.col("n"), "int16")) is None
    assert one(samples.power(F.substring("b", 1, 4), "int16", 2.0)) == [50.0] and one(samples.power(F.substring("b", 5, 8), "float32")) == [6.25]
    assert one(samples.power(F.lit(bytearray([3, 9, 5, 0, 7])), "amp8", 2.0)) == [18.0, 50.0, 98.0] and one(samples.power(F.substring("b", 1, 6), "int16")) == [25.0]
    rng = np.random.default_rng(7)
    raw = rng.integers(0, 2**32, 400, dtype=np.uint32)
    got = np.array(spark.createDataFrame([(bytearray(raw.astype(">u4").tobytes()),)], "b binary").select(samples.decoded(F.col("b"), "float32", True)).first()[0])
    want = raw.view("<f4").astype(float)
    assert ((got == want) | (np.isnan(got) & np.isnan(want))).all()
