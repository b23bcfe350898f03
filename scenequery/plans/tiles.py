"""Queries of display tiles and of networks run in tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mosaic, networks
from ..sources import adapters as src
from .registry import query

SIZE, CHUNK = 32, 25
PX = src.EVENT_RASTER_SQL


def _tiles(spark, sf_dir):
    """Two tiles a scene, with the chunks they touch; every fifth chunk is absent."""
    scenes = src.event_raster(spark, sf_dir).select("scene_id").distinct()
    places = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("tile", "top", "left", "height", "width"), t, strict=True))) for t in ((0, 0, 0, 100, 100), (1, 20, 30, 50, 60))))
    tiles = scenes.select("scene_id", F.inline(places))
    span = lambda start, length: F.sequence(F.floor(F.col(start) / CHUNK).cast("int"), F.floor((F.col(start) + F.col(length) - 1) / CHUNK).cast("int"))
    chunks = tiles.withColumn("chunk_row", F.explode(span("top", "height"))).withColumn("chunk_col", F.explode(span("left", "width")))
    return tiles, chunks.select("scene_id", "tile", "chunk_row", "chunk_col", ((F.col("scene_id") + F.col("chunk_row") * 4 + F.col("chunk_col")) % 5 != 2).alias("present"))


def _mosaic_sql(kernel: str) -> str:
    d = "(f - i)"
    weight = {"lanczos": f"CASE WHEN {d} = 0 THEN 1.0 WHEN abs{d} >= 3 THEN 0.0 ELSE 3 * sin(pi() * {d}) * sin(pi() * {d} / 3) / (pi() * {d} * pi() * {d}) END", "bilinear": f"greatest(0.0, 1 - abs{d})"}[kernel]
    reach = {"lanczos": "i BETWEEN floor(f + 0.5) - 2 AND floor(f + 0.5) + 3", "bilinear": "abs(i - f) < 1"}[kernel]
    side = lambda name, start, length, chunks: f"""{name}c AS (SELECT scene_id, tile, i, ({chunks} + i // n) * {CHUNK} + (i % n + 0.5) * ({CHUNK} // n) AS centre FROM t, range(64) r(i) WHERE i < n * ({name}n)),
      {name}s AS (SELECT t.scene_id, t.tile, p, n * ({name}n) AS m, {start} + (p + 0.5) * {length} / {SIZE} AS s FROM t, range({SIZE}) r(p)),
      {name}l AS (SELECT a.scene_id, a.tile, p, any_value(s) AS s, least(any_value(m) - 2, count(*) FILTER (WHERE i > 0 AND centre <= s)) AS low FROM {name}s a JOIN {name}c b USING (scene_id, tile) GROUP BY 1, 2, 3),
      {name}f AS (SELECT a.scene_id, a.tile, p, low + greatest(0, least(1, (s - b.centre) / (c.centre - b.centre))) AS f FROM {name}l a JOIN {name}c b ON a.scene_id = b.scene_id AND a.tile = b.tile AND b.i = low JOIN {name}c c ON a.scene_id = c.scene_id AND a.tile = c.tile AND c.i = low + 1),
      {name}w AS (SELECT a.scene_id, a.tile, p, i, {weight} AS w FROM {name}f a JOIN {name}c USING (scene_id, tile) WHERE {reach})"""  # noqa: E731
    return f"""WITH {PX}, t AS (SELECT *, least(16, greatest(4, CAST(ceil({SIZE}.0 / greatest(rown, coln)) AS INTEGER))) AS n FROM (SELECT scene_id, tile, top, lft, hgt, wid, top // {CHUNK} AS r0, lft // {CHUNK} AS c0, (top + hgt - 1) // {CHUNK} - top // {CHUNK} + 1 AS rown, (lft + wid - 1) // {CHUNK} - lft // {CHUNK} + 1 AS coln
        FROM (SELECT DISTINCT scene_id FROM px), (VALUES (0, 0, 0, 100, 100), (1, 20, 30, 50, 60)) v(tile, top, lft, hgt, wid))),
      cells AS (SELECT t.scene_id, tile, ("row" // {CHUNK} - r0) * n + ("row" % {CHUNK}) // ({CHUNK} // n) AS y, (col // {CHUNK} - c0) * n + (col % {CHUNK}) // ({CHUNK} // n) AS x, avg(v) AS v FROM t JOIN px USING (scene_id)
        WHERE v > 0 AND "row" // {CHUNK} BETWEEN r0 AND r0 + rown - 1 AND col // {CHUNK} BETWEEN c0 AND c0 + coln - 1 AND (scene_id + ("row" // {CHUNK}) * 4 + col // {CHUNK}) % 5 <> 2 AND "row" % {CHUNK} < n * ({CHUNK} // n) AND col % {CHUNK} < n * ({CHUNK} // n) GROUP BY 1, 2, 3, 4),
      {side("row", "top", "hgt", "r0")}, {side("col", "lft", "wid", "c0")},
      s AS (SELECT a.scene_id, a.tile, a.p AS "row", b.p AS col, sum(v * a.w * b.w) AS v, sum(a.w * b.w) AS w FROM roww a JOIN colw b USING (scene_id, tile) JOIN cells c ON c.scene_id = a.scene_id AND c.tile = a.tile AND c.y = a.i AND c.x = b.i GROUP BY 1, 2, 3, 4)
      SELECT t.scene_id, t.tile, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, round(CASE WHEN w > 0 THEN v / w ELSE 0.0 END, 6) AS v FROM t CROSS JOIN range({SIZE}) a(r) CROSS JOIN range({SIZE}) b(c) LEFT JOIN s ON s.scene_id = t.scene_id AND s.tile = t.tile AND s."row" = r AND s.col = c"""


def _mosaic(spark, sf_dir, kernel):
    tiles, chunks = _tiles(spark, sf_dir)
    out = mosaic.mosaic_tiles(src.event_raster(spark, sf_dir), tiles, chunks, SIZE, (CHUNK, CHUNK), kernel)
    return out.withColumn("v", F.round("v", 6))


@query(_mosaic_sql("lanczos"))
def mosaic_lanczos(spark, sf_dir):
    """Display tiles from chunks of which some are absent, smooth."""
    return _mosaic(spark, sf_dir, "lanczos")


@query(_mosaic_sql("bilinear"))
def mosaic_bilinear(spark, sf_dir):
    """The same between the four nearest blocks."""
    return _mosaic(spark, sf_dir, "bilinear")


#: A network of two layers of 3 x 3 convolutions: one band, two hidden channels, three classes.
NET = [
    networks.Convolution([[[[0.5, 0.25, 0.0], [0.25, 1.0, 0.25], [0.0, 0.25, 0.5]]], [[[-0.5, 0.0, 0.5], [-1.0, 0.125, 1.0], [-0.5, 0.0, 0.5]]]], [-4.0, 1.0], relu=True),
    networks.Convolution([[[[0.0, 0.1, 0.0], [0.1, 0.3, 0.1], [0.0, 0.1, 0.0]], [[0.1, 0.0, 0.1], [0.0, 0.2, 0.0], [0.1, 0.0, 0.1]]], [[[-0.1, 0.0, -0.1], [0.0, 0.2, 0.0], [-0.1, 0.0, -0.1]], [[0.0, 0.3, 0.0], [0.3, 0.5, 0.3], [0.0, 0.3, 0.0]]], [[[0.05, 0.05, 0.05], [0.05, 0.05, 0.05], [0.05, 0.05, 0.05]], [[0.2, 0.1, 0.2], [0.1, -0.4, 0.1], [0.2, 0.1, 0.2]]]], [0.0, 3.0, 6.0]),
]


def _layer_sql(k: int) -> str:
    """The weights of a layer as rows (o, i, dy, dx, w)."""
    rows = [f"({o}, {i}, {y - 1}, {x - 1}, {w})" for o, channels in enumerate(NET[k].weights) for i, grid in enumerate(channels) for y, line in enumerate(grid) for x, w in enumerate(line)]
    return f"(VALUES {', '.join(rows)}) n{k}(o, i, dy, dx, w)"


_BIAS = lambda k: "CASE o " + " ".join(f"WHEN {o} THEN {b}" for o, b in enumerate(NET[k].bias)) + " END"


@query(f"""WITH {PX}, d AS (SELECT scene_id, "row", col, CASE WHEN v > 0 THEN 10 * log10(v) ELSE 0 END AS v FROM px),
  h AS (SELECT scene_id, "row" - dy AS "row", col - dx AS col, o, greatest(0.0, sum(v * w) + {_BIAS(0)}) AS v FROM d, {_layer_sql(0)} WHERE "row" - dy BETWEEN 0 AND 99 AND col - dx BETWEEN 0 AND 99 GROUP BY 1, 2, 3, 4),
  s AS (SELECT scene_id, "row" - dy AS "row", col - dx AS col, n1.o, sum(v * w) + {_BIAS(1).replace("CASE o", "CASE n1.o")} AS v FROM h JOIN {_layer_sql(1)} ON h.o = n1.i WHERE "row" - dy BETWEEN 0 AND 99 AND col - dx BETWEEN 0 AND 99 GROUP BY 1, 2, 3, 4)
  SELECT scene_id, "row", col, CAST(arg_min(o, -v) AS INTEGER) AS class, round(max(v), 6) AS score FROM s JOIN px USING (scene_id, "row", col) GROUP BY 1, 2, 3""".replace(" v FROM s JOIN px", " v FROM s JOIN px").replace("max(v)", "max(s.v)").replace("-v)", "-s.v)"))
def network_classes(spark, sf_dir):
    """A small convolutional network run on overlapping tiles, its class channels blended before the best one is taken."""
    px = src.event_raster(spark, sf_dir).withColumn("v", F.when(F.col("v") > 0, 10 * F.log10("v")))
    classes = networks.classify(networks.run(px, ["scene_id"], ["v"], NET, 100, 100, tile=40, overlap=6))
    return classes.withColumn("score", F.round("score", 6))
