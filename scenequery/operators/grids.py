"""Grids and files: resampling, sampled statistics, blended tiles, co-registration, stacks, metadata."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest_down(pixels: DataFrame, keys: list[str], source: int, target: int) -> DataFrame:
    """Every target pixel takes the source pixel under its centre; only those rows are kept."""
    at = [(t, min(source - 1, math.floor((t + 0.5) * source / target))) for t in range(target)]
    spark = pixels.sparkSession
    rows, cols = (F.broadcast(spark.createDataFrame(at, f"{n} int, {axis} int")) for n, axis in (("r2", "row"), ("c2", "col")))  # a row a target line
    return pixels.join(rows, "row").join(cols, "col").select(*keys, F.col("r2").alias("row"), F.col("c2").alias("col"), "v")


def bilinear_up(pixels: DataFrame, keys: list[str], source: int, target: int) -> DataFrame:
    """Bilinear enlargement; where a corner has no value or no row, the first valid corner (top left first) stands for all."""
    taps = []
    for t in range(target):
        f = min(max((t + 0.5) * source / target - 0.5, 0.0), source - 1.0)
        a = min(int(f), max(0, source - 2))
        taps += [(t, a, 0, 1 - (f - a)), (t, min(a + 1, source - 1), 1, f - a)]
    spark = pixels.sparkSession
    rows = F.broadcast(spark.createDataFrame(taps, "r2 int, row int, pr int, wr double"))
    cols = F.broadcast(spark.createDataFrame(taps, "c2 int, col int, pc int, wc double"))
    met = pixels.join(rows, "row").join(cols, "col")
    valid = F.col("v").isNotNull()
    found = met.groupBy(*keys, F.col("r2").alias("row"), F.col("c2").alias("col")).agg((F.count("v") == 4).alias("whole"), F.sum(F.col("v") * F.col("wr") * F.col("wc")).alias("mixed"), F.min_by("v", F.when(valid, F.col("pr") * 2 + F.col("pc"))).alias("first"))
    return found.select(*keys, "row", "col", F.when(F.col("whole"), F.col("mixed")).otherwise(F.col("first")).alias("v"))


def feather(position: Column, start: Column, length: int, overlap: int, first: Column, last: Column) -> Column:
    """Weight of a pixel along one axis of its tile; a side at the border of the raster has full weight."""
    margin = overlap // 2
    ramp = max(1, overlap - margin)
    to_start = F.when(first, F.lit(10**6)).otherwise(position - start)
    to_end = F.when(last, F.lit(10**6)).otherwise(start + length - 1 - position)
    d = F.least(to_start, to_end)
    return F.when(d < margin, 0.0).otherwise(F.least(F.lit(1.0), (d - margin + 1) / F.lit(float(ramp + 1))))


def tile_starts(size: int, tile: int, overlap: int) -> list[int]:
    """Where tiles begin along an axis: every tile - 2 * overlap from overlap before the edge on, held to the raster."""
    if not 0 <= 2 * overlap < tile:
        raise ValueError(f"an overlap of {overlap} must be from 0 to less than half of {tile}")
    last = size - tile
    places, at = [], -overlap
    while not places or places[-1] + tile < size:
        places.append(max(0, min(at, last)))
        at += tile - 2 * overlap
    return places


def in_tiles(pixels: DataFrame, height: int, width: int, tile: int, overlap: int) -> DataFrame:
    """Each pixel with every overlapping tile that holds it (tr, tc: starts) and its blending weight w.

    A raster that fits into one tile is one tile, of weight 1."""
    rows, cols = tile_starts(height, tile, overlap), tile_starts(width, tile, overlap)
    if height <= tile and width <= tile:
        return pixels.withColumns({"tr": F.lit(0), "tc": F.lit(0), "w": F.lit(1.0)})
    holds = lambda p, starts: F.filter(F.array(*map(F.lit, starts)), lambda s: (s <= p) & (p < s + tile))
    out = pixels.withColumn("tr", F.explode(holds(F.col("row"), rows))).withColumn("tc", F.explode(holds(F.col("col"), cols)))
    side = lambda p, s, size: feather(F.col(p), F.col(s), tile, overlap, F.col(s) == 0, F.col(s) + tile >= size)
    return out.withColumn("w", side("row", "tr", height) * side("col", "tc", width))


def edges_inside(points: DataFrame, keys: list[str], bounds: tuple[float, float, float, float], share: float = 0.001) -> DataFrame:
    """Runs of ring edges that do not lie on a tile's boundary: keys, run, first, points.

    ``points``: keys, k (order), x, y. An edge whose ends are both less than ``share`` of the tile's extent from one side of
    ``bounds`` (x0, y0, x1, y1) is on it and ends a run.
    """
    order, (x0, y0, x1, y1) = Window.partitionBy(*keys).orderBy("k"), bounds
    near = lambda c, side, extent: F.abs(F.col(c) - side) < extent * share
    extent = {"x": x1 - x0, "y": y1 - y0}
    on = lambda c, d: (near(c, bounds[c == "y"], extent[c]) & near(d, bounds[c == "y"], extent[c])) | (near(c, bounds[2 + (c == "y")], extent[c]) & near(d, bounds[2 + (c == "y")], extent[c]))
    edges = points.withColumn("x2", F.lead("x").over(order)).withColumn("y2", F.lead("y").over(order)).where("x2 is not null")
    kept = edges.withColumn("cut", on("x", "x2") | on("y", "y2")).withColumn("run", F.sum(F.col("cut").cast("int")).over(order)).where("not cut")
    return kept.groupBy(*keys, "run").agg(F.min("k").alias("first"), (F.count("*") + 1).alias("points"))


def classify_power(bands: DataFrame, keys: list[str], gap_db: float = 6.0) -> DataFrame:
    """Bands by mean power: the weaker of two counts as cross-polarised where the gap exceeds ``gap_db``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("mean"), "band")
    ranked = bands.withColumn("rank", F.row_number().over(order)).withColumn("gap", 10 * F.log10(F.max("mean").over(Window.partitionBy(*keys)) / F.col("mean")))
    return ranked.withColumn("kind", F.when((F.col("rank") > 1) & (F.col("gap") > gap_db), "cross").otherwise("co"))


def temporal_labels(files: DataFrame, keys: list[str]) -> DataFrame:
    """Files in the order of their dates, those without one first, with labels T1, T2, ..."""
    order = Window.partitionBy(*keys).orderBy(F.coalesce("date", F.lit("1970-01-01").cast("timestamp")), "file")
    return files.withColumn("place", F.row_number().over(order)).withColumn("label", F.concat(F.lit("T"), F.col("place").cast("string")))


def strided_mean(chunks: DataFrame, key: str, order: str, value: str, most: int = 256) -> DataFrame:
    """n and mean of every max(1, total // most)-th row of each key, in order."""
    own = Window.partitionBy(key)
    placed = chunks.withColumn("_k", F.row_number().over(own.orderBy(order)) - 1).withColumn("_total", F.count("*").over(own))
    kept = placed.where(F.col("_k") % F.greatest(F.lit(1), F.floor(F.col("_total") / most)) == 0)
    return kept.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
