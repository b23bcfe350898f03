"""Scenes of different grids: a table of scenes says how large each is and where it lies, and drives what is done with its pixels.

``scenes``: scene_id, height, width, bounds (x0, y0, x1, y1 of the pixels' outer edges), crs, xs, ys (arrays of pixel centres, from west to
east and from north to south, or null for an even grid). A scene's row is joined to its pixels by scene_id; nothing is taken for
the same in all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = "height, width, x0, y0, x1, y1, crs, xs, ys"


def looks(height: Column, width: Column, most: int) -> Column:
    """By how much a scene is made smaller so that no side has more than ``most`` pixels."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(height, width) / F.lit(most))).cast("int")


def capped(pixels: DataFrame, scenes: DataFrame, most: int = 2048) -> DataFrame:
    """(scene_id, row, col, v, n): each scene averaged over its own number of looks, ragged edges kept; n counts valid pixels.

    Valid are positive values. Blocks without any have no row. Pixels outside their scene, or of scenes that are not listed, do not count.
    """
    sized = pixels.join(scenes.select("scene_id", "height", "width", looks(F.col("height"), F.col("width"), most).alias("_n")), "scene_id")
    inside = sized.filter("row >= 0 and col >= 0 and row < height and col < width and v > 0")
    at = lambda c: F.floor(F.col(c) / F.col("_n")).cast("int").alias(c)
    return inside.groupBy("scene_id", at("row"), at("col")).agg(F.avg("v").alias("v"), F.count("*").alias("n"))


def capped_size(scenes: DataFrame, most: int = 2048) -> DataFrame:
    """(scene_id, looks, height, width) of what ``capped`` gives."""
    n = looks(F.col("height"), F.col("width"), most)
    return scenes.select("scene_id", n.alias("looks"), F.ceil(F.col("height") / n).cast("int").alias("height"), F.ceil(F.col("width") / n).cast("int").alias("width"))


def regions(scenes: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (request, rx0, ry0, rx1, ry1, rcrs) and each scene it names (scene_id): first_row, first_col, rows, cols, the
    bounds of that part (bx0, by0, bx1, by1) and problem.

    A region is held to the scene. With coordinate arrays (of more than two) its pixels are those whose centres lie in it, and the bounds
    are the outermost centres; on an even grid, the pixels that it touches and one more at its far ends, as far as there are any,
    and the bounds are outer edges. A scene of another CRS, one that the region misses, and one of which it holds no pixel are rows with
    their problem.
    """
    met = requests.join(scenes, "scene_id", "left")
    a, b = (lambda low, bound: F.greatest(F.col(low), F.col(bound))), (lambda high, bound: F.least(F.col(high), F.col(bound)))
    met = met.withColumns({"_w": a("rx0", "x0"), "_e": b("rx1", "x1"), "_s": a("ry0", "y0"), "_n": b("ry1", "y1")})
    share = lambda c, start, end, size: (F.col(c) - F.col(start)) / (F.col(end) - F.col(start)) * F.col(size)
    count = lambda arr, test: F.size(F.filter(arr, test))
    listed = lambda arr: F.coalesce(F.size(arr) > 2, F.lit(False))
    below = lambda arr, at: count(arr, lambda v: v < F.col(at))
    c0 = F.when(listed("xs"), below("xs", "_w")).otherwise(F.floor(share("_w", "x0", "x1", "width")))
    c1 = F.when(listed("xs"), count("xs", lambda v: v <= F.col("_e")) - 1).otherwise(F.ceil(share("_e", "x0", "x1", "width")))
    r0 = F.when(listed("ys"), count("ys", lambda v: v > F.col("_n"))).otherwise(F.floor(share("_n", "y1", "y0", "height")))
    r1 = F.when(listed("ys"), count("ys", lambda v: v >= F.col("_s")) - 1).otherwise(F.ceil(share("_s", "y1", "y0", "height")))
    held = {"first_col": F.greatest(F.lit(0), c0), "_c1": F.least(F.col("width") - 1, c1), "first_row": F.greatest(F.lit(0), r0), "_r1": F.least(F.col("height") - 1, r1)}
    met = met.withColumns({k: v.cast("int") for k, v in held.items()}).withColumns({"rows": F.col("_r1") - F.col("first_row") + 1, "cols": F.col("_c1") - F.col("first_col") + 1})
    misses = (F.col("rx1") <= F.col("x0")) | (F.col("rx0") >= F.col("x1")) | (F.col("ry1") <= F.col("y0")) | (F.col("ry0") >= F.col("y1"))
    problem = F.when(F.col("height").isNull(), "no such scene").when(~F.col("crs").eqNullSafe(F.col("rcrs")), F.concat(F.lit("CRS "), F.coalesce("crs", F.lit("unknown")), F.lit(" is not "), F.coalesce("rcrs", F.lit("unknown")))).when(misses, "region misses the scene").when((F.col("rows") <= 0) | (F.col("cols") <= 0), "no pixel in the region")
    met = met.withColumn("problem", problem)
    edge = lambda at, size, start, end: F.col(start) + at / F.col(size) * (F.col(end) - F.col(start))
    last = lambda arr, first, n: F.get(arr, F.least(first + n, F.size(arr)) - 1)
    rows, cols, fr, fc = (F.col(c) for c in ("rows", "cols", "first_row", "first_col"))
    bounds = {"bx0": F.when(listed("xs"), F.get("xs", fc)).otherwise(edge(fc, "width", "x0", "x1")), "bx1": F.when(listed("xs"), last("xs", fc, cols)).otherwise(edge(fc + cols, "width", "x0", "x1")), "by1": F.when(listed("ys"), F.get("ys", fr)).otherwise(edge(fr, "height", "y1", "y0")), "by0": F.when(listed("ys"), last("ys", fr, rows)).otherwise(edge(fr + rows, "height", "y1", "y0"))}
    well = F.col("problem").isNull()
    kept = ["first_row", "first_col", "rows", "cols"]
    return met.withColumns(bounds).select("request", "scene_id", *(F.when(well, F.col(c)).alias(c) for c in (*kept, "bx0", "by0", "bx1", "by1")), "problem")


def series(pixels: DataFrame, found: DataFrame) -> DataFrame:
    """(request, scene_id, mean, n, problem): the mean of the positive pixels of each region, and a row for each problem."""
    well = found.filter("problem is null").select("request", "scene_id", "first_row", "first_col", "rows", "cols")
    inside = pixels.filter("v > 0").join(well, "scene_id").filter("row >= first_row and row < first_row + rows and col >= first_col and col < first_col + cols")
    sums = inside.groupBy("request", "scene_id").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
    joined = found.select("request", "scene_id", "problem").join(sums, ["request", "scene_id"], "left")
    return joined.select("request", "scene_id", "mean", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("problem", F.when(F.col("n").isNull(), "no valid pixel")).alias("problem"))
