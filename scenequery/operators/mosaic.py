"""Display tiles from a sparse set of chunks: means of chunk blocks, then interpolation between block centres that exist.

Both steps are sums. Blocks are means by block; interpolation weights split into one factor an axis, so values and weights are
summed along rows of blocks first and along columns of that after, and divided at the end. Absent chunks have no blocks, so they
weigh nothing. How fine blocks are, and where their centres lie, follows from each tile's own list of chunks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEWEST, MOST = 4, 16
REACH = 3  # of the Lanczos kernel


def blocks_per_chunk(size: int, rows: Column, cols: Column) -> Column:
    """Blocks along a chunk's side: enough for a tile of ``size`` pixels, from 4 to 16."""
    return F.least(F.lit(MOST), F.greatest(F.lit(FEWEST), F.ceil(size / F.greatest(rows, cols)))).cast("int")


def lanczos(x: Column) -> Column:
    px = x * math.pi
    return F.when(x == 0, 1.0).when(F.abs(x) >= REACH, 0.0).otherwise(REACH * F.sin(px) * F.sin(px / REACH) / (px * px))


def _axes(tiles: DataFrame, chunks: DataFrame, size: int, chunk: tuple[int, int]) -> DataFrame:
    """Tiles with their sorted chunk rows and columns, n (blocks a chunk side) and block sides bh and bw."""
    listed = chunks.groupBy("scene_id", "tile").agg(F.sort_array(F.collect_set("chunk_row")).alias("rows"), F.sort_array(F.collect_set("chunk_col")).alias("cols"))  # a tile's chunks at most
    sized = tiles.join(listed, ["scene_id", "tile"]).withColumn("n", blocks_per_chunk(size, F.size("rows"), F.size("cols")))
    return sized.withColumns({"bh": F.floor(F.lit(chunk[0]) / F.col("n")).cast("int"), "bw": F.floor(F.lit(chunk[1]) / F.col("n")).cast("int")})


def _blocks(pixels: DataFrame, present: DataFrame, axes: DataFrame, chunk: tuple[int, int]) -> DataFrame:
    """(scene_id, tile, y, x, v): mean positive value of each block that has any, numbered through the tile's chunk lists."""
    wanted = present.join(axes.select("scene_id", "tile", "rows", "cols", "n", "bh", "bw"), ["scene_id", "tile"])
    placed = pixels.filter("v > 0").withColumns({"chunk_row": F.floor(F.col("row") / chunk[0]).cast("int"), "chunk_col": F.floor(F.col("col") / chunk[1]).cast("int")})
    met = placed.join(wanted, ["scene_id", "chunk_row", "chunk_col"])
    side = lambda p, length, block, list_, at: ((F.array_position(list_, F.col(at)) - 1) * F.col("n") + F.floor(F.pmod(F.col(p), F.lit(length)) / F.col(block))).cast("int")
    inside = met.filter((F.pmod("row", F.lit(chunk[0])) < F.col("n") * F.col("bh")) & (F.pmod("col", F.lit(chunk[1])) < F.col("n") * F.col("bw")))
    return inside.groupBy("scene_id", "tile", side("row", chunk[0], "bh", "rows", "chunk_row").alias("y"), side("col", chunk[1], "bw", "cols", "chunk_col").alias("x")).agg(F.avg("v").alias("v"))


def _taps(axes: DataFrame, list_: str, start: str, length: str, chunk: int, block: str, size: int, kernel: str) -> DataFrame:
    """(scene_id, tile, at, place, w): for each pixel of a tile's side the blocks it takes from, with their weights."""
    last = F.size(list_) * F.col("n") - 1
    centre = lambda i: F.element_at(list_, (F.floor(i / F.col("n")) + 1).cast("int")) * F.lit(chunk) + (i % F.col("n") + 0.5) * F.col(block)
    source = F.col(start) + (F.col("at") + 0.5) * F.col(length) / F.lit(size)
    rows = axes.withColumn("_c", F.transform(F.sequence(F.lit(0), last), centre)).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("_s", source)
    low = F.least(F.greatest(last - 1, F.lit(0)), F.size(F.filter(F.slice("_c", 2, last), lambda m: m <= F.col("_s"))))
    rows = rows.withColumn("_low", low.cast("int"))
    a, b = F.element_at("_c", F.col("_low") + 1), F.element_at("_c", F.least(F.col("_low") + 1, last) + 1)
    share = F.when(a == b, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_s") - a) / (b - a))))
    rows = rows.withColumn("_f", share)
    if kernel == "lanczos":
        where = F.col("_low") + F.col("_f")
        nearest = F.floor(where + 0.5).cast("int")
        taps = F.transform(F.sequence(nearest - REACH + 1, nearest + REACH), lambda i: F.struct(i.alias("place"), lanczos(where - i).alias("w")))
    elif kernel == "bilinear":
        taps = F.array(F.struct(F.col("_low").alias("place"), (1 - F.col("_f")).alias("w")), F.struct(F.least(F.col("_low") + 1, last).alias("place"), F.col("_f").alias("w")))
    else:
        raise ValueError(f"no kernel is called {kernel}")
    return rows.select("scene_id", "tile", "at", F.inline(F.filter(taps, lambda t: (t["place"] >= 0) & (t["place"] <= last) & (t["w"] != 0))))


def mosaic_tiles(pixels: DataFrame, tiles: DataFrame, chunks: DataFrame, size: int = 256, chunk: tuple[int, int] = (512, 512), kernel: str = "lanczos") -> DataFrame:
    """(scene_id, tile, row, col, v): tiles of ``size`` x ``size`` pixels, 0 where nothing is near.

    ``tiles``: scene_id, tile, top, left, height, width in pixels of the scene. ``chunks``: scene_id, tile, chunk_row, chunk_col, present;
    absent ones shape the grid of blocks and give no values. Tiles without chunks are all 0. Pixels that are null, zero, negative
    or not a number do not count.
    """
    axes = _axes(tiles, chunks, size, chunk)
    blocks = _blocks(pixels, chunks.filter("present").select("scene_id", "tile", "chunk_row", "chunk_col").distinct(), axes, chunk)
    across = _taps(axes, "cols", "left", "width", chunk[1], "bw", size, kernel).select("scene_id", "tile", F.col("at").alias("col"), F.col("place").alias("x"), F.col("w").alias("wx"))
    down = _taps(axes, "rows", "top", "height", chunk[0], "bh", size, kernel).select("scene_id", "tile", F.col("at").alias("row"), F.col("place").alias("y"), F.col("w").alias("wy"))
    lines = blocks.join(across, ["scene_id", "tile", "x"]).groupBy("scene_id", "tile", "y", "col").agg(F.sum(F.col("v") * F.col("wx")).alias("v"), F.sum("wx").alias("w"))
    summed = lines.join(down, ["scene_id", "tile", "y"]).groupBy("scene_id", "tile", "row", "col").agg(F.sum(F.col("v") * F.col("wy")).alias("v"), F.sum(F.col("w") * F.col("wy")).alias("w"))
    every = tiles.select("scene_id", "tile", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return every.join(summed, ["scene_id", "tile", "row", "col"], "left").select("scene_id", "tile", "row", "col", F.when(F.col("w") > 0, F.col("v") / F.col("w")).otherwise(0.0).alias("v"))
