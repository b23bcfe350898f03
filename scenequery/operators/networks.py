"""Small convolutional networks on rasters of any size, in overlapping tiles.

A tile is one group of a bounded size: its pixels become a tensor, go through all layers, and come back as rows with the tile's
blending weight. Channels are blended before the best class is taken, so classes do not change at seams. With an overlap whose half
is at least the sum of the kernels' radii, the result is that of the whole raster at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grids

MOST_PARAMETERS = 5_000_000  # go to every task with the function


@dataclass(frozen=True)
class Convolution:
    """weights[out][in][y][x] of an odd side, a bias for each output, zeros around the tile."""

    weights: list
    bias: list
    relu: bool = False

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w = np.asarray(self.weights, float)
        r = w.shape[2] // 2
        windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (r, r), (r, r))), w.shape[2:], axis=(1, 2))
        out = np.einsum("ihwyx,oiyx->ohw", windows, w, optimize=True) + np.asarray(self.bias, float)[:, None, None]
        return np.maximum(out, 0) if self.relu else out


def check(net: list[Convolution], bands: int, overlap: int | None) -> None:
    """An error where layers do not fit each other, are too large, or reach further than an overlap makes up for."""
    held, reach = bands, 0
    for k, layer in enumerate(net):
        shape = np.shape(layer.weights)
        if len(shape) != 4 or shape[2] != shape[3] or shape[2] % 2 == 0 or shape[1] != held or len(layer.bias) != shape[0]:
            raise ValueError(f"layer {k} of shape {shape} does not fit {held} channels")
        if not np.isfinite(layer.weights).all() or not np.isfinite(layer.bias).all():
            raise ValueError(f"layer {k} has weights that are not finite")
        held, reach = shape[0], reach + shape[2] // 2
    if sum(np.size(layer.weights) for layer in net) > MOST_PARAMETERS:
        raise ValueError(f"more than {MOST_PARAMETERS} weights")
    if overlap is not None and reach > overlap // 2:
        raise ValueError(f"layers reach {reach} pixels, an overlap of {overlap} makes up for {overlap // 2}")


def run(pixels: DataFrame, keys: list[str], bands: list[str], net: list[Convolution], height: int, width: int, tile: int = 256, overlap: int = 16) -> DataFrame:
    """(keys, row, col, channels): the network's outputs at every pixel of ``pixels``; null bands, and pixels without a row, count as 0.

    Tiles of ``tile`` x ``tile`` start every tile - 2 * overlap pixels; rasters that fit into one tile are run as one.
    """
    whole = height <= tile and width <= tile
    check(net, len(bands), None if whole else overlap)
    outputs = len(net[-1].bias)
    placed = grids.in_tiles(pixels.select(*keys, "row", "col", *(F.coalesce(F.col(b).cast("double"), F.lit(0.0)).alias(b) for b in bands)), height, width, tile, overlap)

    def infer(table: pa.Table) -> pa.Table:
        top, left = table.column("tr")[0].as_py(), table.column("tc")[0].as_py()
        r, c, w = (table.column(n).to_numpy() for n in ("row", "col", "w"))
        tensor = np.zeros((len(bands), min(tile, height - top), min(tile, width - left)))
        for k, band in enumerate(bands):
            tensor[k, r - top, c - left] = table.column(band).to_numpy()
        for layer in net:
            tensor = layer(tensor)
        kept = np.flatnonzero(w > 0)
        values = tensor[:, r[kept] - top, c[kept] - left] * w[kept]
        found = {name: table.column(name).take(pa.array(kept)) for name in (*keys, "row", "col", "w")}
        return pa.table(found | {f"c{k}": pa.array(values[k]) for k in range(outputs)})

    schema = ", ".join([*(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys), "row int, col int, w double", *(f"c{k} double" for k in range(outputs))])
    parts = placed.groupBy(*keys, "tr", "tc").applyInArrow(infer, schema)
    summed = parts.groupBy(*keys, "row", "col").agg(F.sum("w").alias("w"), *(F.sum(f"c{k}").alias(f"c{k}") for k in range(outputs)))
    return summed.select(*keys, "row", "col", F.array(*(F.col(f"c{k}") / F.col("w") for k in range(outputs))).alias("channels"))


def classify(run: DataFrame) -> DataFrame:
    """class (the first of the best channels) and score in place of channels."""
    best = F.array_max("channels")
    return run.withColumn("class", (F.array_position("channels", best) - 1).cast("int")).withColumn("score", best).drop("channels")
