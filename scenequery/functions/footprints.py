"""Polygon footprints: rings are arrays of structs (x, y), open or closed. Areas are column expressions; cutting works on whole batches
of rings at once, as flat arrays of points with the number of points of each ring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x: double, y: double>>"


def opened(ring: Column) -> Column:
    """The ring without a last point that repeats the first."""
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def ring_area(ring: Column) -> Column:
    """Area of a ring in the units of its coordinates; 0 with fewer than three points."""
    points = opened(ring)
    after = lambda i: F.element_at(points, F.pmod(i + 1, F.size(points)) + 1)
    parts = F.transform(points, lambda p, i: p["x"] * after(i)["y"] - after(i)["x"] * p["y"])
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)) / 2)


def _following(sizes: np.ndarray) -> np.ndarray:
    """Of each point, the place of the one that follows it in its ring."""
    ends = np.cumsum(sizes)
    after = np.arange(1, ends[-1] + 1 if len(ends) else 1)
    some = sizes > 0
    after[ends[some] - 1] = (ends - sizes)[some]
    return after


def points_of(rings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(points, sizes) of a column of rings, opened; a null ring has none."""
    sizes = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rings.flatten()
    points = np.column_stack([flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1)]) if len(flat) else np.zeros((0, 2))
    last = np.cumsum(sizes)[sizes > 1] - 1
    closed = (points[last] == points[last - sizes[sizes > 1] + 1]).all(1)
    keep = np.ones(len(points), bool)
    keep[last[closed]] = False
    sizes[np.flatnonzero(sizes > 1)[closed]] -= 1
    return points[keep], sizes


def clip(points: np.ndarray, sizes: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What of each ring lies in its box (x0, y0, x1, y1): all rings are cut by one side after the other."""
    for axis, side, above in ((0, 0, True), (0, 2, False), (1, 1, True), (1, 3, False)):
        ring = np.repeat(np.arange(len(sizes)), sizes)
        after, bound, at = _following(sizes), boxes[ring, side], points[:, axis]
        inside = at >= bound if above else at <= bound
        crosses = inside != inside[after]
        count = inside.astype(int) + crosses
        place = np.cumsum(count) - count
        out = np.empty((int(count.sum()), 2))
        out[place[inside]] = points[inside]
        a, b = points[crosses], points[after[crosses]]
        t = (bound[crosses] - a[:, axis]) / (b[:, axis] - a[:, axis])
        out[(place + inside)[crosses]] = a + t[:, None] * (b - a)
        points, sizes = out, np.bincount(ring, weights=count, minlength=len(sizes)).astype(np.int64)
    return points, sizes


def areas(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ring, after = np.repeat(np.arange(len(sizes)), sizes), _following(sizes)
    parts = points[:, 0] * points[after, 1] - points[after, 0] * points[:, 1]
    return np.where(sizes < 3, 0.0, np.abs(np.bincount(ring, weights=parts, minlength=len(sizes))) / 2)


def cover(rings: pa.Array, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each ring and its box: per cent of the box that it covers, corners of what lies inside, whether its extent meets the box."""
    points, sizes = points_of(rings)
    ring = np.repeat(np.arange(len(sizes)), sizes)
    extent = np.full((len(sizes), 4), [np.inf, np.inf, -np.inf, -np.inf])
    for k in (0, 1):
        np.minimum.at(extent[:, k], ring, points[:, k])
        np.maximum.at(extent[:, k + 2], ring, points[:, k])
    meets = (extent[:, 0] <= boxes[:, 2]) & (extent[:, 2] >= boxes[:, 0]) & (extent[:, 1] <= boxes[:, 3]) & (extent[:, 3] >= boxes[:, 1])
    inside, left = clip(points, sizes, boxes)
    whole = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    share = np.divide(areas(inside, left), whole, out=np.zeros(len(sizes)), where=whole > 0) * 100
    given = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.where(given < 3, 0.0, np.clip(share, 0, 100)), left, meets
