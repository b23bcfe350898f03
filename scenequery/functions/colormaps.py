"""Colour maps on [0, 1] as column expressions, and their table of 256 entries each.

A map is a polynomial, a ramp between stops, a cycle or a rule. Stored coefficients and stops are fixed values of published
maps; tables are made from them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Coefficients by rising power, a row a power with red, green, blue.
POLYNOMIALS = {
    "viridis": ((0.277727, 0.005407, 0.334100), (0.105093, 1.404613, 1.384590), (-0.330862, 0.214848, 0.095095), (-4.634230, -5.799101, -19.332441), (6.228270, 14.179933, 56.690553), (4.776385, -13.745145, -65.353033), (-5.435456, 4.645853, 26.312435)),
    "inferno": ((0.000219, 0.001651, -0.019481), (0.106513, 0.563956, 3.932712), (11.602493, -3.972854, -15.942394), (-41.703996, 17.436399, 44.354145), (77.162936, -33.402359, -81.807309), (-71.319428, 32.626064, 73.209520), (25.131126, -12.242669, -23.070325)),
    "plasma": ((0.058732, 0.023337, 0.543340), (2.176515, 0.238383, 0.753960), (-2.689460, -7.455851, 3.110800), (6.130348, 42.346188, -28.518855), (-11.107436, -82.666311, 60.139848), (10.023066, 71.413618, -54.072187), (-3.658714, -22.931535, 18.191908)),
    "turbo": ((0.13572138, 0.09140261, 0.10667330), (4.61539260, 2.19418839, 12.64194608), (-42.66032258, 4.84296658, -60.58204836), (132.13108234, -14.18503333, 110.36276771), (-152.94239396, 4.27729857, -89.90310912), (59.28637943, 2.82956604, 27.34824973)),
}

#: Stops in order, as (position, red, green, blue).
RAMPS = {
    "grayscale": ((0, 0, 0, 0), (1, 1, 1, 1)),
    "magma": ((0, 0.001, 0.000, 0.014), (0.125, 0.116, 0.063, 0.296), (0.25, 0.317, 0.072, 0.485), (0.375, 0.522, 0.139, 0.510), (0.5, 0.716, 0.215, 0.476), (0.625, 0.890, 0.314, 0.395), (0.75, 0.986, 0.530, 0.380), (0.875, 0.997, 0.763, 0.530), (1, 0.987, 0.991, 0.749)),
    "cividis": ((0, 0.000, 0.135, 0.305), (0.125, 0.102, 0.220, 0.436), (0.25, 0.263, 0.307, 0.423), (0.375, 0.380, 0.394, 0.435), (0.5, 0.487, 0.484, 0.471), (0.625, 0.607, 0.578, 0.464), (0.75, 0.733, 0.678, 0.425), (0.875, 0.867, 0.787, 0.346), (1, 0.996, 0.909, 0.218)),
    "batlow": ((0, 0.005, 0.098, 0.350), (0.125, 0.067, 0.263, 0.378), (0.25, 0.132, 0.375, 0.380), (0.375, 0.300, 0.450, 0.301), (0.5, 0.508, 0.510, 0.195), (0.625, 0.750, 0.564, 0.209), (0.75, 0.948, 0.615, 0.422), (0.875, 0.993, 0.705, 0.705), (1, 0.981, 0.800, 0.981)),
    "twilight": ((0, 0.886, 0.850, 0.888), (0.125, 0.580, 0.707, 0.779), (0.25, 0.384, 0.460, 0.731), (0.375, 0.351, 0.167, 0.562), (0.5, 0.186, 0.078, 0.215), (0.625, 0.455, 0.117, 0.310), (0.75, 0.697, 0.337, 0.322), (0.875, 0.800, 0.638, 0.534), (1, 0.886, 0.850, 0.888)),
    "roma_cyclic": ((0, 0.451, 0.223, 0.342), (0.125, 0.543, 0.266, 0.202), (0.25, 0.667, 0.456, 0.184), (0.375, 0.809, 0.733, 0.395), (0.5, 0.798, 0.883, 0.698), (0.625, 0.549, 0.799, 0.811), (0.75, 0.328, 0.582, 0.753), (0.875, 0.346, 0.350, 0.574), (1, 0.451, 0.223, 0.342)),
    "coherence": ((0, 0, 0, 0), (0.2, 0.180, 0.030, 0.040), (0.4, 0.500, 0.110, 0.040), (0.6, 0.820, 0.310, 0.050), (0.8, 0.980, 0.620, 0.110), (1, 1.000, 1.000, 0.880)),
    "red_blue": ((0, 0.020, 0.188, 0.380), (0.1, 0.129, 0.400, 0.674), (0.2, 0.263, 0.576, 0.765), (0.3, 0.573, 0.773, 0.871), (0.4, 0.820, 0.898, 0.941), (0.5, 0.969, 0.969, 0.969), (0.6, 0.992, 0.859, 0.780), (0.7, 0.957, 0.647, 0.510), (0.8, 0.839, 0.376, 0.302), (0.9, 0.698, 0.094, 0.169), (1, 0.404, 0.000, 0.122)),
    "flood": ((0, 10 / 255, 22 / 255, 40 / 255), (0.33, 181 / 255, 100 / 255, 42 / 255), (0.67, 232 / 255, 131 / 255, 58 / 255), (1, 1.0, 92 / 255, 92 / 255)),
    "diverging": ((0, 78 / 255, 201 / 255, 212 / 255), (0.5, 10 / 255, 22 / 255, 40 / 255), (1, 232 / 255, 131 / 255, 58 / 255)),
    "polarimetric": ((0, 212 / 255, 92 / 255, 1.0), (0.5, 10 / 255, 22 / 255, 40 / 255), (1, 61 / 255, 220 / 255, 132 / 255)),
}

#: Fixed values of the cubehelix rule: weights of cosine and sine by channel, and the floor of each channel.
HELIX = ((-0.14861, 1.78277), (-0.29227, -0.90649), (1.97294, 0.0))
HELIX_FLOOR = (3 / 255, 2 / 255, 1 / 255)
GOLDEN = 0.618033988749895

NAMES = [*POLYNOMIALS, *RAMPS, "phase", "cubehelix", "label"]


def _held(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def _ramp(t: Column, stops: tuple, channel: int) -> Column:
    out = F.lit(float(stops[-1][channel + 1]))
    for a, b in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(t < b[0], a[channel + 1] + (t - a[0]) / (b[0] - a[0]) * (b[channel + 1] - a[channel + 1])).otherwise(out)
    return out


def _label(t: Column) -> list[Column]:
    k = F.floor(t * 255 + 0.5)
    hue = F.pmod(k * GOLDEN, F.lit(1.0)) * 6
    sat, val = 0.7 + 0.3 * F.pmod(k * 13, F.lit(7)) / 6, 0.75 + 0.25 * F.pmod(k * 7, F.lit(5)) / 4
    # a channel falls from full to least and back around the circle of hues
    wave = lambda shift: val - val * sat * F.greatest(F.lit(0.0), F.least(F.pmod(hue + shift, F.lit(6.0)), 4 - F.pmod(hue + shift, F.lit(6.0)), F.lit(1.0)))
    return [F.when(k == 0, 0.0).otherwise(wave(shift)) for shift in (5.0, 3.0, 1.0)]


def colours(name: str, t: Column) -> list[Column]:
    """Red, green and blue, each on [0, 1], of a value on [0, 1]."""
    t = _held(t)
    if name in POLYNOMIALS:
        out = []
        for channel in range(3):
            value = F.lit(0.0)
            for power in reversed(POLYNOMIALS[name]):
                value = value * t + power[channel]
            out.append(_held(value))
        return out
    if name in RAMPS:
        return [_ramp(t, RAMPS[name], channel) for channel in range(3)]
    if name == "phase":
        return [0.5 + 0.5 * F.cos(t * 2 * math.pi + 2 * math.pi * k / 3) for k in range(3)]
    if name == "cubehelix":
        angle, amplitude = 2 * math.pi * (0.5 / 3 - 1.5 * t), t * (1 - t) / 2
        return [floor + (1 - floor) * _held(t + amplitude * (c * F.cos(angle) + s * F.sin(angle))) for (c, s), floor in zip(HELIX, HELIX_FLOOR, strict=True)]
    if name == "label":
        return _label(t)
    raise ValueError(f"unknown colour map {name}")


def tables(spark: SparkSession, names: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """(colormap, idx, r, g, b): 256 rows a map, bytes."""
    t = F.col("id") / 255.0
    t = 1 - t if reverse else t
    byte = lambda c: F.floor(c * 255 + 0.5).cast("int")
    maps = F.array(*(F.struct(F.lit(n).alias("colormap"), *(byte(c).alias(k) for c, k in zip(colours(n, t), "rgb", strict=True))) for n in names or NAMES))
    return spark.range(256).select(F.col("id").cast("int").alias("idx"), F.explode(maps).alias("m")).select("m.colormap", "idx", "m.r", "m.g", "m.b")
