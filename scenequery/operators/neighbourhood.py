"""Neighbourhood filters on dense pixel grids.

Sums over k x k windows are separable: a range window down each column, then one along each row, so a pixel is shuffled
twice whatever k is. Nodata pixels must be present as null rows. Partitions are single columns and rows of a scene.
Weights of distances that depend on the centre (Frost) weigh sums by row and column offset, which come from the same two windows.
Weights of a reduction (Lanczos) join the pixel with a fixed table of offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.radiometry import half_up


def odd_kernel(k: int) -> int:
    """A kernel from 3 to 15; even sizes go up by one."""
    k = max(3, min(15, k))
    return k if k % 2 else k + 1


def local_sums(pixels: DataFrame, half: int, keys: list[str], value: str = "v") -> DataFrame:
    """Adds n, s and q: count, sum and sum of squares of the valid values within ``half`` pixels."""
    v = F.col(value)
    down = Window.partitionBy(*keys, "col").orderBy("row").rangeBetween(-half, half)
    along = Window.partitionBy(*keys, "row").orderBy("col").rangeBetween(-half, half)
    first = pixels.withColumns({"_n": F.count(v).over(down), "_s": F.sum(v).over(down), "_q": F.sum(v * v).over(down)})
    return first.withColumns({"n": F.sum("_n").over(along), "s": F.sum("_s").over(along), "q": F.sum("_q").over(along)}).drop("_n", "_s", "_q")


def _moments() -> tuple[Column, Column, Column, Column]:
    c, n = F.col("v"), F.col("n")
    mean = F.col("s") / n
    return c, n, mean, F.greatest(F.col("q") / n - mean * mean, F.lit(0.0))


def _centred(out: Column) -> Column:
    """0 without a valid centre, the centre itself with fewer than two valid neighbours."""
    return F.when(F.col("v").isNull(), 0.0).when(F.col("n") < 2, F.col("v")).otherwise(out)


def _lee(enl: float) -> Column:
    c, _, m, var = _moments()
    noise = m * m / max(enl, 1)
    k = F.when(var > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (var - noise) / F.when(var > 0, var)))).otherwise(0.0)
    return F.greatest(m + k * (c - m), F.lit(0.0))


def _enhanced_lee(enl: float) -> Column:
    c, _, m, var = _moments()
    cv = F.when(m > 0, F.sqrt(var) / F.when(m > 0, m)).otherwise(0.0)
    return F.when(cv <= 1 / math.sqrt(enl), m).when(cv >= math.sqrt(1 + 2 / enl), c).otherwise(_lee(enl))


def _gamma_map(enl: float) -> Column:
    c, _, m, var = _moments()
    cv2 = F.when(m > 0, var / F.when(m > 0, m * m)).otherwise(0.0)
    low, high = 1 / enl, (2 + 1 / enl) / enl
    alpha = (1 + low) / F.greatest(cv2 - low, F.lit(1e-10))
    a = alpha - enl - 1
    d = m * m * a * a + 4 * alpha * enl * c * m
    found = (a * m + F.sqrt(F.greatest(d, F.lit(0.0)))) / (2 * alpha)
    return F.when(cv2 <= low, m).when(cv2 >= high, c).when(d < 0, _lee(enl)).otherwise(F.greatest(found, F.lit(0.0)))


def speckle(pixels: DataFrame, kind: str, keys: list[str], kernel: int = 7, enl: float = 4.0, damping: float = 1.0) -> DataFrame:
    """Adds out. ``kind``: boxcar, lee, enhanced-lee, gamma-map or frost; v must be null or positive."""
    half = odd_kernel(kernel) // 2
    if kind == "frost":
        return _frost(pixels, keys, half, damping)
    rules = {"boxcar": lambda e: F.col("s") / F.col("n"), "lee": _lee, "enhanced-lee": _enhanced_lee, "gamma-map": _gamma_map}
    if kind not in rules:
        raise ValueError(f"unknown filter {kind}")
    summed = local_sums(pixels, half, keys)
    out = F.when(F.col("v").isNull(), 0.0).otherwise(rules[kind](enl)) if kind == "boxcar" else _centred(rules[kind](enl))
    return summed.withColumn("out", out).drop("n", "s", "q")


def _frost(pixels: DataFrame, keys: list[str], half: int, damping: float) -> DataFrame:
    """Weights fall with the distance, which only few pairs of a row and a column offset have: values are added up by row offset down
    each column, then by column offset along each row, and the centre weighs these sums. A pixel is shuffled twice."""
    v, reach = F.col("v"), range(half + 1)
    down, along = Window.partitionBy(*keys, "col").orderBy("row"), Window.partitionBy(*keys, "row").orderBy("col")

    def apart(c: Column, window, k: int) -> Column:
        """Sum of the values just k pixels away on either side."""
        at = lambda o: F.coalesce(F.sum(c).over(window.rangeBetween(o, o)), F.lit(0.0))
        return at(k) + at(-k) if k else at(0)

    parts = {"s": v, "n": F.when(v.isNotNull(), 1.0), "q": v * v}
    first = pixels.withColumns({f"_{p}{i}": apart(c, down, i) for p, c in parts.items() for i in (reach if p != "q" else ())} | {"_q": F.sum(parts["q"]).over(down.rangeBetween(-half, half))})
    both = first.withColumns({f"_{p}{i}_{j}": apart(F.col(f"_{p}{i}"), along, j) for p in "sn" for i in reach for j in reach} | {"q": F.sum("_q").over(along.rangeBetween(-half, half))})
    total = lambda p, w: sum((w(i, j) * F.col(f"_{p}{i}_{j}") for i in reach for j in reach), F.lit(0.0))
    summed = both.withColumns({"n": total("n", lambda i, j: F.lit(1.0)), "s": total("s", lambda i, j: F.lit(1.0))})
    _, _, m, var = _moments()
    alpha = summed.withColumn("_alpha", F.when(m > 0, damping * var / F.when(m > 0, m * m)).otherwise(0.0))
    weight = lambda i, j: F.exp(-F.col("_alpha") * math.hypot(i, j))
    return alpha.withColumn("out", _centred(total("s", weight) / F.when(F.col("n") > 0, total("n", weight)))).select(*pixels.columns, "out")


def smooth(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """3 x 3 mean of valid values; a pixel without any keeps its own. Fills holes."""
    return local_sums(pixels, 1, keys).withColumn("out", F.coalesce(F.when(F.col("n") > 0, F.col("s") / F.col("n")), F.col("v"))).drop("n", "s", "q")


def local_contrast(pixels: DataFrame, keys: list[str], kernel: int = 16, strength: float = 0.3) -> DataFrame:
    """Adds byte: log tone after scaling by the ratio of the scene's mean to the local one; kernel 16 reaches 8 pixels."""
    local = local_sums(pixels, kernel // 2, keys)
    whole = pixels.where("v is not null").groupBy(*keys).agg(F.avg("v").alias("g"))
    scaled = F.col("v") * (1 + strength * (F.col("g") / F.coalesce(F.col("s") / F.col("n"), F.col("g")) - 1))
    byte = F.greatest(F.lit(0), F.least(F.lit(255), half_up(F.log(scaled + 1) / F.log(F.col("g") * 5 + 1) * 255)))
    return local.join(whole, keys).withColumn("byte", F.when(F.col("v").isNotNull(), byte).otherwise(0).cast("int")).drop("n", "s", "q", "g")


def lanczos_weights(source: int, target: int) -> list[tuple[int, int, float]]:
    """(target index, source index, weight) of a Lanczos-3 reduction along one axis."""
    scale = source / target
    kernel = lambda x: 1.0 if x == 0 else 0.0 if abs(x) >= 3 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2
    found = []
    for t in range(target):
        centre, reach = (t + 0.5) * scale - 0.5, math.ceil(3 * scale)
        found += [(t, s, kernel((s - centre) / scale)) for s in range(max(0, math.floor(centre - reach)), min(source - 1, math.ceil(centre + reach)) + 1)]
    return found


def lanczos(pixels: DataFrame, keys: list[str], size: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Lanczos-3 reduction (rows, columns), first along rows, weights over valid values; 0 where there are none."""
    spark = pixels.sparkSession
    out = pixels
    for axis, other, n, m in (("col", "row", size[1], target[1]), ("row", "col", size[0], target[0])):
        weights = F.broadcast(spark.createDataFrame(lanczos_weights(n, m), "t int, s int, w double"))  # a row a weight: set by the sizes
        met = out.where(F.col("v") > 0).join(weights, F.col(axis) == F.col("s"))
        total = F.sum("w")
        out = met.groupBy(*keys, F.col("t").alias(axis), other).agg(F.when(total > 0, F.greatest(F.lit(0.0), F.sum(F.col("w") * F.col("v")) / F.when(total > 0, total))).otherwise(0.0).alias("v"))
    return out.select(*keys, "row", "col", "v")
