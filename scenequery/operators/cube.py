"""Metadata cubes and phase corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MOST_CELLS = 200_000  # of a cube whose cells are broadcast; larger ones are shuffled


def _cells(spark: SparkSession, grid: list[list[list[float | None]]]) -> DataFrame:
    """The cells between the nodes of a cube [height][row][column], each with its corners; corners beyond the last node are null."""
    nk, nj, ni = len(grid), len(grid[0]), len(grid[0][0])
    node = lambda k, j, i: grid[k][j][i] if k < nk and j < nj and i < ni else None
    value = lambda k, j, i: None if (v := node(k, j, i)) is None else float(v)
    steps = [(dk, dj, di) for dk in (0, 1) for dj in (0, 1) for di in (0, 1)]
    rows = [(k, j, i, *(value(k + dk, j + dj, i + di) for dk, dj, di in steps)) for k in range(max(1, nk - 1)) for j in range(max(1, nj - 1)) for i in range(max(1, ni - 1))]
    cells = spark.createDataFrame(rows, "_k int, _j int, _i int, " + ", ".join(f"_c{dk}{dj}{di} double" for dk, dj, di in steps))
    return F.broadcast(cells) if len(rows) <= MOST_CELLS else cells


def interpolated(rows: DataFrame, grid: list[list[list[float | None]]], fi: Column, fj: Column, fk: Column, name: str) -> DataFrame:
    """Adds the value of a small cube [height][row][column] at index coordinates.

    Each of the two layers next to the height is bilinear, nodes without a value losing their weight in it; then layers mix by
    height, or the one that has a value stands for both. Null beyond half a cell outside, or without coordinates; heights are
    held to the cube. Rows meet the cell that they lie in, whose corners then are eight columns.
    """
    nk, nj, ni = len(grid), len(grid[0]), len(grid[0][0])
    base = lambda f, n: F.greatest(F.lit(0), F.least(F.lit(max(0, n - 2)), F.floor(f))).cast("int")
    held = F.least(F.lit(float(nk - 1)), F.greatest(F.lit(0.0), fk))
    placed = rows.withColumns({"_fi": fi.cast("double"), "_fj": fj.cast("double"), "_fk": F.when(fk.isNotNull(), held)})
    placed = placed.withColumns({"_i": base(F.col("_fi"), ni), "_j": base(F.col("_fj"), nj), "_k": base(F.col("_fk"), nk)})
    met = placed.join(_cells(rows.sparkSession, grid), ["_k", "_j", "_i"], "left")
    part = lambda f, at: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(f) - F.col(at)))
    met = met.withColumns({"_wi": part("_fi", "_i"), "_wj": part("_fj", "_j"), "_wk": part("_fk", "_k")})

    def layer(dk: int) -> Column:
        total, weight = F.lit(0.0), F.lit(0.0)
        for dj in (0, 1):
            for di in (0, 1):
                node = F.col(f"_c{dk}{dj}{di}")
                w = (F.col("_wj") if dj else 1 - F.col("_wj")) * (F.col("_wi") if di else 1 - F.col("_wi"))
                total = total + F.when(node.isNotNull(), w * node).otherwise(0.0)
                weight = weight + F.when(node.isNotNull(), w).otherwise(0.0)
        return total / F.when(weight > 0, weight)

    met = met.withColumns({"_low": layer(0), "_high": layer(1)})
    mixed = F.when(F.col("_wk") == 0, F.col("_low")).when(F.col("_wk") == 1, F.col("_high")).otherwise(F.coalesce(F.col("_low") * (1 - F.col("_wk")) + F.col("_high") * F.col("_wk"), "_low", "_high"))
    inside = (F.col("_fi") >= -0.5) & (F.col("_fi") <= ni - 0.5) & (F.col("_fj") >= -0.5) & (F.col("_fj") <= nj - 0.5) & F.col("_fk").isNotNull()
    return met.withColumn(name, F.when(inside, mixed)).select(*(c for c in rows.columns if c != name), name)


def resampled(rows: DataFrame, grid: list[list[float | None]], row: Column, col: Column, height: int, width: int, name: str) -> DataFrame:
    """Adds a small grid's value at a pixel of a larger one whose corners are the same, bilinear; missing nodes lose their weight, and 0
    stands where all are missing, so that layers can be added up."""
    scale = lambda n, m: (n - 1) / ((m - 1) or 1)
    found = interpolated(rows, [grid], col * scale(len(grid[0]), width), row * scale(len(grid), height), F.lit(0.0), name)
    return found.withColumn(name, F.coalesce(name, F.lit(0.0)))


def plane_fit(points: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """a, b, c of p = a x + b y + c by least squares over all points of a group; zeros with too few or on one line."""
    x, y, p = F.col("x"), F.col("y"), F.col("p")
    sums = points.groupBy(*keys).agg(*(F.sum(e).alias(n) for e, n in ((x * x, "sxx"), (x * y, "sxy"), (x, "sx"), (y * y, "syy"), (y, "sy"), (x * p, "sxp"), (y * p, "syp"), (p, "sp"))), F.count("*").alias("n_pixels"))
    xx, xy, sx, yy, sy, xp, yp, sp, n = (F.col(c) for c in ("sxx", "sxy", "sx", "syy", "sy", "sxp", "syp", "sp", "n_pixels"))
    three = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    det = three(xx, xy, sx, xy, yy, sy, sx, sy, n)
    fits = (n >= least) & (F.abs(det) >= 1e-20)
    solve = lambda num: F.when(fits, num / F.when(fits, det)).otherwise(0.0)
    return sums.select(*keys, solve(three(xp, xy, sx, yp, yy, sy, sp, sy, n)).alias("a"), solve(three(xx, xp, sx, xy, yp, sy, sx, sp, n)).alias("b"), solve(three(xx, xy, xp, xy, yy, yp, sx, sy, sp)).alias("c"), F.when(fits, n).otherwise(0).alias("n_pixels"))
