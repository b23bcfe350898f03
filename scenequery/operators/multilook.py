"""Block averages of pixels: power, phase, complex values, display pyramids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block(n: int, row: str = "row", col: str = "col") -> list[Column]:
    return [F.floor(F.col(row) / n).cast("int").alias("row"), F.floor(F.col(col) / n).cast("int").alias("col")]


def multilook(pixels: DataFrame, n: int, values: list[str], keys: list[str], keep_edge: bool = True, height: int | None = None, width: int | None = None) -> DataFrame:
    """Mean of the valid values of each n x n block; null where there is none.

    A ragged edge is kept, or dropped where ``keep_edge`` is false (``height`` and ``width`` are then needed).
    """
    rows = pixels
    if not keep_edge:
        rows = rows.where((F.col("row") < height // n * n) & (F.col("col") < width // n * n))
    return rows.groupBy(*keys, *block(n)).agg(*(F.avg(v).alias(v) for v in values), F.count(values[0]).alias("looks"))


def multilook_phase(pixels: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Phase of the mean of re and im."""
    return pixels.groupBy(*keys, *block(n)).agg(F.avg("re").alias("re"), F.avg("im").alias("im")).select(*keys, "row", "col", F.atan2("im", "re").alias("phase"))


def pyramid_bytes(pixels: DataFrame, n: int, low: float, high: float, keys: list[str], value: str = "byte") -> DataFrame:
    """Overview of display bytes that stand for dB: averaged as power, not as dB."""
    power = F.pow(F.lit(10.0), (F.col(value) / 255.0 * (high - low) + low) / 10)
    mean = 10 * F.log10(F.avg(power))
    byte = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (mean - low) / (high - low))) * 255 + 0.5)
    return pixels.groupBy(*keys, *block(n)).agg(byte.cast("int").alias(value))
