"""Display helpers: look-up tables, channel matrices, alpha masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .radiometry import half_up


def lut_table(spark: SparkSession, channels: dict[str, Callable[[Column], Column]], reverse: bool = False) -> DataFrame:
    """256 rows (idx and a byte for each channel) of a colour map given as curves on [0, 1]."""
    t = F.col("id") / 255.0
    t = 1 - t if reverse else t
    return spark.range(256).select(F.col("id").cast("int").alias("idx"), *(half_up(curve(t) * 255).cast("int").alias(c) for c, curve in channels.items()))


def mix_channels(channels: list[Column], matrix: list[list[float]]) -> list[Column]:
    """Channels through a matrix, held to [0, 1]."""
    rows = [sum((w * c for w, c in zip(weights[1:], channels[1:], strict=True)), weights[0] * channels[0]) for weights in matrix]
    return [F.least(F.lit(1.0), F.greatest(F.lit(0.0), r)) for r in rows]


def alpha(mask: Column, coherence: Column, least: float, most: float | None = None, hide_layover: bool = True) -> Column:
    """0 where the mask says invalid (or layover) or coherence is missing or out of range, else 255."""
    hidden = (mask < 0.5) | (mask > 254.5)
    if hide_layover:
        hidden = hidden | ((mask > 1.5) & (mask < 254.5))
    hidden = hidden | coherence.isNull() | (coherence < least)
    if most is not None:
        hidden = hidden | (coherence > most)
    return F.when(hidden, 0).otherwise(255)
