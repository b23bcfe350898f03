"""Texts of maps: coordinates, extents, scale bars. Halves are rounded away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo


def fixed(value: Column, places: int) -> Column:
    """A number with so many decimals."""
    return F.format_string(f"%.{places}f", F.round(value.cast("decimal(38,12)"), places).cast("double"))


def grouped(value: Column) -> Column:
    """A whole number in groups of three, with thin spaces; a true minus before it."""
    digits = F.floor(F.abs(value) + 0.5).cast("long").cast("string")
    return F.concat(F.when(value < 0, "−").otherwise(""), F.regexp_replace(digits, r"(?<=\d)(?=(\d{3})+$)", " "))


def coordinate(value: Column, projected: Column, axis: str) -> Column:
    """A coordinate for display: grouped with E or N where it is projected, else degrees with a direction. ``axis``: x or y."""
    east, west = ("E", "W") if axis == "x" else ("N", "S")
    degrees = F.concat(fixed(F.abs(value), 2), F.lit("°"), F.when(value >= 0, east).otherwise(west))
    return F.when(projected, F.concat(grouped(value), F.lit(f" {east}"))).otherwise(degrees)


def extent(width: Column, height: Column, projected: Column) -> Column:
    """The size of an area: km from a kilometre on, metres below, or degrees."""
    times = F.lit(" × ")
    metres = F.when((width >= 1000) | (height >= 1000), F.concat(fixed(width / 1000, 1), times, fixed(height / 1000, 1), F.lit(" km"))).otherwise(F.concat(fixed(width, 0), times, fixed(height, 0), F.lit(" m")))
    return F.when(projected, metres).otherwise(F.concat(fixed(width, 2), F.lit("°"), times, fixed(height, 2), F.lit("°")))


def scale_bar(pixels_per_unit: Column, target: int = 150) -> tuple[Column, Column, Column]:
    """Metres, pixels and label of a bar of a round length, some ``target`` pixels long."""
    span = F.lit(float(target)) / pixels_per_unit
    metres = F.when(span > 0, geo.nice_step(span, 1.5)).otherwise(1.0)
    label = (
        F.when(metres >= 10000, F.concat(fixed(metres / 1000, 0), F.lit(" km"))).when(metres >= 1000, F.concat(fixed(metres / 1000, 1), F.lit(" km")))
        .when(metres >= 10, F.concat(fixed(metres, 0), F.lit(" m"))).when(metres >= 1, F.concat(fixed(metres, 1), F.lit(" m"))).otherwise(F.concat(fixed(metres, 2), F.lit(" m")))
    )
    return metres, metres * pixels_per_unit, label
