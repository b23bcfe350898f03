"""Numbers in binary columns, of either byte order, as expressions: whole numbers, half and single floats, complex power."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of each kind of sample.
WIDTHS = {"uint8": 1, "int8": 1, "uint16": 2, "int16": 2, "uint32": 4, "int32": 4, "float16": 2, "float32": 4}
#: Bits of exponent and fraction of floats.
FLOATS = {"float16": (5, 10), "float32": (8, 23)}


def unsigned(data: Column, at: Column, width: int, big: bool) -> Column:
    """The ``width`` bytes from byte ``at`` (from 0) as a whole number."""
    hexed = F.hex(F.substring(data, at + 1, F.lit(width)))
    if not big and width > 1:
        hexed = F.concat(*(F.substring(hexed, 2 * k + 1, 2) for k in range(width - 1, -1, -1)))
    return F.conv(hexed, 16, 10).cast("long")


def floating(bits: Column, exponent: int, fraction: int) -> Column:
    """The number that the bits of a float stand for: subnormals, infinities and NaN too; the zero below zero is a zero, and NaN has no sign."""
    top, bias = (1 << exponent) - 1, (1 << (exponent - 1)) - 1
    negative = F.shiftright(bits, exponent + fraction).bitwiseAND(F.lit(1)) == 1
    e, f = F.shiftright(bits, fraction).bitwiseAND(F.lit(top)), bits.bitwiseAND(F.lit((1 << fraction) - 1))
    part = f / F.lit(float(1 << fraction))
    size = F.when(e == 0, part * 2.0 ** (1 - bias)).when(e == top, F.lit(float("inf"))).otherwise(F.pow(F.lit(2.0), e - bias) * (1 + part))
    return F.when((e == top) & (f != 0), F.lit(float("nan"))).when(negative & (f + e != 0), -size).otherwise(size)


def sample(data: Column, at: Column, kind: str, big: bool = False) -> Column:
    """One sample, a double, from byte ``at``."""
    width = WIDTHS[kind]
    bits = unsigned(data, at, width, big)
    if kind in FLOATS:
        return floating(bits, *FLOATS[kind])
    return (F.when(bits >= 1 << (8 * width - 1), bits - (1 << 8 * width)).otherwise(bits) if kind.startswith("int") else bits).cast("double")


def decoded(data: Column, kind: str, big: bool = False, stride: int | None = None, start: int = 0) -> Column:
    """All samples of a binary value; bytes at the end that make no whole sample are left out.

    ``stride`` bytes lie from one sample to the next, the first one starts at byte ``start``."""
    step = stride or WIDTHS[kind]
    n = F.floor((F.octet_length(data) - start - WIDTHS[kind] + step) / F.lit(step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: sample(data, i * step + start, kind, big))).when(data.isNotNull(), F.array().cast("array<double>"))


def power(data: Column, layout: str, scale: float | Column = 1.0) -> Column:
    """Power of interleaved pixels, big-endian: ``int16`` or ``float32`` pairs (scale times I^2 + Q^2), ``amp8`` (amplitude and a phase
    that does not count, each a byte: scale times its square)."""
    if layout == "amp8":
        return F.transform(decoded(data, "uint8", True, 2), lambda a: scale * a * a)
    width = WIDTHS[layout]
    # a pair must be whole: its second half says how many there are
    i, q = decoded(data, layout, True, 2 * width), decoded(data, layout, True, 2 * width, width)
    return F.zip_with(F.slice(i, F.lit(1), F.greatest(F.size(q), F.lit(0))), q, lambda a, b: scale * (a * a + b * b))
