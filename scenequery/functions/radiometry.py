"""Radiometric column expressions: nodata rules, decibels, stretches, indices and composites.

Every rule about nodata is explicit: NaN counts as missing, and ``NaN > 0`` is never relied on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def positive(v: Column) -> Column:
    """v where it is finite and above zero, else null."""
    return F.when(finite(v) & (v > 0), v)


def nonzero(v: Column) -> Column:
    """v where it is finite and not zero, else null; negative values stay."""
    return F.when(finite(v) & (v != 0), v)


def db(v: Column) -> Column:
    """10 log10 v; null where v is missing or not positive."""
    return 10 * F.log10(positive(v))


def db_clamped(v: Column, floor: float = 1e-10) -> Column:
    return 10 * F.log10(F.greatest(v, F.lit(floor)))


def half_up(x: Column) -> Column:
    """Rounding halves up, also below zero."""
    return F.floor(x + 0.5)


def normalise(v: Column, low: float, high: float) -> Column:
    """(v - low) over the range, held to [0, 1]; an empty range counts as 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / ((high - low) or 1.0)))


def stretch(t: Column, kind: str, gamma: float = 1.0) -> Column:
    """A tone curve on [0, 1]: linear, sqrt, cbrt, log, gamma or sigmoid."""
    if kind == "linear":
        return t
    if kind == "sqrt":
        return F.sqrt(t)
    if kind == "cbrt":
        return F.cbrt(t)
    if kind == "gamma":
        return F.pow(t, F.lit(gamma))
    if kind == "log":
        k = 10.0 ** (1 + gamma)
        return F.log(1 + k * t) / math.log(1 + k)
    if kind == "sigmoid":
        gain = 8.0 * gamma
        low, high = 1 / (1 + math.exp(gain / 2)), 1 / (1 + math.exp(-gain / 2))
        return (1 / (1 + F.exp(-gain * (t - 0.5))) - low) / (high - low)
    raise ValueError(f"unknown stretch {kind}")


def gamma_byte(t: Column, gamma: float) -> Column:
    """floor(t^gamma * 255 + 0.5) for t in [0, 1]. Where each byte begins is searched once, so bytes at a half do not depend on the last bit of
    the JVM's powers."""
    byte = lambda x: math.floor(x**gamma * 255 + 0.5)
    begins = [0.0]
    for k in range(1, 256):
        x = ((k - 0.5) / 255) ** (1 / gamma)
        while byte(x) >= k:
            x = math.nextafter(x, 0.0)
        while byte(x) < k:
            x = math.nextafter(x, 1.0)
        begins.append(x)
    at = lambda k: F.get(F.lit([*begins, math.inf]), k)
    near = half_up(F.pow(t, F.lit(gamma)) * 255).cast("int")
    return F.when(t >= at(near + 1), near + 1).when(t < at(near), near - 1).otherwise(near)


def rvi_quad(hh: Column, hv: Column, vv: Column) -> Column:
    """8 HV / (HH + VV + 2 HV), null without a positive denominator."""
    below = hh + vv + 2 * hv
    return F.when(finite(below) & (below > 0), 8 * hv / below)


def rvi_dual(co: Column, cross: Column) -> Column:
    """4 X / (co + X), null without a positive denominator."""
    below = co + cross
    return F.when(finite(below) & (below > 0), 4 * cross / below)


def freeman_durden(c11: Column, c22: Column, c33: Column, re: Column, im: Column) -> tuple[Column, Column, Column]:
    """Surface, double-bounce and volume power of a three-component decomposition; all zero without power."""
    span, fv = c11 + 2 * c22 + c33, 4 * c22
    a, b = c11 - fv / 2, c33 - fv / 2
    cr = re - c22
    q, det = cr * cr + im * im, a * b
    usable = (a > 0) & (b > 0)
    surface = F.when(cr >= 0, b).otherwise(F.when(det > q, b - q / a).otherwise(0.0))
    double = F.when(cr >= 0, F.when(det > q, a - q / b).otherwise(0.0)).otherwise(a)
    none = span <= 1e-20
    ps = F.when(none | ~usable, 0.0).otherwise(F.greatest(surface, F.lit(0.0)))
    pd = F.when(none | ~usable, 0.0).otherwise(F.greatest(double, F.lit(0.0)))
    pv = F.when(none, 0.0).otherwise(F.when(usable, F.greatest(span - ps - pd, F.lit(0.0))).otherwise(span))
    return ps, pd, pv


def dual_pol_composite(co: Column, cross: Column) -> tuple[Column, Column, Column]:
    """Red, green, blue: co, cross and their ratio."""
    return co, cross, co / F.greatest(cross, F.lit(1e-10))


def pauli_power(hh: Column, hv: Column, vv: Column) -> tuple[Column, Column, Column]:
    """Red, green, blue from powers alone: the difference and the sum of the like bands around the cross band."""
    return F.abs(hh - vv), hv, hh + vv


def channel_byte(v: Column, low: float, high: float, use_db: bool = True, kind: str = "linear", gamma: float = 1.0) -> Column:
    """A display byte: dB, range, stretch; 0 where the value is missing or zero."""
    valid = nonzero(v).isNotNull()
    scaled = normalise(db_clamped(v) if use_db else v, low, high)
    byte = gamma_byte(scaled, gamma) if kind == "gamma" else half_up(stretch(scaled, kind, gamma) * 255)
    return F.when(valid, byte).otherwise(0).cast("int")


def saturate(r: Column, g: Column, b: Column, amount: float) -> tuple[Column, Column, Column]:
    """Saturation around luma."""
    luma = 0.299 * r + 0.587 * g + 0.114 * b
    return tuple(F.least(F.lit(1.0), F.greatest(F.lit(0.0), luma + amount * (c - luma))) for c in (r, g, b))


def entropy3(l1: Column, l2: Column, l3: Column) -> Column:
    """Entropy, base 3, of three eigenvalues, within [0, 1]; 0 without power."""
    total = l1 + l2 + l3
    part = lambda x: F.when((total > 0) & (x > 0), -(x / total) * F.log(x / total) / math.log(3)).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), part(l1) + part(l2) + part(l3)))


def anisotropy(l2: Column, l3: Column) -> Column:
    return F.when(l2 + l3 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (l2 - l3) / (l2 + l3)))).otherwise(0.0)


def phase(re: Column, im: Column) -> Column:
    """Angle of a complex value; the signs of zeros count, which Spark's atan2 drops."""
    below = lambda x: (x < 0) | ((x == 0) & x.cast("string").startswith("-"))
    flat = F.when(below(re), F.when(below(im), -math.pi).otherwise(math.pi)).otherwise(im)
    return F.when((im == 0) & re.isNotNull() & ~F.isnan(re), flat).otherwise(F.atan2(im, re))


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def los_displacement(phase_value: Column, wavelength: float) -> Column:
    """Line-of-sight displacement of an unwrapped phase."""
    return phase_value * wavelength / (4 * math.pi)
