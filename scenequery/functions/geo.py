"""Geodesy as column expressions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84, fixed values.
A, FLATTENING = 6378137.0, 1 / 298.257223563
B, E2 = A * (1 - FLATTENING), FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)


def slippy_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = 1 << zoom
    r = F.radians(lat)
    return F.floor((lon + 180) / 360 * n).cast("int"), F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n).cast("int")


def to_ecef(lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return (n + height) * F.cos(p) * F.cos(q), (n + height) * F.cos(p) * F.sin(q), (n * (1 - E2) + height) * F.sin(p)


def from_ecef(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude, height by Bowring's closed form."""
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * A, p * B)
    lat = F.atan2(z + EP2 * B * F.pow(F.sin(theta), F.lit(3.0)), p - E2 * A * F.pow(F.cos(theta), F.lit(3.0)))
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), p / F.cos(lat) - n


@dataclass(frozen=True)
class Frame:
    """An image plane: its centre (earth-centred columns), unit vectors of rows and columns, metres a row and a column, the centre's
    pixel in the full image, and the first row and column of the part at hand."""

    centre: tuple[Column, Column, Column]
    rows: tuple[float, float, float]
    cols: tuple[float, float, float]
    row_size: float
    col_size: float
    centre_row: float
    centre_col: float
    first_row: float = 0
    first_col: float = 0

    def to_image(self, lat: Column, lon: Column, height: Column) -> tuple[Column, Column]:
        """(row, column) of a ground point: its distance from the centre along both vectors."""
        away = [a - c for a, c in zip(to_ecef(lat, lon, height), self.centre, strict=True)]
        along = lambda u: sum((d * w for d, w in zip(away, u, strict=True)), F.lit(0.0))
        return along(self.rows) / self.row_size + (self.centre_row - self.first_row), along(self.cols) / self.col_size + (self.centre_col - self.first_col)

    def to_ground(self, row: Column, col: Column) -> tuple[Column, Column, Column]:
        """Latitude, longitude and height of a pixel: the point of the plane, as geodetic coordinates."""
        dr, dc = (row - (self.centre_row - self.first_row)) * self.row_size, (col - (self.centre_col - self.first_col)) * self.col_size
        return from_ecef(*(c + dr * u + dc * v for c, u, v in zip(self.centre, self.rows, self.cols, strict=True)))

    def box(self, height: int, width: int) -> tuple[Column, Column, Column, Column]:
        """West, south, east and north of an image of so many rows and columns, by its four corner pixels."""
        corners = [self.to_ground(F.lit(r), F.lit(c)) for r in (0, height - 1) for c in (0, width - 1)]
        lat, lon = [c[0] for c in corners], [c[1] for c in corners]
        return F.least(*lon), F.least(*lat), F.greatest(*lon), F.greatest(*lat)


def utm_forward(lon: Column, lat: Column, zone: int | Column) -> tuple[Column, Column]:
    """Easting and northing (north of the equator) by the standard series of the transverse Mercator projection."""
    p, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    t, c, a = F.tan(p) * F.tan(p), EP2 * F.cos(p) * F.cos(p), lam * F.cos(p)
    e4, e6 = E2 * E2, E2**3
    m = A * ((1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * p - (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * p) + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * p) - 35 * e6 / 3072 * F.sin(6 * p))
    power = lambda x, k: F.pow(x, F.lit(float(k)))
    east = 0.9996 * n * (a + (1 - t + c) * power(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * power(a, 5) / 120) + 500000
    north = 0.9996 * (m + n * F.tan(p) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * power(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * power(a, 6) / 720))
    return east, north


def pixel_range(low: Column, high: Column, start: float, end: float, n: int) -> tuple[Column, Column]:
    """First and last index, held to the axis, of the pixels between two coordinates of a linear axis."""
    f = lambda x: (x - start) / (end - start) * n
    first, last = F.floor(F.least(f(low), f(high))), F.ceil(F.greatest(f(low), f(high))) - 1
    held = lambda x: F.least(F.lit(n - 1), F.greatest(F.lit(0), x)).cast("int")
    return held(first), held(last)


#: A box wider than this many degrees is shown at the zoom of its place here; smaller ones at 11.
ZOOM_SPANS = (180, 90, 45, 20, 10, 5, 2, 1, 0.5, 0.2, 0.1)


def zoom_for(width: Column, height: Column) -> Column:
    """A map zoom for a box of so many degrees, by its larger side."""
    found = F.lit(len(ZOOM_SPANS))
    for zoom, span in reversed(list(enumerate(ZOOM_SPANS))):
        found = F.when(F.greatest(width, height) > span, zoom).otherwise(found)
    return found


def nice_step(span: Column, parts: float = 5) -> Column:
    """The 1-2-5 step nearest to a part of the span."""
    raw = span / parts
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    x = raw / base
    return base * F.when(x < 1.5, 1).when(x < 3.5, 2).when(x < 7.5, 5).otherwise(10)


_NUMBER = r"[-+]?\d+\.?\d*(?:[eE][-+]?\d+)?"


def parse_wkt(text: str) -> dict:
    """POINT, LINESTRING, POLYGON, their MULTI forms, and BBOX as a GeoJSON geometry; ValueError for anything else."""
    found = re.fullmatch(r"\s*(MULTI)?(POINT|LINESTRING|POLYGON|BBOX)\s*(\(.*\))\s*", text or "", re.I | re.S)
    if not found:
        raise ValueError("not a geometry")
    multi, kind, body = bool(found[1]), found[2].upper(), found[3]
    if kind == "BBOX":
        x0, y0, x1, y1 = map(float, re.findall(_NUMBER, body))
        return {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}

    def parts(s: str) -> list:
        s = s.strip()
        if not s.startswith("("):
            x = [float(n) for n in re.findall(_NUMBER, s)]
            if len(x) < 2 or not all(map(math.isfinite, x)):
                raise ValueError("a point needs two numbers")
            return x[:2]
        out, depth, start = [], 0, 1
        for i, c in enumerate(s):
            depth += (c == "(") - (c == ")")
            if (c == "," and depth == 1) or (c == ")" and depth == 0):
                out.append(parts(s[start:i]))
                start = i + 1
        if depth:
            raise ValueError("brackets do not match")
        return out

    coordinates = parts(body)
    if kind == "POINT":
        coordinates = [p[0] if isinstance(p[0], list) else p for p in coordinates] if multi else coordinates[0]
    return {"type": ("Multi" if multi else "") + {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon"}[kind], "coordinates": coordinates}


def wkt_box(wkt: Column) -> Column:
    """Kind (as GeoJSON names it) and bounds of a WKT geometry or BBOX(west, south, east, north); null for anything else."""
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    point = rf"\s*{number}\s+{number}\s*"
    ring = rf"\(\s*{point}(?:,{point})*\)\s*"
    rings = rf"\(\s*{ring}(?:,\s*{ring})*\)\s*"
    kinds = (
        ("Polygon", rf"BBOX\s*\(\s*{number}\s*(?:,\s*{number}\s*){{3}}\)"), ("Point", rf"POINT\s*\({point}\)"), ("LineString", rf"LINESTRING\s*{ring}"), ("Polygon", rf"POLYGON\s*{rings}"),
        ("MultiPoint", rf"MULTIPOINT\s*\((?:{point}|\s*\({point}\)\s*)(?:,(?:{point}|\s*\({point}\)\s*))*\)"), ("MultiLineString", rf"MULTILINESTRING\s*{rings}"), ("MultiPolygon", rf"MULTIPOLYGON\s*\(\s*{rings}(?:,\s*{rings})*\)"),
    )
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(kinds):
        kind = F.when(wkt.rlike(rf"(?i)^\s*{pattern}\s*$"), name).otherwise(kind)
    values = F.transform(F.regexp_extract_all(wkt, F.lit(f"({number})"), F.lit(1)), lambda x: x.cast("double"))
    along = lambda k: F.filter(values, lambda v, i: i % 2 == k)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.array_min(along(0)).alias("x0"), F.array_min(along(1)).alias("y0"), F.array_max(along(0)).alias("x1"), F.array_max(along(1)).alias("y1")))


def box_wkt(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box as a WKT polygon, closed, from its south-west corner."""
    pair = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", pair(x0, y0), pair(x1, y0), pair(x1, y1), pair(x0, y1), pair(x0, y0)), F.lit("))"))


def epsg_from_wkt(wkt: Column) -> Column:
    """The last EPSG code of a CRS text, in either notation."""
    codes = F.regexp_extract_all(wkt, F.lit(r'(?:AUTHORITY|ID)\["EPSG",\s*"?(\d+)'), F.lit(1))
    return F.when(F.size(codes) > 0, F.element_at(codes, -1).cast("int"))


def pixel_bounds(first: Column, count: Column, start: float, end: float, n: int) -> tuple[Column, Column]:
    """Edges, lower one first, of ``count`` pixels from ``first`` on of a linear axis from ``start`` to ``end``."""
    at = lambda k: start + k / float(n) * (end - start)
    return F.least(at(first), at(first + count)), F.greatest(at(first), at(first + count))


def utm_inverse(easting: Column, northing: Column, zone: int | Column, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of UTM coordinates (WGS84), by series; give it columns, not what they come from, since the series
    repeat them often."""
    e1 = (1 - (1 - E2) ** 0.5) / (1 + (1 - E2) ** 0.5)
    mu = (northing - (10_000_000.0 if south else 0.0)) / 0.9996 / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    s2 = F.sin(p) * F.sin(p)
    n, r = A / F.sqrt(1 - E2 * s2), A * (1 - E2) / F.pow(1 - E2 * s2, F.lit(1.5))
    t, c, d = F.pow(F.tan(p), F.lit(2)), EP2 * F.cos(p) * F.cos(p), (easting - 500_000.0) / (A / F.sqrt(1 - E2 * s2) * 0.9996)
    lat = p - n * F.tan(p) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) * F.pow(d, F.lit(4)) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) * F.pow(d, F.lit(6)) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, F.lit(3)) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) * F.pow(d, F.lit(5)) / 120) / F.cos(p)
    return F.degrees(lon) + (zone * 6 - 183), F.degrees(lat)


#: Polar stereographic systems by EPSG code: north or south, latitude of true scale, central meridian, false easting and northing.
POLAR = {3413: (1, 70.0, -45.0, 0.0), 3031: (-1, 71.0, 0.0, 0.0), 32661: (1, 90.0, 0.0, 2_000_000.0), 32761: (-1, 90.0, 0.0, 2_000_000.0)}


def _polar_radius(true_scale: float) -> float:
    """Radius by which the isometric term of a latitude is multiplied."""
    e = E2**0.5
    if true_scale == 90.0:
        return 2 * A / ((1 + e) ** (1 + e) * (1 - e) ** (1 - e)) ** 0.5
    s = math.sin(math.radians(true_scale))
    t = math.tan(math.pi / 4 - math.radians(true_scale) / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)
    return A * math.cos(math.radians(true_scale)) / (1 - E2 * s * s) ** 0.5 / t


def polar_forward(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """x and y of a polar stereographic system of ``POLAR`` (UPS where true scale is at the pole, with its factor 0.994)."""
    side, true_scale, meridian, false = POLAR[epsg]
    e, p, lam = E2**0.5, F.radians(lat * side), F.radians((lon - meridian) * side)
    t = F.tan(math.pi / 4 - p / 2) / F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))
    rho = t * _polar_radius(true_scale)
    return false + side * rho * F.sin(lam), false - side * rho * F.cos(lam)


def polar_inverse(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    side, true_scale, meridian, false = POLAR[epsg]
    u, v = (x - false) * side, (y - false) * side
    chi = math.pi / 2 - 2 * F.atan(F.sqrt(u * u + v * v) / _polar_radius(true_scale))
    p = chi + (E2 / 2 + 5 * E2**2 / 24 + E2**3 / 12 + 13 * E2**4 / 360) * F.sin(2 * chi) + (7 * E2**2 / 48 + 29 * E2**3 / 240 + 811 * E2**4 / 11520) * F.sin(4 * chi) + (7 * E2**3 / 120 + 81 * E2**4 / 1120) * F.sin(6 * chi) + (4279 * E2**4 / 161280) * F.sin(8 * chi)
    return F.pmod(F.degrees(F.atan2(u, -v)) * side + meridian + 180, F.lit(360.0)) - 180, F.degrees(p) * side


def envelope(box: tuple[Column, Column, Column, Column], to_degrees) -> tuple[Column, Column, Column, Column]:
    """Degrees that a projected box reaches: of its corners and the middles of its edges. ``to_degrees``: (x, y) -> (lon, lat)."""
    x0, y0, x1, y1 = box
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    points = [to_degrees(x, y) for x, y in ((x0, y0), (x0, y1), (x1, y0), (x1, y1), (mx, y0), (mx, y1), (x0, my), (x1, my))]
    return F.least(*(p[0] for p in points)), F.least(*(p[1] for p in points)), F.greatest(*(p[0] for p in points)), F.greatest(*(p[1] for p in points))
