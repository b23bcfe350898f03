"""The TIFF layout: directories at the front, then tiles, so that a file is written in one go and read by ranges.

Only directories are handled here, a few hundred bytes a file; tiles stay rows of bytes in Spark.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Tags of the format, in ascending order.
SUBFILE, WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR = 254, 256, 257, 258, 259, 262, 277, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, EXTRA, FORMAT, SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA = 322, 323, 324, 325, 338, 339, 33550, 33922, 34264, 34735, 42113
#: Codes and sizes of its number types, and their struct letters.
SHORT, LONG, DOUBLE, ASCII = 3, 4, 12, 2
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8}
LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
#: Keys of the geographic directory.
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072
MOST_BYTES = 4_000_000_000


@dataclass
class Level:
    """One image of a file: level 0 or an overview."""

    width: int
    height: int
    tile_width: int
    tile_height: int
    samples: int
    bits: int
    sample_format: int
    compression: int
    predictor: int
    offsets: list[int]
    counts: list[int]
    tags: dict[int, list | bytes] = field(default_factory=dict)

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)


def tiles_of(size: int, tile: int) -> int:
    return -(-size // tile)


def head(levels: list[dict], tile: int, samples: int, rgba: bool, bounds: tuple[float, float, float, float], epsg: int) -> bytes:
    """Everything before the tiles: header and a directory for each level (width, height, counts: bytes of its tiles in order)."""
    x0, _, _, y1 = bounds
    directories: list[list[tuple[int, int, list | bytes]]] = []
    for k, level in enumerate(levels):
        geographic = 4000 <= epsg < 5000
        across, down = ((bounds[i + 2] - bounds[i]) / level[s] for i, s in ((0, "width"), (1, "height")))
        keys = [1, 1, 0, 3, MODEL_TYPE, 0, 1, 2 if geographic else 1, RASTER_TYPE, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, epsg]
        entries = [(WIDTH, LONG, [level["width"]]), (LENGTH, LONG, [level["height"]]), (BITS, SHORT, [8 if rgba else 32] * samples), (COMPRESSION, SHORT, [8]), (PHOTOMETRIC, SHORT, [2 if rgba else 1]), (SAMPLES, SHORT, [samples]), (PLANAR, SHORT, [1])]
        entries += [(TILE_WIDTH, LONG, [tile]), (TILE_LENGTH, LONG, [tile]), (TILE_OFFSETS, LONG, [0] * len(level["counts"])), (TILE_COUNTS, LONG, level["counts"]), (FORMAT, SHORT, [1 if rgba else 3] * samples)]
        entries += [(SCALE, DOUBLE, [across, down, 0.0]), (TIEPOINT, DOUBLE, [0.0, 0.0, 0.0, x0, y1, 0.0]), (GEO_KEYS, SHORT, keys)]
        if rgba:
            entries += [(SUBFILE, LONG, [int(k > 0)]), (PREDICTOR, SHORT, [2]), (EXTRA, SHORT, [1])]
        else:
            entries += [(NODATA, ASCII, b"nan\0")] + [(EXTRA, SHORT, [0] * (samples - 1))] * (samples > 1)
        directories.append(sorted(entries, key=lambda e: e[0]))
    size_of = lambda kind, values: SIZES[kind] * len(values)
    even = lambda n: n + n % 2
    beyond = lambda entries: sum(even(size_of(kind, v)) for _, kind, v in entries if size_of(kind, v) > 4)
    starts, at = [], 8
    for entries in directories:
        starts.append(at)
        at += 6 + 12 * len(entries) + beyond(entries)
    tile_at, out = at, bytearray(struct.pack("<2sHI", b"II", 42, starts[0]))
    for k, entries in enumerate(directories):
        places = []
        for count in levels[k]["counts"]:
            places.append(tile_at)
            tile_at += count
        spill, spill_at = bytearray(), starts[k] + 6 + 12 * len(entries)
        out += struct.pack("<H", len(entries))
        for tag, kind, values in entries:
            values = places if tag == TILE_OFFSETS else values
            packed = bytes(values) if kind == ASCII else struct.pack(f"<{len(values)}{LETTERS[kind]}", *values)
            if len(packed) > 4:
                out += struct.pack("<HHII", tag, kind, len(values), spill_at + len(spill))
                spill += packed.ljust(even(len(packed)), b"\0")
            else:
                out += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        out += struct.pack("<I", starts[k + 1] if k + 1 < len(starts) else 0) + spill
    if tile_at > MOST_BYTES:
        raise ValueError(f"a file of {tile_at / 1e9:.1f} GB is beyond the 4 GB of the format: take more looks or a smaller area")
    return bytes(out)


def read_levels(read: Callable[[int, int], bytes]) -> list[Level]:
    """All images of a file; ``read(offset, size)`` gives its bytes. Only tiled images can be told apart; others are an error."""
    end = {b"II": "<", b"MM": ">"}.get(read(0, 2))
    if end is None or struct.unpack(f"{end}H", read(2, 2))[0] != 42:
        raise ValueError("not a TIFF file")
    (at,), levels = struct.unpack(f"{end}I", read(4, 4)), []
    while at:
        (n,) = struct.unpack(f"{end}H", read(at, 2))
        block, tags = read(at + 2, 12 * n + 4), {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{end}HHI", block, 12 * k)
            size = SIZES.get(kind, 1) * count
            data = block[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else read(struct.unpack_from(f"{end}I", block, 12 * k + 8)[0], size)
            tags[tag] = bytes(data) if kind not in LETTERS else list(struct.unpack(f"{end}{count}{LETTERS[kind]}", data))
        (at,) = struct.unpack_from(f"{end}I", block, 12 * n)
        if TILE_OFFSETS not in tags:
            raise ValueError("not a tiled TIFF file")
        one = lambda tag, default=1: tags.get(tag, [default])[0]  # noqa: E731, B023
        levels.append(Level(one(WIDTH), one(LENGTH), one(TILE_WIDTH), one(TILE_LENGTH), one(SAMPLES), one(BITS), one(FORMAT), one(COMPRESSION), one(PREDICTOR), tags[TILE_OFFSETS], tags[TILE_COUNTS], tags))
    return levels


def encode_tile(grid: np.ndarray, level: int = 1) -> bytes:
    """A tile's samples (rows, columns, samples): floats as they are, bytes as differences to the sample on the left."""
    if grid.dtype == np.uint8:
        grid = np.concatenate([grid[:, :1], np.diff(grid, axis=1)], axis=1)
    return zlib.compress(np.ascontiguousarray(grid).tobytes(), level)


def decode_tile(data: bytes, level: Level) -> np.ndarray:
    """Samples of a tile as (rows, columns, samples)."""
    kinds = {(8, 1): "<u1", (16, 1): "<u2", (32, 1): "<u4", (32, 3): "<f4", (64, 3): "<f8", (16, 2): "<i2", (32, 2): "<i4"}
    if level.compression not in (1, 8, 32946) or (level.bits, level.sample_format) not in kinds:
        raise ValueError(f"compression {level.compression} or samples of {level.bits} bits are not read")
    raw = data if level.compression == 1 else zlib.decompress(data)
    grid = np.frombuffer(raw, kinds[level.bits, level.sample_format]).reshape(level.tile_height, level.tile_width, level.samples)
    return np.cumsum(grid, axis=1, dtype=grid.dtype) if level.predictor == 2 else grid


def place(level: Level) -> dict:
    """bounds and crs of an image: by its transformation, else tie point and pixel size; EPSG:4326 where no key names another."""
    tags, keys = level.tags, level.tags.get(GEO_KEYS, [])
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    crs = f"EPSG:{codes.get(PROJECTED) or codes.get(GEOGRAPHIC) or 4326}"
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        x, y = (m[3], m[3] + m[0] * level.width), (m[7], m[7] + m[5] * level.height)
    elif SCALE in tags and TIEPOINT in tags:
        t, s = tags[TIEPOINT], tags[SCALE]
        left, top = t[3] - t[0] * s[0], t[4] + t[1] * s[1]
        x, y = (left, left + s[0] * level.width), (top - s[1] * level.height, top)
    else:
        return {"bounds": None, "crs": crs}
    return {"bounds": [min(x), min(y), max(x), max(y)], "crs": crs}
