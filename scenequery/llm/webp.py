"""Lossless WebP columns: decode files to pixel arrays, and keep bytes as grayscale pictures.

The decoder reads the whole lossless format: prefix codes, back-references, colour cache, groups of codes chosen by an
entropy image, and the predictor, cross-colour, subtract-green and palette transforms. Pictures that vary in one channel
only are read many bits at a time: what a token at each bit would be, then which bits tokens start at.

Payloads are written as pictures of 192 columns with equal red, green and blue, at most 16,384 rows each; longer payloads
become several files, one after another. The writer uses what pays for such bytes: prefix codes of their frequencies,
back-references to repeated passages, and a palette where there are at most 16 levels. Predictors, cross-colour, the
colour cache and several groups of codes do not pay there, so op2 does not meet them; the decoder's tests do.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNIT = 192
MOST_ROWS = 16_384
WINDOW = 1 << 17  # bits looked at together
LEAST_COPY, MOST_COPY = 12, 4096
FARTHEST = (1 << 20) - 120  # fixed by the format, as is the most that one reference copies

#: The order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)

#: The neighbours (columns to the left, rows up) that distance codes 1 to 120 stand for.
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)

#: Multiplier of the colour cache's hash, fixed by the format.
CACHE_HASH = 0x1E35A7BD


class Bits:
    """Reads bits from the lowest of each byte up."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise ValueError("truncated")
        value = int.from_bytes(self.data[first:last], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return value


class Code:
    """A canonical prefix code from the lengths of its symbols."""

    def __init__(self, lengths: list[int], used: list[int] | None = None):
        used = [s for s, n in enumerate(lengths) if n] if used is None else used
        self.only = used[0] if len(used) == 1 else None
        self.symbols = used
        self.lengths = lengths
        self.table: dict[tuple[int, int], int] | None = None

    def codes(self) -> Iterator[tuple[int, int, int]]:
        """(symbol, length, code), shortest first."""
        code, before = 0, 0
        for n, s in sorted((self.lengths[s], s) for s in self.symbols):
            code <<= n - before
            before = n
            yield s, n, code
            code += 1

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self.table = {(n, code): s for s, n, code in self.codes()}
        code = 0
        for n in range(1, 16):
            code = code << 1 | bits.read(1)
            if (s := self.table.get((n, code))) is not None:
                return s
        raise ValueError("no such code")

    def by_next_bits(self, n_bits: int) -> list[tuple[int, int] | None]:
        """(symbol, bits it takes) for every value of the next ``n_bits`` bits."""
        if self.only is not None:
            return [(self.only, 0)] * (1 << n_bits)
        table: list[tuple[int, int] | None] = [None] * (1 << n_bits)
        for s, n, code in self.codes():
            first = int(f"{code:0{n}b}"[::-1], 2)
            table[first :: 1 << n] = [(s, n)] * (1 << (n_bits - n))
        return table


    def lookup(self) -> np.ndarray:
        """For every value of the next bits, as many as the longest code has: the symbol, and above its 12 bits how many it takes."""
        if self.only is not None:
            return np.array([self.only])
        used = np.array(self.symbols)
        n = np.array(self.lengths)[used]
        longest = int(n.max(initial=0))
        order = np.argsort(n, kind="stable")
        first_bit_first = np.repeat((used | n << 12)[order], 1 << (longest - n[order]))
        if len(first_bit_first) != 1 << longest:
            raise ValueError("not a complete code")
        return first_bit_first[_reversed(longest)]


def _reversed(n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006
    """Numbers of n bits with their bits in reverse order."""
    if n not in kept:
        kept[n] = np.zeros(1, np.int64) if not n else np.concatenate([_reversed(n - 1) * 2, _reversed(n - 1) * 2 + 1])
    return kept[n]


def _read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * max(alphabet, 256)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        used = {bits.read(8 if wide else 1)}
        if two:
            used.add(bits.read(8))
        for s in used:
            lengths[s] = 1
        return Code(lengths, sorted(used))
    of_lengths = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[k] = bits.read(3)
    inner = Code(of_lengths).by_next_bits(7)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    start = bits.at >> 3
    ahead = int.from_bytes(bits.data[start : start + (alphabet * 14 >> 3) + 2], "little") >> (bits.at & 7)
    at, before, used = 0, 8, 0
    while at < alphabet and left:
        left -= 1
        if inner[ahead & 127] is None:
            raise ValueError("no such code")
        symbol, n = inner[ahead & 127]
        ahead >>= n
        used += n
        if symbol < 16:
            lengths[at] = symbol
            before = symbol or before
            at += 1
            continue
        value, extra, least = {16: (before, 2, 3), 17: (0, 3, 3), 18: (0, 7, 11)}[symbol]
        n = least + (ahead & ((1 << extra) - 1))
        ahead >>= extra
        used += extra
        if at + n > alphabet:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = [value] * n
        at += n
    bits.at += used
    return Code(lengths)


def _value(bits: Bits, symbol: int) -> int:
    """The number that a length or distance symbol and its extra bits stand for."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _values(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of length or distance symbols: the least number each stands for, and how many extra bits add to it."""
    extra = np.maximum(symbol - 2, 0) >> 1
    return np.where(symbol < 4, symbol, (2 + (symbol & 1)) << extra) + 1, extra


def _read_levels(bits: Bits, total: int, width: int, green: Code, distances: Code) -> np.ndarray:
    """The green channel of a picture whose other channels have one value each, so a token is a literal or a back-reference."""
    if green.only is not None:
        return np.full(total, green.only, np.uint8)
    data = np.concatenate([np.frombuffer(bits.data, np.uint8), np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from each byte on
    ahead = lambda at, n: (eight[np.minimum(at >> 3, len(eight) - 1)] >> (at & 7).astype(np.uint64) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    tokens, far = green.lookup(), distances.lookup() if distances.symbols else np.zeros(1, np.int64)
    far_width = np.array(len(far).bit_length() - 1)
    out, done = np.zeros(total, np.uint8), 0
    while done < total:
        first, here = bits.at >> 3, min(WINDOW, 8 * len(bits.data) - bits.at)
        if here <= 0:
            raise ValueError("truncated")
        # what a token that starts at each bit would be, and how many bits it takes
        low = eight[first : first + (here >> 3) + 2].astype(np.uint32)
        token = tokens[((low[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(len(tokens) - 1)).ravel()[bits.at & 7 :][:here]]
        step = token >> 12
        copy = np.flatnonzero(token & 256)
        least, extra = _values((token[copy] & 4095) - 256)
        at = bits.at + copy + step[copy]
        length = least + ahead(at, extra)
        at += extra
        code = far[ahead(at, far_width)]
        least, more = _values(code & 4095)
        at += code >> 12
        distance = least + ahead(at, more)
        step[copy] = at + more - bits.at - copy
        # which bits tokens start at: 16 tokens at a time, then those in between
        after = np.arange(here + 1)
        after[:-1] += step
        jumps = [np.minimum(after, here, out=after)]
        for _ in range(4):
            jumps.append(jumps[-1][jumps[-1]])
        starts, p, jump = [], 0, jumps.pop().item
        while p < here:
            starts.append(p)
            p = jump(p)
        start = np.array(starts)
        for j in reversed(jumps):
            start = np.stack([start, j[start]], 1).ravel()
        start = start[start < here]
        symbol = token[start] & 4095
        of_copy = np.searchsorted(copy, start[symbol >= 256])
        sizes = np.ones(len(start), np.int64)
        sizes[symbol >= 256] = length[of_copy]
        ends = done + np.cumsum(sizes)
        n = int(np.searchsorted(ends, total)) + 1  # tokens up to the end of the picture
        start, symbol, ends, sizes = start[:n], symbol[:n], ends[:n], sizes[:n]
        literal = symbol < 256
        out[ends[literal] - 1] = symbol[literal]
        for end, size, d in zip(ends[~literal].tolist(), sizes[~literal].tolist(), distance[of_copy].tolist(), strict=False):
            d = d - 120 if d > 120 else max(1, NEIGHBOURS[d - 1][0] + NEIGHBOURS[d - 1][1] * width)
            a = end - size
            if d > a or end > total:
                raise ValueError("a reference out of the picture")
            if d >= size:
                out[a:end] = out[a - d : end - d]
            else:
                out[a:end] = np.resize(out[a - d : a], size)
        bits.at += int(start[-1] + step[start[-1]])
        done = int(ends[-1])
    if bits.at > 8 * len(bits.data):
        raise ValueError("truncated")
    return out


def _read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """One entropy-coded image, as uint32 ARGB of height x width."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    step, groups_of = 0, None
    if main and bits.read(1):
        step = bits.read(3) + 2
        groups_of = (_read_image(bits, -(-width >> step), -(-height >> step)) >> 8) & 0xFFFF
    n_groups = int(groups_of.max()) + 1 if groups_of is not None else 1
    groups = [[_read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(n_groups)]
    total = width * height
    green, *others = groups[0][:4]
    if n_groups == 1 and not cache_bits and all(c.only is not None for c in others) and (green.only is None or green.only < 256):
        red, blue, alpha = (np.uint32(c.only) for c in others)
        levels = _read_levels(bits, total, width, green, groups[0][4])
        return (alpha << np.uint32(24) | red << np.uint32(16) | blue | levels.astype(np.uint32) << np.uint32(8)).reshape(height, width)
    out = [0] * total
    cache, at = [0] * (1 << cache_bits if cache_bits else 0), 0
    while at < total:
        codes = groups[int(groups_of[at // width >> step, at % width >> step])] if groups_of is not None else groups[0]
        symbol, start = codes[0].read(bits), at
        if symbol < 256:
            red, blue, alpha = (c.read(bits) for c in codes[1:4])
            out[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < 280:
            length = _value(bits, symbol - 256)
            distance = _value(bits, codes[4].read(bits))
            if distance > 120:
                distance -= 120
            else:
                left, up = NEIGHBOURS[distance - 1]
                distance = max(1, left + up * width)
            if distance > at or at + length > total:
                raise ValueError("a reference out of the picture")
            for _ in range(length):
                out[at] = out[at - distance]
                at += 1
        else:
            out[at] = cache[symbol - 280]
            at += 1
        if cache_bits:
            for pixel in out[start:at]:
                cache[(CACHE_HASH * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel
    return np.array(out, np.uint32).reshape(height, width)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """uint32 ARGB -> int32 array with a last axis of alpha, red, green, blue."""
    return np.stack([(pixels >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _packed(channels: np.ndarray) -> np.ndarray:
    a, r, g, b = (channels[..., k].astype(np.uint32) & np.uint32(255) for k in range(4))
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def _predicted(mode: int, left, top, top_right, top_left):
    half = lambda a, b: (a + b) >> 1
    if mode in (0, 14, 15):
        return np.array([255, 0, 0, 0], np.int32)
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 13:
        a = half(left, top)
        return np.clip(a + np.trunc((a - top_left) / 2).astype(np.int32), 0, 255)
    return (
        left, top, top_right, top_left, half(half(left, top_right), top), half(left, top_left), half(left, top), half(top_left, top),
        half(top, top_right), half(half(left, top_left), half(top, top_right)), None, np.clip(left + top - top_left, 0, 255),
    )[mode - 1]


def _undo_predictor(pixels: np.ndarray, modes: np.ndarray, step: int) -> np.ndarray:
    x = _channels(pixels)
    height, width = pixels.shape
    for r in range(height):
        for c in range(width):
            if r == 0:
                guess = x[0, c - 1] if c else np.array([255, 0, 0, 0], np.int32)
            elif c == 0:
                guess = x[r - 1, 0]
            else:
                after = x[r - 1, c + 1] if c + 1 < width else x[r, 0]
                guess = _predicted(int(modes[r >> step, c >> step]), x[r, c - 1], x[r - 1, c], after, x[r - 1, c - 1])
            x[r, c] = (x[r, c] + guess) & 255
    return _packed(x)


def _undo_cross_colour(pixels: np.ndarray, elements: np.ndarray, step: int) -> np.ndarray:
    height, width = pixels.shape
    e = _channels(elements)[np.arange(height)[:, None] >> step, np.arange(width)[None, :] >> step]
    signed = lambda v: ((v & 255) ^ 128) - 128
    delta = lambda a, b: (signed(a) * signed(b)) >> 5
    x = _channels(pixels)
    x[..., 1] = (x[..., 1] + delta(e[..., 3], x[..., 2])) & 255
    x[..., 3] = (x[..., 3] + delta(e[..., 2], x[..., 2]) + delta(e[..., 1], x[..., 1])) & 255
    return _packed(x)


def _undo_palette(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    per = {1: 8, 2: 8, 3: 4, 4: 4}.get(len(palette), 2 if len(palette) <= 16 else 1)
    index = (pixels >> np.uint32(8)) & np.uint32(255)
    bits = 8 // per
    index = np.repeat(index, per, 1)[:, :width] >> np.tile(np.arange(per, dtype=np.uint32) * np.uint32(bits), index.shape[1])[:width] & np.uint32((1 << bits) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """The pixels of one lossless WebP file: uint32 ARGB, height x width."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":  # other chunks may come first
        if at + 8 > len(data):
            raise ValueError("no lossless picture")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1)
    bits = Bits(data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]])
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless picture")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            step = bits.read(3) + 2
            image = _read_image(bits, -(-now >> step), -(-height >> step))
            undo.append((lambda p, i=image, s=step: _undo_predictor(p, (i >> np.uint32(8)) & np.uint32(15), s)) if kind == 0 else (lambda p, i=image, s=step: _undo_cross_colour(p, i, s)))
        elif kind == 2:
            undo.append(lambda p: (p & np.uint32(0xFF00FF00)) | ((p & np.uint32(0x00FF00FF)) + ((p >> np.uint32(8)) & np.uint32(255)) * np.uint32(0x00010001)) & np.uint32(0x00FF00FF))
        else:
            size = bits.read(8) + 1
            palette = _packed(np.cumsum(_channels(_read_image(bits, size, 1))[0], 0))
            undo.append(lambda p, c=palette, w=now: _undo_palette(p, c, w))
            now = -(-now // (8 if size <= 2 else 4 if size <= 4 else 2 if size <= 16 else 1))
    pixels = _read_image(bits, now, height, main=True)
    for step in reversed(undo):
        pixels = step(pixels)
    return pixels


def code_lengths(counts: dict[int, int], limit: int) -> dict[int, int]:
    """Lengths of a prefix code for at least two symbols with these counts, none above ``limit``."""
    symbols = list(counts)
    while True:
        heap = [(n, k) for k, n in enumerate(counts.values())]
        heapq.heapify(heap)
        above = [0] * (2 * len(heap) - 1)
        for k in range(len(symbols), len(above)):
            n, a = heapq.heappop(heap)
            more, b = heap[0]
            above[a] = above[b] = k
            heapq.heapreplace(heap, (n + more, k))
        depth = [0] * len(above)
        for k in range(len(above) - 2, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[: len(symbols)]) <= limit:
            return dict(zip(symbols, depth, strict=False))
        counts = {s: n // 2 + 1 for s, n in counts.items()}


def _codes(length: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical codes of symbols, as (bits in the order they are written, how many)."""
    code, before, found, turned = 0, 0, {}, _reversed(15)
    for n, s in sorted((n, s) for s, n in length.items()):
        code <<= n - before
        before = n
        found[s] = (int(turned[code]) >> (15 - n), n)
        code += 1
    return found


def _write_code(counts: dict[int, int], alphabet: int) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
    """A prefix code as fields (value, bits) of the file, and the codes of its symbols."""
    if len(counts) <= 2 and all(s < 256 for s in counts):
        two = sorted(counts) or [0]
        return [(1, 1), (len(two) - 1, 1), (1, 1), *((s, 8) for s in two)], {s: (k, len(two) - 1) for k, s in enumerate(two)}
    if len(counts) == 1:
        counts = {**counts, 0: 0}
    length = code_lengths(counts, 15)
    runs, before = [], -1
    for s in [*sorted(length), alphabet]:
        gap = s - before - 1
        while gap >= 3:
            n = min(gap, 138)
            runs.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
            gap -= n
        runs += [(0, 0, 0)] * gap
        if s < alphabet:
            runs.append((length[s], 0, 0))
        before = s
    seen: dict[int, int] = {}
    for k, _, _ in runs:
        seen[k] = seen.get(k, 0) + 1
    inner = code_lengths(seen, 7)
    own, fields = _codes(inner), [(0, 1), (len(LENGTH_ORDER) - 4, 4)]
    fields += [(inner.get(k, 0), 3) for k in LENGTH_ORDER]
    fields.append((0, 1))
    for k, value, n in runs:
        fields.append(own[k])
        if n:
            fields.append((value, n))
    return fields, _codes(length)


#: Red and blue 0 and alpha 255 throughout.
_OTHERS = [field for only in (0, 0, 255) for field in _write_code({only: 1}, 256)[0]]


def _repeats(v: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of passages seen before, in order and without overlap. Only places after white space and every
    sixteenth one are looked at; what is missed costs bits, nothing else."""
    n = len(v) - LEAST_COPY
    if n < 1:
        return []
    place = np.flatnonzero(np.concatenate([[False], v[: n - 1] <= 32]) | (np.arange(n) & 15 == 0))
    key = np.ndarray((n,), "<u8", v, strides=(1,))[place] * np.uint64(0x9E3779B97F4A7C15) ^ np.ndarray((n,), "<u4", v[8:], strides=(1,))[place]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    later, sooner = place[order[same + 1]], place[order[same]]
    found, end = [], 0
    for i in np.argsort(later).tolist():
        p, q = int(later[i]), int(sooner[i])
        if p < end or p - q > FARTHEST:
            continue
        a, b = v[p : p + MOST_COPY], v[q : q + min(MOST_COPY, len(v) - p)]
        differ = np.flatnonzero(a != b)
        size = int(differ[0]) if len(differ) else len(a)
        if size >= LEAST_COPY:
            found.append((p, size, p - q))
            end = p + size
    return found


def _prefix(value: int) -> tuple[int, int, int]:
    """Symbol, extra value and its bits of a length or distance."""
    w = value - 1
    if w < 4:
        return w, 0, 0
    extra = w.bit_length() - 2
    return 2 * (extra + 1) + (w >> extra & 1), w & ((1 << extra) - 1), extra


def _write_levels(v: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Fields of the codes, then values and bits (16 at most) of all tokens, of a picture that varies in green only."""
    copies = _repeats(v)
    covered = np.zeros(len(v), bool)
    for place, size, _ in copies:
        covered[place : place + size] = True
    literal = np.flatnonzero(~covered) if copies else slice(None)
    lengths, distances = [_prefix(size) for _, size, _ in copies], [_prefix(d + 120) for _, _, d in copies]
    count = np.bincount(v[literal], minlength=256)
    used = {int(s): int(count[s]) for s in np.flatnonzero(count)}
    times: dict[int, int] = {}
    for (s, _, _), (d, _, _) in zip(lengths, distances, strict=True):
        used[256 + s] = used.get(256 + s, 0) + 1
        times[d] = times.get(d, 0) + 1
    fields, green = _write_code(dict(sorted(used.items())), 280)
    fields += _OTHERS
    more, distance = _write_code(times, 40)
    code, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in green.items():
        if s < 256:
            code[s], bits[s] = c, n
    values, widths = code[v[literal]], bits[v[literal]]
    if copies:
        own = []
        for (s, x, n), (d, y, m) in zip(lengths, distances, strict=True):
            own += [green[256 + s], (x, n), distance[d], (y & 0xFFFF, min(m, 16)), (y >> 16, max(0, m - 16))]
        before = np.repeat(np.searchsorted(literal, [place for place, _, _ in copies]), 5)
        own = np.array(own, np.int64)
        values, widths = np.insert(values, before, own[:, 0]), np.insert(widths, before, own[:, 1])
    return [*fields, *more], values, widths


_FIRST_BITS = np.arange(16) < np.arange(17)[:, None]


def encode_gray(samples: bytes, width: int = UNIT) -> bytes:
    """A picture whose pixels are (v, v, v), rows of ``width`` samples, by subtract-green or, for at most 16 levels, by a palette."""
    v = np.frombuffer(samples, np.uint8)
    levels = np.flatnonzero(np.bincount(v, minlength=256))
    fields = [(0x2F, 8), (width - 1, 14), (len(v) // width - 1, 14), (0, 4)]
    if len(levels) <= 16:
        fields += [(1, 1), (3, 2), (len(levels) - 1, 8), (0, 1)]  # a palette, whose own picture has no cache
        steps = np.diff(levels, prepend=0)
        channel, code = _write_code({int(x): int(n) for x, n in zip(*np.unique(steps, return_counts=True), strict=True)}, 280)
        fields += channel
        colours = _write_code({int(x): int(n) for x, n in zip(*np.unique(steps, return_counts=True), strict=True)}, 256)
        first = _write_code({0: 1, 255: 1} if len(levels) > 1 else {255: 1}, 256)
        fields += colours[0] + colours[0] + first[0] + _write_code({0: 1}, 40)[0]
        for k, x in enumerate(steps.tolist()):
            fields += [code[x], colours[1][x], colours[1][x], first[1][0 if k else 255]]
        per = 8 if len(levels) <= 2 else 4 if len(levels) <= 4 else 2
        rows = np.zeros((len(v) // width, -(-width // per) * per), np.uint8)
        rows[:, :width] = np.searchsorted(levels, v).reshape(-1, width)
        v = np.ascontiguousarray(np.bitwise_or.reduce(rows.reshape(len(rows), -1, per) << (np.arange(per) * (8 // per)).astype(np.uint8), 2).astype(np.uint8)).ravel()
    else:
        fields += [(1, 1), (2, 2)]
    more, values, bits = _write_levels(v)
    head = np.array([*fields, (0, 1), (0, 1), (0, 1), *more], np.int64)  # no other transform, no cache, one group of codes
    values, bits = np.concatenate([head[:, 0], values]), np.concatenate([head[:, 1], bits])
    written = np.unpackbits(values.astype("<u2").view(np.uint8), bitorder="little")[_FIRST_BITS[bits].ravel()]
    data = np.packbits(written, bitorder="little").tobytes()
    pad = data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + pad


def to_media(payload: bytes) -> bytes:
    """A payload (a positive multiple of 192 bytes) as WebP files, one after another."""
    size = UNIT * MOST_ROWS
    return b"".join(encode_gray(payload[a : a + size]) for a in range(0, len(payload), size))


def split_media(media: bytes) -> list[bytes]:
    files, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        files.append(media[at:end])
        at = end
    return files


def decode_column(media: DataFrame, column: str) -> DataFrame:
    """Adds width, height and pixels (little-endian uint32 ARGB) for a binary column with one file each.

    Null and undecodable values give nulls; the row stays. Columns that already have these names are replaced.
    """
    keep = [c for c in media.columns if c not in ("width", "height", "pixels")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(batch.schema.get_field_index(column)).to_pylist():
                try:
                    found.append(decode(data) if data is not None else None)
                except (ValueError, IndexError, struct.error):
                    found.append(None)
            sizes = [[None if f is None else f.shape[k] for f in found] for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, *(pa.array(s, pa.int32()) for s in sizes), pa.array([None if f is None else f.astype("<u4").tobytes() for f in found], pa.binary())], names=[*keep, "width", "height", "pixels"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(keep).schema)
    return media.mapInArrow(common.lean(read), f"{kept}, width int, height int, pixels binary")


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text (null: empty) as UTF-8, padded by spaces to a multiple of 192 bytes, as pictures.

    Rows that repeat give a row each, a null doc_id stays null, an empty table gives an empty one, other columns are not kept.
    doc_id is a whole number. A long text becomes several pictures of at most ``MOST_ROWS`` rows.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                raw = [t.encode() for t in rows.column(1).to_pylist()]
                media = [to_media(x.ljust(max(1, -(-len(x) // UNIT)) * UNIT)) for x in raw]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    common.small_batches(docs.sparkSession)
    return docs.select("doc_id", common.text_or_empty().alias("text")).mapInArrow(common.lean(write), "doc_id long, n_bytes long, media binary")


def feature(samples: np.ndarray) -> str:
    """Mean, spread and an average hash: for each of 64 equal stretches, whether its mean exceeds the whole one."""
    cuts = np.arange(64) * len(samples) // 64
    means = np.add.reduceat(samples, cuts, dtype=np.float64) / np.diff([*cuts, len(samples)])
    bits = np.packbits(means > samples.mean()).tobytes().hex()
    return f"mean={samples.mean():.3f};std={samples.std():.3f};levels={int((np.bincount(samples, minlength=256) > 0).sum())};hash={bits}"


def op2_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text kept as lossless WebP, read back: sizes, digests and a feature of the pixels."""
    stored = common.staged(store_texts(common.documents(spark, sf_dir)), "webp")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                sizes, shas, crcs, media_shas, features = [], [], [], [], []
                media = rows.column(2).to_pylist()
                for m in media:
                    samples = np.concatenate([(decode(f) >> np.uint32(8)).astype(np.uint8).ravel() for f in split_media(m)])
                    payload = samples.tobytes()
                    sizes.append(len(payload))
                    shas.append(hashlib.sha256(payload).hexdigest())
                    crcs.append(zlib.crc32(payload[-16:]))
                    media_shas.append(hashlib.sha256(m).hexdigest())
                    features.append(feature(samples))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(sizes, pa.int64()), pa.array(shas), pa.array(crcs, pa.int64()), pa.array(list(map(len, media)), pa.int64()), pa.array(media_shas), pa.array(features)],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return stored.mapInArrow(common.lean(read), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
