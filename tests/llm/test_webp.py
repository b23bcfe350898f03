"""The lossless decoder against an encoder written for these tests, and payloads through pictures."""

import hashlib
import heapq
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from scenequery.llm import webp


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]

    def data(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def huffman(counts):
    if len(counts) == 1:
        return {next(iter(counts)): 1}
    heap = [(n, i, {s: 0}) for i, (s, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    k = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], k, {s: n + 1 for s, n in [*a[2].items(), *b[2].items()]}))
        k += 1
    return heap[0][2]


def write_code(w, counts, alphabet):
    """Stores a code with lengths of four bits each, all length symbols used; returns symbol -> bits."""
    lengths = huffman(counts)
    assert max(lengths.values()) <= 15
    w.put(0, 1)
    w.put(15, 4)
    for k in webp.LENGTH_ORDER:
        w.put(4 if k < 16 else 0, 3)
    w.put(0, 1)
    for s in range(alphabet):
        n = lengths.get(s, 0)
        w.bits += [n >> k & 1 for k in (3, 2, 1, 0)]
    if len(lengths) == 1:
        return {s: [] for s in lengths}
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - before
        before = n
        out[s] = [code >> (n - 1 - k) & 1 for k in range(n)]
        code += 1
    return out


def prefix(value):
    """(symbol, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v - ((2 + half) << (top - 1)), top - 1


def tokens_of(pixels, cache_bits, references, rng):
    out, cache, at = [], {}, 0
    while at < len(pixels):
        length = 0
        if references and at > 3 and rng.random() < 0.5:
            d = rng.randrange(1, min(at, 200) + 1)
            while at + length < len(pixels) and length < 60 and pixels[at + length] == pixels[at + length - d]:
                length += 1
        start = at
        key = (webp.CACHE_HASH * pixels[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if length >= 2:
            out.append(("copy", length, d))
            at += length
        elif cache_bits and cache.get(key, 0) == pixels[at]:
            out.append(("cache", key))
            at += 1
        else:
            out.append(("pixel", pixels[at]))
            at += 1
        for p in pixels[start:at] if cache_bits else ():
            cache[(webp.CACHE_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return out


def write_image(w, image, main=False, cache_bits=0, references=False, groups=None, seed=0):
    """One entropy-coded image; ``groups`` is (step, array of group numbers)."""
    height, width = image.shape
    rng = random.Random(seed)
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(1 if groups else 0, 1)
        if groups:
            w.put(groups[0] - 2, 3)
            write_image(w, groups[1].astype(np.uint32) << np.uint32(8))
    toks = tokens_of(image.ravel().tolist(), cache_bits, references, rng)
    n = int(groups[1].max()) + 1 if groups else 1
    counts = [[Counter() for _ in range(5)] for _ in range(n)]
    plan, at = [], 0
    for t in toks:
        g = int(groups[1][at // width >> groups[0], at % width >> groups[0]]) if groups else 0
        if t[0] == "pixel":
            a, r, gr, b = (t[1] >> s & 255 for s in (24, 16, 8, 0))
            parts = [(0, gr, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
            at += 1
        elif t[0] == "cache":
            parts = [(0, 280 + t[1], 0, 0)]
            at += 1
        else:
            s, extra, k = prefix(t[1])
            near = [i + 1 for i, (x, y) in enumerate(webp.NEIGHBOURS) if max(1, x + y * width) == t[2]]
            d, dx, dk = prefix(rng.choice(near) if near and rng.random() < 0.7 else t[2] + 120)
            parts = [(0, 256 + s, extra, k), (4, d, dx, dk)]
            at += t[1]
        for c, s, _, _ in parts:
            counts[g][c][s] += 1
        plan.append((g, parts))
    codes = [[write_code(w, c or Counter([0]), size) for c, size in zip(group, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40), strict=True)] for group in counts]
    for g, parts in plan:
        for c, s, extra, k in parts:
            w.bits += codes[g][c][s]
            w.put(extra, k)


def riff(w, junk=False):
    data = w.data()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    before = b"ICCP" + struct.pack("<I", 3) + b"abc\0" if junk else b""
    return b"RIFF" + struct.pack("<I", 4 + len(before) + len(chunk)) + b"WEBP" + before + chunk


def start(width, height):
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    return w


def some_image(height, width, colours, seed):
    rng = np.random.default_rng(seed)
    palette = rng.integers(0, 2**32, colours).astype(np.uint32)
    return palette[rng.integers(0, colours, (height, width))]


def channel(p, s):
    return int(p) >> s & 255


@pytest.mark.parametrize("cache_bits,references,colours", [(0, False, 500), (4, False, 9), (0, True, 3), (7, True, 5), (11, True, 40), (0, False, 1)])
def test_entropy_coding(cache_bits, references, colours):
    image = some_image(17, 23, colours, cache_bits + colours)
    w = start(23, 17)
    w.put(0, 1)
    write_image(w, image, True, cache_bits, references, seed=colours)
    assert (webp.decode(riff(w, junk=True)) == image).all()


def test_groups_of_codes():
    image = some_image(20, 30, 40, 5)
    groups = np.random.default_rng(1).integers(0, 3, (5, 8))
    groups[0, 0] = 2
    w = start(30, 20)
    w.put(0, 1)
    write_image(w, image, True, 3, True, (2, groups))
    assert (webp.decode(riff(w)) == image).all()


def predict(mode, x, r, c, s):
    """One channel of the prediction, from the format's description."""
    at = lambda i, j: channel(x[i, j], s)
    left, top, corner = at(r, c - 1), at(r - 1, c), at(r - 1, c - 1)
    right = at(r - 1, c + 1) if c + 1 < x.shape[1] else at(r, 0)
    mean = lambda a, b: (a + b) // 2
    clamp = lambda v: max(0, min(255, v))
    if mode == 0:
        return 255 if s == 24 else 0
    if mode == 11:
        p_left = sum(abs(channel(x[r - 1, c], k) - channel(x[r - 1, c - 1], k)) for k in (0, 8, 16, 24))
        p_top = sum(abs(channel(x[r, c - 1], k) - channel(x[r - 1, c - 1], k)) for k in (0, 8, 16, 24))
        return left if p_left < p_top else top
    if mode == 12:
        return clamp(left + top - corner)
    if mode == 13:
        a = mean(left, top)
        return clamp(a + int((a - corner) / 2))
    return {1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top), 8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right))}[mode]


def test_predictor_modes():
    image = some_image(16, 28, 200, 9)
    modes = (np.arange(4 * 7).reshape(4, 7) % 14).astype(np.uint32)
    residual = np.zeros_like(image)
    for r in range(16):
        for c in range(28):
            value = 0
            for s in (24, 16, 8, 0):
                if r == 0:
                    guess = (255 if s == 24 else 0) if c == 0 else channel(image[0, c - 1], s)
                elif c == 0:
                    guess = channel(image[r - 1, 0], s)
                else:
                    guess = predict(int(modes[r >> 2, c >> 2]), image, r, c, s)
                value |= (channel(image[r, c], s) - guess & 255) << s
            residual[r, c] = value
    w = start(28, 16)
    w.put(1, 1)
    w.put(0, 2)
    w.put(0, 3)
    write_image(w, modes << np.uint32(8))
    w.put(0, 1)
    write_image(w, residual, True)
    assert (webp.decode(riff(w)) == image).all()


def test_cross_colour_then_subtract_green():
    image = some_image(9, 13, 100, 11)
    elements = some_image(3, 4, 12, 12)
    signed = lambda v: v - 256 if v > 127 else v
    stored = np.zeros_like(image)
    for r in range(9):
        for c in range(13):
            a, red, green, blue = (channel(image[r, c], s) for s in (24, 16, 8, 0))
            e = elements[r >> 2, c >> 2]
            r2b, g2b, g2r = (signed(channel(e, s)) for s in (16, 8, 0))
            blue = blue - (g2b * signed(green) >> 5) - (r2b * signed(red) >> 5) & 255
            red = red - (g2r * signed(green) >> 5) & 255
            stored[r, c] = a << 24 | (red - green & 255) << 16 | green << 8 | (blue - green & 255)
    w = start(13, 9)
    w.put(1, 1)
    w.put(1, 2)
    w.put(0, 3)
    write_image(w, elements)
    w.put(1, 1)
    w.put(2, 2)
    w.put(0, 1)
    write_image(w, stored, True)
    assert (webp.decode(riff(w)) == image).all()


@pytest.mark.parametrize("colours,per", [(2, 8), (4, 4), (11, 2), (60, 1)])
def test_palette(colours, per):
    rng = np.random.default_rng(colours)
    palette = rng.integers(0, 2**32, colours).astype(np.uint32)
    index = rng.integers(0, colours, (7, 21)).astype(np.uint32)
    bundled = np.zeros((7, -(-21 // per)), np.uint32)
    for c in range(21):
        bundled[:, c // per] |= index[:, c] << np.uint32((c % per) * (8 // per))
    deltas = np.array([sum((channel(p, s) - channel(q, s) & 255) << s for s in (0, 8, 16, 24)) for p, q in zip(palette, [0, *palette[:-1]], strict=True)], np.uint32)
    w = start(21, 7)
    w.put(1, 1)
    w.put(3, 2)
    w.put(colours - 1, 8)
    write_image(w, deltas[None, :])
    w.put(0, 1)
    write_image(w, bundled << np.uint32(8), True)
    assert (webp.decode(riff(w)) == palette[index]).all()


def test_payloads_come_back():
    for payload in (b" " * 192, bytes(range(256)) * 3, b"ab" * 96 * 5, b"x" * 192 * 16385 + b" " * 192):
        files = webp.split_media(webp.to_media(payload))
        assert len(files) == -(-len(payload) // (192 * 16384))
        pixels = np.concatenate([webp.decode(f).ravel() for f in files])
        assert ((pixels >> 8) & 255).astype(np.uint8).tobytes() == payload
        assert (pixels >> 24 == 255).all() and ((pixels & 255) == (pixels >> 16 & 255)).all()


def test_damaged_files():
    good = webp.to_media(bytes(range(192)))
    for bad in (b"", b"RIFFxxxxWEBP", good[:40], good.replace(b"VP8L", b"VP8 ")):
        with pytest.raises((ValueError, IndexError, struct.error)):
            webp.decode(bad)


def test_columns(spark):
    rows = [(0, bytearray(webp.to_media(b"a" * 192)), 5), (1, None, 6), (2, bytearray(b"no"), 7)]
    got = webp.decode_column(spark.createDataFrame(rows, "id int, media binary, width int"), "media").orderBy("id").collect()
    assert [(r.width, r.height, r.pixels and len(r.pixels)) for r in got] == [(192, 1, 768), (None, None, None), (None, None, None)]


def test_query_on_odd_texts(spark, tmp_path):
    texts = [None, "", "é" * 100, "same", "same", "x" * 100_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in webp.op2_lossless_webp(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert (got[3].media_sha256, got[3].feature) == (got[4].media_sha256, got[4].feature)


def samples():
    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) for n in rng.integers(2, 9, 300)]
    prose = b" ".join(words[k] for k in rng.integers(0, 300, 3000))
    yield b" " * webp.UNIT
    yield bytes([0]) * webp.UNIT * 50
    yield bytes([0] * 191 + [255])
    for levels in (2, 3, 4, 5, 16, 17, 256):
        yield bytes(rng.integers(0, levels, webp.UNIT * 11).astype(np.uint8))
    yield bytes(range(192))
    yield prose.ljust(-(-len(prose) // webp.UNIT) * webp.UNIT)
    yield (prose[:5000] * 40).ljust(-(-200_000 // webp.UNIT) * webp.UNIT)
    yield bytes(rng.geometric(0.3, webp.UNIT * 300).clip(0, 255).astype(np.uint8))  # lengths up to the limit
    yield (prose * 200)[: webp.UNIT * webp.MOST_ROWS]


def scalar(bits, total, width, green, distances):
    """Levels read token by token, as other pictures are."""
    out = []
    while len(out) < total:
        symbol = green.read(bits)
        if symbol < 256:
            out.append(symbol)
            continue
        length, d = webp._value(bits, symbol - 256), webp._value(bits, distances.read(bits))
        d = d - 120 if d > 120 else max(1, webp.NEIGHBOURS[d - 1][0] + webp.NEIGHBOURS[d - 1][1] * width)
        for _ in range(length):
            out.append(out[-d])
    return np.array(out, np.uint8)


@pytest.mark.parametrize("case", range(15))
def test_levels_come_back_and_read_like_single_tokens(case, monkeypatch):
    raw = list(samples())[case]
    media = webp.encode_gray(raw)
    pixels = webp.decode(media)
    v = np.frombuffer(raw, np.uint8).astype(np.uint32)
    assert (pixels.ravel() == 255 << 24 | v * 0x10101).all()
    monkeypatch.setattr(webp, "WINDOW", 900)
    assert (webp.decode(media) == pixels).all()
    if len(raw) < 300_000:
        monkeypatch.setattr(webp, "_read_levels", scalar)
        assert (webp.decode(media) == pixels).all()
    assert len(media) < 1.01 * len(raw) + 400


def test_texts_are_stored_with_copies_and_several_code_lengths(monkeypatch):
    seen = []
    read = webp._read_levels

    def spy(bits, total, width, green, distances):
        seen.append((len({green.lengths[s] for s in green.symbols}), green.symbols[-1] >= 256))
        return read(bits, total, width, green, distances)

    monkeypatch.setattr(webp, "_read_levels", spy)
    text = ("A passage that is long enough to be found again. " * 2 + "Something else between, 0123456789. ") * 3
    webp.decode(webp.to_media(text.encode().ljust(576)))
    assert seen[-1][0] > 2 and seen[-1][1]


def test_cut_off_and_broken_pictures_are_errors():
    media = webp.encode_gray(list(samples())[11])
    for cut in (25, 60, len(media) // 2, len(media) - 40):
        with pytest.raises((ValueError, IndexError, struct.error)):
            webp.decode(media[:16] + struct.pack("<I", cut) + media[20 : 20 + cut])
