"""Media columns in lossless WebP (VP8L), decoded to pixel arrays.

``decode`` reads the whole lossless format: prefix codes (simple and normal, with meta codes per block),
back-references with the distance map, the colour cache, and the inverse of the predictor, cross-colour,
subtract-green and palette transforms. Symbols are looked up in tables by the next 15 bits, which NumPy lays out for
a stretch of bit positions at a time, so work arrays stay small whatever the image's size.

``encode`` uses all of these but meta codes and cross-colour: a palette for few colours; else whichever of the image as
it is, subtract-green, and prediction from the left or from above has the least entropy; then back-references for runs, a
colour cache and prefix codes, of one fixed model of text for small images and of their own counts for larger ones.
A payload of bytes is stored as 8-bit R, G, B, A samples in rows of ROW pixels, up to 16384 rows an image; longer
payloads take several images, one after the other. Each stored form is a run of complete RIFF files.

Null and empty payloads are stored as padding only. Equal payloads have equal stored forms; repeated rows and rows
without an id stay rows of their own, an empty table gives none, and other columns are not read. Damaged data raise.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import new_folder, table

#: Bytes that a payload is a multiple of, and pixels in a row (four bytes each).
UNIT, ROW, MOST_ROWS = 576, 144, 16384

# Fixed values of the format: order of the code length codes; symbols of lengths; the cache's multiplier.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTHS, DISTANCES, CACHE_FACTOR = 256, 24, 40, 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Near pixels by distance code, nearest first: x to the left is positive, y above.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))

_REVERSED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint8)
#: The 15 bits of a number, mirrored.
_REVERSED_15 = (_REVERSED[np.arange(1 << 15) & 255].astype(np.int64) << 8 | _REVERSED[np.arange(1 << 15) >> 8]) >> 1


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data) + 8:
            raise ValueError("image data ends early")
        out = int.from_bytes(self.data[a:b], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return out


def mirrored(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2) if n else 0


def canonical(lengths: list[int]) -> list[tuple[int, int]]:
    """(code, length) of each symbol of a canonical prefix code."""
    out, code, last = [(0, 0)] * len(lengths), 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s] = (code, n)
        code, last = code + 1, n
    return out


class Code:
    """A canonical prefix code. flat: all of the symbols 0..255 have eight bits."""

    def __init__(self, lengths: list[int]):
        self.used = used = sorted((n, s) for s, n in enumerate(lengths) if n)
        self.only = used[0][1] if len(used) == 1 else None
        self.flat = len(used) == 256 and all(n == 8 for n, _ in used) and used[-1][1] == 255
        if not used:
            self.only = 0
        if self.only is not None:
            return
        if sum(2.0**-n for n, _ in used) != 1.0:
            raise ValueError("incomplete prefix code")

    @functools.cached_property
    def table_of(self) -> tuple[np.ndarray, int]:
        """(length << 16 | symbol by the next bits, mask of these bits)."""
        if self.only is not None:
            return np.array([self.only]), 0
        # In order of their codes, symbols fill all numbers of ``width`` bits, each as many as its length leaves open.
        n, s = np.array(self.used).T
        width = int(n[-1])
        return np.repeat(n << 16 | s, 1 << (width - n))[_REVERSED_15[: 1 << width] >> (15 - width)], (1 << width) - 1

    @functools.cached_property
    def size_of(self) -> np.ndarray:
        """The length by the next bits."""
        return self.table_of[0] >> 16

    @functools.cached_property
    def lookup(self) -> tuple[list[int], int]:
        return self.table_of[0].tolist(), self.table_of[1]

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        table_, mask = self.lookup
        v = table_[int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 3], "little") >> (bits.at & 7) & mask]
        bits.read(v >> 16)
        return v & 0xFFFF


@functools.lru_cache(256)
def _code(lengths: tuple[int, ...]) -> Code:
    return Code(list(lengths))


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return _code(tuple(lengths))
    own = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    code, left = Code(own), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, last = 0, 8
    while at < size and left > 0:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            last, at = s or last, at + 1
            continue
        value, n = (last, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if at + n > size:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = [value] * n
        at += n
    return _code(tuple(lengths))


#: The latest groups of codes by their sizes, with the bits they were read from: images of one writer share them.
_recent: dict[tuple, list[tuple[int, int, list[Code]]]] = {}


def _read_group(bits: Bits, sizes: tuple[int, ...]) -> list[Code]:
    known, at = _recent.setdefault(sizes, []), bits.at
    for n, value, group in known:
        if at + n <= 8 * len(bits.data) and bits.read(n) == value:
            return group
        bits.at = at
    group = [_read_code(bits, n) for n in sizes]
    n, bits.at = bits.at - at, at
    known[:] = [(n, bits.read(n), group), *known[:7]]
    if len(_recent) > 64:
        _recent.clear()
    return group


def _prefixed(bits: Bits, s: int) -> int:
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + bits.read(extra) + 1


def _entropy_image(bits: Bits, w: int, h: int, main: bool) -> np.ndarray:
    """ARGB pixels (uint32) of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    blocks, meta, block_bits, across = 1, None, 0, 0
    if main and bits.read(1):
        block_bits = bits.read(3) + 2
        across = (w + (1 << block_bits) - 1) >> block_bits
        meta = _entropy_image(bits, across, (h + (1 << block_bits) - 1) >> block_bits, False) >> 8 & 0xFFFF
        blocks = int(meta.max()) + 1
    sizes = (LITERALS + LENGTHS + len(cache), 256, 256, 256, DISTANCES)
    groups = [_read_group(bits, sizes) for _ in range(blocks)]
    total = w * h
    if blocks == 1 and not cache and all(c.flat for c in groups[0][:4]):
        return _flat_pixels(bits, total)
    if meta is None and (made := _plain_stream(bits, groups[0], total, cache_bits)) is not None:
        return made
    out, at, shift = [0] * total, 0, 32 - cache_bits
    tables = [[c.lookup for c in group] for group in groups]
    base = bits.at & ~7
    window, p = _windows(bits.data, base).tolist(), bits.at & 7

    def extra(n: int) -> int:
        nonlocal p
        value, got = 0, 0
        while got < n:
            k = min(n - got, 15)
            value |= (window[p] & ((1 << k) - 1)) << got
            p, got = p + k, got + k
        return value

    def number(s: int) -> int:
        return s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + extra((s - 2) >> 1) + 1

    (green, g_mask), (red, r_mask), (blue, b_mask), (alpha, a_mask), (far, f_mask) = tables[0]
    try:
        while at < total:
            if p > STRETCH - 256:
                base, p = base + (p & ~7), p & 7
                if base > 8 * len(bits.data) + 64:
                    raise ValueError("image data ends early")
                window = _windows(bits.data, base).tolist()
            if meta is not None:
                (green, g_mask), (red, r_mask), (blue, b_mask), (alpha, a_mask), (far, f_mask) = tables[int(meta[(at // w >> block_bits) * across + (at % w >> block_bits)])]
            v = green[window[p] & g_mask]
            p, s = p + (v >> 16), v & 0xFFFF
            if s < LITERALS:
                v = red[window[p] & r_mask]
                p, made = p + (v >> 16), (v & 0xFFFF) << 16 | s << 8
                v = blue[window[p] & b_mask]
                p, made = p + (v >> 16), made | v & 0xFFFF
                v = alpha[window[p] & a_mask]
                p, made = p + (v >> 16), made | (v & 0xFFFF) << 24
                out[at] = made
                at += 1
                if cache:
                    cache[(CACHE_FACTOR * made & 0xFFFFFFFF) >> shift] = made
            elif s < LITERALS + LENGTHS:
                n = number(s - LITERALS)
                v = far[window[p] & f_mask]
                p += v >> 16
                d = number(v & 0xFFFF)
                if d > len(NEAR):
                    d -= len(NEAR)
                else:
                    x, y = NEAR[d - 1]
                    d = max(1, x + y * w)
                if d > at or at + n > total:
                    raise ValueError("bad back-reference")
                if d == 1:  # the pixel is in the cache already
                    out[at : at + n] = [out[at - 1]] * n
                else:
                    for k in range(at, at + n):
                        out[k] = out[k - d]
                    for made in out[at : at + n] if cache else ():
                        cache[(CACHE_FACTOR * made & 0xFFFFFFFF) >> shift] = made
                at += n
            else:
                made = out[at] = cache[s - LITERALS - LENGTHS]
                at += 1
                cache[(CACHE_FACTOR * made & 0xFFFFFFFF) >> shift] = made
    except IndexError:
        raise ValueError("image data ends early") from None
    bits.at = base + p
    if bits.at > 8 * len(bits.data):
        raise ValueError("image data ends early")
    return np.array(out, np.uint32)


#: Bit positions that are laid out at a time.
STRETCH = 1 << 15


def _windows(data: bytes, base: int) -> np.ndarray:
    """The next 15 bits at each of STRETCH bit positions from a whole byte on; zeros beyond the end."""
    part = np.frombuffer(data, np.uint8, max(0, min((STRETCH >> 3) + 2, len(data) - (base >> 3))), min(base >> 3, len(data)))
    out = np.zeros(max(8 * len(part) + 16, 512) + 256, np.int64)
    many = min(len(part), STRETCH >> 3)
    raw = np.zeros(many + 2, np.int64)
    raw[: len(part)] = part
    long = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    wide = out[: 8 * many].reshape(many, 8)
    np.right_shift(long[:, None], np.arange(8), out=wide)
    wide &= 0x7FFF
    return out


def _plain_stream(bits: Bits, group: list[Code], total: int, cache_bits: int) -> np.ndarray | None:
    """The pixels of an image with one group of codes whose back-references all repeat the pixel before; None if others
    turn up. What would be read at each bit position is worked out for a stretch at once; then only the way from entry to
    entry is walked, and the cache is resolved by sorting entries by slot."""
    (green, g_mask), (red, r_mask), (blue, b_mask), (alpha, a_mask), (far, f_mask) = (c.table_of for c in group)
    if not g_mask and not r_mask and not b_mask and not a_mask and green[0] < LITERALS:  # one colour, of no bits
        return np.full(total, int(alpha[0]) << 24 | int(red[0]) << 16 | int(green[0]) << 8 | int(blue[0]), np.uint32)
    base, p, end = bits.at & ~7, bits.at & 7, 8 * len(bits.data)
    symbols, pixels, counts, have = [], [], [], 0

    def number(window: np.ndarray, s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.where(s < 4, 0, (s - 2) >> 1)
        low = window[np.minimum(at, len(window) - 1)] & ((1 << np.minimum(n, 15)) - 1)
        return np.where(s < 4, s + 1, ((2 + (s & 1)) << n) + low + 1), n

    while have < total:
        if base + p >= end:
            raise ValueError("image data ends early")
        window = _windows(bits.data, base)
        room = min(STRETCH, len(window) - 256)
        s = green.take(window[:room] & g_mask)
        place = np.arange(len(window))
        after = s >> 16
        after += place[:room]
        s &= 0xFFFF
        # Where the symbol at each position ends, once for each code; the same code often serves several channels.
        r_end = group[1].size_of.take(window & r_mask)
        r_end += place
        b_end, a_end = (r_end if c is group[1] else c.size_of.take(window & m) + place for c, m in ((group[2], b_mask), (group[3], a_mask)))
        nxt = a_end.take(b_end.take(r_end.take(after), mode="clip"), mode="clip")
        others = np.flatnonzero(s >= LITERALS)
        nxt[others] = after[others]
        runs = others[s[others] < LITERALS + LENGTHS]
        n, size = number(window, s[runs] - LITERALS, after[runs])
        at = after[runs] + size
        v = far[window[np.minimum(at, len(window) - 1)] & f_mask]
        at = at + (v >> 16)
        d, size = number(window, v & 0xFFFF, at)
        count = np.ones(room, np.int64)
        nxt[runs], count[runs] = at + size, np.where(d == 2, n, -1)
        stop = min(room, STRETCH - 256) if base + room < end else room
        way, path = memoryview(nxt), []
        step = path.append
        for _ in range(total - have):
            if p >= stop:
                break
            step(p)
            p = way[p]
        path = np.array(path, np.int64)
        own = np.cumsum(count[path]) if (count[path] > 0).all() else None
        if own is None:
            bad = int(np.argmax(count[path] < 0))
            if have + int(count[path[:bad]].sum()) < total:
                return None
            own = np.cumsum(np.abs(count[path]))
        k = int(np.searchsorted(own, total - have)) + 1
        if k <= len(path):
            p = int(nxt[path[k - 1]])
            path, own = path[:k], own[:k]
        symbols.append(s[path])
        first = after[path]
        second = r_end[first]
        third = b_end[second]
        part = (red[window[first] & r_mask] & 0xFFFF) << 16 | s[path] << 8 | blue[window[second] & b_mask] & 0xFFFF
        pixels.append(part | (alpha[window[third] & a_mask] & 0xFFFF) << 24)
        counts.append(count[path])
        have += int(own[-1]) if len(own) else 0
        base, p = base + (p & ~7), p & 7
    bits.at = base + p
    if bits.at > end:
        raise ValueError("image data ends early")
    s, pixel, count = np.concatenate(symbols), np.concatenate(pixels), np.concatenate(counts)
    repeat = (s >= LITERALS) & (s < LITERALS + LENGTHS)
    if have > total or repeat[0]:
        raise ValueError("bad back-reference")
    if cache_bits:
        one = np.flatnonzero(~repeat)
        known = s[one] >= LITERALS + LENGTHS
        slot = np.where(known, s[one] - LITERALS - LENGTHS, (pixel[one] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits))
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        slot = slot[order]
        source = np.maximum.accumulate(np.where(known[order], -1, np.arange(len(order))))
        begin = np.searchsorted(slot, slot)
        pixel[one[order]] = np.where(source >= begin, pixel[one[order[np.maximum(source, 0)]]], 0)
    pixel = pixel[np.maximum.accumulate(np.where(repeat, 0, np.arange(len(s))))]
    return np.repeat(pixel, count).astype(np.uint32)


def _flat_pixels(bits: Bits, total: int) -> np.ndarray:
    a, shift, n = bits.at >> 3, bits.at & 7, 4 * total
    raw = np.frombuffer(bits.data, np.uint8, min(n + 1, len(bits.data) - a), a).astype(np.uint16)
    if len(raw) < n + (shift > 0):
        raise ValueError("image data ends early")
    raw = np.append(raw, 0) if len(raw) == n else raw
    g, r, b, al = _REVERSED[(raw[:n] >> shift | raw[1 : n + 1] << (8 - shift)) & 255].reshape(-1, 4).T.astype(np.uint32)
    bits.at += 8 * n
    return al << 24 | r << 16 | g << 8 | b


def _channels(p: np.ndarray) -> np.ndarray:
    """... x 4 as integers: alpha, red, green, blue."""
    return np.stack([p >> s & 255 for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _average(a, b):
    return (a + b) >> 1


def _half(a, b):
    q = a - b
    return np.clip(a + np.where(q < 0, -(-q >> 1), q >> 1), 0, 255)


def _select(left, top, corner):
    return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top


# By mode, from the pixels left, above, above left and above right.
_MODES = [
    lambda l, t, tl, tr: np.array([255, 0, 0, 0]),
    lambda l, t, tl, tr: l,
    lambda l, t, tl, tr: t,
    lambda l, t, tl, tr: tr,
    lambda l, t, tl, tr: tl,
    lambda l, t, tl, tr: _average(_average(l, tr), t),
    lambda l, t, tl, tr: _average(l, tl),
    lambda l, t, tl, tr: _average(l, t),
    lambda l, t, tl, tr: _average(tl, t),
    lambda l, t, tl, tr: _average(t, tr),
    lambda l, t, tl, tr: _average(_average(l, tl), _average(t, tr)),
    lambda l, t, tl, tr: _select(l, t, tl),
    lambda l, t, tl, tr: np.clip(l + t - tl, 0, 255),
    lambda l, t, tl, tr: _half(_average(l, t), tl),
    lambda l, t, tl, tr: np.array([255, 0, 0, 0]),
    lambda l, t, tl, tr: np.array([255, 0, 0, 0]),
]


def predicted(px: np.ndarray, x: int, y: int, w: int, mode: int) -> np.ndarray:
    """The prediction of pixel (x, y) from those before it in a flat (w * h, 4) array."""
    at = y * w + x
    if not at:
        return np.array([255, 0, 0, 0])
    if not y:
        return px[at - 1]
    if not x:
        return px[at - w]
    return _MODES[mode](px[at - 1], px[at - w], px[at - w - 1], px[at - w + 1])


def _undo_predictor(px: np.ndarray, w: int, h: int, modes: np.ndarray, bits: int) -> np.ndarray:
    if len(np.unique(modes)) == 1 and modes[0] in (1, 2):  # one sum along each row, or column, of the whole image
        p = px.reshape(h, w, 4).copy()
        p[0, 0] += (255, 0, 0, 0)
        if modes[0] == 1:
            p[:, 0] = np.cumsum(p[:, 0], 0)
            p = np.cumsum(p, 1)
        else:
            p[0] = np.cumsum(p[0], 0)
            p = np.cumsum(p, 0)
        return (p & 255).reshape(-1, 4)
    across = (w + (1 << bits) - 1) >> bits
    for y in range(h):
        for x in range(w):
            mode = int(modes[(y >> bits) * across + (x >> bits)]) & 15
            px[y * w + x] = (px[y * w + x] + predicted(px, x, y, w, mode)) & 255
    return px


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint8).view(np.int8).astype(np.int64)


def colour_shift(factor: np.ndarray, value: np.ndarray) -> np.ndarray:
    return (_signed(factor) * _signed(value)) >> 5


def _undo_cross_colour(px: np.ndarray, w: int, h: int, factors: np.ndarray, bits: int) -> np.ndarray:
    across = (w + (1 << bits) - 1) >> bits
    y, x = np.divmod(np.arange(w * h), w)
    f = _channels(factors)[(y >> bits) * across + (x >> bits)]
    red = (px[:, 1] + colour_shift(f[:, 3], px[:, 2])) & 255
    px[:, 3] = (px[:, 3] + colour_shift(f[:, 2], px[:, 2]) + colour_shift(f[:, 1], red)) & 255
    px[:, 1] = red
    return px


def decode(data: bytes) -> np.ndarray:
    """One WebP file to rows x columns x (R, G, B, A)."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("no lossless WebP")
    bits = Bits(data[21 : 20 + struct.unpack_from("<I", data, 16)[0]])
    w, h = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    width, steps = w, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            n = (1 << size) - 1
            steps.append((kind, width, _entropy_image(bits, (width + n) >> size, (h + n) >> size, False), size))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = np.cumsum(_channels(_entropy_image(bits, n, 1, False)), 0) & 255
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, width, colours, packed))
            width = (width + (1 << packed) - 1) >> packed
        else:
            steps.append((kind, width, None, 0))
    flat = _entropy_image(bits, width, h, True)
    if not steps:
        return (flat << 8 | flat >> 24).astype(">u4").view(np.uint8).reshape(h, w, 4)
    px = _channels(flat)
    for kind, width, held, size in reversed(steps):
        if kind == PREDICTOR:
            px = _undo_predictor(px, width, h, held >> 8 & 255, size)
        elif kind == CROSS_COLOUR:
            px = _undo_cross_colour(px, width, h, held, size)
        elif kind == SUBTRACT_GREEN:
            px[:, 1] = (px[:, 1] + px[:, 2]) & 255
            px[:, 3] = (px[:, 3] + px[:, 2]) & 255
        else:
            wide, per = 8 >> size, 1 << size
            index = (px[:, 2:3] >> (np.arange(per) * wide)) & ((1 << wide) - 1)
            index = index.reshape(h, -1)[:, :width].reshape(-1)
            table_ = np.zeros((256, 4), np.int64)
            table_[: len(held)] = held
            px = table_[index]
    return px[:, [1, 2, 3, 0]].astype(np.uint8).reshape(h, w, 4)


class Writer:
    """Bits, least significant first."""

    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def code_lengths(counts: list[int], most: int = 15) -> list[int]:
    """Lengths of a prefix code for counts, none above ``most``."""
    used = [s for s, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0]] = 1
    while len(used) > 1:
        heap = [(counts[s], k, k) for k, s in enumerate(used)]
        heapq.heapify(heap)
        above, n = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            above[a[2]] = above[b[2]] = n
            heapq.heappush(heap, (a[0] + b[0], n, n))
            n += 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth) <= most:
            for k, s in enumerate(used):
                out[s] = depth[k]
            break
        counts = [(c + 1) >> 1 if c else 0 for c in counts]
    return out


def put_code(out: Writer, lengths: list[int]) -> None:
    """A prefix code by its lengths: a simple one for one small symbol, else lengths under a code of their own."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        s = used[0] if used else 0
        out.put(1, 1)
        out.put(0, 1)
        out.put(int(s > 1), 1)
        out.put(s, 8 if s > 1 else 1)
        return
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, bits of it
    for n, run in itertools.groupby(lengths):
        left = len(list(run))
        if n:
            tokens.append((n, 0, 0))
            left -= 1
        while left:
            most, least, s, size = (6, 3, 16, 2) if n else (138, 11, 18, 7) if left > 10 else (10, 3, 17, 3)
            take = min(left, most)
            tokens += [(s, take - least, size)] if take >= least else [(n, 0, 0)] * take
            left -= take
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19).tolist(), 7)
    codes = canonical(own)
    single = sum(map(bool, own)) == 1
    out.put(0, 1)
    out.put(19 - 4, 4)
    for k in LENGTH_ORDER:
        out.put(own[k], 3)
    out.put(0, 1)
    for s, value, size in tokens:
        if not single:
            out.put(mirrored(*codes[s]), codes[s][1])
        out.put(value, size)


#: Bits of the colour cache, pixels from which an image has its own codes, the longest back-reference.
CACHE_BITS, OWN_CODES, LONGEST = 8, 4096, 4096


def _entries(px: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What an image is written as: for each entry its green symbol, its pixel, and the length of a run of the pixel
    before it (0: the entry is a pixel)."""
    first = np.flatnonzero(np.concatenate(([True], px[1:] != px[:-1])))
    size = np.diff(np.append(first, len(px)))
    runs = np.where(size >= 4, -(-(size - 1) // LONGEST), size - 1)
    owner = np.repeat(np.arange(len(first)), runs + 1)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(runs + 1) - runs - 1, runs + 1)
    run = np.where((size[owner] >= 4) & (place > 0), np.minimum(LONGEST, size[owner] - 1 - (place - 1) * LONGEST), 0)
    pixel = px[first][owner]
    green = (pixel >> 8 & 255).astype(np.int64)
    if cache_bits:
        slot = ((pixel.astype(np.uint64) * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)).astype(np.int64)
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        known = np.zeros(len(pixel), bool)
        known[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (pixel[order[1:]] == pixel[order[:-1]])
        green = np.where(known, LITERALS + LENGTHS + slot, green)
    at = np.flatnonzero(run)
    v, extra = run[at] - 1, _extra(run[at])
    green[at] = LITERALS + np.where(v < 4, v, 2 * (extra + 1) + (v >> extra & 1))
    return green, pixel, run


def _extra(run: np.ndarray) -> np.ndarray:
    """Bits beyond the symbol of the lengths of runs."""
    return np.maximum(np.frexp(np.maximum(run - 1, 1))[1] - 2, 0)


def put_image(out: Writer, px: np.ndarray, main: bool, cache_bits: int = 0, codes: list[list[int]] | None = None) -> None:
    """An entropy-coded image of ARGB pixels; codes: lengths of its five codes, else those of its own counts."""
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    green, pixel, run = _entries(px, cache_bits)
    literal = green < LITERALS
    others = [(pixel >> s & 255).astype(np.int64) for s in (16, 0, 24)]
    if codes is None:
        wide = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
        codes = [code_lengths(np.bincount(green, minlength=wide).tolist()), *(code_lengths(np.bincount(c[literal], minlength=256).tolist()) for c in others)]
        codes.append([0, int((run > 0).any()), *[0] * (DISTANCES - 2)])
    if codes is text_codes():
        out.put(*_text_header())
    else:
        for lengths in codes:
            put_code(out, lengths)
    tables = _text_tables() if codes is text_codes() else [_written(lengths) for lengths in codes[:4]]
    # One number of at most 60 bits for each entry: its symbols, or a run's length and what is beyond its symbol.
    value, bits = (t[green] for t in tables[0])
    long = np.flatnonzero(run > 4)
    n = _extra(run[long])
    value[long] |= (run[long] - 1 & ((1 << n) - 1)) << bits[long]
    bits[long] += n
    for c, (code, size) in zip(others, tables[1:], strict=True):
        value, bits = value | np.where(literal, code[c] << bits, 0), bits + np.where(literal, size[c], 0)
    # An entry lies in one or two words of 64 bits; those of a word follow each other.
    end = np.cumsum(bits)
    at, total = end - bits, int(end[-1])
    word, shift, value = at >> 6, (at & 63).astype(np.uint64), value.astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    body = np.zeros((total >> 6) + 2, np.uint64)
    body[word[first]] = np.bitwise_or.reduceat(value << shift, first)
    body[word[first] + 1] |= np.bitwise_or.reduceat(value >> np.uint64(1) >> (np.uint64(63) - shift), first)
    out.put(int.from_bytes(body.astype("<u8").tobytes(), "little") & ((1 << total) - 1), total)


def _written(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The bits of each symbol as they are written, and how many; a code of one symbol has none."""
    if sum(n > 0 for n in lengths) <= 1:
        return np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    code, size = np.array(canonical(lengths), np.int64).T
    return _REVERSED_15[code] >> (15 - size), size


@functools.cache
def text_codes() -> list[list[int]]:
    """Lengths of codes for bytes of text: letters by how common they are, then signs, then other bytes; a quarter of all
    pixels is in the cache."""
    weight = [4] * 256
    for b in range(32, 127):
        weight[b] = 60
    for k, c in enumerate("etaoinshrdlucmfwypvbgkjqxz"):
        weight[ord(c)] = int(4000 * 0.88**k)
    weight[32], weight[10], weight[255] = 6000, 200, 30
    total = sum(weight)
    rare = max(1, total // 3 // (1 << CACHE_BITS))
    same = code_lengths(weight)
    return [code_lengths([*weight, *[max(1, total // 2000)] * LENGTHS, *[rare] * (1 << CACHE_BITS)]), same, same, same, [0, 1, *[0] * (DISTANCES - 2)]]


@functools.cache
def _text_tables() -> list[tuple[np.ndarray, np.ndarray]]:
    return [_written(lengths) for lengths in text_codes()[:4]]


@functools.cache
def _text_header() -> tuple[int, int]:
    out = Writer()
    for lengths in text_codes():
        put_code(out, lengths)
    return out.value, out.size


def _cost(px: np.ndarray) -> float:
    """Bits that the samples of some pixels take at the entropy of each channel."""
    n = np.bincount((px.reshape(-1, 4) + np.arange(0, 1024, 256)).reshape(-1), minlength=1024)
    n = n[n > 0]
    return float((n * np.log2(len(px) * 1.0 / n)).sum()) if len(px) else 0.0


def residuals(px: np.ndarray, mode: int) -> np.ndarray:
    """rows x columns x 4 (A, R, G, B) less what is left of (mode 1) or above (mode 2) each pixel, modulo 256."""
    before = np.empty_like(px)
    if mode == 1:
        before[:, 1:], before[1:, 0] = px[:, :-1], px[:-1, 0]
    else:
        before[1:], before[0, 1:] = px[:-1], px[0, :-1]
    before[0, 0] = (255, 0, 0, 0)
    return (px - before) & 255


def less_green(px: np.ndarray) -> np.ndarray:
    """... x 4 (A, R, G, B) with red and blue less green, modulo 256."""
    return (px - px[..., 2:3] * np.array([0, 1, 0, 1], px.dtype)) & 255


#: An image as it is, less what is left or above, less green.
_WAYS = {0: lambda px: px, 1: lambda px: residuals(px, 1), 2: lambda px: residuals(px, 2), 3: less_green}


def _argb(px: np.ndarray) -> np.ndarray:
    p = px.reshape(-1, 4).astype(np.uint32)
    return p[:, 0] << 24 | p[:, 1] << 16 | p[:, 2] << 8 | p[:, 3]


def encode(pixels: np.ndarray) -> bytes:
    """Rows x columns x (R, G, B, A) as one WebP file."""
    h, w = pixels.shape[:2]
    out = Writer()
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    raw = np.ascontiguousarray(pixels).view("<u4").reshape(-1)
    flat = raw & 0xFF00FF00 | (raw & 255) << 16 | raw >> 16 & 255
    px = lambda rows=None: pixels[:rows, :, [3, 0, 1, 2]]
    few = np.unique(flat[:256])
    colours = np.unique(flat) if len(few) <= 16 else few
    if len(colours) <= 16:
        n = len(colours)
        packed = 3 if n <= 2 else 2 if n <= 4 else 1
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(n - 1, 8)
        table_ = np.stack([colours >> s & 255 for s in (24, 16, 8, 0)], -1).astype(np.int64)
        put_image(out, _argb((table_ - np.concatenate([np.zeros((1, 4), np.int64), table_[:-1]])) & 255), False)
        per, wide = 1 << packed, 8 >> packed
        index = np.zeros((h, (w + per - 1) // per * per), np.int64)
        index[:, :w] = np.searchsorted(colours, flat).reshape(h, w)
        index = (index.reshape(h, -1, per) << (np.arange(per) * wide)).sum(-1)
        out.put(0, 1)
        put_image(out, (index.reshape(-1) << 8 | 0xFF000000).astype(np.uint32), True)
    else:
        sample = px(max(1, 512 // w))
        way = min(_WAYS, key=lambda k: (_cost(_WAYS[k](sample).reshape(-1, 4)), k))
        if way == 3:
            out.put(1, 1)
            out.put(SUBTRACT_GREEN, 2)
        elif way:
            out.put(1, 1)
            out.put(PREDICTOR, 2)
            out.put(9 - 2, 3)
            put_image(out, np.full(((w + 511) >> 9) * ((h + 511) >> 9), way << 8, np.uint32), False)
        out.put(0, 1)
        put_image(out, _argb(_WAYS[way](px())) if way else flat, True, CACHE_BITS, text_codes() if not way and len(flat) < OWN_CODES else None)
    data = b"\x2f" + out.value.to_bytes((out.size + 7) // 8, "little")
    pad = len(data) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(data) + pad) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * pad


def store_payload(text: bytes) -> bytes:
    """A payload, padded with 255 to a positive multiple of UNIT, as one or more WebP files in a row."""
    pad = (-len(text)) % UNIT or (0 if text else UNIT)
    px = np.frombuffer(text + b"\xff" * pad, np.uint8).reshape(-1, ROW, 4)
    return b"".join(encode(px[a : a + MOST_ROWS]) for a in range(0, len(px), MOST_ROWS))


def images(stored: bytes) -> Iterator[np.ndarray]:
    """The pixel arrays of a run of WebP files."""
    at = 0
    while at < len(stored):
        end = at + 8 + struct.unpack_from("<I", stored, at + 4)[0]
        yield decode(stored[at:end])
        at = end


@functools.lru_cache(1024)
def _blocks(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of 64 parts of n samples begins, and its size."""
    cuts = np.linspace(0, n, 65).astype(np.int64)
    return cuts[:-1], np.diff(cuts)


def feature(parts: list[np.ndarray]) -> str:
    """Mean and deviation of each channel, and whether each of 8 x 8 blocks is lighter than the mean, as hex."""
    px = (parts[0] if len(parts) == 1 else np.concatenate(parts)).reshape(-1, 4)
    n = len(px)
    total = px.sum(0, dtype=np.int64)
    square = np.array([np.dot(c, c) for c in px.T.astype(np.float32)], np.float64) if n < 1 << 12 else (px.astype(np.float64) ** 2).sum(0)
    mean = total / n
    deviation = np.sqrt(np.maximum(square / n - mean**2, 0))
    light = px.reshape(-1)
    cuts, size = _blocks(len(light))
    blocks = np.add.reduceat(light, cuts, dtype=np.int64) / size
    return "|".join([*(f"{m:.3f},{d:.3f}" for m, d in zip(mean, deviation, strict=True)), np.packbits(blocks > total.sum() / (4 * n)).tobytes().hex()])


STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            texts = [t.as_py() or b"" for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(map(store_payload, texts), pa.binary())], names=["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for m in b.column("media"):
            m = m.as_py()
            parts = list(images(m))
            payload = b"".join(p.tobytes() for p in parts)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(parts)))
        made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *made], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def store_media(docs: DataFrame, folder: str) -> DataFrame:
    """docs (doc_id, text) as a table of media in a shared folder."""
    docs.select("doc_id", "text").mapInArrow(_store, STORED).write.option("compression", "zstd").mode("overwrite").parquet(folder)
    return docs.sparkSession.read.schema(STORED).parquet(folder)


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of the decoded media."""
    return media.mapInArrow(_read, READ)


def pixel_arrays(media: DataFrame) -> DataFrame:
    """One row per image of each media value: doc_id, image number, rows, columns, samples (R, G, B, A)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, m in zip(b.column("doc_id").to_pylist(), b.column("media"), strict=True):
                for k, p in enumerate(images(m.as_py() or b"")):
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), *(pa.array([x], pa.int32()) for x in (k, *p.shape[:2])), pa.array([p.tobytes()], pa.binary())], names=["doc_id", "image", "n_rows", "n_columns", "samples"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, image int, n_rows int, n_columns int, samples binary")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_media(table(spark, sf_dir, "documents"), new_folder(spark, "media")))
