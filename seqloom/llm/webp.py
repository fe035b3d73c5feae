"""Lossless WebP, written and read without an image library.

:func:`decode` reads any VP8L stream (all four transforms, colour cache,
back-references, several prefix-code groups) one symbol at a time.
:func:`decode_frames` reads many plain streams together: one symbol of every
stream per numpy step, so a block of documents is decoded without a Python loop
over samples; streams of another shape go to the general reader.
:func:`encode_image` writes one image with any choice of transforms, and
:func:`encode_frames` writes many grey strips together.

A payload of bytes is stored as grey samples, 192 a row.  Rows beyond
``FRAME_ROWS`` become further frames of an animated file, each a strip of the
canvas, so no payload outgrows the 16384-pixel limit of a frame and the memory
for a frame is bounded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

WIDTH = 192
FRAME_ROWS = 64
MAX_BITS = 12  # of the codes that the frame writer makes
GREEN, SMALL, DIST = 256 + 24, 256, 40

# Fixed values of the format: the order in which code-length code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3

#: Short distance codes 1..120 name near pixels, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Damaged(ValueError):
    """The stream is not lossless WebP."""


# ---------------------------------------------------------------- bits and codes


class BitReader:
    """Least significant bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at * 8

    def read(self, n: int) -> int:
        if self.at + n > len(self.data) * 8 + 64:
            raise Damaged("the stream ends early")
        byte = self.at >> 3
        value = int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


class BitWriter:
    def __init__(self):
        self.value, self.bits = 0, 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.bits
        self.bits += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.bits + 7) // 8, "little")


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of code lengths, bit-reversed as the stream has them."""
    used = np.flatnonzero(lengths)
    if not len(used):
        return np.zeros(len(lengths), np.int64)
    order = used[np.argsort(lengths[used], kind="stable")]
    steps = 1 << (15 - lengths[order].astype(np.int64))
    starts = np.cumsum(steps) - steps
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = _FLIP15[starts]  # a code's bits stand at the top of its start
    return codes


_FLIP15 = np.array([0], np.int64)
for _ in range(15):
    _FLIP15 = np.concatenate([_FLIP15 * 2, _FLIP15 * 2 + 1])

_FLIPS: dict[int, np.ndarray] = {}


def flips(bits: int) -> np.ndarray:
    if bits not in _FLIPS:
        _FLIPS[bits] = _FLIP15[: 1 << bits] >> (15 - bits)
    return _FLIPS[bits]


def lookup(lengths: np.ndarray, bits: int = 0) -> tuple[np.ndarray, int]:
    """A table from the next bits to symbol * 16 + length, and its number of bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 0:
        raise Damaged("an empty prefix code")
    if len(used) == 1:  # one symbol takes no bits
        return np.full(1 << bits, used[0] << 4, np.int32), bits
    own = lengths[used].astype(np.int64)
    top = max(bits, int(own.max()))
    order = np.argsort(own, kind="stable")
    steps = 1 << (top - own[order])
    if steps.sum() != 1 << top:
        raise Damaged("a prefix code that isn't complete")
    table = np.repeat((used[order] << 4) | own[order], steps).astype(np.int32)
    return table[flips(top)], top


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths of at most ``limit`` bits."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].tolist()
    n = len(weights)
    while True:
        # leaves in order and pairs in the order they are made: the two smallest are at a front
        made: list[int] = []
        parent = [0] * (2 * n - 1)
        leaf = pair = 0
        for k in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (pair >= len(made) or weights[leaf] <= made[pair]):
                    total += weights[leaf]
                    parent[leaf] = k
                    leaf += 1
                else:
                    total += made[pair]
                    parent[n + pair] = k
                    pair += 1
            made.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= limit:
            lengths[order] = depth[:n]
            return lengths
        weights = sorted(w // 2 + 1 for w in weights)


def prefix_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix code, number of extra bits and extra bits of lengths or distances >= 1."""
    v = np.asarray(values, np.int64) - 1
    top = np.zeros_like(v)
    big = v >= 4
    top[big] = np.floor(np.log2(v[big])).astype(np.int64)
    extra = np.where(big, top - 1, 0)
    second = np.where(big, (v >> np.maximum(top - 1, 0)) & 1, 0)
    code = np.where(big, 2 * top + second, v)
    return code, extra, np.where(big, v & ((1 << extra) - 1), 0)


def _value_of(reader: BitReader, code: int) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + reader.read(extra) + 1


# ---------------------------------------------------------------- the general reader


def _read_lengths(r: BitReader, alphabet: int) -> np.ndarray:
    lengths = np.zeros(alphabet, np.uint8)
    if r.read(1):
        n = r.read(1) + 1
        lengths[r.read(8 if r.read(1) else 1)] = 1
        if n == 2:
            lengths[r.read(8)] = 1
        return lengths
    own = np.zeros(19, np.uint8)
    for i in range(4 + r.read(4)):
        own[LENGTH_ORDER[i]] = r.read(3)
    table, bits = lookup(own)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
    at, last, data, pos = 0, 8, r.data, r.at
    table = table.tolist()
    mask = (1 << bits) - 1
    while at < alphabet and left > 0:
        left -= 1
        byte = pos >> 3
        window = int.from_bytes(data[byte : byte + 4], "little") >> (pos & 7)
        entry = table[window & mask]
        pos += entry & 15
        symbol = entry >> 4
        if symbol < 16:
            lengths[at] = symbol
            last = symbol or last
            at += 1
            continue
        window >>= entry & 15
        base, more = ((3, 2), (3, 3), (11, 7))[symbol - 16]
        n = base + (window & ((1 << more) - 1))
        pos += more
        if at + n > alphabet:
            raise Damaged("code lengths run over")
        if symbol == 16:
            lengths[at : at + n] = last
        at += n
    r.at = pos
    return lengths


class Group:
    """The five prefix codes of a group."""

    def __init__(self, r: BitReader, cache: int):
        self.tables = []
        for size in (GREEN + cache, SMALL, SMALL, SMALL, DIST):
            lengths = _read_lengths(r, size)
            table, bits = lookup(lengths)
            self.tables.append((table.tolist(), (1 << bits) - 1))


def _image(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as uint32 ARGB."""
    cache_bits = r.read(4) if r.read(1) else 0
    cache_size = 1 << cache_bits if cache_bits else 0
    if cache_bits > 11:
        raise Damaged("a colour cache that's too large")
    cache = [0] * cache_size
    tile, groups_of, ngroups = 0, None, 1
    if main and r.read(1):
        tile = r.read(3) + 2
        tw = (width + (1 << tile) - 1) >> tile
        entropy = _image(r, tw, (height + (1 << tile) - 1) >> tile, False)
        groups_of = ((entropy >> 8) & 0xFFFF).tolist()
        ngroups = max(map(max, groups_of)) + 1
    groups = [Group(r, cache_size) for _ in range(ngroups)]
    total, out, at = width * height, [], 0
    limit = len(r.data) * 8 + 8

    def symbol(table: tuple[list[int], int]) -> int:
        byte = r.at >> 3
        entry = table[0][(int.from_bytes(r.data[byte : byte + 3], "little") >> (r.at & 7)) & table[1]]
        r.at += entry & 15
        return entry >> 4

    while at < total:
        if r.at > limit:
            raise Damaged("the stream ends early")
        if groups_of is None:
            tables = groups[0].tables
        else:
            tables = groups[groups_of[(at // width) >> tile][(at % width) >> tile]].tables
        s = symbol(tables[0])
        if s < 256:
            red = symbol(tables[1])
            blue = symbol(tables[2])
            alpha = symbol(tables[3])
            new = [(alpha << 24) | (red << 16) | (s << 8) | blue]
        elif s < GREEN:
            n = _value_of(r, s - 256)
            d = _value_of(r, symbol(tables[4]))
            if d <= 120:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            else:
                d -= 120
            if d > at or at + n > total:
                raise Damaged("a back-reference out of bounds")
            for k in range(n):
                out.append(out[at + k - d])
            new = out[at:] if cache_size else ()
            at += n
            for argb in new:
                cache[((0x1E35A7BD * argb) & 0xFFFFFFFF) >> (32 - cache_bits)] = argb
            continue
        else:
            new = [cache[s - GREEN]]
        out += new
        at += 1
        if cache_size:
            cache[((0x1E35A7BD * new[0]) & 0xFFFFFFFF) >> (32 - cache_bits)] = new[0]
    return np.array(out, np.uint32).reshape(height, width)


def _planes(argb: np.ndarray) -> np.ndarray:
    return np.stack([(argb >> s) & 255 for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _joined(planes: np.ndarray) -> np.ndarray:
    p = (planes & 255).astype(np.uint32)
    return (p[..., 0] << 24) | (p[..., 1] << 16) | (p[..., 2] << 8) | p[..., 3]


def _predicted(mode: int, left, top, top_right, top_left):
    """What a predictor mode gives from the four neighbours (lists of A, R, G, B)."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 6:
        return mean(left, top_left)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(top_left, top)
    if mode == 9:
        return mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        guess = [a + b - c for a, b, c in zip(left, top, top_left)]
        nearer_left = sum(abs(g - a) for g, a in zip(guess, left)) < sum(abs(g - b) for g, b in zip(guess, top))
        return left if nearer_left else top
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(left, top, top_left)]
    if mode == 13:
        half = mean(left, top)
        return [clamp(h + int((h - c) / 2)) for h, c in zip(half, top_left)]
    return [255, 0, 0, 0]


def _predict(image: np.ndarray, modes: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """Add (undo) or take off the predictions.  Rows hold lists of A, R, G, B."""
    height, width = image.shape
    source = _planes(image).tolist()
    known = [] if undo else source
    out = []
    for y in range(height):
        row, done = source[y], []
        if undo:
            known.append(done)
        for x in range(width):
            if y == 0 and x == 0:
                guess = [255, 0, 0, 0]
            elif y == 0:
                guess = known[0][x - 1]
            elif x == 0:
                guess = known[y - 1][0]
            else:
                up = known[y - 1]
                # right of the last column stands the first pixel of the row itself
                corner = up[x + 1] if x + 1 < width else known[y][0]
                guess = _predicted(int(modes[y >> bits, x >> bits]), known[y][x - 1], up[x], corner, up[x - 1])
            sign = 1 if undo else -1
            done.append([(v + sign * g) & 255 for v, g in zip(row[x], guess)])
        out.append(done)
    return _joined(np.array(out, np.int64))


def _cross_color(image: np.ndarray, factors: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """Red and blue against green, blue against red, by a tile's three factors."""
    height, width = image.shape
    y, x = np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits
    f = factors[y, x]
    signed = lambda v: ((v.astype(np.int64) & 255) ^ 128) - 128
    green_red, green_blue, red_blue = signed(f), signed(f >> 8), signed(f >> 16)
    p = _planes(image)
    green = signed(p[..., 2])
    sign = 1 if undo else -1
    red = (p[..., 1] + sign * ((green_red * green) >> 5)) & 255
    base = red if undo else p[..., 1]
    p[..., 3] = (p[..., 3] + sign * (((green_blue * green) >> 5) + ((red_blue * signed(base)) >> 5))) & 255
    p[..., 1] = red
    return _joined(p)


def decode_stream(data: bytes) -> np.ndarray:
    """The pixels (height, width) of a VP8L stream as uint32 ARGB."""
    if not data or data[0] != 0x2F:
        raise Damaged("no VP8L signature")
    r = BitReader(data, 1)
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise Damaged("an unknown version")
    todo, own = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS_COLOR):
            bits = r.read(3) + 2
            up = lambda n, b=bits: (n + (1 << b) - 1) >> b
            todo.append((kind, bits, _image(r, up(own), up(height), False)))
        elif kind == PALETTE:
            n = r.read(8) + 1
            colours = _joined(np.cumsum(_planes(_image(r, n, 1, False)[0]), 0))
            bits = _bits_of(n)
            todo.append((kind, bits, (colours, own)))
            own = (own + (1 << bits) - 1) >> bits
        else:
            todo.append((kind, 0, None))
    image = _image(r, own, height, True)
    for kind, bits, with_ in reversed(todo):
        if kind == PREDICTOR:
            image = _predict(image, (with_ >> 8) & 15, bits, True)
        elif kind == CROSS_COLOR:
            image = _cross_color(image, with_, bits, True)
        elif kind == SUBTRACT_GREEN:
            p = _planes(image)
            p[..., 1] += p[..., 2]
            p[..., 3] += p[..., 2]
            image = _joined(p)
        else:
            colours, full = with_
            index = (image >> 8) & 255
            if bits:
                each = 8 >> bits
                shifts = np.arange(1 << bits) * each
                index = ((index[..., None] >> shifts) & ((1 << each) - 1)).reshape(height, -1)[:, :full]
            padded = np.zeros(256, np.uint32)
            padded[: len(colours)] = colours
            image = padded[index]
    return image


# ---------------------------------------------------------------- the general writer


#: Code lengths are written with sixteen symbols of four bits each: a complete code.
_SHORT = {s: int(f"{i:04b}"[::-1], 2) for i, s in enumerate([*range(13), 16, 17, 18])}
_LENGTH_HEAD = (sum((0 if s in (13, 14, 15) else 4) << (5 + 3 * i) for i, s in enumerate(LENGTH_ORDER)) | 15 << 1, 5 + 3 * 19)


def _write_lengths(w: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        w.write(1, 1)
        symbols = [int(x) for x in used] or [0]
        w.write(len(symbols) - 1, 1)
        w.write(1, 1)
        w.write(symbols[0], 8)
        if len(symbols) == 2:
            w.write(symbols[1], 8)
        return
    value, n = _LENGTH_HEAD
    count, body, size = 0, 0, 0
    run = 0
    for v in lengths[: int(used[-1]) + 1].tolist():
        if not v:
            run += 1
            continue
        while run:
            k = min(run, 138)
            if k < 3:
                token, bits = _SHORT[0], 4
                k = 1
            elif k < 11:
                token, bits = _SHORT[17] | (k - 3) << 4, 7
            else:
                token, bits = _SHORT[18] | (k - 11) << 4, 11
            body |= token << size
            size += bits
            count += 1
            run -= k
        body |= _SHORT[v] << size
        size += 4
        count += 1
    if count < 2:
        body |= _SHORT[0] << size
        size += 4
        count += 1
    wide = 8 if count < 258 else 16
    w.write(value, n)
    w.write(1, 1)
    w.write((wide - 2) // 2, 3)
    w.write(count - 2, wide)
    w.write(body, size)


def _write_image(w: BitWriter, image: np.ndarray, main: bool, cache_bits: int = 0, tile: int = 0, matches: bool = False) -> None:
    """One entropy-coded image; ``tile`` > 0 gives tile columns their own codes by turns."""
    height, width = image.shape
    flat = image.ravel().tolist()
    w.write(int(cache_bits > 0), 1)
    if cache_bits:
        w.write(cache_bits, 4)
    ngroups = 1
    if main:
        w.write(int(tile > 0), 1)
        if tile:
            w.write(tile - 2, 3)
            tw, th = (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
            which = (np.arange(th)[:, None] + np.arange(tw)) % 2
            _write_image(w, (which << 8).astype(np.uint32), False)
            ngroups = int(which.max()) + 1
    group = lambda p: (((p // width) >> tile) + ((p % width) >> tile)) % 2 if tile and main else 0
    cache: dict[int, int] = {}
    tokens, seen, p = [], {}, 0
    while p < len(flat):
        n, d = 0, 0
        key = tuple(flat[p : p + 3])
        if matches and key in seen and len(key) == 3:
            d = p - seen[key]
            while p + n < len(flat) and flat[p + n] == flat[p + n - d] and n < 4096:
                n += 1
        if n >= 3:
            tokens.append((p, "copy", n, d))
        else:
            slot = (0x1E35A7BD * flat[p] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else -1
            n = 1
            tokens.append((p, "cache", slot, 0) if cache_bits and cache.get(slot) == flat[p] else (p, "pixel", flat[p], 0))
        for k in range(n):
            if cache_bits:
                cache[(0x1E35A7BD * flat[p + k] & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[p + k]
            seen[tuple(flat[p + k : p + k + 3])] = p + k
        p += n
    sizes = (GREEN + (1 << cache_bits if cache_bits else 0), SMALL, SMALL, SMALL, DIST)
    near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}
    coded, counts = [], [[np.zeros(s, np.int64) for s in sizes] for _ in range(ngroups)]
    for p, kind, a, b in tokens:
        if kind == "pixel":
            parts = [(0, (a >> 8) & 255, 0, 0), (1, (a >> 16) & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)]
        elif kind == "cache":
            parts = [(0, GREEN + a, 0, 0)]
        else:
            code, bits, extra = (int(x[0]) for x in prefix_of(np.array([a])))
            far = near.get(b, b + 120)
            dcode, dbits, dextra = (int(x[0]) for x in prefix_of(np.array([far])))
            parts = [(0, 256 + code, extra, bits), (4, dcode, dextra, dbits)]
        g = group(p)
        coded.append((g, parts))
        for t, s, _, _ in parts:
            counts[g][t][s] += 1
    codes = []
    for g in range(ngroups):
        codes.append([])
        for t in range(5):
            lengths = code_lengths(counts[g][t], MAX_BITS)
            _write_lengths(w, lengths)
            if (lengths > 0).sum() <= 1:
                codes[-1].append((canonical(lengths), np.zeros_like(lengths)))
            else:
                codes[-1].append((canonical(lengths), lengths))
    for g, parts in coded:
        for t, s, extra, bits in parts:
            code, lengths = codes[g][t]
            w.write(int(code[s]) if lengths[s] else 0, int(lengths[s]))
            w.write(extra, bits)


def encode_image(argb: np.ndarray, transforms: Iterable[int] = (), cache_bits: int = 0, tile: int = 0, matches: bool = True, bits: int = 2) -> bytes:
    """A VP8L stream of uint32 ARGB pixels (height, width), with the transforms named, in order."""
    image = np.asarray(argb, np.uint32)
    height, width = image.shape
    w = BitWriter()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(1, 1)
    w.write(0, 3)
    for kind in transforms:
        h, n = image.shape
        tiles = ((h + (1 << bits) - 1) >> bits, (n + (1 << bits) - 1) >> bits)
        w.write(1, 1)
        w.write(kind, 2)
        if kind == PREDICTOR:  # every mode by turns
            modes = np.arange(tiles[0] * tiles[1]).reshape(tiles) % 14
            w.write(bits - 2, 3)
            _write_image(w, (modes << 8).astype(np.uint32), False)
            image = _predict(image, modes, bits, False)
        elif kind == CROSS_COLOR:
            rng = np.random.default_rng(7)
            factors = rng.integers(0, 1 << 24, tiles).astype(np.uint32)
            w.write(bits - 2, 3)
            _write_image(w, factors, False)
            image = _cross_color(image, factors, bits, False)
        elif kind == SUBTRACT_GREEN:
            p = _planes(image)
            p[..., 1] -= p[..., 2]
            p[..., 3] -= p[..., 2]
            image = _joined(p)
        else:
            colours, index = np.unique(image, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("more than 256 colours")
            w.write(len(colours) - 1, 8)
            _write_image(w, _joined(np.diff(_planes(colours), axis=0, prepend=0))[None, :], False)
            index = index.reshape(image.shape).astype(np.uint32)
            n = len(colours)
            own = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            if own:
                each, fill = 8 >> own, -index.shape[1] % (1 << own)
                index = np.pad(index, ((0, 0), (0, fill))).reshape(index.shape[0], -1, 1 << own)
                index = (index << (np.arange(1 << own) * each).astype(np.uint32)).sum(-1).astype(np.uint32)
            image = index << 8
    w.write(0, 1)
    _write_image(w, image, True, cache_bits, tile, matches)
    return w.bytes()


# ---------------------------------------------------------------- many grey strips together


PLAIN, LEFT, TOP, COLOURS = range(4)  # how a grey strip is stored


def _head(height: int, way: int, colours: np.ndarray | None) -> BitWriter:
    w = BitWriter()
    w.write(0x2F, 8)
    w.write(WIDTH - 1, 14)
    w.write(height - 1, 14)
    w.write(0, 1)
    w.write(0, 3)
    w.write(1, 1)
    if way == COLOURS:
        w.write(PALETTE, 2)
        w.write(len(colours) - 1, 8)
        grey = 0xFF000000 | colours.astype(np.uint32) * 0x010101
        _write_image(w, _joined(np.diff(_planes(grey), axis=0, prepend=0))[None, :], False)
    else:
        w.write(SUBTRACT_GREEN, 2)
        if way != PLAIN:  # one tile, one mode: the pixel to the left (1) or above (2)
            w.write(1, 1)
            w.write(PREDICTOR, 2)
            w.write(7, 3)
            _write_image(w, np.array([[(1 if way == LEFT else 2) << 8]], np.uint32), False)
    w.write(0, 1)  # no further transform
    w.write(0, 1)  # no colour cache
    w.write(0, 1)  # one group of codes
    return w


def _packed(rows: np.ndarray, colours: np.ndarray) -> np.ndarray:
    """Palette indices of strip rows, two, four or eight to a byte where that's all they need."""
    index = np.searchsorted(colours, rows).astype(np.uint8)
    more = _bits_of(len(colours))
    if not more:
        return index
    each = 8 >> more
    return (index.reshape(len(rows), -1, 1 << more) << (np.arange(1 << more) * each).astype(np.uint8)).sum(-1).astype(np.uint8)


def _bits_of(colours: int) -> int:
    """How many times pixels of so many colours are packed in halves."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _entropy(values: np.ndarray, frame: np.ndarray, nf: int) -> np.ndarray:
    """About the bits that each strip's samples take: those inside runs go to back-references."""
    inside = np.zeros(len(values), bool)
    inside[2:] = (values[2:] == values[1:-1]) & (values[2:] == values[:-2])
    counts = np.bincount(frame[~inside] * 256 + values[~inside], minlength=nf * 256).reshape(nf, 256).astype(float)
    total = counts.sum(1, keepdims=True)
    return (counts * np.log2(np.maximum(total, 1) / np.maximum(counts, 1e-9), where=counts > 0, out=np.zeros_like(counts))).sum(1) + 8.0 * (counts > 0).sum(1)


def choose_ways(samples: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """For each strip the way that takes the fewest bits: the samples to store, where each strip's begin, ways and palettes.

    A strip is stored as it is, as differences to the left or above, or as indices into up
    to sixteen colours.  Grey pixels leave nothing for a cross-colour transform or a colour
    cache to save, so these are read but never written here.
    """
    nf, size = len(bounds) - 1, np.diff(bounds)
    frame = np.repeat(np.arange(nf), size)
    at = np.arange(len(samples)) - np.repeat(bounds[:-1], size)
    left, above = samples.copy(), samples.copy()
    left[1:] -= samples[:-1]
    above[WIDTH:] -= samples[:-WIDTH]
    first_row, first_column = at < WIDTH, at % WIDTH == 0
    left[first_column] = above[first_column]
    above[first_row] = left[first_row]
    start = bounds[:-1]
    left[start] = above[start] = samples[start]
    bits = np.stack([_entropy(x, frame, nf) for x in (samples, left, above)])
    bits[1:] += 60
    way = bits.argmin(0)
    kinds = (np.bincount(frame * 256 + samples, minlength=nf * 256).reshape(nf, 256) > 0).sum(1)
    palettes: list[np.ndarray | None] = [None] * nf
    own = np.where(np.repeat(way == LEFT, size), left, np.where(np.repeat(way == TOP, size), above, samples))
    pieces = {}
    for f in np.flatnonzero(kinds <= 16).tolist():
        rows = samples[bounds[f] : bounds[f + 1]].reshape(-1, WIDTH)
        colours = np.unique(rows)
        packed = _packed(rows, colours).ravel()
        if _entropy(packed, np.zeros(len(packed), np.int64), 1)[0] + 60 + 8 * len(colours) < bits[way[f], f]:
            way[f], palettes[f], pieces[f] = COLOURS, colours, packed
    if pieces:
        parts = [pieces.get(f, own[bounds[f] : bounds[f + 1]]) for f in range(nf)]
        own, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return own, bounds, way, palettes


def encode_frames(samples: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Grey strips of WIDTH samples a row, strip i at bounds[i]:bounds[i + 1].

    Grey less green leaves one channel; each strip takes the transform that makes it least,
    and runs of a sample become back-references.
    """
    if len(samples) == 0:
        return []
    heights = np.diff(bounds) // WIDTH
    samples, bounds, ways, palettes = choose_ways(samples, np.asarray(bounds))
    n, nf = len(samples), len(bounds) - 1
    same = np.zeros(n, bool)
    same[1:] = samples[1:] == samples[:-1]
    same[bounds[:-1]] = False
    heads = np.flatnonzero(~same)
    run = np.diff(np.append(heads, n))
    long = run >= 5
    keep = np.ones(n, bool)
    inside = np.repeat(long, run) & same
    keep[inside] = False
    # a copy starts after the head of its run, and again each 4096 samples
    offset = np.arange(n, dtype=np.int32) - np.repeat(heads.astype(np.int32), run)
    copy = inside & ((offset - 1) & 4095 == 0)
    at = np.flatnonzero(keep | copy)
    is_copy = copy[at]
    symbol = samples[at].astype(np.int32)
    copies = np.flatnonzero(is_copy)
    if len(copies):
        rest = (np.repeat(run, run) - offset)[at[is_copy]]
        code, extra_bits, extra = prefix_of(np.minimum(rest, 4096))
        symbol[copies] = 256 + code
    begin = np.searchsorted(at, bounds)
    frame = np.repeat(np.arange(nf, dtype=np.int32), np.diff(begin))
    key = frame * np.int32(GREEN) + symbol
    counts = np.bincount(key, minlength=nf * GREEN).reshape(nf, GREEN)
    has_copy = counts[:, 256:].any(1)
    lengths = np.zeros((nf, GREEN), np.int64)
    codes = np.zeros((nf, GREEN), np.int64)
    starts = []
    for f in range(nf):
        own = code_lengths(counts[f], MAX_BITS)
        w = _head(int(heights[f]), int(ways[f]), palettes[f])
        _write_lengths(w, own)
        used = np.flatnonzero(own)
        if len(used) > 1:
            lengths[f] = own
        elif used[0] >= 256:  # can't be: a strip starts with a sample
            raise AssertionError("a strip without samples")
        w.write(0b101, 3)  # red: simple, one symbol of eight bits
        w.write(0, 8)
        w.write(0b101, 3)
        w.write(0, 8)
        w.write(0b101, 3)
        w.write(255 if ways[f] == PLAIN else 0, 8)
        w.write(0b101, 3)  # distances: code 1, the pixel to the left
        w.write(1 if has_copy[f] else 0, 8)
        starts.append(w)
    ordered = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    sorted_lengths = np.take_along_axis(lengths, ordered, 1)
    steps = np.where(sorted_lengths > 0, 1 << (15 - sorted_lengths), 0)
    np.put_along_axis(codes, ordered, _FLIP15[(np.cumsum(steps, 1) - steps) & 0x7FFF], 1)
    # length and code of a symbol in one look-up
    both = (lengths | (codes << 8)).astype(np.int32).ravel()[key]
    size = both & 255
    value = (both >> 8).astype(np.uint64)
    if len(copies):
        value[copies] |= extra.astype(np.uint64) << size[copies].astype(np.uint64)
        size[copies] += extra_bits.astype(np.int32)
    done = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=done[1:])
    total = np.diff(done[begin])
    head_bits = np.array([w.bits for w in starts], np.int64)
    words = (head_bits + total + 31) // 32 + 1
    first_word = np.concatenate([[0], np.cumsum(words)])
    pos = done[:-1] + np.repeat(first_word[:-1] * 32 + head_bits - done[begin[:-1]], np.diff(begin))
    shifted = value << (pos & 31).astype(np.uint64)
    low = (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64)
    high = (shifted >> np.uint64(32)).astype(np.float64)
    m = int(first_word[-1]) + 1
    word = pos >> 5
    packed = np.bincount(word, weights=low, minlength=m)
    packed[1:] += np.bincount(word, weights=high, minlength=m)[:-1]
    packed = packed.astype(np.uint64).astype("<u4")
    out = []
    for f in range(nf):
        body = bytearray(packed[first_word[f] : first_word[f + 1]].tobytes())
        head = starts[f].bytes()
        last = len(head) - 1
        body[: last] = head[:last]
        body[last] |= head[last]
        out.append(bytes(body[: (int(head_bits[f] + total[f]) + 7) // 8]))
    return out


def _plain(data: bytes) -> tuple[BitReader, int, int, np.ndarray, int, tuple] | None:
    """Height, width as stored, green code lengths, distance and transform of a stream that the batch reader takes."""
    r = BitReader(data, 1)
    if data[0] != 0x2F or r.read(14) + 1 != WIDTH:
        return None
    height = r.read(14) + 1
    r.read(4)
    way, width = [], WIDTH
    while r.read(1):
        kind = r.read(2)
        if kind == SUBTRACT_GREEN and not way:
            way = [PLAIN]
        elif kind == PREDICTOR and way == [PLAIN]:
            if r.read(3) != 7:
                return None
            mode = (int(_image(r, 1, 1, False)[0, 0]) >> 8) & 15
            if mode not in (1, 2):
                return None
            way = [LEFT if mode == 1 else TOP]
        elif kind == PALETTE and not way:
            colours = np.cumsum(_planes(_image(r, r.read(8) + 1, 1, False)[0])[:, 2]) & 255
            way = [COLOURS, colours.astype(np.uint8)]
            width = -(-WIDTH >> _bits_of(len(colours)))
        else:
            return None
    if not way or r.read(2):  # no transform, or a colour cache or several groups
        return None
    green = _read_lengths(r, GREEN)
    for constant in (0, 0, 255 if way[0] == PLAIN else 0):
        own = np.flatnonzero(_read_lengths(r, SMALL))
        if len(own) != 1 or own[0] != constant:
            return None
    distance = np.flatnonzero(_read_lengths(r, DIST))
    if len(distance) != 1 or distance[0] > 3:
        return None
    x, y = NEAR[int(distance[0])]
    return r, height, width, green, max(1, x + y * width), tuple(way)


def _undone(stored: np.ndarray, height: int, way: tuple) -> np.ndarray:
    """The grey samples of a strip from what is stored of it."""
    rows = stored.reshape(height, -1)
    if way[0] == LEFT:
        rows = rows.copy()
        rows[:, 0] = np.cumsum(rows[:, 0], dtype=np.uint8)
        rows = np.cumsum(rows, axis=1, dtype=np.uint8)
    elif way[0] == TOP:
        rows = rows.copy()
        rows[0] = np.cumsum(rows[0], dtype=np.uint8)
        rows = np.cumsum(rows, axis=0, dtype=np.uint8)
    elif way[0] == COLOURS:
        more = _bits_of(len(way[1]))
        if more:
            each = 8 >> more
            rows = ((rows[..., None] >> (np.arange(1 << more) * each).astype(np.uint8)) & ((1 << each) - 1)).reshape(height, -1)[:, :WIDTH]
        padded = np.zeros(256, np.uint8)
        padded[: len(way[1])] = way[1]
        rows = padded[rows]
    return rows.ravel()


def decode_frames(streams: list[bytes]) -> list[np.ndarray]:
    """The grey samples of each stream; every step reads one symbol of all that are left."""
    out: list[np.ndarray | None] = [None] * len(streams)
    found = []
    for i, data in enumerate(streams):
        if (plain := _plain(data)) is None:
            out[i] = ((decode_stream(data) >> 8) & 255).astype(np.uint8).ravel()
        else:
            found.append((i, *plain))
    if not found:
        return out
    bits = max(1, *(int(g.max()) for _, _, _, _, g, _, _ in found))
    nf = len(found)
    tables = np.concatenate([lookup(g, bits)[0] for _, _, _, _, g, _, _ in found])
    sizes = np.array([h * width for _, _, h, width, _, _, _ in found], np.int64)
    begin = np.zeros(nf, np.int64)
    parts, at = [], 0
    for k, (i, r, *_) in enumerate(found):
        begin[k] = at * 8 + r.at
        parts.append(streams[i])
        at += len(streams[i])
    tables = tables.astype(np.int16) if int(tables.max()) < 1 << 15 else tables
    # a damaged stream reads on past its end, two bytes a sample at most, before it's found
    joined = np.frombuffer(b"".join(parts) + bytes(16 + 2 * int(sizes.max())), np.uint8)
    windows = np.lib.stride_tricks.as_strided(joined.view(np.uint8)[:8].view("<u8"), (len(joined) - 8,), (1,))
    end = 8 * np.cumsum([len(p) for p in parts])
    live = np.arange(nf)
    pos, base, left = begin, live * (1 << bits), sizes.copy()
    mask = np.uint64((1 << bits) - 1)
    frames, symbols, counts = [], [], []
    names = live.astype(np.uint16) if nf < 65536 else live
    until = int(left.min())
    while len(live):
        window = windows[pos >> 3] >> (pos & 7).astype(np.uint64)
        entry = tables[base + (window & mask).astype(np.int64)]
        size = entry & 15
        pos = pos + size
        count = None
        symbol = entry >> 4
        copies = entry >= 4096
        if copies.any():
            count = np.ones(len(live), np.int32)
            which = np.flatnonzero(copies)
            code = symbol[which].astype(np.int64) - 256
            more = np.where(code < 4, 0, (code - 2) >> 1)
            rest = (window[which] >> size[which].astype(np.uint64)).astype(np.int64) & ((1 << more) - 1)
            count[which] = np.where(code < 4, code + 1, ((2 + (code & 1)) << more) + rest + 1)
            pos[which] += more
            left = left - count
            until = int(left.min())
        else:
            left = left - 1
            until -= 1
        frames.append(names)
        symbols.append(symbol)
        counts.append(count)
        if until <= 0:
            on = left > 0
            if until < 0 or (pos > end[live]).any():
                raise Damaged("a stream that ends early or runs over")
            live, pos, base, left, names = live[on], pos[on], base[on], left[on], names[on]
            until = int(left.min()) if len(left) else 0
    frame = np.concatenate(frames)
    order = np.argsort(frame, kind="stable")
    frame = frame[order].astype(np.int64)
    symbol = np.concatenate(symbols)[order]
    count = np.concatenate([np.ones(len(s), np.int32) if c is None else c for s, c in zip(symbols, counts)])[order].astype(np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    place = np.cumsum(count) - count  # strips are whole, so tokens follow each other
    pixels = np.zeros(int(start[-1]), np.uint8)
    literal = symbol < 256
    pixels[place[literal]] = symbol[literal]
    if not literal.all():
        n, p = count[~literal], place[~literal]
        step = np.array([d for *_, d, _ in found], np.int64)[frame[~literal]]
        if (p - step < start[frame[~literal]]).any():
            raise Damaged("a back-reference out of bounds")
        target = np.repeat(p, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        source = np.arange(len(pixels))
        source[target] = target - np.repeat(step, n)
        while True:  # halve the distance to a sample that's known
            further = source[source[target]]
            if (further == source[target]).all():
                break
            source[target] = further
        pixels[target] = pixels[source[target]]
    for k, (i, _, height, _, _, _, way) in enumerate(found):
        own = pixels[start[k] : start[k + 1]]
        out[i] = own if way[0] == PLAIN else _undone(own, height, way)
    return out


# ---------------------------------------------------------------- files


def _chunk(tag: bytes, data: bytes) -> bytes:
    return tag + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _u24(v: int) -> bytes:
    return v.to_bytes(3, "little")


def container(streams: list[bytes], heights: list[int], width: int = WIDTH) -> bytes:
    """A file of one still stream, or of strips as the frames of an animation."""
    if len(streams) == 1:
        body = _chunk(b"VP8L", streams[0])
    else:
        body = _chunk(b"VP8X", b"\x02\0\0\0" + _u24(width - 1) + _u24(sum(heights) - 1)) + _chunk(b"ANIM", struct.pack("<IH", 0xFF000000, 1))
        top, parts = 0, [body]
        for stream, h in zip(streams, heights, strict=True):
            parts.append(_chunk(b"ANMF", _u24(0) + _u24(top // 2) + _u24(width - 1) + _u24(h - 1) + _u24(0) + b"\x02" + _chunk(b"VP8L", stream)))
            top += h
        body = b"".join(parts)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def streams_of(data: bytes) -> list[bytes]:
    """The VP8L streams of a file, in order."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Damaged("no WebP file")
    end, at, out = min(len(data), 8 + struct.unpack("<I", data[4:8])[0]), 12, []

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            tag, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
            if at + 8 + size > end:
                raise Damaged("a chunk that runs over")
            if tag == b"VP8L":
                out.append(data[at + 8 : at + 8 + size])
            elif tag == b"ANMF":
                walk(at + 24, at + 8 + size)
            at += 8 + size + (size & 1)

    walk(at, end)
    return out


def decode(data: bytes) -> list[np.ndarray]:
    """The frames of a file as uint32 ARGB pixel arrays."""
    return [decode_stream(s) for s in streams_of(data)]
