"""Lossless WebP (VP8L) streams: a decoder for the whole format, and an encoder.

Pictures are arrays of unsigned 32-bit pixels, alpha in the top byte, then red, green and blue.
The decoder reads prefix codes (simple and normal), meta prefix codes, back-references, the colour
cache, and inverts the predictor, cross-colour, subtract-green and palette transforms. The
encoder writes any of these on request; its plain way (prefix codes over single samples) is
vectorised.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

#: The order in which lengths of code lengths are stored (fixed by the format).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Extra bits and base of the repeats 16, 17 and 18 among code lengths (fixed by the format).
REPEATS = {16: (2, 3), 17: (3, 3), 18: (7, 11)}
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
BLACK = 0xFF000000
#: Longest code that the encoder uses; short codes make small tables.
MAX_CODE = 11


def plane_codes() -> list[tuple[int, int]]:
    """Steps left and up of the 120 short distances: nearest first, then by the step left, positive first."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


PLANE = plane_codes()


class Bits:
    """Reads bits, least significant first; past the end come zeros."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.count = data, 0, 0, 0

    def fill(self) -> None:
        self.value |= int.from_bytes(self.data[self.at : self.at + 8], "little") << self.count
        self.at += 8
        self.count += 64

    def read(self, n: int) -> int:
        if self.count < n:
            self.fill()
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.count -= n
        return out


def _turned() -> np.ndarray:
    x = np.arange(1 << 16)
    return sum((x >> i & 1) << 15 - i for i in range(16))


#: All numbers of 16 bits with their bits turned round.
REVERSED = _turned()


@lru_cache(maxsize=256)
def decoding_table(lengths: bytes, place: int = 0) -> tuple[list[int], int]:
    """(table, mask): at the next bits under the mask, symbol << place + 6 | length. A single symbol takes no bits."""
    size = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(size)
    if len(used) == 0:
        return [0], 0
    if len(used) == 1:
        return [int(used[0]) << place + 6], 0
    order = used[np.argsort(size[used], kind="stable")]
    sizes = size[order].astype(np.int64)
    most = int(sizes.max())
    if int((1 << (most - sizes)).sum()) != 1 << most:
        raise ValueError("a prefix code is not complete")
    table = np.repeat(order.astype(np.int64) << place + 6 | sizes, 1 << (most - sizes))
    return table[reversed_bits(np.arange(1 << most), most)].tolist(), (1 << most) - 1


def reversed_bits(x: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """The lowest n bits of numbers below 2^n, turned round; n is 16 at most."""
    return REVERSED[x] >> (16 - n)


#: By alphabet, codes read lately: their stored bits, how many, and the table. The same bits are the same code.
_recent: dict[tuple[int, int], list[tuple[int, int, tuple[list[int], int]]]] = {}


def read_code(bits: Bits, alphabet: int, place: int = 0) -> tuple[list[int], int]:
    recent = _recent.setdefault((alphabet, place), [])
    while bits.count < 640 and bits.at < len(bits.data):
        bits.fill()
    for stored, n, table in recent:
        if n <= bits.count and bits.value & ((1 << n) - 1) == stored:
            bits.value >>= n
            bits.count -= n
            return table
    value, before = bits.value, 8 * bits.at - bits.count
    table = _parse_code(bits, alphabet, place)
    n = 8 * bits.at - bits.count - before
    if n <= 640:
        recent[:] = [(value & ((1 << n) - 1), n, table), *recent[:3]]
    return table


#: Bits that a table of three codes looks up at once, and pixels that make it worth building one.
AHEAD, OFTEN = 17, 1 << 15
#: By the codes' tables (held, so that no other gets their place): pixels read with them, and the table of all three once there is one.
_threes: dict[tuple[int, int, int], list] = {}


def three_codes(codes: list[tuple[list[int], int]], pixels: int) -> list[int] | None:
    """At the next AHEAD bits, the sum of the three codes' entries; 0 if they take more bits. None if the codes are too new for a table."""
    key = tuple(id(table) for table, _ in codes)
    seen = _threes.pop(key, None) or [codes, 0, None]
    _threes[key] = seen  # the last one used is last
    if len(_threes) > 8:
        del _threes[next(iter(_threes))]
    seen[1] += pixels
    if seen[2] is None and seen[1] >= OFTEN:
        left, entry = np.arange(1 << AHEAD), np.zeros(1 << AHEAD, np.int64)
        for table, mask in codes:
            found = np.array(table, np.int64)[left & mask]
            left, entry = left >> (found & 15), entry + found
        seen[2] = np.where((entry & 63) <= AHEAD, entry, 0).tolist()
    return seen[2]


def _parse_code(bits: Bits, alphabet: int, place: int) -> tuple[list[int], int]:
    lengths = bytearray(alphabet)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return decoding_table(bytes(lengths), place)
    small = bytearray(19)
    for i in range(4 + bits.read(4)):
        small[LENGTH_ORDER[i]] = bits.read(3)
    table, mask = decoding_table(bytes(small))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    i, last = 0, 8
    while i < alphabet and left:
        left -= 1
        if bits.count < 16:
            bits.fill()
        entry = table[bits.value & mask]
        bits.value >>= entry & 15
        bits.count -= entry & 15
        what = entry >> 6
        if what < 16:
            lengths[i] = what
            last = what or last
            i += 1
        else:
            extra, base = REPEATS[what]
            run = base + bits.read(extra)
            if i + run > alphabet:
                raise ValueError("code lengths run over the alphabet")
            if what == 16:
                lengths[i : i + run] = bytes([last]) * run
            i += run
    return decoding_table(bytes(lengths), place)


def _prefixed(bits: Bits, code: int) -> int:
    """The length or distance that a prefix symbol and its extra bits stand for."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def read_reference(bits: Bits, symbol: int, far: list[int], mask: int, width: int) -> tuple[int, int]:
    """Run and distance of a back-reference behind the symbol of its run."""
    run = _prefixed(bits, symbol - 256)
    if bits.count < 16:
        bits.fill()
    e = far[bits.value & mask]
    bits.value >>= e & 15
    bits.count -= e & 15
    step = _prefixed(bits, e >> 6)
    if step > 120:
        return run, step - 120
    x, y = PLANE[step - 1]
    return run, max(1, x + y * width)


@dataclass
class Coded:
    """An entropy-coded picture whose codes are read; its pixels come next among the bits."""

    bits: Bits
    width: int
    total: int
    cache_bits: int
    codes: list[list[tuple[list[int], int]]]
    main: bool
    groups_of: list[int] | None
    block: int


def read_codes(bits: Bits, width: int, height: int, main: bool = False) -> Coded:
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_of, block = None, 0
    groups = 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        groups_of = (read_pixels(bits, -(-width >> block), -(-height >> block)) >> np.uint32(8) & np.uint32(0xFFFF)).tolist()
        groups = max(groups_of) + 1
    # The sum of a pixel's four entries is the pixel above, and the bits that it took below.
    codes = [[read_code(bits, n, place) for n, place in ((280 + (1 << cache_bits if cache_bits else 0), 8), (256, 16), (256, 0), (256, 24), (40, 0))] for _ in range(groups)]
    return Coded(bits, width, width * height, cache_bits, codes, main, groups_of, block)


def read_pixels(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """An entropy-coded picture, as a flat array."""
    return read_rest(read_codes(bits, width, height, main), [])


def read_rest(coded: Coded, out: list[int], cache: list[int] | None = None) -> np.ndarray:
    """The picture whose first pixels are out; these are in the cache if it is given."""
    bits, width, total, groups_of, block = coded.bits, coded.width, coded.total, coded.groups_of, coded.block
    codes, across = coded.codes, -(-width >> block)
    cached = 0 if cache is None else len(out)  # pixels before this one are in the cache
    cache = cache or [0] * (1 << coded.cache_bits)
    shift = 32 - coded.cache_bits
    back = max(0, bits.count - 64) >> 3
    bits.at, bits.count = bits.at - back, bits.count - 8 * back
    bits.value &= (1 << bits.count) - 1
    put = out.append
    (green, gm), (red, rm), (blue, bm), (alpha, am), (far, fm) = codes[0]
    value, count, at, data = bits.value, bits.count, bits.at, bits.data
    literal, ahead = 256 << 14, (1 << AHEAD) - 1
    three = three_codes(codes[0][1:4], total) if coded.main and groups_of is None else None
    n = len(out)
    while n < total:
        if groups_of is not None:
            (green, gm), (red, rm), (blue, bm), (alpha, am), (far, fm) = codes[groups_of[(n // width >> block) * across + (n % width >> block)]]
        if count < 64:
            value |= int.from_bytes(data[at : at + 8], "little") << count
            at += 8
            count += 64
        e = green[value & gm]
        if e < literal:
            value >>= e & 15
            if three is not None and (r := three[value & ahead]):
                value >>= r & 63
                e += r
                count -= e & 63
                put(e >> 6)
                n += 1
                continue
            r = red[value & rm]
            value >>= r & 15
            b = blue[value & bm]
            value >>= b & 15
            a = alpha[value & am]
            value >>= a & 15
            e += r + b + a
            count -= e & 63
            put(e >> 6)
            n += 1
            continue
        value >>= e & 15
        count -= e & 15
        symbol = e >> 14
        if symbol >= 280:
            for x in out[cached:]:
                cache[(CACHE_FACTOR * x & 0xFFFFFFFF) >> shift] = x
            cached = n
            put(cache[symbol - 280])
            n += 1
            continue
        bits.value, bits.count, bits.at = value, count, at
        run, step = read_reference(bits, symbol, far, fm, width)
        value, count, at = bits.value, bits.count, bits.at
        if step > n or n + run > total:
            raise ValueError("a back-reference leaves the picture")
        if step >= run:
            out += out[n - step : n - step + run]
        else:
            for i in range(n - step, n - step + run):
                put(out[i])
        n += run
    if at - count // 8 > len(data):
        raise ValueError("the stream ends early")
    bits.value, bits.count, bits.at = value, count, at
    return np.array(out, np.uint32)


#: Files that are read together at most, and fewer than this many are read one by one.
TOGETHER, ALONE = 1024, 48
#: Longest codes of the four samples that are read together: bits at hand from any place on.
AT_HAND = 49


def read_together(all_coded: list[Coded]) -> list[np.ndarray]:
    """What read_rest() finds for each picture: a token of every picture at a time, and the last few pictures one by one."""
    fits = lambda c: c.groups_of is None and sum(mask.bit_length() for _, mask in c.codes[0][:4]) <= AT_HAND
    lanes = [i for i, c in enumerate(all_coded) if fits(c)]
    if len(lanes) < ALONE:
        return [read_rest(c, []) for c in all_coded]
    coded = [all_coded[i] for i in lanes]
    found: list[np.ndarray | None] = [None if fits(c) else read_rest(c, []) for c in all_coded]
    # All files in one array, as the 64 bits from each 16th bit on.
    data = [c.bits.data + bytes(8 + len(c.bits.data) % 2) for c in coded]
    begins = np.cumsum([0, *map(len, data)])
    halves = np.frombuffer(b"".join(data) + bytes(8), "<u2").astype(np.uint64)
    ahead = (halves[:-3] | halves[1:-2] << np.uint64(16) | halves[2:-1] << np.uint64(32) | halves[3:] << np.uint64(48)).view(np.int64)
    # All tables in one array; of equal ones there is one.
    starts: dict[int, int] = {}
    tables, end = [], 0
    for c in coded:
        for table, _ in c.codes[0][:4]:
            if id(table) not in starts:
                starts[id(table)] = end
                tables.append(np.array(table, np.int64))
                end += len(table)
    entries = np.concatenate(tables)
    firsts = np.cumsum([0, *(c.total for c in coded)])
    caches = np.cumsum([0, *(1 << c.cache_bits for c in coded)])
    out, cache = np.zeros(firsts[-1], np.int64), np.zeros(caches[-1], np.int64)
    state = np.array(
        [
            [k, 8 * (begins[k] + c.bits.at) - c.bits.count, firsts[k], firsts[k + 1], caches[k], 32 - c.cache_bits, *(x for table, mask in c.codes[0][:4] for x in (starts[id(table)], mask))]
            for k, c in enumerate(coded)
        ],
        np.int64,
    ).T.copy()
    literal, slot = 256 << 14, 280 << 14
    while state.shape[1] >= ALONE:
        lane, pos, n, last, held, shift, green, gm, red, rm, blue, bm, alpha, am = state
        while True:
            value = ahead.take(pos >> 4, mode="clip") >> (pos & 15)
            e = entries.take(green + (value & gm))
            value >>= e & 15
            r = entries.take(red + (value & rm))
            value >>= r & 15
            b = entries.take(blue + (value & bm))
            value >>= b & 15
            r += b
            r += entries.take(alpha + (value & am))
            other = (e >= literal).nonzero()[0]
            r[other] = 0
            r += e
            pos += r & 63
            pixel = r >> 6
            if len(other):
                code = e[other]
                hit = other[code >= slot]
                pixel[hit] = cache.take(held[hit] + (e[hit] >> 14) - 280)
                for k in other[code < slot].tolist():
                    c, at, first = coded[lane[k]], int(n[k]), int(firsts[lane[k]])
                    seek(c.bits, int(pos[k]) - 8 * int(begins[lane[k]]))
                    run, step = read_reference(c.bits, int(e[k]) >> 14, *c.codes[0][4], c.width)
                    if step > at - first or at + run > last[k]:
                        raise ValueError("a back-reference leaves the picture")
                    copied = np.resize(out[at - step : at], run) if step < run else out[at - step : at - step + run]
                    out[at : at + run] = copied
                    cache[held[k] + ((copied * CACHE_FACTOR & 0xFFFFFFFF) >> shift[k])] = copied
                    pixel[k] = copied[-1]  # it is put at its place once more below
                    n[k] += run - 1
                    pos[k] = 8 * (int(begins[lane[k]]) + c.bits.at) - c.bits.count
            out[n] = pixel
            cache[held + ((pixel * CACHE_FACTOR & 0xFFFFFFFF) >> shift)] = pixel
            n += 1
            if (n >= last).any():
                break
        for k in np.flatnonzero(n >= last).tolist():
            if -(-int(pos[k]) // 8) - begins[lane[k]] > len(coded[lane[k]].bits.data):
                raise ValueError("the stream ends early")
        state = state[:, n < last]
    left = state[0].tolist()
    for k, c in enumerate(coded):
        found[lanes[k]] = None if k in left else out[firsts[k] : firsts[k + 1]].astype(np.uint32)
    for k, pos, n in zip(left, state[1].tolist(), state[2].tolist()):
        seek(coded[k].bits, pos - 8 * int(begins[k]))
        found[lanes[k]] = read_rest(coded[k], out[firsts[k] : n].tolist(), cache[caches[k] : caches[k + 1]].tolist())
    return found


def seek(bits: Bits, at: int) -> None:
    """The bit at this place is read next."""
    bits.at, bits.value, bits.count = at >> 3, 0, 0
    bits.read(at & 7)


def slots(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    """Places of pixels in the colour cache."""
    return (pixels.astype(np.uint32) * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits)).astype(np.int64)


def last_same(keys: np.ndarray) -> np.ndarray:
    """The place of the last equal key before each, or -1."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), -1)
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    out[order[same + 1]] = order[same]
    return out


def channels(pixels: np.ndarray) -> np.ndarray:
    """Flat pixels as rows of blue, green, red, alpha samples."""
    return pixels.astype("<u4").view(np.uint8).reshape(-1, 4)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predicted(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """The predictor's value from neighbours of shape (..., 4), as int32."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(-1, keepdims=True), np.abs(left - top_left).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        middle = _average(left, top)
        diff = middle - top_left
        return np.clip(middle + np.where(diff < 0, -(-diff >> 1), diff >> 1), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255], np.int32), left.shape)


def _along(mode: int, row: list[list[int]], above: list[list[int]], lo: int, hi: int) -> None:
    """Adds to the samples of a row from lo to hi what a mode predicts that needs the sample on the left; above goes on with the row's first sample."""
    for x in range(lo, hi):
        left, top, top_left, own = row[x - 1], above[x], above[x - 1], row[x]
        over = above[x + 1] if x + 1 < len(row) else row[0]
        if mode == 11:
            to_left = sum(abs(top[k] - top_left[k]) for k in range(4))
            guess = left if to_left < sum(abs(left[k] - top_left[k]) for k in range(4)) else top
            row[x] = [own[k] + guess[k] & 255 for k in range(4)]
        elif mode == 12:
            row[x] = [own[k] + min(255, max(0, left[k] + top[k] - top_left[k])) & 255 for k in range(4)]
        elif mode == 13:
            made = []
            for k in range(4):
                middle = left[k] + top[k] >> 1
                apart = middle - top_left[k]
                made.append(own[k] + min(255, max(0, middle + (apart // 2 if apart >= 0 else -(-apart // 2)))) & 255)
            row[x] = made
        elif mode == 5:
            row[x] = [own[k] + ((left[k] + over[k] >> 1) + top[k] >> 1) & 255 for k in range(4)]
        elif mode == 6:
            row[x] = [own[k] + (left[k] + top_left[k] >> 1) & 255 for k in range(4)]
        elif mode == 7:
            row[x] = [own[k] + (left[k] + top[k] >> 1) & 255 for k in range(4)]
        else:
            row[x] = [own[k] + ((left[k] + top_left[k] >> 1) + (top[k] + over[k] >> 1) >> 1) & 255 for k in range(4)]


def unpredict(residuals: np.ndarray, width: int, height: int, modes: np.ndarray, block: int) -> np.ndarray:
    rows = channels(residuals).astype(np.int32).reshape(height, width, 4)
    across = -(-width >> block)
    modes = (modes >> np.uint32(8) & np.uint32(15)).reshape(-1, across)
    rows[0, 0] += (0, 0, 0, 255)
    rows[0] = np.cumsum(rows[0], 0) & 255
    for y in range(1, height):
        rows[y, 0] = (rows[y, 0] + rows[y - 1, 0]) & 255
        above = rows[y - 1]
        right = np.concatenate([above[1:], rows[y, :1]])
        held: list[list[list[int]]] = []
        for bx in range(across):
            mode, lo, hi = int(modes[y >> block, bx]), max(1, bx << block), min(width, (bx + 1) << block)
            if lo >= hi:
                continue
            if mode in (0, 2, 3, 4, 8, 9) or mode > 13:  # what they need of the row above is all there
                rows[y, lo:hi] = (rows[y, lo:hi] + _predicted(mode, above[lo:hi], above[lo:hi], right[lo:hi], above[lo - 1 : hi - 1])) & 255
            elif mode == 1:
                rows[y, lo:hi] = (rows[y, lo - 1] + np.cumsum(rows[y, lo:hi], 0)) & 255
            else:
                own = rows[y].tolist()
                held = held or [above.tolist()]
                _along(mode, own, held[0], lo, hi)
                rows[y, lo:hi] = own[lo:hi]
    return rows.reshape(-1, 4).astype(np.uint8).view("<u4").ravel()


def predict(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, block: int) -> np.ndarray:
    """The residuals that unpredict() turns back."""
    rows = channels(pixels).astype(np.int32).reshape(height, width, 4)
    out = rows.copy()
    kinds = _spread(modes >> np.uint32(8) & np.uint32(15), width, height, block).reshape(height, width)[1:, 1:]
    out[0, 0] -= (0, 0, 0, 255)
    out[0, 1:] -= rows[0, :-1]
    out[1:, 0] -= rows[:-1, 0]
    if height > 1 and width > 1:
        over = np.concatenate([rows[:-1, 2:], rows[1:, :1]], 1)  # of a row's last pixel the next row's first one
        around = rows[1:, :-1], rows[:-1, 1:], over, rows[:-1, :-1]
        for mode in np.unique(kinds).tolist():
            here = kinds == mode
            out[1:, 1:][here] -= _predicted(mode, *(x[here] for x in around))
    return (out & 255).reshape(-1, 4).astype(np.uint8).view("<u4").ravel()


def _spread(elements: np.ndarray, width: int, height: int, block: int) -> np.ndarray:
    """Elements of a block picture, one for each pixel."""
    grid = elements.reshape(-1, -(-width >> block))
    return np.repeat(np.repeat(grid, 1 << block, 0)[:height], 1 << block, 1)[:, :width].ravel()


def cross_colour(pixels: np.ndarray, elements: np.ndarray, width: int, height: int, block: int, sign: int) -> np.ndarray:
    """sign 1 inverts the transform, -1 applies it."""
    px, el = channels(pixels).astype(np.int32), channels(_spread(elements, width, height, block)).view(np.int8).astype(np.int32)
    signed = lambda x: (x & 255) - ((x & 128) << 1)
    green, red = px[:, 1], px[:, 2]
    new_red = (red + sign * (el[:, 0] * signed(green) >> 5)) & 255
    from_red = new_red if sign > 0 else red
    blue = px[:, 0] + sign * ((el[:, 1] * signed(green) >> 5) + (el[:, 2] * signed(from_red) >> 5))
    return np.stack([blue & 255, green, new_red, px[:, 3]], 1).astype(np.uint8).view("<u4").ravel()


def add_green(pixels: np.ndarray, sign: int) -> np.ndarray:
    px = channels(pixels).astype(np.int32)
    px[:, [0, 2]] += sign * px[:, [1]]
    return (px & 255).astype(np.uint8).view("<u4").ravel()


def _packing(colours: int) -> int:
    """Bits by which a palette of so many colours narrows the picture."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def from_palette(pixels: np.ndarray, palette: np.ndarray, width: int, height: int) -> np.ndarray:
    narrow = _packing(len(palette))
    each = 8 >> narrow
    index = (pixels >> np.uint32(8) & np.uint32(255)).reshape(height, -1)
    index = (index[:, :, None] >> (np.arange(1 << narrow, dtype=np.uint32) * np.uint32(each)) & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index].ravel()


def to_palette(pixels: np.ndarray, palette: np.ndarray, width: int, height: int) -> np.ndarray:
    narrow = _packing(len(palette))
    index = np.searchsorted(palette, pixels).reshape(height, width)
    index = np.pad(index, ((0, 0), (0, -width % (1 << narrow)))).reshape(height, -1, 1 << narrow)
    packed = (index << np.arange(1 << narrow) * (8 >> narrow)).sum(2).ravel().astype(np.uint32)
    return packed << np.uint32(8) | np.uint32(BLACK)


@dataclass
class Opened:
    """A file whose transforms and codes are read."""

    width: int
    height: int
    todo: list[tuple[int, int, np.ndarray | None, int]]
    coded: Coded

    def picture(self, pixels: np.ndarray) -> np.ndarray:
        """The picture (height, width) behind the coded one."""
        for kind, wide, side, block in reversed(self.todo):
            if kind == PREDICTOR:
                pixels = unpredict(pixels, wide, self.height, side, block)
            elif kind == CROSS_COLOUR:
                pixels = cross_colour(pixels, side, wide, self.height, block, 1)
            elif kind == SUBTRACT_GREEN:
                pixels = add_green(pixels, 1)
            else:
                pixels = from_palette(pixels, side, wide, self.height)
        return pixels.reshape(self.height, self.width)


def opened(media: bytes) -> Opened:
    if media[:4] != b"RIFF" or media[8:16] != b"WEBPVP8L" or media[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    bits = Bits(media[21 : 20 + struct.unpack("<I", media[16:20])[0]])
    full_width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    width, todo = full_width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            todo.append((kind, width, read_pixels(bits, -(-width >> block), -(-height >> block)), block))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            deltas = channels(read_pixels(bits, size, 1))
            todo.append((kind, width, np.cumsum(deltas, 0, np.uint8).view("<u4").ravel(), 0))
            width = -(-width >> _packing(size))
        else:
            todo.append((kind, width, None, 0))
    return Opened(full_width, height, todo, read_codes(bits, width, height, main=True))


def decode(media: bytes) -> np.ndarray:
    """The picture (height, width) of a lossless WebP file; ValueError if it is none."""
    file = opened(media)
    return file.picture(read_rest(file.coded, []))


def decode_together(media: list[bytes]) -> Iterator[np.ndarray]:
    """What decode() finds for each of the files, which are all held at once."""
    files = [opened(x) for x in media]
    for file, pixels in zip(files, read_together([f.coded for f in files])):
        yield file.picture(pixels)


# ---- encoder


def code_lengths(counts: np.ndarray, most: int = MAX_CODE) -> np.ndarray:
    """Lengths of a complete prefix code, at most so long; a single symbol gets 1."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        out[used or [0]] = 1
        return out
    weights = counts[used].tolist()
    floor = 1
    while True:
        heap = [(max(w, floor), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        up, free = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            heapq.heapreplace(heap, (a[0] + b[0], free))
            up[a[1]] = up[b[1]] = free
            free += 1
        deep = [0] * free
        for i in range(free - 2, -1, -1):
            deep[i] = deep[up[i]] + 1
        if max(deep[: len(used)]) <= most:
            out[used] = deep[: len(used)]
            return out
        floor = max(2 * floor, sum(weights) >> most)  # flatter weights make shorter codes


def encoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths) by symbol, first bit lowest; a single symbol takes no bits."""
    codes, sizes = np.zeros(len(lengths), np.int64), lengths.astype(np.int64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return codes, np.zeros(len(lengths), np.int64)
    order = used[np.argsort(lengths[used], kind="stable")]
    most = int(sizes.max())
    starts = np.cumsum(np.concatenate([[0], 1 << (most - sizes[order])]))[:-1]
    codes[order] = reversed_bits(starts >> (most - sizes[order]), sizes[order])
    return codes, sizes


class Writer:
    def __init__(self) -> None:
        self.value, self.count, self.done = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= int(value) << self.count
        self.count += int(n)
        if self.count >= 4096:
            self.flush()

    def flush(self) -> None:
        whole = self.count >> 3
        self.done.append((self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
        self.value >>= 8 * whole
        self.count &= 7

    def put_many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Values of at most 56 bits each, as uint64."""
        self.flush()
        at = np.cumsum(sizes) - sizes + self.count
        end = int(at[-1] + sizes[-1]) if len(at) else self.count
        words = np.zeros((end >> 6) + 2, np.uint64)
        words[0] = self.value
        word, low = at >> 6, (at & 63).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] |= np.bitwise_or.reduceat(values << low, first) if len(first) else 0
        over = np.flatnonzero((at & 63) + sizes > 64)
        words[word[over] + 1] |= values[over] >> (np.uint64(64) - low[over])  # one value at most leaves a word
        data = words.tobytes()
        self.done.append(data[: end >> 3])
        self.count = end & 7
        self.value = data[end >> 3] & ((1 << self.count) - 1)

    def bytes(self) -> bytes:
        self.count += -self.count % 8
        self.flush()
        return b"".join(self.done)


def _joined(parts: list[tuple[int, int]]) -> tuple[int, int]:
    value = at = 0
    for x, n in parts:
        value |= x << at
        at += n
    return value, at


@lru_cache(maxsize=256)
def _stored_code(lengths: bytes) -> tuple[int, int]:
    """The bits, and their number, that store a prefix code."""
    size = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(size).tolist()
    if len(used) <= 2 and all(x < 256 for x in used):
        one = used[0] if used else 0
        out = [(1, 1), (int(len(used) == 2), 1), (int(one > 1), 1), (one, 8 if one > 1 else 1)]
        return _joined(out + [(x, 8) for x in used[1:]])
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    edges = np.flatnonzero(np.diff(size)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(size)]):
        run, what = hi - lo, int(size[lo])
        if what:
            tokens.append((what, 0, 0))
            run -= 1
        while run:
            if not what and run >= 11:
                n = min(run, 138)
                tokens.append((18, n - 11, 7))
            elif not what and run >= 3:
                n = min(run, 10)
                tokens.append((17, n - 3, 3))
            elif what and run >= 3:
                n = min(run, 6)
                tokens.append((16, n - 3, 2))
            else:
                n = 1
                tokens.append((what, 0, 0))
            run -= n
    small = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    codes, sizes = encoding_table(small)
    stored = max(4, max(i for i, x in enumerate(LENGTH_ORDER) if small[x]) + 1)
    out = [(0, 1), (stored - 4, 4)] + [(int(small[x]), 3) for x in LENGTH_ORDER[:stored]] + [(0, 1)]
    for what, extra, n in tokens:
        out.append((int(codes[what]) | extra << int(sizes[what]), int(sizes[what]) + n))
    return _joined(out)


def _put_code(out: Writer, lengths: np.ndarray) -> None:
    out.put(*_stored_code(lengths.tobytes()))


#: What a code of a picture's own must save of the fixed one's bits to be worth its making and reading.
WORTH = 0.35


@lru_cache(maxsize=32)
def fixed_code(alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, codes and sizes of a code for text in UTF-8, by a rule: letters by rank, the rest by kind.

    Behind the 256 samples the alphabet may have 24 lengths and the colour cache; one of 40 is that of distances.
    """
    if alphabet == 40:
        weights = np.full(40, 2, np.int64)
        weights[8:24] = 12
    else:
        weights = np.full(256, 2, np.int64)
        weights[0x20:0x7F] = 30
        weights[0x80:0xC0] = 60
        weights[0xC2:0xD2] = 40
        weights[0x0A], weights[0xC3] = 120, 300
        for rank, letter in enumerate(b" etnioahrsdlcumgbpfwyvk,."):
            weights[letter] = 60_000 // (rank * rank + 6 * rank + 30)
        if alphabet > 280:
            weights = np.concatenate([weights, np.full(24, 24), np.full(alphabet - 280, int(weights.sum()) // (2 * (alphabet - 280)))])
    lengths = np.pad(code_lengths(weights), (0, alphabet - len(weights)))
    return lengths, *encoding_table(lengths)


@lru_cache(maxsize=32)
def _fixed_lengths(alphabet: int) -> tuple[np.ndarray, int]:
    """The fixed code's length of each symbol, as no bits count where it has none, and how many bits store it."""
    lengths = fixed_code(alphabet)[0]
    return np.where(lengths > 0, lengths.astype(np.int64), 1 << 20), _stored_code(lengths.tobytes())[1]


def _split(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and extra bits of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    extra = value.bit_length() - 2
    return 2 * extra + 2 + (value >> extra & 1), value & ((1 << extra) - 1), extra


#: Longest run of a back-reference that the encoder writes.
RUN = 4096


def _matches(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, run, distance) of back-references of three pixels and more, from left to right."""
    n = len(pixels)
    if n < 4:
        return []
    wide = pixels.astype(np.uint64)
    key = (wide[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ wide[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ wide[2:]
    before = last_same(key)
    here = np.flatnonzero(before >= 0)
    for k in range(3):
        here = here[pixels[here + k] == pixels[before[here] + k]]
    out, free = [], 0
    for at, source in zip(here.tolist(), before[here].tolist()):
        if at < free:
            continue
        run, most = 3, min(RUN, n - at)
        while run < most:
            chunk = min(64 if run < 64 else RUN, most - run)
            differs = pixels[source + run : source + run + chunk] != pixels[at + run : at + run + chunk]
            if differs.any():
                run += int(differs.argmax())
                break
            run += chunk
        out.append((at, run, at - source))
        free = at + run
    return out


@dataclass
class Tokens:
    """Tokens of a picture in order: the symbols of the first code, the samples and which of them are written, and the back-references.

    refs: rows of a token's place and, for its length and its distance, symbol, value and number of the extra bits.
    """

    green: np.ndarray
    samples: np.ndarray
    single: np.ndarray | None
    refs: np.ndarray
    cache_bits: int

    @cached_property
    def counts(self) -> list[np.ndarray]:
        """How often each symbol of the five codes occurs."""
        own = self.samples if self.single is None else self.samples[self.single]
        rest = [np.bincount(own[:, k], minlength=256) for k in (2, 0, 3)]
        return [np.bincount(self.green, minlength=280 + (1 << self.cache_bits if self.cache_bits else 0)), *rest, np.bincount(self.refs[:, 4], minlength=40)]

    def extra_bits(self) -> int:
        return int(self.refs[:, 3].sum() + self.refs[:, 6].sum())


NO_REFS = np.zeros((0, 7), np.int64)


def tokens(pixels: np.ndarray, width: int, cache_bits: int = 0, references: bool = False) -> Tokens:
    """A picture's tokens: single pixels, ones that the colour cache holds, and back-references."""
    samples, single, refs = channels(pixels), None, NO_REFS
    green = samples[:, 1].astype(np.int16)
    if cache_bits:
        slot = slots(pixels, cache_bits)
        before = last_same(slot)
        hit = (before >= 0) & (pixels[before] == pixels)
        green[hit] = 280 + slot[hit]
        single = ~hit
    found = _matches(pixels) if references else []
    if found:
        short, keep = _short_distances(width), np.ones(len(pixels), bool)
        single = np.ones(len(pixels), bool) if single is None else single
        rows = []
        for at, run, distance in found:
            keep[at + 1 : at + run] = False
            rows.append((at, *_split(run), *_split(short.get(distance, distance + 120))))
        refs = np.array(rows, np.int64)
        green[refs[:, 0]] = 256 + refs[:, 1]
        single[refs[:, 0]] = False
        refs[:, 0] = np.cumsum(keep)[refs[:, 0]] - 1
        green, samples, single = green[keep], samples[keep], single[keep]
    return Tokens(green, samples, single, refs, cache_bits)


@lru_cache(maxsize=16)
def _short_distances(width: int) -> dict[int, int]:
    return {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(PLANE)))}


def _own_bits(counts: np.ndarray) -> float:
    """About how many bits a code of its own takes, with what it takes to store it."""
    used = counts[counts > 0].astype(float)
    if len(used) < 2:
        return 4.0
    return float((used * np.log2(used.sum() / used)).sum()) + 5.5 * len(used) + 60


def fixed_bits(counts: list[np.ndarray]) -> float:
    """The bits that tokens with such counts take in the fixed codes, and these themselves; a single symbol takes none but to say which it is."""
    total = 0
    for count in counts:
        if np.count_nonzero(count) < 2:
            total += 12
        else:
            lengths, stored = _fixed_lengths(len(count))
            total += int(count @ lengths) + stored
    return float(total)


def plan(counts: list[np.ndarray]) -> list[bool]:
    """Which of the codes for tokens with such counts are the fixed one: all whose own would not save WORTH of it."""
    out = []
    for count in counts:
        lengths, stored = _fixed_lengths(len(count))
        out.append((1 - WORTH) * (float(count @ lengths) + stored) < _own_bits(count))
    return out


def write_pixels(out: Writer, pixels: np.ndarray, width: int, main: bool = False, cache_bits: int = 0, references: bool = False, made: Tokens | None = None) -> None:
    """Tokens, the picture's own if they are not given, behind their codes."""
    made = made or tokens(pixels, width, cache_bits, references)
    out.put(1 | made.cache_bits << 1 if made.cache_bits else 0, 5 if made.cache_bits else 1)
    if main:
        out.put(0, 1)
    counts, tables = made.counts, []
    for count, fixed in zip(counts, plan(counts)):
        lengths, codes, sizes = fixed_code(len(count)) if fixed else (lambda x: (x, *encoding_table(x)))(code_lengths(count))
        _put_code(out, lengths)
        tables.append((codes.astype(np.uint64), sizes))
    values, sizes = tables[0][0][made.green], tables[0][1][made.green]
    for (code, size), k in zip(tables[1:4], (2, 0, 3)):
        own = made.samples[:, k]
        values |= (code[own] if made.single is None else code[own] * made.single) << sizes.astype(np.uint64)
        sizes = sizes + (size[own] if made.single is None else size[own] * made.single)
    if len(made.refs):  # behind a length's symbol are its extra bits, the distance's symbol, and its extra bits
        at, _, more, n, far, far_more, far_n = made.refs.T
        for value, size in ((more, n), (tables[4][0][far], tables[4][1][far]), (far_more, far_n)):
            values[at] |= value.astype(np.uint64) << sizes[at].astype(np.uint64)
            sizes[at] += size
    out.put_many(values, sizes)


def smallest(picture: np.ndarray) -> bytes:
    """The file that is smallest, as far as the fixed codes tell: of single pixels, of the colour cache with back-references, or of a palette."""
    height, width = picture.shape
    pixels = picture.astype(np.uint32).ravel()
    plain, short = tokens(pixels, width), tokens(pixels, width, 8, True)
    choices = [(fixed_bits(plain.counts), {"made": plain}), (fixed_bits(short.counts) + short.extra_bits(), {"made": short})]
    ordered = np.sort(pixels)
    colours = ordered[np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))]
    # A palette holds each colour about as a single pixel is held, and each pixel then is a number below that of colours.
    least = choices[0][0] * len(colours) / len(pixels) + len(pixels) * np.log2(len(colours))
    if len(colours) <= 256 and least < 1.5 * min(choices[0][0], choices[1][0]):
        packed = tokens(to_palette(pixels, colours, width, height), -(-width >> _packing(len(colours))), 0, True)
        own = sum(map(_own_bits, packed.counts)) + packed.extra_bits() + fixed_bits(tokens(_deltas(colours), len(colours)).counts)
        choices.append((own, {"palette": True, "references": True}))
    return encode(picture, **min(choices, key=lambda x: x[0])[1])


def _deltas(colours: np.ndarray) -> np.ndarray:
    """A palette as it is stored, each colour less the one before."""
    return np.diff(channels(colours), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8).view("<u4").ravel()


def encode(picture: np.ndarray, palette: bool = False, green: bool = False, modes: np.ndarray | None = None, elements: np.ndarray | None = None, block: int = 2, cache_bits: int = 0, references: bool = False, made: Tokens | None = None) -> bytes:
    """A lossless WebP file of the picture (height, width) with these transforms and tokens. made are those of a picture without transforms."""
    height, width = picture.shape
    if not (0 < height <= 1 << 14 and 0 < width <= 1 << 14):
        raise ValueError("a side must have 1 to 16384 pixels")
    pixels, out = picture.astype(np.uint32).ravel(), Writer()
    out.put(width - 1 | (height - 1) << 14 | 1 << 28, 32)
    if green:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        pixels = add_green(pixels, -1)
    if modes is not None:
        out.put(1 | PREDICTOR << 1 | (block - 2) << 3, 6)
        side = modes.astype(np.uint32).ravel() << np.uint32(8) | np.uint32(BLACK)
        write_pixels(out, side, -(-width >> block))
        pixels = predict(pixels, width, height, side, block)
    if elements is not None:
        out.put(1 | CROSS_COLOUR << 1 | (block - 2) << 3, 6)
        write_pixels(out, elements.astype(np.uint32).ravel(), -(-width >> block))
        pixels = cross_colour(pixels, elements.astype(np.uint32).ravel(), width, height, block, -1)
    wide = width
    if palette:
        colours = np.unique(pixels)
        if len(colours) > 256:
            raise ValueError("a palette holds 256 colours")
        out.put(1 | PALETTE << 1 | (len(colours) - 1) << 3, 11)
        write_pixels(out, _deltas(colours), len(colours))
        pixels, wide = to_palette(pixels, colours, width, height), -(-width >> _packing(len(colours)))
    out.put(0, 1)
    write_pixels(out, pixels, wide, True, cache_bits, references, made)
    body = b"\x2f" + out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
