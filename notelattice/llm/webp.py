"""Media columns: lossless WebP (VP8L), written and read here.

decode() reads any lossless WebP still image: prefix codes, groups of them by a meta image, back
references, colour cache, and the inverse predictor, cross-colour, subtract-green and palette
transforms. A stream whose pixels differ in one channel only, as grey images have it, is parsed in
numpy: the step to the next symbol is looked up for every bit position at once, steps are doubled
three times, and the walk along them gives all symbols. Other streams go symbol by symbol.

encode_payloads() stores byte strings as grey images of 64 pixels a row: one fixed palette and prefix
code for text, another code (with subtract-green) for the rest, and back references to repeats.
encode_image() writes any ARGB image with chosen transforms and colour cache.

Defined results of the operator: a null or empty text is a payload of 64 zero bytes; a payload of
more than 1 MB is several images, one after the other; equal texts are equal media; an empty table
gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_type, map_arrow, materialize, text_blocks

WIDTH, MAX_SIDE = 64, 1 << 14
PREDICTOR, CROSS, GREEN, PALETTE = 0, 1, 2, 3
#: Fixed value: the order in which the format stores lengths of code length codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Distance codes 1 to 120 stand for near pixels: by distance, then |x|, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
HASH = 0x1E35A7BD


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: Sequence[float], limit: int = 15) -> list[int]:
    """Huffman code lengths of at most `limit`; small counts are raised until they fit."""
    live = [i for i, c in enumerate(counts) if c > 0]
    out = [0] * len(counts)
    if len(live) < 2:
        for i in live:
            out[i] = 1
        return out
    floor = 0.0
    while True:
        heap = [(max(counts[i], floor), n, (i,)) for n, i in enumerate(live)]
        heapq.heapify(heap)
        depth = dict.fromkeys(live, 0)
        n = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                depth[i] += 1
            heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
            n += 1
        if max(depth.values()) <= limit:
            break
        floor = max(floor * 2, sum(counts) / 2**limit)
    for i, d in depth.items():
        out[i] = d
    return out


def codes(lengths: Sequence[int]) -> list[int]:
    """Canonical codes, bits reversed as the stream holds them."""
    out, code = [0] * len(lengths), 0
    for n in range(1, 16):
        for i, m in enumerate(lengths):
            if m == n:
                out[i] = int(f"{code:0{n}b}"[::-1], 2)
                code += 1
        code <<= 1
    return out


def table_of(lengths: Sequence[int]) -> tuple[np.ndarray, int]:
    """Lookup by the next bits: symbol * 16 + length. A code with one symbol takes no bits."""
    live = [i for i, n in enumerate(lengths) if n]
    if len(live) == 1:
        return np.array([live[0] * 16], np.int32), 0
    if not live or sum(2.0**-n for n in lengths if n) != 1:
        raise ValueError("incomplete prefix code")
    top = max(lengths)
    out = np.zeros(1 << top, np.int32)
    for i, c in enumerate(codes(lengths)):
        if lengths[i]:
            out[c :: 1 << lengths[i]] = i * 16 + lengths[i]
    return out, top


def prefixed(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, their value) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    extra = top - 1
    return 2 * top + second, extra, v - ((2 + second) << extra)


# ---------------------------------------------------------------- writing


class Writer:
    def __init__(self) -> None:
        self.value = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def code(self, lengths: Sequence[int]) -> None:
        """A prefix code: simple for one or two symbols below 256, else its lengths, plainly."""
        live = [i for i, n in enumerate(lengths) if n]
        if len(live) <= 2 and all(i < 256 for i in live):
            live = live or [0]
            self.put(1, 1)
            self.put(len(live) - 1, 1)
            self.put(1, 1)
            for i in live:
                self.put(i, 8)
            return
        self.put(0, 1)
        runs: list[tuple[int, int, int]] = []
        i = 0
        while i < len(lengths):
            n = 1
            while i + n < len(lengths) and lengths[i + n] == lengths[i]:
                n += 1
            if lengths[i] == 0 and n >= 3:
                n = min(n, 138)
                runs.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
            else:
                n = 1
                runs.append((lengths[i], 0, 0))
            i += n
        counts = [0] * 19
        for s, _, _ in runs:
            counts[s] += 1
        own = code_lengths(counts, 7)
        own_codes = codes(own)
        last = max(k for k, s in enumerate(LENGTH_ORDER) if own[s]) + 1
        self.put(max(last, 4) - 4, 4)
        for s in LENGTH_ORDER[: max(last, 4)]:
            self.put(own[s], 3)
        self.put(0, 1)
        single = sum(n > 0 for n in own) == 1
        for s, extra, n in runs:
            if not single:
                self.put(own_codes[s], own[s])
            self.put(extra, n)

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def container(stream: bytes) -> bytes:
    n = len(stream)
    chunk = b"VP8L" + n.to_bytes(4, "little") + stream + b"\0" * (n & 1)
    return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk


def head(width: int, height: int) -> int:
    """Signature, size, no alpha, version 0: 40 bits."""
    return 0x2F | (width - 1) << 8 | (height - 1) << 22


def _tokens(px: list[int], cache_bits: int) -> list[tuple]:
    """("p", pixel), ("c", key) and ("m", length, distance) tokens by a hash of three pixels."""
    out, seen, i = [], {}, 0
    keep: dict[int, int] = {}
    while i < len(px):
        key = tuple(px[i : i + 3])
        j = seen.get(key) if len(key) == 3 else None
        n = 0
        if j is not None:
            while i + n < len(px) and px[j + n] == px[i + n] and n < 4096:
                n += 1
        if n >= 3:
            out.append(("m", n, i - j))
        else:
            n = 1
            k = (HASH * px[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            out.append(("c", k) if cache_bits and keep.get(k) == px[i] else ("p", px[i]))
        for q in range(i, i + n):
            seen[tuple(px[q : q + 3])] = q
            if cache_bits:
                keep[(HASH * px[q] & 0xFFFFFFFF) >> (32 - cache_bits)] = px[q]
        i += n
    return out


def _entropy(w: Writer, px: list[int], cache_bits: int = 0, meta: bool = False) -> None:
    """Colour cache, prefix codes and data of an image."""
    w.put(1, 1) if cache_bits else w.put(0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if meta:
        w.put(0, 1)
    tokens = _tokens(px, cache_bits)
    counts = [[0] * (280 + (1 << cache_bits) * bool(cache_bits)), [0] * 256, [0] * 256, [0] * 256, [0] * 40]
    for t in tokens:
        if t[0] == "p":
            for k, shift in enumerate((8, 16, 0, 24)):
                counts[k][t[1] >> shift & 255] += 1
        elif t[0] == "c":
            counts[0][280 + t[1]] += 1
        else:
            counts[0][256 + prefixed(t[1])[0]] += 1
            counts[4][prefixed(t[2] + 120)[0]] += 1
    lengths = [code_lengths(c) for c in counts]
    own = [codes(n) for n in lengths]
    single = [sum(x > 0 for x in n) < 2 for n in lengths]
    for n in lengths:
        w.code(n)

    def sym(k: int, s: int) -> None:
        if not single[k]:
            w.put(own[k][s], lengths[k][s])

    for t in tokens:
        if t[0] == "p":
            for k, shift in enumerate((8, 16, 0, 24)):
                sym(k, t[1] >> shift & 255)
        elif t[0] == "c":
            sym(0, 280 + t[1])
        else:
            for k, base, value in ((0, 256, t[1]), (4, 0, t[2] + 120)):
                s, n, extra = prefixed(value)
                sym(k, base + s)
                w.put(extra, n)


def _channels(argb: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue planes of uint32 pixels."""
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)]).astype(np.int64)


def _joined(planes: Sequence[np.ndarray]) -> np.ndarray:
    a, r, g, b = (np.asarray(p).astype(np.uint32) & 255 for p in planes)
    return a << 24 | r << 16 | g << 8 | b


def encode_image(argb: np.ndarray, transforms: Sequence[int] = (), cache_bits: int = 0, mode: int = 11, bits: int = 3, factors: tuple[int, int, int] = (5, 251, 9)) -> bytes:
    """A lossless WebP of an image [height, width] of uint32 ARGB pixels. One predictor mode, or one
    triple of colour factors, serves the whole image."""
    img = np.array(argb, np.uint32)
    h, width = img.shape
    w = Writer()
    w.put(head(width, h) | 1 << 36, 40)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        blocks = -(-img.shape[1] >> bits) * -(-h >> bits) if kind < 2 else 0
        blocks = ((img.shape[1] + (1 << bits) - 1) >> bits) * ((h + (1 << bits) - 1) >> bits)
        if kind == PREDICTOR:
            w.put(bits - 2, 3)
            _entropy(w, [0xFF000000 | mode << 8] * blocks)
            img = _joined([x - y for x, y in zip(_channels(img), _channels(_predict_all(img, mode)), strict=True)])
        elif kind == CROSS:
            w.put(bits - 2, 3)
            _entropy(w, [0xFF000000 | factors[2] << 16 | factors[1] << 8 | factors[0]] * blocks)
            img = _cross(img, np.full(img.shape, factors[0]), np.full(img.shape, factors[1]), np.full(img.shape, factors[2]), -1)
        elif kind == GREEN:
            a, r, g, b = _channels(img)
            img = _joined([a, r - g, g, b - g])
        else:
            table = np.unique(img)
            if len(table) > 256:
                raise ValueError("too many colours for a palette")
            w.put(len(table) - 1, 8)
            ch = _channels(table)
            _entropy(w, _joined([np.diff(c, prepend=0) for c in ch]).tolist())
            img = np.searchsorted(table, img).astype(np.uint32)
            pack = _pack_bits(len(table))
            per = 1 << pack
            wide = -(-img.shape[1] // per)
            img = np.pad(img, ((0, 0), (0, wide * per - img.shape[1]))).reshape(h, wide, per)
            img = (img << (np.arange(per, dtype=np.uint32) * (8 >> pack))).sum(2).astype(np.uint32) << 8 | np.uint32(0xFF000000)
    w.put(0, 1)
    _entropy(w, img.ravel().tolist(), cache_bits, True)
    return container(w.bytes())


def _pack_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


# ---------------------------------------------------------------- transforms


def _half(a: int, b: int) -> int:
    """Channel means of two pixels, rounded down."""
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _guess(mode: int, l: int, t: int, tr: int, tl: int) -> int:  # noqa: E741
    """The predictor of a pixel from its left, top, top right and top left neighbours."""
    if mode == 0 or mode > 13:
        return 0xFF000000
    if mode == 1:
        return l
    if mode == 2:
        return t
    if mode == 3:
        return tr
    if mode == 4:
        return tl
    if mode == 5:
        return _half(_half(l, tr), t)
    if mode == 6:
        return _half(l, tl)
    if mode == 7:
        return _half(l, t)
    if mode == 8:
        return _half(tl, t)
    if mode == 9:
        return _half(t, tr)
    if mode == 10:
        return _half(_half(l, tl), _half(t, tr))
    quads = [(l >> s & 255, t >> s & 255, tl >> s & 255) for s in (24, 16, 8, 0)]
    if mode == 11:  # the neighbour nearer to the plane through all three
        from_left = sum(abs(b - c) for _, b, c in quads)
        from_top = sum(abs(a - c) for a, _, c in quads)
        return l if from_left < from_top else t
    out = 0
    for a, b, c in quads:
        if mode == 12:
            v = _clamp(a + b - c)
        else:
            m = (a + b) >> 1
            d = m - c
            v = _clamp(m + (abs(d) // 2) * (1 if d >= 0 else -1))
        out = out << 8 | v
    return out


def _guess_at(px: list[int], x: int, y: int, w: int, mode: int) -> int:
    i = y * w + x
    if y == 0:
        return px[i - 1] if x else 0xFF000000
    if x == 0:
        return px[i - w]
    # the last column's top right pixel is the first one of this row
    return _guess(mode, px[i - 1], px[i - w], px[i - w + 1], px[i - w - 1])


def _predict_all(img: np.ndarray, mode: int) -> np.ndarray:
    h, w = img.shape
    px = img.ravel().tolist()
    return np.array([_guess_at(px, x, y, w, mode) for y in range(h) for x in range(w)], np.uint32).reshape(h, w)


def _unpredict(img: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    h, w = img.shape
    px = img.ravel().tolist()
    grid = (modes >> 8 & 15).tolist()
    for y in range(h):
        for x in range(w):
            p = _guess_at(px, x, y, w, grid[y >> bits][x >> bits])
            i = y * w + x
            v = px[i]
            px[i] = ((v & 0xFF00FF00) + (p & 0xFF00FF00)) & 0xFF00FF00 | ((v & 0x00FF00FF) + (p & 0x00FF00FF)) & 0x00FF00FF
    return np.array(px, np.uint32).reshape(h, w)


def _signed(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x).astype(np.int64) & 255
    return x - 256 * (x > 127)


def _cross(img: np.ndarray, g2r: np.ndarray, g2b: np.ndarray, r2b: np.ndarray, way: int) -> np.ndarray:
    """Adds (way 1) or takes away (way -1) the colour deltas; blue takes the red of the image."""
    a, r, g, b = _channels(img)
    delta = lambda t, c: _signed(t) * _signed(c) >> 5
    red = r + way * delta(g2r, g)
    plain = red if way > 0 else r
    return _joined([a, red, g, b + way * (delta(g2b, g) + delta(r2b, plain))])


# ---------------------------------------------------------------- reading


class Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw + b"\0" * 16, 0
        self.end = len(raw) * 8

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return int.from_bytes(self.raw[i : i + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def get(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return v

    def code(self, alphabet: int) -> tuple[np.ndarray, int]:
        lengths = [0] * alphabet
        if self.get(1):
            n = self.get(1) + 1
            lengths[self.get(8 if self.get(1) else 1)] = 1
            if n == 2:
                lengths[self.get(8)] = 1
            return table_of(lengths)
        own = [0] * 19
        for s in LENGTH_ORDER[: 4 + self.get(4)]:
            own[s] = self.get(3)
        table, top = table_of(own)
        left = alphabet
        if self.get(1):
            left = 2 + self.get(2 + 2 * self.get(3))
        i, last = 0, 8
        while i < alphabet and left:
            left -= 1
            e = int(table[self.peek(top)])
            self.get(e & 15)
            s = e >> 4
            if s < 16:
                lengths[i] = s
                last = s or last
                i += 1
                continue
            base, n, value = ((3, 2, last), (3, 3, 0), (11, 7, 0))[s - 16]
            run = base + self.get(n)
            lengths[i : i + run] = [value] * run
            i += run
        if i > alphabet:
            raise ValueError("too many code lengths")
        return table_of(lengths)

    def symbol(self, code: tuple[np.ndarray, int]) -> int:
        e = int(code[0][self.peek(code[1])])
        self.get(e & 15)
        return e >> 4

    def number(self, prefix: int) -> int:
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.get(extra) + 1

    def group(self, cache_bits: int) -> list[tuple[np.ndarray, int]]:
        return [self.code(n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]

    def cache_bits(self) -> int:
        n = self.get(4) if self.get(1) else 0
        if n > 11:
            raise ValueError("bad colour cache")
        return n

    def sub_image(self, w: int, h: int) -> np.ndarray:
        bits = self.cache_bits()
        return self.pixels(w, h, [self.group(bits)], None, 0, bits)

    def pixels(self, w: int, h: int, groups: list, meta: np.ndarray | None, meta_bits: int, cache_bits: int) -> np.ndarray:
        """Symbol by symbol, for any stream."""
        out: list[int] = []
        keep = [0] * (1 << cache_bits)
        n = w * h
        kept = 0  # pixels that the cache has seen
        grid = None if meta is None else meta.tolist()
        group = groups[0]
        while len(out) < n:
            i = len(out)
            if grid is not None:
                group = groups[grid[i // w >> meta_bits][i % w >> meta_bits]]
            s = self.symbol(group[0])
            if s < 256:
                r = self.symbol(group[1])
                b = self.symbol(group[2])
                out.append(self.symbol(group[3]) << 24 | r << 16 | s << 8 | b)
            elif s < 280:
                length = self.number(s - 256)
                dist = self.number(self.symbol(group[4]))
                if dist > 120:
                    dist -= 120
                else:
                    x, y = NEAR[dist - 1]
                    dist = max(1, x + y * w)
                if dist > i or i + length > n:
                    raise ValueError("bad back reference")
                for k in range(length):
                    out.append(out[i - dist + k])
            else:
                while kept < i:  # entered late, so that copies need no second loop
                    keep[(HASH * out[kept] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[kept]
                    kept += 1
                out.append(keep[s - 280])
        return np.array(out, np.uint32).reshape(h, w)


class Plan:
    """What stands before an image's pixels: transforms and prefix codes, for its width and height."""

    def __init__(self, r: Reader, w: int, h: int):
        self.width, self.height = w, h
        self.transforms: list[tuple] = []
        while r.get(1):
            kind = r.get(2)
            if kind in [t[0] for t in self.transforms]:
                raise ValueError("a transform comes twice")
            if kind in (PREDICTOR, CROSS):
                bits = r.get(3) + 2
                side = (1 << bits) - 1
                self.transforms.append((kind, bits, r.sub_image((w + side) >> bits, (h + side) >> bits)))
            elif kind == GREEN:
                self.transforms.append((kind,))
            else:
                n = r.get(8) + 1
                table = _joined([np.cumsum(c) for c in _channels(r.sub_image(n, 1)[0])])
                self.transforms.append((kind, table, w))
                w = -(-w // (1 << _pack_bits(n)))
        self.coded_width = w
        self.cache = r.cache_bits()
        self.meta, self.meta_bits = None, 0
        groups = 1
        if r.get(1):
            self.meta_bits = r.get(3) + 2
            side = (1 << self.meta_bits) - 1
            self.meta = r.sub_image((w + side) >> self.meta_bits, (h + side) >> self.meta_bits) >> 8 & 0xFFFF
            groups = int(self.meta.max()) + 1
        self.groups = [r.group(self.cache) for _ in range(groups)]

    def plain(self) -> bool:
        """Only green takes bits, and no symbol needs the cache."""
        return self.meta is None and not self.cache and all(top == 0 for _, top in self.groups[0][1:4])

    def undo(self, img: np.ndarray) -> np.ndarray:
        for t in reversed(self.transforms):
            if t[0] == PREDICTOR:
                img = _unpredict(img, t[2], t[1])
            elif t[0] == CROSS:
                at = np.ix_(np.arange(img.shape[0]) >> t[1], np.arange(img.shape[1]) >> t[1])
                f = t[2][at]
                img = _cross(img, f, f >> 8, f >> 16, 1)
            elif t[0] == GREEN:
                a, r, g, b = _channels(img)
                img = _joined([a, r + g, g, b + g])
            else:
                n = len(t[1])
                pack = _pack_bits(n)
                index = img >> 8 & 255
                if pack:
                    per = 1 << pack
                    shift = np.arange(per, dtype=np.uint32) * (8 >> pack)
                    index = (index[:, :, None] >> shift & ((1 << (8 >> pack)) - 1)).reshape(img.shape[0], -1)[:, : t[2]]
                full = np.zeros(256, np.uint32)
                full[:n] = t[1]
                img = full[index]
        return img


def streams(raw: bytes) -> Iterator[bytes]:
    """The VP8L streams of one or more files, one after the other."""
    at = 0
    while at < len(raw):
        if raw[at : at + 4] != b"RIFF" or raw[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end = at + 8 + int.from_bytes(raw[at + 4 : at + 8], "little")
        at += 12
        while at < end:
            n = int.from_bytes(raw[at + 4 : at + 8], "little")
            if raw[at : at + 4] == b"VP8L":
                yield raw[at + 8 : at + 8 + n]
            at += 8 + n + (n & 1)


def size_of(stream: bytes) -> tuple[int, int]:
    v = int.from_bytes(stream[:5], "little")
    if v & 255 != 0x2F or v >> 37:
        raise ValueError("not a lossless WebP stream")
    return (v >> 8 & 0x3FFF) + 1, (v >> 22 & 0x3FFF) + 1


#: Plans of headers met before, by their bytes, for images whose plan does not depend on their size.
_PLANS: dict[tuple[int, bytes], list[tuple[int, int, Plan]]] = {}
_KEY = 24


def plan_of(stream: bytes) -> tuple[Plan, int]:
    """The plan of a stream, and the bit where its pixels start."""
    w, h = size_of(stream)
    key = (w, stream[5 : 5 + _KEY])
    for value, bits, plan in _PLANS.get(key, ()):
        n = (bits + 7) // 8
        if len(stream) >= n and (int.from_bytes(stream[5:n], "little") & ((1 << (bits - 40)) - 1)) == value:
            return plan, bits
    r = Reader(stream)
    r.at = 40
    plan = Plan(r, w, h)
    if plan.plain() and all(t[0] in (GREEN, PALETTE) for t in plan.transforms) and len(_PLANS) < 64:
        value = int.from_bytes(stream[5 : (r.at + 7) // 8], "little") & ((1 << (r.at - 40)) - 1)
        _PLANS.setdefault(key, []).append((value, r.at, plan))
    return plan, r.at


def decode(stream: bytes) -> np.ndarray:
    """ARGB pixels [height, width] of a VP8L stream."""
    plan, at = plan_of(stream)
    w, h = size_of(stream)
    if plan.plain():
        img = _plain_pixels(np.frombuffer(stream, np.uint8), at, plan, plan.coded_width * h).reshape(h, plan.coded_width)
    else:
        r = Reader(stream)
        r.at = at
        img = r.pixels(plan.coded_width, h, plan.groups, plan.meta, plan.meta_bits, plan.cache)
    return plan.undo(img)


_EXTRA = np.array([0 if p < 4 else (p - 2) >> 1 for p in range(40)], np.int64)
_FIRST = np.array([p + 1 if p < 4 else ((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(40)], np.int64)


def _plain_pixels(raw: np.ndarray, at: int, plan: Plan, n: int) -> np.ndarray:
    """Pixels of a stream in which only green takes bits."""
    (green, top), (dist, dist_top) = plan.groups[0][0], plan.groups[0][4]
    fixed = np.uint32(int(plan.groups[0][3][0][0]) >> 4 << 24 | int(plan.groups[0][1][0][0]) >> 4 << 16 | int(plan.groups[0][2][0][0]) >> 4)
    if not top:
        return np.full(n, fixed | np.uint32(int(green[0]) >> 4 << 8), np.uint32)
    bits = len(raw) * 8
    pad = np.concatenate([raw, np.zeros(16, np.uint8)])
    three = pad[:-2].astype(np.uint32)
    three |= pad[1:-1].astype(np.uint32) << 8
    three |= pad[2:].astype(np.uint32) << 16
    lo = at >> 3
    window = (three[lo : len(raw), None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << top) - 1)
    entry = green[window.ravel()]
    place = np.arange(lo * 8, bits, dtype=np.int64)
    step = place + (entry & 15)
    run = np.flatnonzero(entry >= 256 * 16)
    length = distance = None
    if len(run):
        def fetch(p: np.ndarray, k: np.ndarray | int) -> np.ndarray:
            p = np.minimum(p, bits)
            i = p >> 3
            v = three[i].astype(np.int64) | three[i + 3].astype(np.int64) << 24
            return v >> (p & 7) & ((np.int64(1) << k) - 1)

        s = (entry[run] >> 4) - 256
        p = step[run]
        length = _FIRST[s] + fetch(p, _EXTRA[s])
        p = p + _EXTRA[s]
        e = dist[fetch(p, dist_top)].astype(np.int64)
        p = p + (e & 15)
        d = e >> 4
        distance = _FIRST[d] + fetch(p, _EXTRA[d])
        step[run] = p + _EXTRA[d]
    base = lo * 8
    one = np.minimum(step, bits) - base
    one = np.append(one, bits - base)
    two = one[one]
    four = two[two]
    eight = four[four]
    walk, ends = memoryview(eight), bits - base
    found, p = [], at - base
    left = (n + 7) // 8
    while left and p < ends:
        found.append(p)
        p = walk[p]
        left -= 1
    p = np.array(found, np.int64)
    both = lambda a: np.stack([a, one[a]], -1)
    quad = np.concatenate([both(p), both(two[p])], -1)
    four_on = four[p]
    order = np.concatenate([quad, both(four_on), both(two[four_on])], -1).ravel()
    order = order[order < ends]
    value = entry[order] >> 4
    if length is None or not (value >= 256).any():
        if len(value) < n:
            raise ValueError("the stream ends early")
        return fixed | value[:n].astype(np.uint32) << 8
    copies = np.flatnonzero(value >= 256)
    k = np.searchsorted(run, order[copies])
    size = np.ones(len(value), np.int64)
    size[copies] = length[k]
    stop = np.cumsum(size)
    used = int(np.searchsorted(stop, n)) + 1
    if used > len(value) or stop[used - 1] != n:
        raise ValueError("the stream ends early")
    out = np.zeros(n, np.uint8)
    literal = value[:used] < 256
    out[stop[:used][literal] - 1] = value[:used][literal]
    w = plan.coded_width
    buf = bytearray(out.tobytes())
    for end, m, d in zip(stop[copies[copies < used]].tolist(), length[k].tolist(), distance[k].tolist(), strict=False):
        if d > 120:
            d -= 120
        else:
            x, y = NEAR[d - 1]
            d = max(1, x + y * w)
        s = end - m
        if d > s:
            raise ValueError("bad back reference")
        if d >= m:
            buf[s:end] = buf[s - d : s - d + m]
        else:
            buf[s:end] = (buf[s - d : s] * (m // d + 1))[:m]
    return fixed | np.frombuffer(bytes(buf), np.uint8).astype(np.uint32) << 8


# ---------------------------------------------------------------- payloads

#: Fixed value: bytes of Latin text from frequent to rare, then the rest of the text palette.
FREQUENT = " etaonirshldcumfpgwybvk,.jxqzETAONIRSHLDCUMFPGWYBVKJXQZ\n\0'-\"0123456789!?;:()/@+%$#*&|<>=[]{}_~^`\\\t\r"


@cache
def _modes() -> list[dict]:
    """The text mode (palette) and the mode for other bytes (subtract-green), with their fixed
    headers and prefix codes."""
    known = FREQUENT.encode()
    text = known + bytes([0xC3, 0xC2]) + bytes(range(0x80, 0xC0))
    out = []
    for palette in (text, None):
        w = Writer()
        w.put(1, 1)
        w.put(PALETTE if palette else GREEN, 2)
        if palette:
            w.put(len(palette) - 1, 8)
            grey = np.frombuffer(palette, np.uint8).astype(np.int64)
            _entropy(w, _joined([np.diff(np.full(len(grey), 255), prepend=0), *[np.diff(grey, prepend=0)] * 3]).tolist())
        w.put(0, 1)  # no more transforms
        w.put(0, 1)  # no colour cache
        w.put(0, 1)  # one group
        order = {b: i for i, b in enumerate(text)}
        weights = [0.0] * 280
        for b in range(256):
            rank = order.get(b, 200)
            weights[order[b] if palette and b in order else b if not palette else 255] = 1 / (rank + 4) ** (1.5 if palette else 1.2)
        if palette:
            weights[len(palette) : 256] = [0.0] * (256 - len(palette))
        for s in range(256, 280):
            weights[s] = 4e-4
        lengths = [code_lengths(weights), [0] * 256, [0] * 256, [0] * 256, [5] * 24 + [6] * 16]
        for k, only in ((1, 0), (2, 0), (3, 255)):
            lengths[k][only] = 1
        for x in lengths:
            w.code(x)
        index = np.zeros(256, np.int64)
        for b, i in order.items():
            index[b] = i
        mode = {
            "bits": w.size, "value": w.value, "index": index if palette else np.arange(256), "has": np.isin(np.arange(256), list(order)) if palette else np.ones(256, bool),
            "length": np.array(lengths[0], np.int64), "code": np.array(codes(lengths[0]), np.int64), "d_length": np.array(lengths[4], np.int64), "d_code": np.array(codes(lengths[4]), np.int64),
        }
        out.append(mode)
    return out


MATCH = 16


def _first_equal(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The first place of each place's (doc, key). A round settles all places of the pair that came
    first in their slot of a table; the others go on to a round with other slots."""
    n = len(key)
    source = np.empty(n, np.int32)
    left, k, d = np.arange(n, dtype=np.int32), key, doc
    bits, turn = 21, 0
    while len(left):
        h = (k ^ (d.astype(np.uint64) + np.uint64(turn << 32)) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
        slot = (h >> np.uint64(64 - bits)).astype(np.int64)
        table = np.zeros(1 << bits, np.int32)
        at = np.arange(len(left), dtype=np.int32)
        table[slot[::-1]] = at[::-1]
        first = table[slot]
        same = (k[first] == k) & (d[first] == d)
        source[left[same]] = left[first[same]]
        left, k, d = left[~same], k[~same], d[~same]
        bits, turn = max(8, min(21, len(left).bit_length() + 2)), turn + 1
    return source


def _repeats(buf: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of disjoint repeats of MATCH bytes or more, within a document, in
    order. The first place with the same 16 bytes is the source."""
    n = len(buf) - MATCH + 1
    if n <= 0:
        return []
    v = buf.astype(np.uint64)
    four = v[:-3] | v[1:-2] << np.uint64(8) | v[2:-1] << np.uint64(16) | v[3:] << np.uint64(24)
    mul = np.uint64(0x9E3779B97F4A7C15)
    eight = four[:-4] * mul + four[4:] * np.uint64(0xC2B2AE3D27D4EB4F)
    eight ^= eight >> np.uint64(29)
    key = eight[:-8] * mul + eight[8:]
    place = np.arange(n, dtype=np.int32)
    source = _first_equal(key, doc[:n])
    near = place - source <= (1 << 20) - 120  # the farthest that the format can name
    ok = (source < place) & near & (doc[:n] == doc[MATCH - 1 :])
    dist = np.where(ok, place - source, 0)
    edge = np.flatnonzero(np.diff(dist, prepend=0, append=0))
    out, free = [], 0
    raw = buf.tobytes()
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        d = int(dist[s])
        if not d:
            continue
        end = e + MATCH - 1
        s = max(s, free)
        while end - s >= MATCH:
            m = min(end - s, 4096)
            if raw[s : s + m] == raw[s - d : s - d + m]:
                out.append((s, m, d))
            s += m
            free = s
    return out


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A WebP file, or several in a row, of each payload; payloads are multiples of 64 bytes."""
    most = WIDTH * MAX_SIDE
    pieces = [(i, p[k : k + most]) for i, p in enumerate(payloads) for k in range(0, len(p), most)]
    sizes = np.array([len(p) for _, p in pieces], np.int64)
    buf = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    doc = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    modes = _modes()
    plain = np.logical_and.reduceat(modes[0]["has"][buf], starts)
    mode = np.where(plain, 0, 1)
    byte_mode = mode[doc]
    lut = [np.stack([m["code"][m["index"]], m["length"][m["index"]]]) for m in modes]
    value = np.where(byte_mode == 0, lut[0][0][buf], lut[1][0][buf])
    length = np.where(byte_mode == 0, lut[0][1][buf], lut[1][1][buf])
    # a repeat puts its length at its first place, its distance at the second, and nothing elsewhere
    for s, m, d in _repeats(buf, doc):
        x = modes[byte_mode[s]]
        a, n, extra = prefixed(m)
        value[s] = x["code"][256 + a] | extra << int(x["length"][256 + a])
        length[s : s + m] = 0
        length[s] = x["length"][256 + a] + n
        a, n, extra = prefixed(d + 120)
        value[s + 1] = x["d_code"][a] | extra << int(x["d_length"][a])
        length[s + 1] = x["d_length"][a] + n
    header = np.array([m["bits"] for m in modes])[mode] + 40
    body = np.add.reduceat(length, starts)
    nbytes = (header + body + 7) // 8
    first = np.concatenate(([0], np.cumsum(nbytes)))
    ahead = np.cumsum(length) - length
    offset = ahead - np.repeat(ahead[starts] if len(starts) else ahead, sizes) + np.repeat(first[:-1] * 8 + header, sizes)
    lane, shift = offset >> 5, (offset & 31).astype(np.uint64)
    wide = np.where(length > 0, value, 0).astype(np.uint64) << shift
    lanes = int(first[-1] // 4 + 3)
    acc = np.bincount(lane, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), lanes)
    acc += np.bincount(lane + 1, (wide >> np.uint64(32)).astype(np.float64), lanes)
    stream = acc.astype(np.uint64).astype("<u4").tobytes()
    out = [b""] * len(payloads)
    for k, (i, p) in enumerate(pieces):
        s, n, m = int(first[k]), int(nbytes[k]), modes[mode[k]]
        top = head(WIDTH, len(p) // WIDTH) | m["value"] << 40
        hb = (m["bits"] + 47) // 8
        # the last header byte is shared with the first pixels
        mixed = top | int.from_bytes(stream[s + hb - 1 : s + hb], "little") << 8 * (hb - 1)
        out[i] += container(mixed.to_bytes(hb, "little") + stream[s + hb : s + n])
    return out


def samples(media: bytes) -> bytes:
    """The grey samples of stored files: what was the payload."""
    return b"".join((decode(s) & 255).astype(np.uint8).tobytes() for s in streams(media))


def padded(text: str) -> bytes:
    raw = text.encode("utf-8")
    return raw + b"\0" * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def feature_of(payload: bytes) -> str:
    """Rows, mean, spread and the shares of eight grey bands, of pixels read back."""
    px = np.frombuffer(payload, np.uint8)
    bands = np.bincount(px >> 5, minlength=8)
    total = int(px.sum(dtype=np.int64))
    square = int((px.astype(np.int64) ** 2).sum())
    n = len(px)
    return f"rows={n // WIDTH};mean={total * 1000 // n};var={(square * n - total * total) * 100 // (n * n)};bands={'/'.join(str(int(b) * 1000 // n) for b in bands)}"


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the stored files) of every document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    id_type = arrow_type(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            payloads = [padded(t) for t in texts]
            media = encode_payloads(payloads)
            sizes = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema.names)

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def read_media(stored: DataFrame) -> DataFrame:
    """The digests of stored media, from pixels decoded out of the stored bytes."""
    kinds = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    schema = T.StructType([stored.schema["doc_id"], *(T.StructField(n, t) for n, t in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2):
                media = media.as_py()
                payload = samples(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], schema.names)

    return map_arrow(stored.select("doc_id", "n_bytes", "media"), run, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every document's payload as media in the shared folder, reads it back and digests it."""
    return read_media(materialize(store_media(docs), "media"))
