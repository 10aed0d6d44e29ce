"""Lossless WebP (VP8L): an encoder for byte payloads and a decoder for whole streams.

The decoder reads prefix codes, back-references, the colour cache and meta prefix images, and inverts the predictor,
cross-colour, subtract-green and palette transforms. All images of a batch advance together, one pixel a step, so its
inner loop is numpy over images. The encoder writes literals, back-references to earlier equal runs and colour-cache hits
under per-image prefix codes, after any of the transforms. For a payload it takes subtract-green or a palette where these
are estimated to save bits; the predictor and cross-colour, which are made for neighbouring tones, on request alone.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np

#: Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
LENGTH_CODES, DISTANCE_CODES = 24, 40
CACHE_MULTIPLIER = 0x1E35A7BD
#: Distance codes 1 to 120 name near pixels, nearest first: (columns to the left, rows up).
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
_NEAR = np.array(NEAR, np.int64)

WIDTH, MAX_HEIGHT = 16, 16384
SHORTEST, LONGEST_COPY = 3, 4096
_LONGEST = 11  # of the encoder's codes; it keeps the decoder's tables small


class Bits:
    """Bits of a stream, least significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        begin = self.at >> 3
        value = int.from_bytes(self.data[begin : begin + ((n + 14) >> 3)], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


@dataclass
class Writer:
    value: int = 0
    size: int = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


# Prefix codes


def code_lengths(counts: dict[int, int], longest: int = _LONGEST) -> dict[int, int]:
    """Lengths of a complete prefix code over the symbols of positive count; a lone symbol has length 0."""
    used = sorted((c, s) for s, c in counts.items() if c)
    if len(used) < 2:
        return {s: 0 for _, s in used}
    while True:
        # Leaves are in order and joint nodes come in order, so the two least stand at the fronts of two queues; leaves go first.
        n, limit = len(used), 1 << 62
        weight = [c for c, _ in used] + [limit] * n
        parent: list[int] = [0] * (2 * n - 1)
        leaf, joint = 0, n
        for node in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and weight[leaf] <= weight[joint]:
                    total += weight[leaf]
                    parent[leaf] = node
                    leaf += 1
                else:
                    total += weight[joint]
                    parent[joint] = node
                    joint += 1
            weight[node] = total
        depth = [0] * len(parent)
        for node in range(len(parent) - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth) <= longest:
            return {s: depth[i] for i, (_, s) in enumerate(used)}
        used = [((c + 1) // 2, s) for c, s in used]


@functools.cache
def _reverse(value: int, n: int) -> int:
    return int(f"{value:0{n}b}"[::-1], 2) if n else 0


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(bits in stream order, length) of each symbol."""
    out, code, before = {}, 0, 0
    for n, symbol in sorted((n, s) for s, n in lengths.items()):
        code <<= n - before
        out[symbol] = (_reverse(code, n), n)
        code, before = code + 1, n
    return out


def put_code(out: Writer, lengths: dict[int, int]) -> None:
    """Write a prefix code: the simple form for one or two small symbols, else run-length coded lengths."""
    symbols = sorted(lengths)
    if len(symbols) <= 2 and all(s < 256 for s in symbols):
        symbols = symbols or [0]
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        wide = symbols[0] > 1
        out.put(int(wide), 1)
        out.put(symbols[0], 8 if wide else 1)
        if len(symbols) == 2:
            out.put(symbols[1], 8)
        return
    tokens: list[tuple[int, int, int]] = []
    before = -1
    for symbol in symbols:
        gap = symbol - before - 1
        while gap >= 11:
            n = min(gap, 138)
            tokens.append((18, n - 11, 7))
            gap -= n
        if gap >= 3:
            tokens.append((17, gap - 3, 3))
        else:
            tokens += [(0, 0, 0)] * gap
        tokens.append((lengths[symbol] or 1, 0, 0))
        before = symbol
    counts: dict[int, int] = {}
    for token, _, _ in tokens:
        counts[token] = counts.get(token, 0) + 1
    meta = code_lengths(counts, 7)
    codes = canonical(meta)
    last = max(i for i, s in enumerate(CODE_LENGTH_ORDER) if s in meta)
    whole, out = out, Writer()  # a short number grows faster
    out.put(0, 1)
    out.put(max(last + 1, 4) - 4, 4)
    for s in CODE_LENGTH_ORDER[: max(last + 1, 4)]:
        out.put((meta[s] or 1) if s in meta else 0, 3)
    out.put(1, 1)
    bits = max(2, (max(len(tokens) - 2, 0)).bit_length())
    bits += bits & 1
    out.put((bits - 2) // 2, 3)
    out.put(len(tokens) - 2, bits)
    for token, extra, n in tokens:
        code, size = codes[token]
        out.put(code | extra << size, size + n)
    whole.put(out.value, out.size)


def read_lengths(bits: Bits, alphabet: int) -> dict[int, int]:
    """The symbols' code lengths; a lone symbol has length 0."""
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        return {s: int(len(set(symbols)) > 1) for s in symbols}
    meta = {}
    for symbol in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        if n := bits.read(3):
            meta[symbol] = n
    if not meta:
        raise ValueError("a prefix code without symbols")
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lone = next(iter(meta)) if len(meta) == 1 else None
    by_bits = {(n, code): s for s, (code, n) in canonical(meta).items()}
    top = max(meta.values())
    quick: list[tuple[int, int]] = [(0, 0)] * (1 << top)
    for (n, code), s in by_bits.items():
        for high in range(1 << (top - n)):
            quick[code | high << n] = (s, n)
    out, symbol, before = {}, 0, 8
    window = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 8 + 3 * alphabet], "little") >> (bits.at & 7)
    start, taken = bits.at, 0
    mask = (1 << top) - 1
    while symbol < alphabet and left:
        left -= 1
        if lone is None:
            token, n = quick[window & mask]
        else:
            token, n = lone, 0
        window >>= n
        taken += n
        if token < 16:
            if token:
                out[symbol] = before = token
            symbol += 1
            continue
        n, least = ((2, 3), (3, 3), (7, 11))[token - 16]
        run = least + (window & ((1 << n) - 1))
        window >>= n
        taken += n
        if token == 16:
            out.update((s, before) for s in range(symbol, min(symbol + run, alphabet)))
        symbol += run
    bits.at = start + taken
    if len(out) == 1:
        return dict.fromkeys(out, 0)
    if not out or sum(1 << (15 - n) for n in out.values()) != 1 << 15:
        raise ValueError("an incomplete prefix code")
    return out


_turned: dict[int, np.ndarray] = {}


def _table(lengths: dict[int, int]) -> np.ndarray:
    """Entry for the next bits of the stream: symbol, and length in the upper four bits."""
    top = max(lengths.values())
    symbols = np.array(sorted(lengths, key=lambda s: (lengths[s], s)), np.uint16)
    sizes = np.array([lengths[s] for s in symbols.tolist()], np.int64)
    if top not in _turned:
        order = np.zeros(1 << top, np.int64)
        for i in range(top):
            order |= ((np.arange(1 << top) >> i) & 1) << (top - 1 - i)
        _turned[top] = order
    return np.repeat(symbols | (sizes << 12).astype(np.uint16), 1 << (top - sizes))[_turned[top]]


# Decoding


@dataclass
class Stream:
    """An entropy-coded image: where its pixels begin, and what they are read with."""

    bit: int
    width: int
    height: int
    cache_bits: int
    codes: list[list[np.ndarray]]  # five tables a group
    meta: np.ndarray | None = None  # the group of each block
    meta_bits: int = 0


def _pixels(data: np.ndarray, streams: list[Stream]) -> tuple[list[np.ndarray], list[int]]:
    """The ARGB pixels of each stream and the bit after it. data: all streams' bytes with 16 more at the end."""
    order = sorted(range(len(streams)), key=lambda i: -streams[i].width * streams[i].height)
    held = [streams[i] for i in order]
    sizes = np.array([s.width * s.height for s in held], np.int64)
    # Signed like the places: the sign's bits come in from above, where no code reads.
    words = np.ndarray((len(data) - 7,), "<i8", data, 0, (1,))
    bit = np.array([s.bit for s in held], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    out = np.zeros(int(sizes.sum()), np.uint32)
    at: dict[int, int] = {}
    tables: list[np.ndarray] = []
    total = 0
    base, mask, group_of = [], [], []
    for s in held:
        group_of.append(len(base))
        for group in s.codes:
            row = []
            for table in group:
                if id(table) not in at:
                    at[id(table)] = total
                    tables.append(table)
                    total += len(table)
                row.append(at[id(table)])
            base.append(row)
            mask.append([len(t) - 1 for t in group])
    table = np.concatenate(tables)
    base_of, mask_of = np.array(base, np.int64).T.copy(), np.array(mask, np.int64).T.copy()
    group = np.array(group_of, np.int64)
    any_meta = any(s.meta is not None for s in held)
    plain = all(s.cache_bits == 0 for s in held) and all(int((g[0] & 0xFFF).max()) < 256 for s in held for g in s.codes)
    cache_bits = np.array([s.cache_bits for s in held], np.int64)
    cache_at = np.concatenate(([0], np.cumsum(np.where(cache_bits > 0, 1 << cache_bits, 0))))[:-1]
    cache = np.zeros(int(np.where(cache_bits > 0, 1 << cache_bits, 0).sum()), np.uint32)
    cached = np.flatnonzero(cache_bits)
    widths = np.array([s.width for s in held], np.int64)
    left, back = np.zeros(len(held), np.int64), np.ones(len(held), np.int64)
    deepest = max(sum(max(int((t >> 12).max()) for t in [table]) for table in g[:4]) for s in held for g in s.codes)
    bases, masks = [b[group] for b in base_of], [m[group] for m in mask_of]

    def symbol(which: int, rows: np.ndarray | slice, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = window & masks[which][rows]
        at += bases[which][rows]
        entry = table.take(at)
        return entry & 0xFFF, entry >> 12

    def look(where: np.ndarray) -> np.ndarray:
        return words[where >> 3] >> (where & 7)

    def extra(where: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A value of the length and distance prefix coding, and the bit after it."""
        n = np.where(prefix < 4, 0, (prefix - 2) >> 1)
        low = look(where) & ((1 << n) - 1)
        return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << n) + low) + 1, where + n

    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
    for t, k in enumerate(active.tolist()):
        if any_meta:
            for i, s in enumerate(held[:k]):
                if s.meta is not None:
                    across = -(-s.width >> s.meta_bits)
                    g = group_of[i] + int(s.meta[(t // s.width >> s.meta_bits) * across + (t % s.width >> s.meta_bits)])
                    for c in range(5):
                        bases[c][i], masks[c][i] = base_of[c, g], mask_of[c, g]
        rows: np.ndarray | slice = slice(0, k)
        if not plain and left[:k].any():
            rows = np.flatnonzero(left[:k] == 0)
        where = bit[rows]
        window = look(where)
        green, n = symbol(0, rows, window)
        if plain or (green < 256).all():
            literal, values = rows, green
        else:
            index = np.arange(k)[rows]
            literal = index[green < 256]
            copy = np.flatnonzero((green >= 256) & (green < 256 + LENGTH_CODES))
            if len(copy):
                row = index[copy]
                length, after = extra(where[copy] + n[copy], green[copy].astype(np.int64) - 256)
                prefix, n_distance = symbol(4, row, look(after))
                code, after = extra(after + n_distance, prefix.astype(np.int64))
                near = _NEAR[np.minimum(code, len(NEAR)) - 1]
                back[row] = np.maximum(1, np.where(code > len(NEAR), code - len(NEAR), near[:, 0] + near[:, 1] * widths[row]))
                left[row], bit[row] = length, after
            hit = green >= 256 + LENGTH_CODES
            some = index[hit]
            out[starts[some] + t] = cache[cache_at[some] + green[hit] - (256 + LENGTH_CODES)]
            bit[some] = where[hit] + n[hit]
            keep = green < 256
            where, window, values, n = where[keep], window[keep], green[keep], n[keep]
        window = window >> n
        red, n_red = symbol(1, literal, window)
        n = n + n_red
        window = look(where + n) if deepest > 56 else window >> n_red
        blue, n_blue = symbol(2, literal, window)
        alpha, n_alpha = symbol(3, literal, window >> n_blue)
        bit[literal] = where + n + n_blue + n_alpha
        out[starts[literal] + t] = alpha.astype(np.uint32) << 24 | red.astype(np.uint32) << 16 | values.astype(np.uint32) << 8 | blue
        if not plain and left[:k].any():
            copying = np.flatnonzero(left[:k])
            if (back[copying] > t).any():
                raise ValueError("a back-reference before the first pixel")
            out[starts[copying] + t] = out[starts[copying] + t - back[copying]]
            left[copying] -= 1
        if len(cached):
            some = cached[cached < k]
            colour = out[starts[some] + t]
            cache[cache_at[some] + ((colour * np.uint32(CACHE_MULTIPLIER)) >> (32 - cache_bits[some]).astype(np.uint32))] = colour
    found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(streams)
    ends = [0] * len(streams)
    for place, i in enumerate(order):
        found[i], ends[i] = out[starts[place] : starts[place] + sizes[place]], int(bit[place])
    return found, ends


def _read_codes(bits: Bits, cache_bits: int) -> list[np.ndarray]:
    codes: list[np.ndarray] = []
    known: tuple[int, int, np.ndarray] | None = None
    for alphabet in (256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCE_CODES):
        if known and alphabet == 256:  # the same bits give the same code
            at = bits.at
            if bits.read(known[1]) == known[0]:
                codes.append(known[2])
                continue
            bits.at = at
        at = bits.at
        codes.append(_table(read_lengths(bits, alphabet)))
        if alphabet == 256:
            size = bits.at - at
            known = (Bits(bits.data, at).read(size), size, codes[-1])
    return codes


def _sub_image(bits: Bits, width: int, height: int) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    stream = Stream(bits.at, width, height, cache_bits, [])
    stream.codes = [_read_codes(bits, cache_bits)]
    stream.bit = bits.at
    (pixels,), (bits.at,) = _pixels(np.frombuffer(bits.data + bytes(16), np.uint8), [stream])
    return pixels


@dataclass
class Header:
    width: int
    height: int
    transforms: list[tuple]
    stream: Stream


def read_header(data: bytes) -> Header:
    """Everything before the pixels of a VP8L chunk's data."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown VP8L version")
    coded, transforms = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            transforms.append((kind, size, coded, _sub_image(bits, -(-coded >> size), -(-height >> size))))
        elif kind == PALETTE:
            colours = bits.read(8) + 1
            table = _sub_image(bits, colours, 1).view(np.uint8).reshape(-1, 4)
            packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
            transforms.append((kind, packed, coded, np.cumsum(table, 0, dtype=np.uint8).view(np.uint32).ravel()))
            coded = -(-coded >> packed)
        else:
            transforms.append((kind,))
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, meta_bits, groups = None, 0, 1
    if bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = (_sub_image(bits, -(-coded >> meta_bits), -(-height >> meta_bits)) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    codes = [_read_codes(bits, cache_bits) for _ in range(groups)]
    return Header(width, height, transforms, Stream(bits.at, coded, height, cache_bits, codes, meta, meta_bits))


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predicted(mode: int, l: np.ndarray, t: np.ndarray, tr: np.ndarray, tl: np.ndarray) -> np.ndarray:  # noqa: E741
    if mode == 11:
        to_left, to_top = np.abs(t - tl).sum(), np.abs(l - tl).sum()
        return l if to_left < to_top else t
    if mode == 12:
        return np.clip(l + t - tl, 0, 255)
    if mode == 13:
        mean = _average(l, t)
        half = mean - tl
        return np.clip(mean + np.where(half < 0, -(-half >> 1), half >> 1), 0, 255)
    simple = {
        1: lambda: l, 2: lambda: t, 3: lambda: tr, 4: lambda: tl, 5: lambda: _average(_average(l, tr), t), 6: lambda: _average(l, tl),
        7: lambda: _average(l, t), 8: lambda: _average(tl, t), 9: lambda: _average(t, tr), 10: lambda: _average(_average(l, tl), _average(t, tr)),
    }
    return simple[mode]() if mode in simple else np.array([0, 0, 0, 255])


def _predict(pixels: np.ndarray, width: int, height: int, size: int, modes: np.ndarray, sign: int) -> np.ndarray:
    """Add (sign 1) or take off (-1) each pixel's prediction from the pixels before it."""
    across = -(-width >> size)
    source = pixels.view(np.uint8).reshape(height, width, 4).astype(np.int64)
    out = source.copy()
    seen = out if sign == 1 else source
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = seen[0, x - 1] if x else np.array([0, 0, 0, 255])
            elif x == 0:
                guess = seen[y - 1, 0]
            else:
                mode = int(modes[(y >> size) * across + (x >> size)] >> 8) & 15
                beyond = seen[y - 1, x + 1] if x + 1 < width else seen[y, 0]
                guess = _predicted(mode, seen[y, x - 1], seen[y - 1, x], beyond, seen[y - 1, x - 1])
            out[y, x] = (source[y, x] + sign * guess) & 255
    return out.astype(np.uint8).reshape(-1, 4).view(np.uint32).ravel()


def _cross(pixels: np.ndarray, width: int, height: int, size: int, elements: np.ndarray, sign: int) -> np.ndarray:
    across = -(-width >> size)
    y, x = np.divmod(np.arange(width * height), width)
    factor = elements[(y >> size) * across + (x >> size)].view(np.uint8).reshape(-1, 4).view(np.int8).astype(np.int64)
    channel = pixels.view(np.uint8).reshape(-1, 4)
    signed = channel.view(np.int8).astype(np.int64)
    red = (channel[:, 2] + sign * (factor[:, 0] * signed[:, 1] >> 5)) & 255
    true_red = (red if sign == 1 else channel[:, 2]).astype(np.uint8).view(np.int8).astype(np.int64)
    blue = (channel[:, 0] + sign * ((factor[:, 1] * signed[:, 1] >> 5) + (factor[:, 2] * true_red >> 5))) & 255
    out = channel.copy()
    out[:, 0], out[:, 2] = blue, red
    return out.view(np.uint32).ravel()


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    channel = pixels.view(np.uint8).reshape(-1, 4).copy()
    shift = channel[:, 1] if sign == 1 else -channel[:, 1]
    channel[:, 0] += shift
    channel[:, 2] += shift
    return channel.view(np.uint32).ravel()


def _invert(header: Header, pixels: np.ndarray) -> np.ndarray:
    for kind, *rest in reversed(header.transforms):
        pixels = np.ascontiguousarray(pixels)
        if kind == SUBTRACT_GREEN:
            pixels = _green(pixels, 1)
            continue
        size, width, table = rest
        if kind == PREDICTOR:
            pixels = _predict(pixels, width, header.height, size, table, 1)
        elif kind == CROSS_COLOUR:
            pixels = _cross(pixels, width, header.height, size, np.ascontiguousarray(table), 1)
        else:
            each = 8 >> size
            index = (pixels >> 8 & 0xFF).reshape(header.height, -1)
            if size:
                index = (index[:, :, None] >> (np.arange(1 << size) * each) & ((1 << each) - 1)).reshape(header.height, -1)[:, :width]
            padded = np.concatenate((table, np.zeros(256 - len(table), np.uint32)))
            pixels = padded[index].ravel()
    return pixels


def chunk(data: bytes) -> bytes:
    """The VP8L chunk's data of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("no lossless WebP file")
    return data[20 : 20 + struct.unpack_from("<I", data, 16)[0]]


def files(data: bytes) -> Iterator[bytes]:
    """The RIFF files that stand one after another in data."""
    at = 0
    while at < len(data):
        size = 8 + struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + size]
        at += size


def decode(images: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, ARGB pixels in rows) of each WebP file."""
    chunks = [chunk(x) for x in images]
    headers = [read_header(x) for x in chunks]
    at = np.concatenate(([0], np.cumsum([len(x) for x in chunks])))
    data = np.frombuffer(b"".join(chunks) + bytes(16), np.uint8)
    for header, begin in zip(headers, at[:-1].tolist(), strict=True):
        header.stream.bit += 8 * begin
    if not images:
        return []
    # Images of literals alone take a quicker way, so they go by themselves.
    plain = np.array([h.stream.cache_bits == 0 and all(int((g[0] & 0xFFF).max()) < 256 for g in h.stream.codes) for h in headers])
    pixels, ends = [np.zeros(0, np.uint32)] * len(headers), [0] * len(headers)
    for group in (np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()):
        if group:
            for i, found, end in zip(group, *_pixels(data, [headers[i].stream for i in group]), strict=True):
                pixels[i], ends[i] = found, end
    if any(end > 8 * stop for end, stop in zip(ends, at[1:].tolist(), strict=True)):
        raise ValueError("a stream ends before its last pixel")
    return [(h.width, h.height, _invert(h, p)) for h, p in zip(headers, pixels, strict=True)]


# Encoding


@dataclass
class Options:
    """What an image is written with beside literals. copies: (first pixel, length, distance in pixels), or search: those found."""

    cache_bits: int = 0
    copies: list[tuple[int, int, int]] = field(default_factory=list)
    transforms: list[tuple] = field(default_factory=list)  # (PREDICTOR, size, modes), (CROSS_COLOUR, size, elements), (SUBTRACT_GREEN,), (PALETTE,)
    search: bool = False


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number for a length or distance code."""
    value -= 1
    if value < 4:
        return value, 0, 0
    n = value.bit_length() - 2
    return 2 * (n + 1) + (value >> n & 1), value & ((1 << n) - 1), n


@functools.cache
def _near_codes(width: int) -> dict[int, int]:
    return {x + y * width: i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}


def _near_code(distance: int, width: int) -> int:
    return _near_codes(width).get(distance, distance + len(NEAR))


def _length_of_match(pixels: np.ndarray, at: int, before: int) -> int:
    """How many pixels from `at` on equal those from `before` on, up to the longest copy."""
    most, length, step = min(LONGEST_COPY, len(pixels) - at), 0, 64
    while length < most:
        end = min(length + step, most)
        differs = np.flatnonzero(pixels[at + length : at + end] != pixels[before + length : before + end])
        if len(differs):
            return length + int(differs[0])
        length, step = end, step * 4
    return most


def back_references(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """(first pixel, length, distance) of copies of SHORTEST pixels or more, from the start on: each from the nearest earlier place of the
    same SHORTEST pixels. None if they save less than their codes cost."""
    count = len(pixels) - SHORTEST + 1
    if count < 2:
        return []
    wide = pixels.astype(np.uint64)
    key = wide[:count]
    for i in range(1, SHORTEST):
        key = key * np.uint64(0x9E3779B97F4A7C15) + wide[i : count + i]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return []
    at, before = order[same + 1], order[same]
    turn = np.argsort(at)
    found, free = [], 0
    for here, there in zip(at[turn].tolist(), before[turn].tolist(), strict=True):
        if here >= free:
            length = _length_of_match(pixels, here, there)
            if length >= SHORTEST:
                found.append((here, length, here - there))
                free = here + length
    return found if 20 * sum(n for _, n, _ in found) > 30 * len(found) + 150 else []


def _bits_of(*channels: np.ndarray) -> float:
    """Entropy of what is coded together, in bits."""
    counts = np.bincount(np.concatenate(channels), minlength=256)
    counts = counts[counts > 0]
    return float(counts.sum() * np.log2(counts.sum()) - (counts * np.log2(counts)).sum())


def _transforms(pixels: np.ndarray) -> list[tuple]:
    """A palette where each of its colours stands eight times or more; else subtract-green if it lowers the entropy."""
    if len(pixels) >= 32:
        some = np.unique(pixels)
        if len(some) <= min(256, len(pixels) // 8):
            return [(PALETTE,)]
    blue, green, red, alpha = pixels.view(np.uint8).reshape(-1, 4).T
    plain, less = _bits_of(blue, red, alpha), _bits_of(blue - green, red - green, alpha)
    return [(SUBTRACT_GREEN,)] if less < plain else []


def _slots(pixels: np.ndarray, bits: int) -> np.ndarray:
    return ((pixels * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - bits)).astype(np.int64)


def _hits(pixels: np.ndarray, bits: int) -> np.ndarray:
    """The cache slot of each pixel that the colour cache holds, else -1."""
    slot = _slots(pixels, bits)
    order = np.argsort(slot, kind="stable")
    same = (slot[order][1:] == slot[order][:-1]) & (pixels[order][1:] == pixels[order][:-1])
    out = np.full(len(pixels), -1, np.int64)
    out[order[1:][same]] = slot[order[1:][same]]
    # An empty slot holds 0, so the first pixel of a slot is a hit if it is 0 itself.
    firsts = order[np.concatenate(([True], slot[order][1:] != slot[order][:-1]))]
    zero = firsts[pixels[firsts] == 0]
    out[zero] = slot[zero]
    return out


def _lookup(lengths: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    codes, sizes = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
    found = canonical(lengths)
    if found:
        at = np.fromiter(found, np.int64, len(found))
        codes[at], sizes[at] = np.array(list(found.values()), np.uint64).T
    return codes, sizes


def _pack(out: Writer, values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The writer's bits followed by the values, as bytes. No value is longer than 64 bits."""
    ends = out.size + np.cumsum(sizes.astype(np.int64))
    total = int(ends[-1]) if len(ends) else out.size
    at = ends - sizes.astype(np.int64)
    words = np.zeros((total >> 6) + 2, np.uint64)
    place, shift = at >> 6, (at & 63).astype(np.uint64)
    if len(place):
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        words[place[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.where(shift > 0, values >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        words[place[first] + 1] |= np.bitwise_or.reduceat(over, first)
    data = words.tobytes()[: (total + 7) >> 3]
    head = out.value.to_bytes((out.size + 7) >> 3, "little")
    if head and len(data) >= len(head):
        return head[:-1] + bytes([head[-1] | data[len(head) - 1]]) + data[len(head) :]
    return head


def _put_image(out: Writer, pixels: np.ndarray, width: int, options: Options, main: bool) -> tuple[np.ndarray, np.ndarray]:
    """Write the codes of an image and give its pixels' bits."""
    bits = options.cache_bits
    channel = pixels.view(np.uint8).reshape(-1, 4)
    hit = _hits(pixels, bits) if bits else np.full(len(pixels), -1, np.int64)
    keep = np.ones(len(pixels), bool)
    head, more = np.where(hit >= 0, hit + 256 + LENGTH_CODES, channel[:, 1]).astype(np.int64), {}
    distances: dict[int, int] = {}
    for begin, length, distance in options.copies:
        keep[begin : begin + length] = False
        keep[begin] = True
        symbol, extra, n = _prefix(length)
        far, far_extra, far_n = _prefix(_near_code(distance, width))
        head[begin] = 256 + symbol
        distances[far] = distances.get(far, 0) + 1
        more[begin] = (extra, n, far, far_extra, far_n)
    kept = np.flatnonzero(keep)
    literal = kept[head[kept] < 256]
    alphabet = 256 + LENGTH_CODES + ((1 << bits) if bits else 0)
    greens = np.bincount(head[kept], minlength=alphabet)
    others = np.bincount(channel[literal][:, [0, 2, 3]].ravel(), minlength=256)
    green = code_lengths({int(s): int(greens[s]) for s in np.flatnonzero(greens)})
    other = code_lengths({int(s): int(others[s]) for s in np.flatnonzero(others)})
    distance = code_lengths(distances)
    out.put(int(bits > 0), 1)
    if bits:
        out.put(bits, 4)
    if main:
        out.put(0, 1)  # one group of codes
    put_code(out, green)
    again = Writer()
    put_code(again, other)
    for _ in range(3):
        out.put(again.value, again.size)
    put_code(out, distance)
    green_code, green_size = _lookup(green, alphabet)
    code, size = _lookup(other, 256)
    values, sizes = green_code[head], green_size[head]
    for c in (2, 0, 3):  # red, blue, alpha
        symbols = channel[literal, c]
        values[literal] |= code[symbols] << sizes[literal]
        sizes[literal] += size[symbols]
    far_codes = canonical(distance)
    for begin, (extra, n, far, far_extra, far_n) in more.items():
        tail = Writer(int(values[begin]), int(sizes[begin]))
        tail.put(extra, n)
        tail.put(*far_codes[far])
        tail.put(far_extra, far_n)
        values[begin], sizes[begin] = tail.value, tail.size
    return values[kept], sizes[kept]


def _put_sub_image(out: Writer, pixels: np.ndarray, width: int) -> None:
    values, sizes = _put_image(out, np.ascontiguousarray(pixels, np.uint32), width, Options(), False)
    for value, n in zip(values.tolist(), sizes.tolist(), strict=True):
        out.put(value, n)


def encode(pixels: np.ndarray, width: int, options: Options | None = None) -> bytes:
    """A WebP file of ARGB pixels in rows."""
    options = options or Options()
    height = len(pixels) // width
    out = Writer()
    out.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    pixels, coded = np.ascontiguousarray(pixels, np.uint32), width
    for kind, *rest in options.transforms:
        out.put(1 | kind << 1, 3)
        if kind == SUBTRACT_GREEN:
            pixels = _green(pixels, -1)
        elif kind == PALETTE:
            colours, index = np.unique(pixels, return_inverse=True)
            out.put(len(colours) - 1, 8)
            channel = colours.view(np.uint8).reshape(-1, 4)
            _put_sub_image(out, np.diff(channel, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8).view(np.uint32).ravel(), len(colours))
            packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            wide = -(-coded >> packed)
            grid = np.zeros((height, wide << packed), np.uint32)
            grid[:, :coded] = index.reshape(height, coded)
            grid = (grid.reshape(height, wide, 1 << packed) << (np.arange(1 << packed, dtype=np.uint32) * np.uint32(8 >> packed))).sum(2, dtype=np.uint32)
            pixels, coded = (grid << 8 | 0xFF000000).astype(np.uint32).ravel(), wide
        else:
            size, table = rest
            out.put(size - 2, 3)
            _put_sub_image(out, table, -(-coded >> size))
            pixels = (_predict if kind == PREDICTOR else _cross)(pixels, coded, height, size, np.ascontiguousarray(table, np.uint32), -1)
    out.put(0, 1)
    if options.search:
        options = replace(options, copies=back_references(pixels))
    values, sizes = _put_image(out, np.ascontiguousarray(pixels), coded, options, True)
    data = _pack(out, values, sizes)
    padded = data + bytes(len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + padded


def encode_payload(payload: bytes) -> bytes:
    """A payload whose length is a multiple of 64 as images 16 pixels wide: pixel k holds bytes 4k to 4k + 3 as alpha,
    red, green and blue. Beyond 1 MiB further files follow the first one. From 2,048 pixels on a colour cache is used,
    but for palettes. Repeated runs become back-references."""
    step = 4 * WIDTH * MAX_HEIGHT
    out = []
    for begin in range(0, len(payload), step):
        pixels = np.frombuffer(payload[begin : begin + step], ">u4").astype(np.uint32)
        transforms = _transforms(pixels)
        cached = len(pixels) >= 2048 and (PALETTE,) not in transforms
        out.append(encode(pixels, WIDTH, Options(8 if cached else 0, transforms=transforms, search=True)))
    return b"".join(out)


def payload_of(images: list[tuple[int, int, np.ndarray]]) -> bytes:
    return b"".join(p.astype(">u4").tobytes() for _, _, p in images)
