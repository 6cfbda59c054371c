"""Lossless WebP (VP8L) for arrays of pixels: a full decoder, and an encoder for what this package stores.

Pixels are uint8 arrays of shape (height, width, 4), channels A, R, G, B.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: the pixels (left, up) that the first 120 distance codes mean.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD
LENGTHS, DISTANCES = 24, 40
#: Longest code that the encoder gives, and bits that the decoder looks up at once where only one channel varies.
LONGEST, WINDOW = 11, 12
MOST_COPIED = 4096


class WebPError(ValueError):
    pass


#: 16 bits in reverse order.
TURNED = np.packbits(np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8)).reshape(-1, 16)[:, ::-1]).view(">u2").astype(np.int64)


# --- prefix codes -------------------------------------------------------------


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of the given lengths, bits reversed, as they stand in the stream."""
    used = np.flatnonzero(lengths)
    own = lengths[used]
    order = np.argsort(own, kind="stable")
    sizes = own[order]
    top = int(sizes[-1])
    # Codes of one length follow each other; in units of the longest length, each code starts where the last one ends.
    starts = np.cumsum(1 << (top - sizes)) - (1 << (top - sizes))
    words = np.zeros(len(lengths), np.int64)
    words[used[order]] = TURNED[starts >> (top - sizes)] >> (16 - sizes)
    return words


class Code:
    """A prefix code: by the next `bits` bits, symbol << 8 | length. One symbol alone takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only, self.bits = (int(used[0]) if len(used) else 0, 0) if len(used) <= 1 else (None, int(lengths.max()))
        if self.only is not None:
            self.packed = np.array([self.only << 8])
        else:
            own = lengths[used]
            if (1 << self.bits) != (1 << (self.bits - own)).sum():
                raise WebPError("a prefix code is not complete")
            self.packed = packed = np.zeros(1 << self.bits, np.int64)
            for word, n, value in zip(code_words(lengths)[used].tolist(), own.tolist(), (used << 8 | own).tolist()):
                packed[word :: 1 << n] = value
        self.mask = (1 << self.bits) - 1
        self.entries = self.packed.tolist() if self.bits <= 8 else self.packed  # few are asked for one by one in large tables


class Bits:
    """The stream, lowest bit first. win[i] holds the 32 bits from byte i on."""

    def __init__(self, data: bytes):
        self.end = 8 * len(data)
        padded = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        self.windows = padded[:-3] | padded[1:-2] << 8 | padded[2:-1] << 16 | padded[3:] << 24
        self.win = self.windows.tolist()
        self.pos = 0

    def read(self, n: int) -> int:
        if self.pos + n > self.end:
            raise WebPError("the stream ends early")
        out = (self.win[self.pos >> 3] >> (self.pos & 7)) & ((1 << n) - 1)
        self.pos += n
        return out

    def symbol(self, code: Code) -> int:
        found = int(code.entries[(self.win[self.pos >> 3] >> (self.pos & 7)) & code.mask])
        self.pos += found & 255
        if self.pos > self.end:
            raise WebPError("the stream ends early")
        return found >> 8

    def value(self, prefix: int) -> int:
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + [bits.read(8) for _ in range(two)]
        if max(symbols) >= size:
            raise WebPError("a symbol is out of range")
        lengths[symbols] = 1
        return Code(lengths)
    inner = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        inner[LENGTH_ORDER[i]] = bits.read(3)
    code = Code(inner)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        n = bits.symbol(code)
        if n < 16:
            lengths[at] = n
            last, at = n or last, at + 1
        else:
            times = 3 + bits.read(2) if n == 16 else 3 + bits.read(3) if n == 17 else 11 + bits.read(7)
            if at + times > size:
                raise WebPError("code lengths run over")
            lengths[at : at + times] = last if n == 16 else 0
            at += times
    return Code(lengths)


# --- entropy-coded images -----------------------------------------------------


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """width * height pixels as ARGB numbers; only the main image may have several groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("the colour cache is too large")
    groups, which, block = 1, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        which = (read_image(bits, across, (height + (1 << block) - 1) >> block, False) >> 8 & 0xFFFF).reshape(-1, across)
        groups = int(which.max()) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    green, red, blue, alpha, far = codes[0]
    if groups == 1 and not cache_bits and None not in (red.only, blue.only, alpha.only):
        one = read_single_channel(bits, green, far, width, width * height)
        return one.astype(np.int64) << 8 | (alpha.only << 24 | red.only << 16 | blue.only)
    return read_pixels(bits, codes, which, block, cache_bits, width, height)


def read_single_channel(bits: Bits, green: Code, far: Code, width: int, total: int) -> np.ndarray:
    """Where red, blue and alpha stand still: several literals a look-up, and copies in between."""
    if green.only is not None:
        if green.only >= 256:
            raise WebPError("an image of copies alone")
        return np.full(total, green.only, np.uint8)
    # For each window: up to 4 literals, how many, and how many bits they take; none if a copy comes first.
    top = max(WINDOW, green.bits)
    packed = np.where(green.packed < 256 << 8, green.packed, 255)  # a copy fits into no window
    size = 1 << top
    literals, count, used, at = np.zeros((size, 4), np.uint8), np.zeros(size, np.uint8), np.zeros(size, np.int64), np.arange(size)
    for k in range(4):
        found = packed.take((at >> used) & green.mask)
        more = found & 255
        fits = (used + more <= top) & (count == k)
        literals[:, k] = found >> 8
        count += fits
        used += more * fits
    # The window at every bit from here on, and the steps from one to the next; none from the end of the stream on.
    first = bits.pos >> 3
    every = ((bits.windows[first : (bits.end >> 3) + 1, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(size - 1)).reshape(-1)
    end = bits.end - 8 * first
    stretch = every[: min(end, 16 + total * green.bits)]  # no image of literals alone is longer
    steps = [*used[stretch].astype(np.uint8).tobytes(), *bytes(top + 1)]
    out, pos = bytearray(), bits.pos - 8 * first
    while len(out) < total:
        seen, left = [], total - len(out)
        see = seen.append
        while step := steps[pos]:
            see(pos)
            pos += step
        if seen:
            at = every[seen]
            n = np.cumsum(count[at])
            upto = int(np.searchsorted(n, left)) + 1  # this window fills the image, or a copy comes before that
            out.extend(literals[at[:upto]][np.arange(4) < count[at[:upto], None]].tobytes())
            if n[-1] >= left:
                pos = seen[upto - 1] + int(used[every[seen[upto - 1]]])
                break
        if pos >= end:
            raise WebPError("the stream ends early")
        bits.pos = pos + 8 * first
        length = bits.value(bits.symbol(green) - 256)
        back = distance(bits.value(bits.symbol(far)), width)
        if back > len(out) or len(out) + length > total:
            raise WebPError("a copy runs over")
        piece = out[len(out) - back : len(out) - back + length]
        out.extend((piece * (length // len(piece) + 1))[:length])
        pos = bits.pos - 8 * first
    pos += 8 * first
    if len(out) > total:  # the last window looked beyond the image
        pos -= int(green_bits(green, bytes(out[total:])))
        del out[total:]
    if pos > bits.end:
        raise WebPError("the stream ends early")
    bits.pos = pos
    return np.frombuffer(bytes(out), np.uint8)


def green_bits(code: Code, symbols: bytes) -> int:
    known = {int(x) >> 8: int(x) & 255 for x in code.packed}
    return sum(known[s] for s in symbols)


def read_pixels(bits: Bits, codes: list[list[Code]], which: np.ndarray | None, block: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    out, total = [], width * height
    cache, cached = [0] * (1 << cache_bits), 0

    def remember(upto: int) -> None:
        for p in out[cached:upto]:
            cache[((CACHE_FACTOR * p) & 0xFFFFFFFF) >> (32 - cache_bits)] = p

    while len(out) < total:
        y, x = divmod(len(out), width)
        green, red, blue, alpha, far = codes[0 if which is None else which[y >> block, x >> block]]
        s = bits.symbol(green)
        if s < 256:
            r, b = bits.symbol(red), bits.symbol(blue)
            out.append(bits.symbol(alpha) << 24 | r << 16 | s << 8 | b)
        elif s < 256 + LENGTHS:
            length = bits.value(s - 256)
            back = distance(bits.value(bits.symbol(far)), width)
            if back > len(out) or len(out) + length > total:
                raise WebPError("a copy runs over")
            for _ in range(length):
                out.append(out[-back])
        else:
            remember(len(out))
            cached = len(out)
            out.append(cache[s - 256 - LENGTHS])
    return np.array(out, np.int64)


# --- transforms ---------------------------------------------------------------


def channels(argb: np.ndarray, height: int, width: int) -> np.ndarray:
    return argb.astype(">u4").view(np.uint8).reshape(height, width, 4).copy()


def numbers(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels).view(">u4").reshape(-1).astype(np.int64)


def average(a, b):
    return (a.astype(np.int64) + b) >> 1


def predicted(mode: int, left, up, corner, right) -> np.ndarray:
    """What a predictor mode says from the pixels left, above, above left and above right (arrays of channels)."""
    if mode == 1:
        return left
    if mode == 2:
        return up
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return average(average(left, right), up)
    if mode == 6:
        return average(left, corner)
    if mode == 7:
        return average(left, up)
    if mode == 8:
        return average(corner, up)
    if mode == 9:
        return average(up, right)
    if mode == 10:
        return average(average(left, corner), average(up, right))
    if mode == 11:
        to_left = np.abs(up.astype(np.int64) - corner).sum(-1, keepdims=True)
        to_up = np.abs(left.astype(np.int64) - corner).sum(-1, keepdims=True)
        return np.where(to_left < to_up, left, up)
    if mode == 12:
        return np.clip(left.astype(np.int64) + up - corner, 0, 255)
    if mode == 13:
        mean = average(left, up)
        change = mean - corner
        return np.clip(mean + np.sign(change) * (np.abs(change) >> 1), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0]), np.shape(up))


#: Modes that don't look at the pixel to the left: a stretch of a row at once.
ROW_MODES = frozenset({0, 2, 3, 4, 8, 9, 14, 15})


def undo_predictor(rest: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    height, width, _ = rest.shape
    out = rest.astype(np.int64)
    out[0, 0] = (out[0, 0] + [255, 0, 0, 0]) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        ahead = np.concatenate([above[1:], row[:1]])  # beyond the last column comes this row's first pixel
        for start in range(0, width, 1 << block):
            mode, a, b = int(modes[y >> block, start >> block]), max(start, 1), min(start + (1 << block), width)
            if a >= b:
                continue
            if mode in ROW_MODES:
                row[a:b] = (row[a:b] + predicted(mode, None, above[a:b], above[a - 1 : b - 1], ahead[a:b])) & 255
            elif mode == 1:
                row[a:b] = (np.cumsum(row[a:b], axis=0) + row[a - 1]) & 255
            else:
                for x in range(a, b):
                    row[x] = (row[x] + predicted(mode, row[x - 1], above[x], above[x - 1], ahead[x])) & 255
    return out.astype(np.uint8)


def colour_change(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return factor.astype(np.int8).astype(np.int64) * colour.astype(np.uint8).astype(np.int8) >> 5


def undo_cross_colour(pixels: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    height, width, _ = pixels.shape
    own = factors.repeat(1 << block, 0).repeat(1 << block, 1)[:height, :width]
    out = pixels.astype(np.int64)
    green = pixels[..., 2]
    out[..., 1] = (out[..., 1] + colour_change(own[..., 3], green)) & 255
    out[..., 3] = (out[..., 3] + colour_change(own[..., 2], green) + colour_change(own[..., 1], out[..., 1])) & 255
    return out.astype(np.uint8)


def undo_palette(pixels: np.ndarray, colours: np.ndarray, packed: int, width: int) -> np.ndarray:
    index = pixels[..., 2]
    if packed:
        depth = 8 >> packed
        x = np.arange(width)
        index = (index[:, x >> packed] >> (depth * (x & ((1 << packed) - 1)))) & ((1 << depth) - 1)
    table = np.zeros((256, 4), np.uint8)
    table[: len(colours)] = colours
    return table[index]


def palette_packing(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


# --- files --------------------------------------------------------------------


def chunk_of(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebPError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            if at + 8 + size > len(data):
                raise WebPError("the file ends early")
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise WebPError("no lossless image")


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file."""
    bits = Bits(chunk_of(data))
    if bits.read(8) != 0x2F:
        raise WebPError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("unknown version")
    undo, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            w, h = (across + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            data_ = channels(read_image(bits, w, h, False), h, w)
            undo.append((lambda p, m=data_[..., 2], b=block: undo_predictor(p, m, b)) if kind == PREDICTOR else (lambda p, f=data_, b=block: undo_cross_colour(p, f, b)))
        elif kind == SUBTRACT_GREEN:
            undo.append(add_green)
        else:
            size = bits.read(8) + 1
            colours = np.cumsum(channels(read_image(bits, size, 1, False), 1, size)[0].astype(np.int64), axis=0).astype(np.uint8)
            packed = palette_packing(size)
            undo.append(lambda p, c=colours, k=packed, w=across: undo_palette(p, c, k, w))
            across = (across + (1 << packed) - 1) >> packed
    pixels = channels(read_image(bits, across, height, True), height, across)
    for step in reversed(undo):
        pixels = step(pixels)
    return pixels


def add_green(pixels: np.ndarray) -> np.ndarray:
    out = pixels.copy()
    out[..., 1] += pixels[..., 2]
    out[..., 3] += pixels[..., 2]
    return out


class Writer:
    """Bit fields of 25 bits at most, lowest bit first: small ones one by one, and whole arrays of code words at once."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.fields: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        self.fields.append((value, n))

    def puts(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self._flush()
        self.values.append(values)
        self.lengths.append(lengths)

    def _flush(self) -> None:
        if self.fields:
            both = np.array(self.fields, np.int64)
            self.fields = []
            self.puts(both[:, 0], both[:, 1])

    def bytes(self) -> bytes:
        """The fields, packed: each one lies in a word of 32 bits and the one behind it, where no other has a bit set."""
        self._flush()
        lengths = np.concatenate(self.lengths).astype(np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        placed = np.concatenate(self.values).astype(np.int64) << (starts & 31)
        word, size = starts >> 5, int(ends[-1] >> 5) + 2
        packed = np.bincount(word, placed & 0xFFFFFFFF, size) + np.bincount(word + 1, placed >> 32, size)
        return packed[:size].astype("<u4").tobytes()[: int(ends[-1] + 7) >> 3]


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Huffman lengths of the symbols with a count, none above `longest`; a lone symbol gets length 1."""
    used = np.flatnonzero(counts).tolist()
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    weights = np.asarray(counts)[used]
    while True:
        order = np.argsort(weights, kind="stable")
        # The two lightest nodes are at the heads of two queues: of symbols by weight, and of the nodes made, which only grow.
        own = weights[order].tolist()
        n, parent, made, i, j = len(own), [0] * (2 * len(own) - 1), [], 0, 0
        for node in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if i < n and (j >= len(made) or own[i] <= made[j]):
                    total, parent[i], i = total + own[i], node, i + 1
                else:
                    total, parent[n + j], j = total + made[j], node, j + 1
            made.append(total)
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth) <= longest:
            lengths[np.array(used)[order]] = depth[:n]
            return lengths
        weights = weights // 2 + 1


def write_code(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and (not used or used[-1] < 256):
        symbols = used or [0]
        wide = symbols[0] > 1
        for value, n in [(1, 1), (len(symbols) - 1, 1), (int(wide), 1), (symbols[0], 8 if wide else 1)] + [(s, 8) for s in symbols[1:]]:
            out.put(value, n)
        return
    tokens, at = [], 0
    for symbol, n in zip(used, lengths[used].tolist()):
        run = symbol - at
        while run:
            some = min(run, 138)
            if some >= 11:
                tokens.append((18, some - 11, 7))
            elif some >= 3:
                tokens.append((17, some - 3, 3))
            else:
                some = 1
                tokens.append((0, 0, 0))
            run -= some
        tokens.append((n, 0, 0))
        at = symbol + 1
    inner = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    if np.count_nonzero(inner) == 1:  # the format has no lone symbol here without a second one
        inner[0 if not inner[0] else 1] = 1
    size = next(n for n in range(3, 8) if len(tokens) - 2 < 1 << (2 + 2 * n))  # of the field that says how many lengths follow
    fields = [(0, 1), (15, 4)] + [(int(inner[s]), 3) for s in LENGTH_ORDER] + [(1, 1), (size, 3), (len(tokens) - 2, 2 + 2 * size)] if len(tokens) >= 2 else []
    words = code_words(inner)
    for s, extra, n in tokens:
        fields += [(int(words[s]), int(inner[s])), (extra, n)]
    for value, n in fields:
        out.put(value, n)


def prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and how many, of a length or distance code from 1 on."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    extra = top - 1
    return 2 * top + (v >> extra & 1), v & ((1 << extra) - 1), extra


@lru_cache(16)
def near_codes(width: int) -> dict[int, int]:
    """The short codes of distances in an image so wide."""
    return {x + y * width: i + 1 for i, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width >= 1}


def write_image(out: Writer, argb: np.ndarray, width: int, main: bool, copies: list[tuple[int, int, int]] = (), cache_bits: int = 0) -> None:
    """`argb` as literals, but for `copies`: (place, length, distance), in order; with a cache, known colours as its indices."""
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    near = near_codes(width) if len(copies) else {}
    green = (argb >> 8 & 255).astype(np.int64)
    literal = np.ones(len(argb), bool)
    coded = []
    for place, length, back in copies:
        literal[place : place + length] = False
        coded.append((place, prefix_of(length), prefix_of(near.get(back, back + len(NEAR)))))
    symbols = green.copy()
    if cache_bits:
        cache = [-1] * (1 << cache_bits)
        for i, p in enumerate(argb.tolist()):
            slot = ((CACHE_FACTOR * p) & 0xFFFFFFFF) >> (32 - cache_bits)
            if cache[slot] == p and literal[i]:
                symbols[i] = 256 + LENGTHS + slot
            cache[slot] = p
    plain = literal & (symbols < 256)
    counts = np.bincount(symbols[literal], minlength=256 + LENGTHS + (1 << cache_bits if cache_bits else 0))
    far = np.zeros(DISTANCES, np.int64)
    for _, length, back in coded:
        counts[256 + length[0]] += 1
        far[back[0]] += 1
    others, lengths = [], [code_lengths(counts, LONGEST)]
    rest = argb & 0xFFFF00FF
    if len(argb) and (rest == rest[0]).all():  # one value each of red, blue and alpha
        for shift in (16, 0, 24):
            lengths.append(np.zeros(256, np.int64))
            lengths[-1][int(rest[0]) >> shift & 255] = 1
    else:
        others = [(argb >> shift) & 255 for shift in (16, 0, 24)]
        lengths += [code_lengths(np.bincount(c[plain], minlength=256), 15) for c in others]
    lengths.append(code_lengths(far, 15))
    for own in lengths:
        write_code(out, own)
    lengths = [own if np.count_nonzero(own) > 1 else np.zeros_like(own) for own in lengths]  # a lone symbol takes no bits
    words = [code_words(own) if own.any() else own for own in lengths]
    wide = [j for j in (1, 2, 3) if others and lengths[j].any()]
    if not wide:
        own = symbols[literal]
        values, sizes = words[0][own], lengths[0][own]
        if coded:  # each copy's four fields come before the literals behind it
            at = np.repeat(np.searchsorted(np.flatnonzero(literal), [place for place, _, _ in coded]), 4)
            fields = np.array([(words[0][256 + a], lengths[0][256 + a], a_extra, a_bits, words[4][b], lengths[4][b], b_extra, b_bits) for _, (a, a_extra, a_bits), (b, b_extra, b_bits) in coded])
            values, sizes = np.insert(values, at, fields[:, ::2].reshape(-1)), np.insert(sizes, at, fields[:, 1::2].reshape(-1))
        out.puts(values, sizes)
        return
    # A row for each pixel: green or cache symbol, then what varies of red, blue and alpha; copies take the first pixel's row.
    values = np.zeros((len(argb), max(1 + len(wide), 4 if coded else 1)), np.int32)
    sizes = np.zeros_like(values)
    values[literal, 0], sizes[literal, 0] = words[0][symbols[literal]], lengths[0][symbols[literal]]
    for k, j in enumerate(wide, 1):
        values[plain, k], sizes[plain, k] = words[j][others[j - 1][plain]], lengths[j][others[j - 1][plain]]
    for place, (a, a_extra, a_bits), (b, b_extra, b_bits) in coded:
        values[place, :4] = words[0][256 + a], a_extra, words[4][b], b_extra
        sizes[place, :4] = lengths[0][256 + a], a_bits, lengths[4][b], b_bits
    out.puts(values.reshape(-1), sizes.reshape(-1))


def do_predictor(pixels: np.ndarray, mode: int) -> np.ndarray:
    p = pixels.astype(np.int64)
    out = p.copy()
    out[0, 0] -= [255, 0, 0, 0]
    out[0, 1:] -= p[0, :-1]
    out[1:, 0] -= p[:-1, 0]
    if p.shape[0] > 1 and p.shape[1] > 1:
        ahead = np.concatenate([p[:-1, 1:], p[1:, :1]], axis=1)
        out[1:, 1:] -= predicted(mode, p[1:, :-1], p[:-1, 1:], p[:-1, :-1], ahead[:, 1:])
    return (out & 255).astype(np.uint8)


def do_cross_colour(pixels: np.ndarray, factor: tuple[int, int, int]) -> np.ndarray:
    """`factor`: green to red, green to blue, red to blue, as signed bytes."""
    out = pixels.astype(np.int64)
    change = [colour_change(np.array(f), pixels[..., c]) for f, c in zip(factor, (2, 2, 1))]
    out[..., 1] -= change[0]
    out[..., 3] -= change[1] + change[2]
    return (out & 255).astype(np.uint8)


def encode(pixels: np.ndarray, predictor: int | None = None, cross_colour: tuple[int, int, int] | None = None, subtract_green: bool = False, palette: bool = False, copies: list[tuple[int, int, int]] = (), cache_bits: int = 0) -> bytes:
    """A lossless WebP file of `pixels`, with the transforms asked for, in this order; `copies` name repeats in the image that is left."""
    height, width, _ = pixels.shape
    out = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    block = 9
    one = ((width + (1 << block) - 1) >> block) * ((height + (1 << block) - 1) >> block)
    if predictor is not None:
        out.put(1 | PREDICTOR << 1 | (block - 2) << 3, 6)
        write_image(out, np.full(one, 255 << 24 | predictor << 8), width, False)
        pixels = do_predictor(pixels, predictor)
    if cross_colour is not None:
        out.put(1 | CROSS_COLOUR << 1 | (block - 2) << 3, 6)
        r, b, rb = (f & 255 for f in cross_colour)
        write_image(out, np.full(one, 255 << 24 | rb << 16 | b << 8 | r), width, False)
        pixels = do_cross_colour(pixels, cross_colour)
    if subtract_green:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        pixels = pixels.copy()
        pixels[..., 1] -= pixels[..., 2]
        pixels[..., 3] -= pixels[..., 2]
    if palette:
        colours, index = np.unique(numbers(pixels), return_inverse=True)
        if len(colours) > 256:
            raise WebPError("too many colours for a palette")
        table = channels(colours, 1, len(colours))[0].astype(np.int64)
        change = np.diff(table, axis=0, prepend=np.zeros((1, 4), np.int64)).astype(np.uint8)
        out.put(1 | PALETTE << 1 | (len(colours) - 1) << 3, 11)
        write_image(out, numbers(change), len(colours), False)
        packed = palette_packing(len(colours))
        depth, across = 8 >> packed, (width + (1 << packed) - 1) >> packed
        grid = np.zeros((height, across << packed), np.int64)
        grid[:, :width] = index.reshape(height, width)
        green = (grid.reshape(height, across, -1) << (depth * np.arange(1 << packed))).sum(-1)
        argb, width = (255 << 24 | green << 8).reshape(-1), across
    else:
        argb = numbers(pixels)
    out.put(0, 1)
    write_image(out, argb, width, True, copies, cache_bits)
    data = out.bytes()
    body = b"WEBPVP8L" + struct.pack("<I", len(data)) + data + bytes(len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body
