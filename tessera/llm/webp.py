"""Media columns: byte payloads as lossless WebP, written and read back.

The reader handles the whole lossless bit stream: canonical prefix codes, code groups by meta image,
back-references with two-dimensional distances, the colour cache, and the inverse predictor, cross-colour,
subtract-green and palette transforms, and gives pixel arrays. All images of a batch are read side by side, a
symbol of each at a time. The writer stores a payload as 8-bit samples in the green channel, 64 a row, in images of at
most ROWS rows, one after the other; few distinct samples are bundled under a palette, and samples that recur are copied by
back-references where that makes an image smaller. Prediction, colour transforms and the cache gain nothing on one channel of text and are not written.

Defined results: a null or empty text is 64 zero bytes; equal texts have equal media; very long texts have
several images; repeated rows and null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common

# Fixed values of the format.
SIGNATURE = 0x2F
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
#: Near distances: the offsets (dx, dy) of the pixels above and before, from the nearest on.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))

WIDTH, ROWS = 64, 128
U = np.uint64
DEEPEST = 13
TOP = 15
REVERSED = np.array([int(f"{k:015b}"[::-1], 2) for k in range(1 << TOP)], np.int64)


def up(a: int, bits: int) -> int:
    return -(-a // (1 << bits))


# --- Prefix codes -----------------------------------------------------------------------------------------------


def code_lengths(counts: dict[int, int], deepest: int = DEEPEST) -> dict[int, int]:
    """Lengths of a prefix code for the counted symbols, none deeper than that; a single symbol has length 0."""
    if len(counts) <= 1:
        return dict.fromkeys(counts, 0)
    floor = 0
    while True:
        # Two queues, both in ascending order: leaves and what has been joined.
        leaves = sorted((max(n, floor), s) for s, n in counts.items())
        parents, joined, made, at, to = [0] * (2 * len(leaves) - 1), [], len(leaves), 0, 0
        weights = [n for n, _ in leaves]
        for _ in range(len(leaves) - 1):
            total = 0
            for _ in range(2):
                if at < len(weights) and (to >= len(joined) or weights[at] <= joined[to]):
                    total += weights[at]
                    parents[at] = made
                    at += 1
                else:
                    total += joined[to]
                    parents[len(weights) + to] = made
                    to += 1
            joined.append(total)
            made += 1
        depth = [0] * made
        for k in range(made - 2, -1, -1):
            depth[k] = depth[parents[k]] + 1
        if max(depth[: len(leaves)]) <= deepest:
            return {s: depth[k] for k, (_, s) in enumerate(leaves)}
        floor = max(2 * floor, sum(counts.values()) >> deepest, 1)


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(bits as they are written, length) of each symbol."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        out[s] = (int(REVERSED[code] >> (TOP - n)) if n else 0, n)
        code, last = code + 1, n
    return out


class Bits:
    """A writer of little-endian bit fields."""

    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, size: int) -> None:
        self.value |= value << self.size
        self.size += size

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.size // 8), "little")

    def code(self, lengths: dict[int, int], alphabet: int) -> None:
        """A prefix code's lengths; all runs of other symbols are runs of zeros."""
        if len(lengths) <= 1 and next(iter(lengths), 0) < 256:
            self.put(1, 1)
            self.put(0, 1)
            symbol = next(iter(lengths), 0)
            self.put(symbol > 1, 1)
            self.put(symbol, 8 if symbol > 1 else 1)
            return
        if len(lengths) == 1:
            # Only two leaves make a whole code of a symbol beyond 255.
            lengths = {0: 1, next(iter(lengths)): 1}
        self.put(0, 1)
        self.put(len(LENGTH_ORDER) - 4, 4)
        # Sixteen symbols of four bits: 0 to 13 and both runs of zeros.
        four = {*range(DEEPEST + 1), 17, 18}
        for k in LENGTH_ORDER:
            self.put(4 if k in four else 0, 3)
        names = canonical(dict.fromkeys(four, 4))
        self.put(0, 1)
        at = 0
        for s in [*sorted(lengths), alphabet]:
            gap = s - at
            while gap >= 11:
                n = min(gap, 138)
                self.put(*names[18])
                self.put(n - 11, 7)
                gap -= n
            while gap >= 3:
                n = min(gap, 10)
                self.put(*names[17])
                self.put(n - 3, 3)
                gap -= n
            for _ in range(gap):
                self.put(*names[0])
            if s < alphabet:
                self.put(*names[lengths[s]])
            at = s + 1


def prefix_of(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits' value, their number) of a length or distance from 1 on."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v - ((2 + half) << (top - 1)), top - 1


# --- Writing ------------------------------------------------------------------------------------------------------


@dataclass
class Transform:
    """kind with its block bits and its image of 32-bit ARGB values (for a palette: its colours)."""

    kind: int
    bits: int = 0
    image: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.uint32))


def riff(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def head(bits: Bits, width: int, height: int, alpha: bool) -> None:
    bits.put(SIGNATURE, 8)
    bits.put(width - 1, 14)
    bits.put(height - 1, 14)
    bits.put(alpha, 1)
    bits.put(0, 3)


def put_pixels(bits: Bits, pixels: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False, meta: tuple[int, np.ndarray] | None = None) -> None:
    """An entropy-coded image of any kind: literals, optionally back-references and a colour cache, and (main image only) groups of codes by blocks."""
    height, width = pixels.shape
    flat = [int(p) for p in pixels.reshape(-1)]
    cache = [0] * (1 << cache_bits) if cache_bits else None
    slot = lambda p: (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)
    tokens, at, seen = [], 0, {}
    near = {d: k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if (d := x + y * width) >= 1}
    while at < len(flat):
        best = 0
        if references and at + 3 <= len(flat):
            before = seen.get(tuple(flat[at : at + 3]))
            if before is not None:
                while best < 4096 and at + best < len(flat) and flat[before + best] == flat[at + best]:
                    best += 1
        run = max(1, best)
        if best >= 3:
            distance = at - before
            tokens.append((at, "copy", best, near.get(distance, distance + 120)))
        elif cache is not None and cache[slot(flat[at])] == flat[at]:
            tokens.append((at, "cache", slot(flat[at]), 0))
        else:
            tokens.append((at, "literal", flat[at], 0))
        for p in range(at, at + run):
            if cache is not None:
                cache[slot(flat[p])] = flat[p]
            if p >= 2:
                seen[tuple(flat[p - 2 : p + 1])] = p - 2
        at += run
    bits.put(bool(cache_bits), 1)
    if cache_bits:
        bits.put(cache_bits, 4)
    groups = 1
    if main:
        bits.put(meta is not None, 1)
        if meta is not None:
            bits.put(meta[0] - 2, 3)
            groups = int(meta[1].max()) + 1
            put_pixels(bits, (meta[1].astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), False)
    alphabets = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    counts: list[list[dict]] = [[{} for _ in alphabets] for _ in range(groups)]
    plan = []
    for at, kind, value, distance in tokens:
        group = 0 if meta is None else int(meta[1][at // width >> meta[0], at % width >> meta[0]])
        if kind == "literal":
            parts = [(0, value >> 8 & 255, 0, 0), (1, value >> 16 & 255, 0, 0), (2, value & 255, 0, 0), (3, value >> 24, 0, 0)]
        elif kind == "cache":
            parts = [(0, LITERALS + LENGTHS + value, 0, 0)]
        else:
            (s, extra, n), (s2, extra2, n2) = prefix_of(value), prefix_of(distance)
            parts = [(0, LITERALS + s, extra, n), (4, s2, extra2, n2)]
        for k, s, *_ in parts:
            counts[group][k][s] = counts[group][k].get(s, 0) + 1
        plan.append((group, parts))
    codes = []
    for group in counts:
        own = []
        for c, alphabet in zip(group, alphabets, strict=True):
            lengths = code_lengths(c)
            if len(lengths) == 1 and next(iter(lengths)) > 255:
                lengths = {0: 1, next(iter(lengths)): 1}
            bits.code(lengths, alphabet)
            own.append(canonical(lengths))
        codes.append(own)
    for group, parts in plan:
        for k, s, extra, n in parts:
            bits.put(*codes[group][k][s])
            bits.put(extra, n)


def put_transforms(bits: Bits, transforms: list[Transform]) -> None:
    """The transforms in the order in which they were applied; a reader undoes them from the last to the first."""
    for t in transforms:
        bits.put(1, 1)
        bits.put(t.kind, 2)
        if t.kind == PALETTE:
            colours = t.image.reshape(-1)
            bits.put(len(colours) - 1, 8)
            parts = colours.view(np.uint8).reshape(-1, 4)
            put_pixels(bits, np.diff(parts, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8).view(np.uint32).reshape(1, -1), False)
        elif t.kind != GREEN:
            bits.put(t.bits - 2, 3)
            put_pixels(bits, t.image, False)
    bits.put(0, 1)


def image_file(pixels: np.ndarray, width: int, transforms: list[Transform] = (), **kind) -> bytes:
    """A file of residual pixels (what is left after the transforms) of an image of that width."""
    bits = Bits()
    head(bits, width, pixels.shape[0], True)
    put_transforms(bits, list(transforms))
    put_pixels(bits, pixels, True, **kind)
    return riff(bits.bytes())


def bundled(frame: np.ndarray) -> bytes:
    """A file of samples with at most 16 values: palette indices, several to a pixel."""
    values, index = np.unique(frame, return_inverse=True)
    width_bits = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
    size = 8 >> width_bits
    packed = (index.reshape(-1, WIDTH >> width_bits, 1 << width_bits) << (np.arange(1 << width_bits) * size)).sum(2)
    colours = (values.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
    bits = Bits()
    head(bits, WIDTH, len(frame) // WIDTH, False)
    put_transforms(bits, [Transform(PALETTE, image=colours)])
    put_pixels(bits, (packed.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), True)
    return riff(bits.bytes())


def prefixes(most: int) -> np.ndarray:
    """prefix_of() of each value up to most, a row for each of its parts."""
    return np.array([(0, 0, 0), *map(prefix_of, range(1, most + 1))], np.int64).T.copy()


#: Copies are at least and at most so long, and are tried where they make up one sample in SHARE; so many samples and frames are searched at a time
#: (of a sample some 80 bytes are held; a task's memory follows from that, and no file does).
LEAST, LONGEST, SHARE, SEARCHED, FRAMES = 16, 4096, 8, 1 << 19, 4096
PREFIX = prefixes(WIDTH * ROWS + len(NEAR))
#: The code of each distance in an image of WIDTH.
CODE_OF = np.arange(WIDTH * ROWS) + len(NEAR)
for _k, (_x, _y) in reversed(list(enumerate(NEAR))):
    if 1 <= _x + _y * WIDTH < len(CODE_OF):
        CODE_OF[_x + _y * WIDTH] = _k + 1


def copied(frames: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, lengths, distances) of each frame's copies. A copy goes on as long as four samples recur at one distance, the last one each time."""
    sizes = np.array([len(f) for f in frames])
    starts = np.cumsum(sizes) - sizes
    data = np.concatenate(frames)
    # Four samples, the frame and the place in it, in one number to sort.
    key = (data[:-3].astype("<u4") | data[1:-2].astype("<u4") << np.uint32(8) | data[2:-1].astype("<u4") << np.uint32(16) | data[3:].astype("<u4") << np.uint32(24)).astype(np.uint64)
    key <<= U(29)
    key |= (np.repeat(np.arange(len(frames), dtype=np.uint64) << U(13), sizes) + (np.arange(len(data), dtype=np.uint64) - np.repeat(starts.astype(np.uint64), sizes)))[:-3]
    across = (starts[1:, None] - np.array([1, 2, 3])).reshape(-1)
    key = np.delete(key, across) if len(across) else key
    key.sort()
    late = np.flatnonzero((key[1:] ^ key[:-1]) < U(8192)) + 1
    here = key[late] & U(0x1FFFFFFF)
    distance = np.zeros(len(data), np.int16)
    distance[(here & U(8191)).astype(np.int64) + starts[(here >> U(13)).astype(np.int64)]] = key[late] - key[late - 1]
    turns = np.concatenate((np.flatnonzero(distance[1:] != distance[:-1]) + 1, [len(data)]))
    first = np.concatenate(([0], turns[:-1]))
    # Only runs that give a copy of LEAST samples count; places in them are where a copy may start.
    long = (distance[first] > 0) & (turns - first + 3 >= LEAST)
    tokens, lengths, end = [], [], 0
    for p, q in zip(first[long].tolist(), (turns[long] + 3).tolist(), strict=True):
        p = max(p, end)
        while q - p >= LEAST:
            n = min(q - p, LONGEST)
            tokens.append(p)
            lengths.append(n)
            p = end = p + n
    tokens, lengths = np.array(tokens, np.int64), np.array(lengths, np.int64)
    cuts = np.searchsorted(tokens, starts[1:])
    return [(t - s, n, distance[t].astype(np.int64)) for t, n, s in zip(np.split(tokens, cuts), np.split(lengths, cuts), starts.tolist(), strict=True)]


def entropy(counts: np.ndarray) -> float:
    counts = counts[counts > 0]
    return float((counts * -np.log2(counts / counts.sum())).sum()) if len(counts) else 0.0


def fields_of(frame: np.ndarray, counts: np.ndarray, copies: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[Bits, np.ndarray, np.ndarray]:
    """(head, bit fields, their sizes) of a frame, with copies where those make it smaller."""
    at, length, distance = copies
    there, green, uses, fars = at[:0], frame, counts, np.zeros(DISTANCES, np.int64)
    if length.sum() * SHARE >= len(frame):
        size, size_extra, size_bits = PREFIX[:, length]
        far, far_extra, far_bits = PREFIX[:, CODE_OF[distance]]
        inside = np.repeat(at + 1 - (np.cumsum(length - 1) - (length - 1)), length - 1) + np.arange(int((length - 1).sum()))
        mixed = frame.astype(np.int64)
        mixed[at] = LITERALS + size
        mixed = np.delete(mixed, inside)
        both = np.bincount(mixed, minlength=LITERALS + LENGTHS), np.bincount(far, minlength=DISTANCES)
        # Some 100 bits describe the code of the distances and the lengths' part of the other one.
        if sum(map(entropy, both)) + size_bits.sum() + far_bits.sum() + 100 < entropy(counts):
            there, green, (uses, fars) = at - (np.cumsum(length - 1) - (length - 1)), mixed, both
    bits = Bits()
    head(bits, WIDTH, len(frame) // WIDTH, False)
    bits.put(0, 3)  # no transform, no cache, one group
    lengths, far_lengths = (code_lengths(dict(zip((k := np.flatnonzero(c)).tolist(), c[k].tolist(), strict=True))) for c in (uses, fars))
    bits.code(lengths, LITERALS + LENGTHS)
    for symbol in (0, 0, 255):
        bits.code({symbol: 0}, 256)
    bits.code(far_lengths or {0: 0}, DISTANCES)
    table, far_table = np.zeros((2, LITERALS + LENGTHS), np.int64), np.zeros((2, DISTANCES), np.int64)
    for t, own in ((table, lengths), (far_table, far_lengths)):
        for symbol, (code, n) in canonical(own).items():
            t[:, symbol] = code, n
    code, width = table[:, green]
    if len(there):
        code[there] |= size_extra << width[there]
        width[there] += size_bits
        code, width = np.insert(code, there + 1, far_table[0, far] | far_extra << far_table[1, far]), np.insert(width, there + 1, far_table[1, far] + far_bits)
    return bits, code, width


def payload_files(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of 64 bytes) as one or more files, one after the other."""
    frames, owner = [], []
    for k, p in enumerate(payloads):
        for at in range(0, len(p), WIDTH * ROWS):
            frames.append(np.frombuffer(p, np.uint8, min(WIDTH * ROWS, len(p) - at), at))
            owner.append(k)
    made: list[bytes] = [b""] * len(frames)
    plain, counts = [], []
    for k, frame in enumerate(frames):
        count = np.bincount(frame, minlength=LITERALS + LENGTHS)
        if np.count_nonzero(count) <= 16:
            made[k] = bundled(frame)
        else:
            plain.append(k)
            counts.append(count)
    at = 0
    while at < len(plain):
        # Frames are searched and laid out some at a time.
        to, held = at, 0
        while to < len(plain) and to - at < FRAMES and held < SEARCHED:
            held += len(frames[plain[to]])
            to += 1
        some = [frames[k] for k in plain[at:to]]
        parts = [fields_of(f, c, t) for f, c, t in zip(some, counts[at:to], copied(some), strict=True)]
        for k, m in zip(plain[at:to], laid_out(parts), strict=True):
            made[k] = m
        at = to
    files = [b""] * len(payloads)
    for k, o in enumerate(owner):
        files[o] += made[k]
    return files


def laid_out(parts: list[tuple[Bits, np.ndarray, np.ndarray]]) -> list[bytes]:
    """The files of so many heads and bit fields: all fields lie in 32-bit words, each frame from a word of its own on."""
    heads = [p[0] for p in parts]
    code, width = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    sizes = np.array([len(p[1]) for p in parts])
    ends = np.cumsum(width)
    last = ends[np.cumsum(sizes) - 1]
    own = np.diff(last, prepend=0)
    begun = np.array([b.size % 32 for b in heads])
    total = own + begun
    words = -(-total // 32) + 1
    first = np.cumsum(words) - words
    place = ends - width + np.repeat(first * 32 + begun - (last - own), sizes)
    field_ = code.astype(np.uint64) << (place & 31).astype(np.uint64)
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    word = place >> 5
    np.add.at(out, word, field_ & U(0xFFFFFFFF))
    np.add.at(out, word + 1, field_ >> U(32))
    raw = out.astype("<u4")
    made = []
    for b, f, n in zip(heads, first.tolist(), total.tolist(), strict=True):
        whole = b.size // 32 * 4
        start = b.value.to_bytes(whole + 4, "little")
        raw[f] |= int.from_bytes(start[whole:], "little")
        made.append(riff(start[:whole] + raw[f : f + -(-n // 32)].tobytes()[: -(-n // 8)]))
    return made


# --- Reading ------------------------------------------------------------------------------------------------------


class Reader:
    """Little-endian bit fields of a stream."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def get(self, n: int) -> int:
        first = self.at >> 3
        value = int.from_bytes(self.data[first : first + (n + 14 >> 3)], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


def read_lengths(r: Reader, alphabet: int) -> np.ndarray:
    """The code lengths of an alphabet; a single symbol has length 0 and is marked by -1."""
    lengths = np.zeros(alphabet, np.int64)
    if r.get(1):
        two, wide = r.get(1), r.get(1)
        symbols = [r.get(8 if wide else 1)]
        if two:
            symbols.append(r.get(8))
        lengths[symbols] = 1 if len(set(symbols)) > 1 else -1
        return lengths
    own = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + r.get(4)]:
        own[k] = r.get(3)
    if (own > 0).sum() == 1:
        own[own > 0] = -1
    table, depth = lookup(own)
    most = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else alphabet
    at, last = 0, 8
    while at < alphabet and most:
        most -= 1
        entry = int(table[REVERSED[peek(r)] >> (TOP - depth)])
        r.at += entry & 15
        s = entry >> 4
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
        else:
            n = 3 + r.get(2) if s == 16 else 3 + r.get(3) if s == 17 else 11 + r.get(7)
            lengths[at : at + n] = last if s == 16 else 0
            at += n
    if (lengths > 0).sum() == 1:
        lengths[lengths > 0] = -1
    return lengths


def peek(r: Reader) -> int:
    first = r.at >> 3
    return int.from_bytes(r.data[first : first + 3], "little") >> (r.at & 7) & 0x7FFF


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(table of symbol << 4 | length by the code's bits, most significant first; number of those bits)."""
    single = np.flatnonzero(lengths < 0)
    if len(single) or not lengths.any():
        return np.array([int(single[0]) << 4 if len(single) else 0], np.int32), 0
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    depth = int(lengths.max())
    table = np.repeat((order << 4 | lengths[order]).astype(np.int32), 1 << (depth - lengths[order]))
    if len(table) != 1 << depth:
        raise ValueError("a prefix code is not complete")
    return table, depth


@dataclass
class Image:
    """An image whose codes are read; data starts at bit `at` of its stream."""

    width: int
    height: int
    cache_bits: int
    groups: list[list[tuple[np.ndarray, int]]]
    meta: tuple[int, np.ndarray] | None
    at: int = 0


def read_codes(r: Reader, width: int, height: int, main: bool) -> Image:
    cache_bits = r.get(4) if r.get(1) else 0
    meta, groups = None, 1
    if main and r.get(1):
        bits = r.get(3) + 2
        image = read_one(r, up(width, bits), up(height, bits))
        meta = bits, (image >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64)
        groups = int(meta[1].max()) + 1
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[lookup(read_lengths(r, n)) for n in sizes] for _ in range(groups)]
    return Image(width, height, cache_bits, codes, meta, r.at)


def read_one(r: Reader, width: int, height: int) -> np.ndarray:
    """A transform's or meta image."""
    image = read_codes(r, width, height, False)
    pixels, (r.at,) = read_pixels([image], [r.data])
    return pixels[0]


def read_pixels(images: list[Image], streams: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
    """The pixels of all images, and the bit that each ends at: one symbol of every unfinished image at a time."""
    n = len(images)
    data = b"".join(s + b"\0" * 8 for s in streams) + b"\0" * 8
    starts = np.cumsum([0] + [len(s) + 8 for s in streams[:-1]], dtype=np.int64)
    eight = np.ndarray((len(data) - 8,), "<u8", buffer=data, strides=(1,))
    bit = starts * 8 + np.array([i.at for i in images])
    sizes = np.array([i.width * i.height for i in images], np.int64)
    base = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint32)
    # Every code's table lies in one array: by image, group and code its start and number of bits.
    first_group = np.cumsum([0] + [len(i.groups) for i in images[:-1]])
    codes = [c for i in images for g in i.groups for c in g]
    depth = np.array([d for _, d in codes], np.int64).reshape(-1, 5)
    table_at = np.cumsum([0] + [len(t) for t, _ in codes[:-1]], dtype=np.int64).reshape(-1, 5)
    # Up to 32 KB for an image in 32 bits: the largest part of what is held.
    table = np.concatenate([t for t, _ in codes])
    fixed = [table[table_at[:, c]].astype(np.int64) >> 4 if not depth[:, c].any() else None for c in range(5)]
    caches = [np.zeros(1 << i.cache_bits, np.uint32) if i.cache_bits else None for i in images]
    cached = any(i.cache_bits for i in images)
    grouped = any(i.meta is not None for i in images)
    place = np.zeros(n, np.int64)

    def symbol(lanes, group, code):
        if fixed[code] is not None:
            return fixed[code][group]
        at = bit[lanes]
        window = (eight[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64(0x7FFF)).astype(np.int64)
        entry = table[table_at[group, code] + (REVERSED[window] >> (TOP - depth[group, code]))].astype(np.int64)
        bit[lanes] = at + (entry & 15)
        return entry >> 4

    def extra(lane, prefix):
        """A length or distance from its prefix symbol, from 1 on."""
        if prefix < 4:
            return prefix + 1
        size = (prefix - 2) >> 1
        at = int(bit[lane])
        value = int(eight[at >> 3]) >> (at & 7) & ((1 << size) - 1)
        bit[lane] += size
        return ((2 + (prefix & 1)) << size) + value + 1

    def extras(k, prefix):
        """extra() of many lanes."""
        bits = np.where(prefix < 4, 0, (prefix - 2) >> 1)
        at = bit[k]
        value = (eight[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.int64) & ((1 << bits) - 1)
        bit[k] = at + bits
        return np.where(prefix < 4, prefix, (2 + (prefix & 1)) << bits) + value + 1

    widths, offsets = np.array([i.width for i in images], np.int64), np.array(NEAR, np.int64).T
    lanes = np.flatnonzero(sizes > 0)
    while len(lanes):
        group = first_group[lanes]
        if grouped:
            group = group + np.array([0 if (m := images[k].meta) is None else m[1][p // images[k].width >> m[0], p % images[k].width >> m[0]] for k, p in zip(lanes.tolist(), place[lanes].tolist(), strict=True)])
        green = symbol(lanes, group, 0)
        plain = green < LITERALS
        if plain.all():
            mine, own, value = lanes, group, green
        else:
            mine, own, value = lanes[plain], group[plain], green[plain]
        if len(mine):
            red, blue, alpha = symbol(mine, own, 1), symbol(mine, own, 2), symbol(mine, own, 3)
            argb = (alpha << 24 | red << 16 | value << 8 | blue).astype(np.uint32)
            out[base[mine] + place[mine]] = argb
            place[mine] += 1
            if cached:
                for k, p in zip(mine.tolist(), argb.tolist(), strict=True):
                    if caches[k] is not None:
                        caches[k][(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - images[k].cache_bits)] = p
        if not cached and len(mine) < len(lanes):
            # Copies of all images at once.
            own = np.flatnonzero(~plain)
            k, start = lanes[own], base[lanes[own]] + place[lanes[own]]
            length = extras(k, green[own] - LITERALS)
            code = extras(k, symbol(k, group[own], 4))
            x, y = offsets[:, np.minimum(code, len(NEAR)) - 1]
            distance = np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, x + y * widths[k]))
            if (distance > place[k]).any() or (place[k] + length > sizes[k]).any():
                raise ValueError("a back-reference leaves the image")
            each = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            # A copy that overlaps itself repeats what is there.
            out[np.repeat(start, length) + each] = out[np.repeat(start - distance, length) + each % np.repeat(distance, length)]
            place[k] += length
        for j in np.flatnonzero(~plain).tolist() if cached else ():
            k, s = int(lanes[j]), int(green[j]) - LITERALS
            image, b, p = images[k], int(base[k]), int(place[k])
            if s < LENGTHS:
                length = extra(k, s)
                code = extra(k, int(symbol(lanes[j : j + 1], group[j : j + 1], 4)[0]))
                if code > len(NEAR):
                    distance = code - len(NEAR)
                else:
                    x, y = NEAR[code - 1]
                    distance = max(1, x + y * image.width)
                if distance > p or p + length > sizes[k]:
                    raise ValueError("a back-reference leaves the image")
                for q in range(b + p, b + p + length):
                    out[q] = out[q - distance]
                copied = out[b + p : b + p + length]
            else:
                length = 1
                out[b + p] = caches[k][s - LENGTHS]
                copied = out[b + p : b + p + 1]
            if caches[k] is not None:
                for q in copied.tolist():
                    caches[k][(CACHE_FACTOR * q & 0xFFFFFFFF) >> (32 - image.cache_bits)] = q
            place[k] = p + length
        done = place[lanes] >= sizes[lanes]
        if done.any():
            lanes = lanes[~done]
    pixels = [out[b : b + s].reshape(i.height, i.width) for b, s, i in zip(base.tolist(), sizes.tolist(), images, strict=True)]
    return pixels, (bit - starts * 8).tolist()


def parts_of(pixels: np.ndarray) -> np.ndarray:
    """(height, width, 4): blue, green, red, alpha."""
    return np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)


def predicted(mode: int, left, top, corner, ahead):
    """The prediction of a pixel, of integer arrays of four parts."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 11:
        guess = left + top - corner
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        middle = mean(left, top)
        return np.clip(middle + np.trunc((middle - corner) / 2).astype(np.int64), 0, 255)
    simple = {
        1: lambda: left, 2: lambda: top, 3: lambda: ahead, 4: lambda: corner, 5: lambda: mean(mean(left, ahead), top), 6: lambda: mean(left, corner), 7: lambda: mean(left, top),
        8: lambda: mean(corner, top), 9: lambda: mean(top, ahead), 10: lambda: mean(mean(left, corner), mean(top, ahead)),
    }
    return simple[mode]() if mode in simple else np.array([0, 0, 0, 255])


def neighbours(flat: np.ndarray, at: int, width: int, mode: int):
    """The prediction at a place of a flat array of parts whose earlier places are known."""
    if at == 0:
        return np.array([0, 0, 0, 255])
    if at < width:
        return flat[at - 1]
    if at % width == 0:
        return flat[at - width]
    # Right of a row's end lies the current row's start.
    return predicted(mode, flat[at - 1], flat[at - width], flat[at - width - 1], flat[at - width + 1])


def invert(pixels: np.ndarray, t: Transform, width: int) -> np.ndarray:
    """Undo a transform; width is that of the image before it."""
    if t.kind == PALETTE:
        colours = np.zeros(256, np.uint32)
        colours[: t.image.size] = t.image.reshape(-1)
        width_bits = t.bits
        index = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64)
        size = 8 >> width_bits
        each = index[:, :, None] >> (np.arange(1 << width_bits) * size) & ((1 << size) - 1)
        return colours[each.reshape(len(pixels), -1)[:, :width]]
    parts = parts_of(pixels).astype(np.int64)
    if t.kind == GREEN:
        parts[..., [0, 2]] += parts[..., [1]]
    elif t.kind == CROSS:
        rows, cols = np.arange(len(pixels)) >> t.bits, np.arange(width) >> t.bits
        wide = parts_of(t.image)[rows[:, None], cols[None, :]].astype(np.int8).astype(np.int64)
        signed = lambda x: (x & 255).astype(np.uint8).astype(np.int8).astype(np.int64)
        parts[..., 2] += wide[..., 0] * signed(parts[..., 1]) >> 5
        parts[..., 0] += wide[..., 1] * signed(parts[..., 1]) >> 5
        parts[..., 0] += wide[..., 2] * signed(parts[..., 2]) >> 5
    else:
        modes = (t.image >> np.uint32(8) & np.uint32(15)).astype(np.int64)
        flat = parts.reshape(-1, 4)
        for at in range(len(flat)):
            flat[at] = (flat[at] + neighbours(flat, at, width, int(modes[at // width >> t.bits, at % width >> t.bits]))) & 255
    return (parts & 255).astype(np.uint8).view(np.uint32).reshape(pixels.shape)


def files_in(raw: bytes) -> list[bytes]:
    """The streams of files that lie one after the other."""
    out, at = [], 0
    while at < len(raw):
        tag, size, kind, n = struct.unpack_from("<4sI8sI", raw, at)
        if tag != b"RIFF" or kind != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        out.append(raw[at + 20 : at + 20 + n])
        at += 8 + size
    return out


def read_streams(streams: list[bytes]) -> list[np.ndarray]:
    """The pixels (height, width) of 32-bit ARGB of each stream."""
    images, undo = [], []
    for s in streams:
        r = Reader(s)
        if r.get(8) != SIGNATURE:
            raise ValueError("not a lossless stream")
        width, height = r.get(14) + 1, r.get(14) + 1
        r.get(1)
        if r.get(3):
            raise ValueError("unknown version")
        own = []
        while r.get(1):
            t = Transform(r.get(2))
            before = width
            if t.kind == PALETTE:
                size = r.get(8) + 1
                delta = parts_of(read_one(r, size, 1))[0]
                t.image = np.cumsum(delta, axis=0, dtype=np.uint8).view(np.uint32).reshape(-1)
                t.bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
                width = up(width, t.bits)
            elif t.kind != GREEN:
                t.bits = r.get(3) + 2
                t.image = read_one(r, up(width, t.bits), up(height, t.bits))
            own.append((t, before))
        images.append(read_codes(r, width, height, True))
        undo.append(own)
    pixels, _ = read_pixels(images, streams)
    for k, own in enumerate(undo):
        for t, width in reversed(own):
            pixels[k] = invert(pixels[k], t, width)
    return pixels


def payloads_of(media: list[bytes]) -> list[bytes]:
    """The samples (green parts) of each item's files."""
    streams = [files_in(m) for m in media]
    pixels = read_streams([s for own in streams for s in own])
    out, at = [], 0
    for own in streams:
        out.append(b"".join(parts_of(p)[..., 1].tobytes() for p in pixels[at : at + len(own)]))
        at += len(own)
    return out


def feature(samples: bytes) -> str:
    """Mean, mean step between neighbours in a row, and a 16-bin histogram in per mille."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH).astype(np.int64)
    bins = np.bincount(x.reshape(-1) >> 4, minlength=16) * 1000 // x.size
    return f"{x.sum() * 1000 // x.size}|{np.abs(np.diff(x, axis=1)).sum() * 1000 // (x.size - len(x))}|" + ",".join(map(str, bins.tolist()))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's bytes, padded to a positive multiple of 64, as WebP files."""

    def run(rows):
        for batch in common.batches(rows, most=4 << 20):
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            media = payload_files([r + b"\0" * (-len(r) % WIDTH if r else WIDTH) for r in raw])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return common.slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, samples, feature) of a table with doc_id, n_bytes and media."""

    def run(rows):
        for batch in common.batches(rows, "media", most=3 << 20):
            samples = payloads_of(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(samples, pa.binary()), pa.array([feature(s) for s in samples])], ["doc_id", "n_bytes", "media", "samples", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, samples binary, feature string")
