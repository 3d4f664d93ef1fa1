"""Decoding of MPEG audio, layers I to III of MPEG-1, in numpy.

The standard's large tables (synthesis window, Huffman codes, scale factor bands, layer
II's allocations) have no generating rule. They are a parameter: a JSON file in the
caller's hands, as load() describes. What has a rule is built by it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path
from typing import Any

import numpy as np

from . import mpeg
from .flac import Reader

BANDS, SLOTS = 32, 18
#: Bits of the two groups of scale factors by scalefac_compress, what
#: preflag adds to them, and the antialiasing coefficients.
LENGTHS = [(0, 0), (0, 1), (0, 2), (0, 3), (3, 0), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (4, 2), (4, 3)]
PRETAB = np.array([0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 3, 3, 3, 2, 0])
ALIAS = np.array([-0.6, -0.535, -0.33, -0.185, -0.095, -0.041, -0.0142, -0.0037])
#: Groups of bands over which scale factors may be shared, as first and last + 1.
SHARED = ((0, 6), (6, 11), (11, 16), (16, 21))


@dataclass
class Codebook:
    """codes: "bits" -> values; linbits more for a value of 15 in a pair."""

    codes: dict[str, tuple[int, ...]]
    linbits: int = 0

    def __post_init__(self) -> None:
        self.by: dict[tuple[int, int], tuple[int, ...]] = {(len(k), int(k, 2)): tuple(v) for k, v in self.codes.items()}
        self.longest = max(map(len, self.codes), default=0)

    def read(self, r: Reader) -> tuple[int, ...]:
        code = 0
        for n in range(1, self.longest + 1):
            code = code << 1 | r.number(1)
            if (n, code) in self.by:
                return self.by[n, code]
        raise ValueError("no such Huffman code")


@dataclass
class Tables:
    window: np.ndarray
    pairs: dict[int, Codebook] = field(default_factory=dict)
    quads: dict[int, Codebook] = field(default_factory=dict)
    long: dict[int, list[int]] = field(default_factory=dict)
    short: dict[int, list[int]] = field(default_factory=dict)
    allocations: list[dict[str, Any]] = field(default_factory=list)


def load(path: str) -> Tables:
    """window: 512 numbers; pairs and quads: by table number {"codes": {"0110": [x, y]},
    "linbits": n}; long and short: by rate the bands' edges; allocations: for layer II
    {"kbps": [...], "rates": [...], "bands": [[levels by allocation], ...]}."""
    raw = json.loads(Path(path).read_text())
    books = lambda name: {int(k): Codebook({c: tuple(x) for c, x in v["codes"].items()}, v.get("linbits", 0)) for k, v in raw.get(name, {}).items()}
    window = np.array(raw["window"], np.float64)
    if window.shape != (512,):
        raise ValueError("the synthesis window has 512 values")
    return Tables(window, books("pairs"), books("quads"), *({int(k): v for k, v in raw.get(n, {}).items()} for n in ("long", "short")), raw.get("allocations", []))


# ---- synthesis


@lru_cache(1)
def matrixing() -> np.ndarray:
    i, k = np.arange(64)[:, None], np.arange(BANDS)
    return np.cos((16 + i) * (2 * k + 1) * np.pi / 64)


def synthesize(bands: np.ndarray, window: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """bands: slots by 32; past: the last 15 vectors of 64 -> samples, and the new past."""
    v = np.concatenate([past, bands @ matrixing().T])
    n, d = len(bands), window.reshape(16, BANDS)
    out = np.zeros((n, BANDS))
    for i in range(8):
        out += d[2 * i] * v[15 - 2 * i : 15 - 2 * i + n, :32] + d[2 * i + 1] * v[14 - 2 * i : 14 - 2 * i + n, 32:]
    return out.ravel(), v[-15:]


# ---- layers I and II


def scale_factor(index: np.ndarray) -> np.ndarray:
    return 2.0 ** (1 - index / 3)


def level(code: np.ndarray, levels: int) -> np.ndarray:
    """One of an odd number of levels, from near -1 to near 1."""
    return (2 * code - (levels - 1)) / levels


def layer1(r: Reader, h: mpeg.Frame, bound: int, channels: int) -> np.ndarray:
    """channels by 12 slots by 32 bands."""
    bits = np.zeros((channels, BANDS), np.int64)
    for b in range(BANDS):
        for c in range(channels if b < bound else 1):
            n = r.number(4)
            if n == 15:
                raise ValueError("a reserved allocation")
            bits[c if b < bound else slice(None), b] = n + 1 if n else 0
    scale = np.zeros((channels, BANDS))
    for b in range(BANDS):
        for c in range(channels):
            if bits[c, b]:
                scale[c, b] = scale_factor(np.array(r.number(6)))
    out = np.zeros((channels, 12, BANDS))
    for t in range(12):
        for b in range(BANDS):
            for c in range(channels if b < bound else 1):
                if n := int(bits[c, b]):
                    x = level(np.array(r.number(n)), (1 << n) - 1)
                    out[c if b < bound else slice(None), t, b] = x
    return out * scale[:, None]


def layer2(r: Reader, h: mpeg.Frame, bound: int, channels: int, tables: Tables) -> np.ndarray:
    """channels by 36 slots by 32 bands; three samples share a code where levels are 3, 5
    or 9."""
    own = next((t for t in tables.allocations if h.kbps // channels in t["kbps"] and h.rate in t["rates"]), None)
    if own is None:
        raise ValueError("no allocation table for this rate")
    levels = np.zeros((channels, BANDS), np.int64)
    used = len(own["bands"])
    for b, choices in enumerate(own["bands"]):
        for c in range(channels if b < bound else 1):
            levels[c if b < bound else slice(None), b] = choices[r.number((len(choices) - 1).bit_length())]
    share = {(c, b): r.number(2) for b in range(used) for c in range(channels) if levels[c, b]}
    scale = np.zeros((channels, 3, BANDS))
    for b in range(used):
        for c in range(channels):
            if levels[c, b]:
                read = [r.number(6) for _ in range((3, 2, 1, 2)[share[c, b]])]
                which = ([0, 1, 2], [0, 0, 1], [0, 0, 0], [0, 1, 1])[share[c, b]]
                scale[c, :, b] = scale_factor(np.array([read[i] for i in which]))
    out = np.zeros((channels, 36, BANDS))
    for g in range(12):
        for b in range(used):
            for c in range(channels if b < bound else 1):
                n = int(levels[c, b])
                if not n:
                    continue
                if n in (3, 5, 9):
                    code = r.number((n**3 - 1).bit_length())
                    codes = np.array([code % n, code // n % n, code // (n * n)])
                else:
                    codes = r.numbers(3, n.bit_length())
                out[c if b < bound else slice(None), 3 * g : 3 * g + 3, b] = level(codes, n)
    return out * np.repeat(scale, 12, axis=1)


# ---- layer III


@dataclass
class Granule:
    size: int
    big: int
    gain: int
    compress: int
    block: int = 0
    mixed: bool = False
    tables: tuple[int, ...] = (0, 0, 0)
    sub: tuple[int, ...] = (0, 0, 0)
    regions: tuple[int, int] = (0, 0)
    preflag: int = 0
    scale: int = 0
    quad: int = 0


def side_info(r: Reader, channels: int) -> tuple[int, list[list[int]], list[list[Granule]]]:
    """Where the main data begins, which scale factors are shared, and the granules."""
    begin = r.number(9)
    r.number(5 if channels == 1 else 3)
    shared = [[r.number(1) for _ in SHARED] for _ in range(channels)]
    out = []
    for _ in range(2):
        row = []
        for _ in range(channels):
            g = Granule(r.number(12), r.number(9), r.number(8), r.number(4))
            if r.number(1):
                g.block, g.mixed = r.number(2), bool(r.number(1))
                g.tables = (r.number(5), r.number(5), 0)
                g.sub = (r.number(3), r.number(3), r.number(3))
                if g.block == 0:
                    raise ValueError("a reserved block type")
                g.regions = (8 if g.block == 2 and not g.mixed else 7, 36)
            else:
                g.tables = (r.number(5), r.number(5), r.number(5))
                g.regions = (r.number(4), r.number(3))
            g.preflag, g.scale, g.quad = r.number(1), r.number(1), r.number(1)
            if g.big > 288:
                raise ValueError("too many large values")
            row.append(g)
        out.append(row)
    return begin, shared, out


def scale_factors(r: Reader, g: Granule, shared: list[int], before: np.ndarray | None) -> np.ndarray:
    """Long blocks: 22 by band; short ones: 13 by 3, with the long ones in front if mixed."""
    a, b = LENGTHS[g.compress]
    if g.block == 2:
        long = [r.number(a) for _ in range(8)] if g.mixed else []
        first = 3 if g.mixed else 0
        short = [[r.number(a if k < 6 else b) for _ in range(3)] for k in range(first, 12)]
        return np.array(long + [x for k in short for x in k] + [0, 0, 0], np.int64)
    out = np.zeros(22, np.int64)
    for (lo, hi), same in zip(SHARED, shared, strict=True):
        out[lo:hi] = before[lo:hi] if same and before is not None else [r.number(a if k < 11 else b) for k in range(lo, hi)]
    return out


def signed(r: Reader, x: int) -> int:
    return -x if x and r.number(1) else x


def spectrum(r: Reader, g: Granule, end: int, long: list[int], tables: Tables) -> np.ndarray:
    """576 whole numbers: pairs of three regions, then quadruples up to the granule's end."""
    out = np.zeros(576, np.int64)
    edges = [36, 576] if g.block else [long[min(22, g.regions[0] + 1)], long[min(22, g.regions[0] + g.regions[1] + 2)]]
    at = 0
    while at < 2 * g.big:
        book = g.tables[sum(at >= e for e in edges)]
        if book:
            b = tables.pairs[book]
            for x in b.read(r):
                x += r.number(b.linbits) if x == 15 and b.linbits else 0
                out[at] = signed(r, x)
                at += 1
        else:
            at += 2
    quads = tables.quads.get(g.quad)
    while quads and r.at < end and at + 4 <= 576:
        found = [signed(r, x) for x in quads.read(r)]
        if r.at > end:  # what ran over doesn't count
            break
        out[at : at + 4] = found
        at += 4
    r.at = end
    return out


def band_of(g: Granule, long: list[int], short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each line the place of its scale factor, and its window (-1 in long blocks).
    Short blocks stand band by band, window by window."""
    factor, window = np.zeros(576, np.int64), np.full(576, -1)
    if g.block != 2:
        factor = np.searchsorted(long, np.arange(576), "right") - 1
        return np.minimum(factor, 21), window
    at, k = (36, 3) if g.mixed else (0, 0)
    if g.mixed:
        factor[:36] = np.searchsorted(long, np.arange(36), "right") - 1
    base = 8 if g.mixed else 0
    for band in range(k, 13):
        n = short[band + 1] - short[band]
        for w in range(3):
            factor[at : at + n], window[at : at + n] = base + 3 * (band - k) + w, w
            at += n
    return factor, window


def powers(q: np.ndarray) -> np.ndarray:
    """x**(4/3) with the sign."""
    return np.sign(q) * np.abs(q) ** (4 / 3)


def requantized(q: np.ndarray, g: Granule, factors: np.ndarray, long: list[int], short: list[int]) -> np.ndarray:
    """x**(4/3) by global gain, scale factors and the gains of short windows."""
    return powers(q) * steps(g, factors, long, short)


def steps(g: Granule, factors: np.ndarray, long: list[int], short: list[int]) -> np.ndarray:
    """What multiplies each line's power."""
    place, window = band_of(g, long, short)
    padded = np.r_[factors, np.zeros(64, np.int64)]
    sf = padded[place] + np.where(window < 0, g.preflag * PRETAB[np.minimum(place, 21)], 0)
    exponent = (g.gain - 210) / 4 - np.where(window >= 0, 2 * np.array([*g.sub, 0])[window], 0) - (1.0 if g.scale else 0.5) * sf
    return 2.0**exponent


def stereo(left: np.ndarray, right: np.ndarray, mode: int, right_factors: np.ndarray, place: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """mode: 1 intensity, 2 mid/side, 3 both. Intensity goes by the right channel's factors
    (7: not) above the last line that it uses; the rest may be mid and side."""
    l, r = left.copy(), right.copy()
    sides = np.zeros(576, bool)
    if mode & 1:
        at = right_factors[np.minimum(place, len(right_factors) - 1)]
        sides = (np.arange(576) >= top) & (at < 7)
        ratio = np.tan(np.minimum(at, 6) * np.pi / 12)
        l = np.where(sides, left * ratio / (1 + ratio), l)
        r = np.where(sides, left / (1 + ratio), r)
    if mode & 2:
        l, r = np.where(sides, l, (left + right) / np.sqrt(2)), np.where(sides, r, (left - right) / np.sqrt(2))
    return l, r


def reordered(x: np.ndarray, g: Granule, short: list[int]) -> np.ndarray:
    """Short blocks from band by window by line to line by window."""
    if g.block != 2:
        return x
    out, at = x.copy(), 36 if g.mixed else 0
    for band in range(3 if g.mixed else 0, 13):
        n = short[band + 1] - short[band]
        out[at : at + 3 * n] = x[at : at + 3 * n].reshape(3, n).T.ravel()
        at += 3 * n
    return out


def antialiased(x: np.ndarray, g: Granule) -> np.ndarray:
    """Eight butterflies at each edge between bands of long blocks."""
    edges = 0 if g.block == 2 and not g.mixed else 1 if g.block == 2 else 31
    cs, ca = 1 / np.sqrt(1 + ALIAS**2), ALIAS / np.sqrt(1 + ALIAS**2)
    out = x.reshape(BANDS, SLOTS).copy()
    up, down = out[:edges, :9:-1].copy(), out[1 : edges + 1, :8].copy()
    out[:edges, :9:-1] = up * cs - down * ca
    out[1 : edges + 1, :8] = down * cs + up * ca
    return out.ravel()


@lru_cache(8)
def transform(n: int) -> np.ndarray:
    i, k = np.arange(n)[:, None], np.arange(n // 2)
    return np.cos(np.pi / (2 * n) * (2 * i + 1 + n / 2) * (2 * k + 1))


@lru_cache(8)
def shape(block: int) -> np.ndarray:
    """Windows of block types: 0 normal, 1 start, 2 short (12), 3 stop."""
    long, short = np.sin(np.pi / 36 * (np.arange(36) + 0.5)), np.sin(np.pi / 12 * (np.arange(12) + 0.5))
    start = np.r_[long[:18], np.ones(6), short[6:], np.zeros(6)]
    return {0: long, 1: start, 2: short, 3: start[::-1]}[block]


def imdct(x: np.ndarray, block: int) -> np.ndarray:
    """18 lines (three short windows interleaved) to 36 windowed values."""
    if block != 2:
        return transform(36) @ x * shape(block)
    out = np.zeros(36)
    for w in range(3):
        out[6 + 6 * w : 18 + 6 * w] += transform(12) @ x[w::3] * shape(2)
    return out


def hybrid(x: np.ndarray, g: Granule, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """576 lines -> 18 slots by 32 bands and the new overlap; odd slots of odd bands change
    their sign."""
    made = np.array([imdct(x[b * SLOTS : (b + 1) * SLOTS], 0 if g.block == 2 and g.mixed and b < 2 else g.block) for b in range(BANDS)])
    out = (made[:, :18] + overlap).T
    out[1::2, 1::2] *= -1
    return out, made[:, 18:]


class Decoder:
    """Frames of one stream to samples; the state is the filter's past, the overlap, and
    the bytes of main data that later frames refer to."""

    def __init__(self, tables: Tables) -> None:
        self.tables = tables
        self.past = [np.zeros((15, 64)) for _ in range(2)]
        self.overlap = [np.zeros((BANDS, SLOTS)) for _ in range(2)]
        self.reservoir = b""

    def push(self, frame: bytes) -> np.ndarray:
        """channels by samples. A frame that can't be read is an error; the one behind it
        can be decoded if it refers to no lost data."""
        h = mpeg.header(frame)
        if h is None:
            raise ValueError("no frame")
        if not h.mpeg1:
            raise ValueError("only MPEG-1 is decoded")
        word = int.from_bytes(frame[:4], "big")
        channels, mode, extension = 1 if h.mono else 2, word >> 6 & 3, word >> 4 & 3
        at = 4 if word >> 16 & 1 else 6
        bound = 4 * (extension + 1) if mode == 1 else BANDS
        if h.layer == 3:
            parts = self._layer3(frame, at, h, channels, extension if mode == 1 else 0)
        else:
            r = Reader(frame[at:])
            parts = layer1(r, h, bound, channels) if h.layer == 1 else layer2(r, h, bound, channels, self.tables)
        out = []
        for c in range(channels):
            x, self.past[c] = synthesize(parts[c], self.tables.window, self.past[c])
            out.append(x)
        return np.array(out)

    def flush(self) -> np.ndarray:
        return np.zeros((1, 0))

    def _layer3(self, frame: bytes, at: int, h: mpeg.Frame, channels: int, mode: int) -> np.ndarray:
        size = 17 if channels == 1 else 32
        begin, shared, granules = side_info(Reader(frame[at : at + size]), channels)
        own, held = frame[at + size :], self.reservoir
        self.reservoir = (held + own)[-511:]
        if begin > len(held):
            raise ValueError("the main data of an earlier frame is missing")
        r = Reader((held[len(held) - begin :] if begin else b"") + own)
        long, short = self.tables.long[h.rate], self.tables.short[h.rate]
        out, before = np.zeros((channels, 2 * SLOTS, BANDS)), [None] * channels
        start = 0
        for n, row in enumerate(granules):
            lines, factors, places, top = [], [], [], 0
            for c, g in enumerate(row):
                r.at = start
                f = scale_factors(r, g, shared[c] if n else [0] * 4, before[c])
                before[c] = f if g.block != 2 else None
                q = spectrum(r, g, start + g.size, long, self.tables)
                start += g.size
                lines.append(requantized(q, g, f, long, short))
                factors.append(f)
                places.append(band_of(g, long, short)[0])
                used = np.flatnonzero(q)
                top = int(used[-1]) + 1 if len(used) else 0
            if channels == 2 and mode:
                lines = list(stereo(*lines, mode, factors[1], places[1], top))
            for c, g in enumerate(row):
                x = antialiased(reordered(lines[c], g, short), g)
                out[c, n * SLOTS : (n + 1) * SLOTS], self.overlap[c] = hybrid(x, g, self.overlap[c])
        return out


def decode(raw: bytes, tables: Tables) -> Iterator[np.ndarray]:
    """Samples of each frame of a file; frames that can't be decoded are skipped."""
    from . import tags

    d = Decoder(tables)
    for at, size, _ in mpeg.scan(raw, *tags.bounds(raw)):
        try:
            yield d.push(raw[at : at + size])
        except (ValueError, EOFError, KeyError):
            continue
