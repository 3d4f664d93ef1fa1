"""FLAC files: frames are coded one by one over the cluster and joined by stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import crc_bytes, crc_shifts, crc_table
from . import flac_search

#: Bits a sample by their code in a frame header; 0 means as in STREAMINFO.
SAMPLE_BITS = {0: 0, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
#: Rice parameters that are tried.
PARAMETERS = 31
CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)
_FOLDS = {8: (np.array(CRC8, np.int64), crc_shifts(8, 0x07)), 16: (np.array(CRC16, np.int64), crc_shifts(16, 0x8005))}


def crc(raw: bytes, table: list[int], width: int) -> int:
    if len(raw) > 64:  # long payloads are folded in halves
        return crc_bytes(raw, width, *_FOLDS[width])
    x, top, mask = 0, width - 8, (1 << width) - 1
    for b in raw:
        x = x << 8 & mask ^ table[x >> top ^ b]
    return x


def pack(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Numbers of given widths as bits, top bit first, filled to a byte with zeros."""
    ends = np.cumsum(widths)
    out = np.zeros(int(ends[-1]), np.uint8)
    v = values.astype(np.int64)
    for k in range(min(33, int(widths.max()))):
        some = widths > k
        out[ends[some] - 1 - k] = v[some] >> k & 1
    return np.packbits(out).tobytes()


def number_bytes(n: int) -> bytes:
    """A number in the form of UTF-8, up to 36 bits."""
    if n < 128:
        return bytes([n])
    more = 1
    while n >> 6 * more >= 1 << 6 - more:
        more += 1
    return bytes([0xFF << 7 - more & 0xFF | n >> 6 * more, *(0x80 | n >> 6 * i & 63 for i in range(more - 1, -1, -1))])


# ---- coding


@dataclass
class Bits:
    """Numbers and widths to be packed. Long runs of zeros are part of a width."""

    parts: list[tuple[np.ndarray, np.ndarray]]

    def add(self, values, widths) -> Bits:  # noqa: ANN001
        v = np.atleast_1d(np.asarray(values, np.int64))
        self.parts.append((v, np.broadcast_to(np.asarray(widths, np.int64), v.shape)))
        return self

    def size(self) -> int:
        return sum(int(w.sum()) for _, w in self.parts)


def rice_plan(u: np.ndarray, n: int, order: int, deepest: int) -> tuple[int, int, np.ndarray, int, np.ndarray]:
    """Of folded residuals, with zeros for the samples before them: the fewest bits, and the
    depth of partitions, parameters, bits of a parameter and peaks that take them."""
    deep = max(p for p in range(deepest + 1) if not p or n % (1 << p) == 0 and n >> p > order)
    peak = u.reshape(1 << deep, -1).max(axis=1)
    # a parameter of more bits than the peak only adds to the cost
    most = min(PARAMETERS, int(peak.max()).bit_length() + 1)
    if n <= 1024:
        sums = (u >> np.arange(most)[:, None]).reshape(most, 1 << deep, -1).sum(axis=2)
    else:
        sums = np.array([(u >> k).reshape(1 << deep, -1).sum(axis=1) for k in range(most)])
    best = None
    for p in range(deep, -1, -1):
        counts = np.full(1 << p, n >> p)
        counts[0] -= order
        cost = sums + counts * np.arange(1, most + 1)[:, None]
        plain = 5 + counts * np.array([m.bit_length() for m in peak.tolist()])  # folded, one bit more than the magnitude
        for wide, top in ((4, 15), (5, PARAMETERS)):
            k = cost[:top].argmin(axis=0)
            own = cost[:top].min(axis=0)
            use = plain < own
            total = int(np.where(use, plain, own).sum()) + wide * len(k)
            if best is None or total < best[0]:
                best = total, p, np.where(use, (1 << wide) - 1, k), wide, peak
            if most <= 15:
                break  # the same parameters in 5 bits take more
        if p:
            sums, peak = sums.reshape(most, -1, 2).sum(axis=2), peak.reshape(-1, 2).max(axis=1)
    return best


@dataclass
class Rice:
    """Residuals in the partitions, by the method (parameters of 4 or of 5 bits) and with
    the parameters, or as plain numbers, that take the fewest bits; made when it is chosen."""

    r: np.ndarray
    n: int
    order: int
    deepest: int = 6

    def __post_init__(self) -> None:
        self.u = np.concatenate([np.zeros(self.order, np.int64), np.where(self.r >= 0, 2 * self.r, -2 * self.r - 1)])
        self.plan = rice_plan(self.u, self.n, self.order, self.deepest)

    def size(self) -> int:
        return 6 + self.plan[0]

    def bits(self) -> Bits:
        n, order, r, u = self.n, self.order, self.r, self.u
        _, p, ks, wide, peak = self.plan
        out, at = Bits([]).add([wide - 4, p], [2, 4]), order
        for i, k in enumerate(ks.tolist()):
            end = (i + 1) * (n >> p)
            own = u[at:end]
            if k == (1 << wide) - 1:
                raw = int(peak[i]).bit_length()
                out.add([k, raw], [wide, 5]).add(r[at - order : end - order], raw)
            else:
                out.add(k, wide).add(own & (1 << k) - 1 | 1 << k, (own >> k) + 1 + k)
            at = end
        return out


def rice(r: np.ndarray, n: int, order: int, deepest: int = 6) -> Bits:
    return Rice(r, n, order, deepest).bits()


def linear(x: np.ndarray, bits: int, how: flac_search.Preset) -> list[tuple[list[int], int, int]]:
    """Predictors worth coding: coefficients, shift and precision."""
    most = min(how.lpc, len(x) // 4 - 1)
    out = []
    for window in how.windows if most > 0 else ():
        found = flac_search.predictors(flac_search.autocorrelation(x * window(len(x)), most))
        for precision in how.precisions if found else ():
            orders = range(len(found)) if how.every else [flac_search.promising(found, len(x), bits, precision)]
            for k in orders:
                if (q := flac_search.whole(found[k][0], precision)) and q not in [o[:2] for o in out]:
                    out.append((*q, precision))
    return out


def subframe(x: np.ndarray, bits: int, how: flac_search.Preset = flac_search.Preset()) -> Bits:
    """The cheapest of a constant, fixed and linear prediction, and plain samples."""
    n = len(x)
    if (x == x[0]).all():
        return Bits([]).add([0, x[0]], [8, bits])
    wasted = int(np.bitwise_or.reduce(x))
    wasted = min((wasted & -wasted).bit_length() - 1, bits - 1)
    x, bits = x >> wasted, bits - wasted
    head = lambda kind: Bits([]).add([kind << 1 | (wasted > 0)], 8).add([1] * (wasted > 0), wasted)
    found: list[tuple[Bits, Rice | None]] = [(head(1).add(x, bits), None)]
    for order in how.fixed:
        if order < n:
            found.append((head(8 | order).add(x[:order], bits), Rice(np.diff(x, order), n, order, how.partitions)))
    for a, shift, precision in linear(x, bits, how):
        p = len(a)
        guess = sum(c * x[p - 1 - i : n - 1 - i] for i, c in enumerate(a)) >> shift
        r = x[p:] - guess
        if np.abs(r).max() < 1 << 30:
            found.append((head(32 | p - 1).add(x[:p], bits).add([precision - 1, shift], [4, 5]).add(a, precision), Rice(r, n, p, how.partitions)))
    out, rest = min(found, key=lambda f: f[0].size() + (f[1].size() if f[1] else 0))
    return Bits(out.parts + rest.bits().parts) if rest else out


def coded_channels(x: np.ndarray, bits: int, how: flac_search.Preset) -> tuple[int, list[Bits]]:
    """The channel assignment and its subframes. Two channels may go as their difference
    and one of left, right and mean, if that takes fewer bits."""
    if len(x) != 2:
        return len(x) - 1, [subframe(c, bits, how) for c in x]
    made: dict[str, Bits] = {}

    def part(name: str) -> Bits:
        if name not in made:
            made[name] = subframe({"l": lambda: x[0], "r": lambda: x[1], "s": lambda: x[0] - x[1], "m": lambda: x[0] + x[1] >> 1}[name](), bits + (name == "s"), how)
        return made[name]

    kinds = {k: [part(c) for c in {1: "lr", 8: "ls", 9: "sr", 10: "ms"}[k]] for k in flac_search.pairing(x, how.stereo)}
    return min(kinds.items(), key=lambda k: sum(b.size() for b in k[1]))


def frame_of(kind: int, subframes: list[Bits], n: int, number: int, bits: int, variable: bool) -> bytes:
    """number: of the frame, or of its first sample where sizes vary."""
    depth = next((k for k, v in SAMPLE_BITS.items() if v == bits), 0)
    head = bytes([0xFF, 0xF8 | variable, 7 << 4, kind << 4 | depth << 1]) + number_bytes(number) + (n - 1).to_bytes(2, "big")
    head += bytes([crc(head, CRC8, 8)])
    parts = [p for b in subframes for p in b.parts]
    raw = head + pack(np.concatenate([v for v, _ in parts]), np.concatenate([w for _, w in parts]))
    return raw + crc(raw, CRC16, 16).to_bytes(2, "big")


def checked_block(x: np.ndarray, bits: int) -> None:
    channels, n = x.shape
    if not (1 <= channels <= 8 and 1 <= n <= 65536 and 4 <= bits <= 24):
        raise ValueError("frames hold 1 to 8 channels of 1 to 65536 samples of 4 to 24 bits")
    if x.min() < -(1 << bits - 1) or x.max() >= 1 << bits - 1:
        raise ValueError(f"samples from {x.min()} to {x.max()} need more than {bits} bits")


def encode_frame(x: np.ndarray, number: int, bits: int, how: flac_search.Preset = flac_search.Preset()) -> bytes:
    """x: channels by samples, as one frame of a stream of equal ones."""
    checked_block(x, bits)
    kind, subframes = coded_channels(x, bits, how)
    return frame_of(kind, subframes, x.shape[1], number, bits, False)


def encode_block(x: np.ndarray, first: int, bits: int, how: flac_search.Preset) -> list[tuple[int, bytes]]:
    """The block as one frame or several, halved where that takes fewer bits: samples and
    bytes of each."""
    checked_block(x, bits)
    made: dict[tuple[int, int], tuple[int, list[Bits]]] = {}

    def size(a: int, b: int) -> int:
        made[a, b] = coded_channels(x[:, a:b], bits, how)
        return sum(p.size() for p in made[a, b][1])

    return [(b - a, frame_of(*made[a, b], b - a, first + a, bits, True)) for a, b in flac_search.halves(x.shape[1], size, how.split)]


def stream_info(size: int, frames: list[int], rate: int, channels: int, bits: int, samples: int, md5: bytes, least: int | None = None) -> bytes:
    """size, least: the largest block, and the smallest of all but the last."""
    tail = rate << 44 | channels - 1 << 41 | bits - 1 << 36 | samples
    return (least or size).to_bytes(2, "big") + size.to_bytes(2, "big") + min(frames).to_bytes(3, "big") + max(frames).to_bytes(3, "big") + tail.to_bytes(8, "big") + md5


def pcm(x: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian samples, as the digest of a stream takes them."""
    return x.T.astype("<i4").reshape(-1, 1).view(np.uint8)[:, : (bits + 7) // 8].tobytes()


# ---- reading


class Reader:
    def __init__(self, raw: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(raw, np.uint8))
        n = len(self.bits)
        self.next_one = np.minimum.accumulate(np.where(self.bits == 1, np.arange(n), n)[::-1])[::-1]
        self.at = 0

    def number(self, n: int) -> int:
        return int(self.numbers(1, n)[0])

    def numbers(self, count: int, n: int, *, signed: bool = False) -> np.ndarray:
        end = self.at + count * n
        if end > len(self.bits):
            raise EOFError("a frame is cut off")
        out = self.bits[self.at : end].reshape(count, n).astype(np.int64) @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64)) if n else np.zeros(count, np.int64)
        self.at = end
        return np.where(out >= 1 << n - 1, out - (1 << n), out) if signed and n else out

    def unary(self) -> int:
        if self.at >= len(self.bits) or (one := int(self.next_one[self.at])) >= len(self.bits):
            raise EOFError("a frame is cut off")
        out, self.at = one - self.at, one + 1
        return out

    def rice(self, count: int, k: int) -> np.ndarray:
        """The places of the stops one after another, then all low bits at once."""
        high, low, total = np.empty(count, np.int64), np.empty(count, np.int64), len(self.bits)
        at, ones = self.at, self.next_one
        for i in range(count):
            if at >= total or (one := int(ones[at])) + k >= total:
                raise EOFError("a frame is cut off")
            high[i], low[i] = one - at, one + 1
            at = one + 1 + k
        self.at = at
        u = high << k
        for b in range(k):
            u |= self.bits[low + b].astype(np.int64) << k - 1 - b
        return u >> 1 ^ -(u & 1)


def read_residual(r: Reader, n: int, order: int) -> np.ndarray:
    wide = 4 + r.number(2)
    if wide > 5:
        raise ValueError("a reserved residual coding")
    p, out = r.number(4), []
    if n % (1 << p) or n >> p < order:
        raise ValueError("partitions do not fit the frame")
    for i in range(1 << p):
        count, k = (n >> p) - (0 if i else order), r.number(wide)
        out.append(r.numbers(count, r.number(5), signed=True) if k == (1 << wide) - 1 else r.rice(count, k))
    return np.concatenate(out)


def read_subframe(r: Reader, n: int, bits: int) -> np.ndarray:
    if r.number(1):
        raise ValueError("a subframe starts with a set bit")
    kind, wasted = r.number(6), r.number(1)
    wasted = r.unary() + 1 if wasted else 0
    bits -= wasted
    if kind == 0:
        x = np.repeat(r.numbers(1, bits, signed=True), n)
    elif kind == 1:
        x = r.numbers(n, bits, signed=True)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = r.numbers(order, bits, signed=True)
        x = read_residual(r, n, order)
        for j in range(order - 1, -1, -1):  # undo one difference after the other
            x = np.diff(warm, j)[-1] + np.cumsum(x)
        x = np.r_[warm, x]
    elif kind >= 32:
        order = kind - 31
        x = r.numbers(order, bits, signed=True).tolist()
        precision = r.number(4) + 1
        shift = int(r.numbers(1, 5, signed=True)[0])
        a = r.numbers(order, precision, signed=True).tolist()[::-1]
        if precision > 15 or shift < 0:
            raise ValueError("a reserved predictor")
        for e in read_residual(r, n, order).tolist():
            x.append(e + (sum(map(mul, a, x[-order:])) >> shift))
        x = np.array(x, np.int64)
    else:
        raise ValueError("a reserved kind of subframe")
    return x << wasted


def read_frame(raw: bytes, depth: int) -> tuple[np.ndarray, int]:
    """Channels by samples, and the frame's length in bytes; checks both sums."""
    r = Reader(raw)
    if r.number(15) != 0x7FFC:
        raise ValueError("no frame starts here")
    r.number(1)
    size, rate, kind, bits = r.number(4), r.number(4), r.number(4), r.number(3)
    if not size or rate == 15 or kind > 10 or bits not in SAMPLE_BITS or r.number(1):
        raise ValueError("a reserved value in a frame header")
    lead = r.number(8)
    if 0x80 <= lead < 0xC0 or lead == 0xFF:
        raise ValueError("a reserved value in a frame header")
    more = 8 - (lead ^ 0xFF).bit_length() if lead >= 0xC0 else 0
    r.numbers(max(0, more - 1), 8)
    n = 192 if size == 1 else 576 << size - 2 if size <= 5 else r.number(8 * (size - 5)) + 1 if size <= 7 else 256 << size - 8
    r.number({12: 8, 13: 16, 14: 16}.get(rate, 0))
    if r.number(8) != crc(raw[: r.at // 8 - 1], CRC8, 8):
        raise ValueError("a frame header's sum is wrong")
    bits = SAMPLE_BITS[bits] or depth
    x = [read_subframe(r, n, bits + (kind == 8 and c == 1 or kind == 9 and c == 0 or kind == 10 and c == 1)) for c in range(2 if kind >= 8 else kind + 1)]
    r.at += -r.at % 8
    end = r.at // 8
    if r.number(16) != crc(raw[:end], CRC16, 16):
        raise ValueError("a frame's sum is wrong")
    a, b = x[0], x[-1]
    if kind == 8:
        x = [a, a - b]
    elif kind == 9:
        x = [a + b, b]
    elif kind == 10:
        both = 2 * a | b & 1
        x = [both + b >> 1, both - b >> 1]
    return np.array(x), end + 2


@dataclass
class Info:
    size: int
    largest: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    first: int


def parse(raw: bytes, *, strict: bool = False) -> Info:
    """STREAMINFO and where the frames start. ID3v2 tags before the marker are skipped.
    Strictly there are none, STREAMINFO comes first and once, and no kind is reserved."""
    at = 0
    while not strict and raw[at : at + 3] == b"ID3" and at + 10 <= len(raw):
        size = 0
        for b in raw[at + 6 : at + 10]:
            size = size << 7 | b & 127
        at += 10 + size + (10 if raw[at + 5] & 16 else 0)
    if raw[at : at + 4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at, info, last = at + 4, None, False
    while not last:
        if at + 4 > len(raw):
            raise ValueError("metadata is cut off")
        last, kind, size = bool(raw[at] & 128), raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
        body = raw[at + 4 : at + 4 + size]
        if len(body) < size:
            raise ValueError("metadata is cut off")
        if strict and (kind > 6 or (kind == 0) != (info is None)):
            raise ValueError(f"a block of kind {kind} does not belong here")
        if kind == 0 and size >= 34 and info is None:
            tail = int.from_bytes(body[10:18], "big")
            info = Info(int.from_bytes(body[2:4], "big"), int.from_bytes(body[7:10], "big"), tail >> 44, (tail >> 41 & 7) + 1, (tail >> 36 & 31) + 1, tail & (1 << 36) - 1, body[18:34], 0)
        at += 4 + size
    if info is None:
        raise ValueError("no STREAMINFO")
    info.first = at
    return info


#: Bytes that are searched for a first frame where the marker is missing.
SEARCH = 1 << 20


def frame_header(raw: bytes, at: int) -> tuple[int, bool, int] | None:
    """Number (of the frame, or of its first sample if sizes vary), whether sizes vary, and
    samples of a frame whose header's sum is right; None if none starts there."""
    if raw[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9") or at + 6 > len(raw):
        return None
    size, rate, kind, bits = raw[at + 2] >> 4, raw[at + 2] & 15, raw[at + 3] >> 4, raw[at + 3] >> 1 & 7
    if not size or rate == 15 or kind > 10 or bits not in SAMPLE_BITS or raw[at + 3] & 1:
        return None
    lead, here = raw[at + 4], at + 5
    if 0x80 <= lead < 0xC0 or lead == 0xFF:  # no number begins so
        return None
    more = 8 - (lead ^ 0xFF).bit_length() if lead >= 0xC0 else 0
    number = lead & 0x7F if not more else lead & (1 << 7 - more) - 1
    for b in raw[here : here + max(0, more - 1)]:
        number = number << 6 | b & 63
    here += max(0, more - 1)
    if size in (6, 7):
        n = int.from_bytes(raw[here : here + size - 5], "big") + 1
        here += size - 5
    else:
        n = 192 if size == 1 else 576 << size - 2 if size <= 5 else 256 << size - 8
    here += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if here >= len(raw) or raw[here] != crc(raw[at:here], CRC8, 8):
        return None
    return number, raw[at + 1] & 1 == 1, n


def frame_places(raw: bytes, first: int | None = None, *, strict: bool = False) -> Iterator[tuple[int, int, int]]:
    """Place, bytes and samples of each frame. A frame ends where the next header has a
    greater number and the same blocking, behind a right sum over all bytes, or with the
    file. What has a wrong sum is skipped to the next frame, or an error if strict; a bad
    last frame ends the stream."""
    at = parse(raw).first if first is None else first
    while at < len(raw):
        here = frame_header(raw, at)
        if here is None:
            if strict:
                raise ValueError(f"no frame at byte {at}")
            at = next_header(raw, at + 1)
            continue
        end, found = at + 6, 0
        while not found:
            end = next_header(raw, end)
            other = frame_header(raw, end) if end < len(raw) else None
            if other and (other[1] != here[1] or other[0] <= here[0]):
                end += 1
                continue
            found = end if crc(raw[at : end - 2], CRC16, 16) == int.from_bytes(raw[end - 2 : end], "big") else -1
            if found < 0 and end < len(raw) and other:
                if other[0] == here[0] + (here[2] if here[1] else 1):  # the next one: this one is damaged
                    break
                found, end = 0, end + 1
        if found > 0:
            yield at, end - at, here[2]
        elif strict:
            raise ValueError(f"the frame at byte {at} is damaged")
        at = end


def next_header(raw: bytes, at: int) -> int:
    """The next place with a whole header, or the end."""
    while at < len(raw):
        at = raw.find(b"\xff", at)
        if at < 0:
            return len(raw)
        if frame_header(raw, at):
            return at
        at += 1
    return len(raw)


def synthesized(raw: bytes) -> Info:
    """What a file without its marker is, by its first frame within SEARCH bytes."""
    at = next_header(raw[: SEARCH + 16], 0)
    h = frame_header(raw, at) if at < min(len(raw), SEARCH) else None
    if h is None:
        raise ValueError("not a FLAC file")
    rates = [0, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000]
    rate, kind = raw[at + 2] & 15, raw[at + 3] >> 4
    return Info(h[2], 0, rates[rate] if rate < 12 else 44100, 2 if kind >= 8 else kind + 1, SAMPLE_BITS[raw[at + 3] >> 1 & 7] or 16, 0, bytes(16), at)


def read_frames(raw: bytes, *, strict: bool = True) -> Iterator[np.ndarray]:
    """The frames of a file, one in memory at a time. Strictly, sums, parameters, the
    number of samples and the digest, where stated, must be right; else damaged frames are
    skipped, a missing marker is made up for, and totals aren't compared."""
    try:
        info = parse(raw)
    except ValueError:
        if strict:
            raise
        info = synthesized(raw)
    if not strict:
        for at, size, _ in frame_places(raw, info.first):
            try:
                x, _ = read_frame(raw[at : at + size], info.bits)
            except (ValueError, EOFError):
                continue
            if len(x) == info.channels:
                yield x
        return
    at, seen, digest = info.first, 0, hashlib.md5(usedforsecurity=False)
    guess = info.largest or info.size * info.channels * (info.bits + 1) // 8 + 64
    while at < len(raw):
        window = guess
        while True:
            try:
                x, size = read_frame(raw[at : at + window], info.bits)
                break
            except EOFError as e:
                if at + window >= len(raw):
                    raise ValueError("the file is cut off") from e
                window *= 2
        if len(x) != info.channels:
            raise ValueError("the number of channels changes")
        digest.update(pcm(x, info.bits))
        at, seen = at + size, seen + x.shape[1]
        yield x
    validate(info, seen, digest.digest())


def validate(info: Info, samples: int, md5: bytes) -> None:
    """The end of a stream against its STREAMINFO."""
    if info.samples and samples != info.samples:
        raise ValueError("the file has another number of samples than it states")
    if any(info.md5) and md5 != info.md5:
        raise ValueError("the samples' digest is wrong")


# ---- on the cluster


def frames(df: DataFrame, *, size: int = 4096, bits: int = 16, channels: tuple[str, ...] = ("q",), in_order: bool = False, how: flac_search.Preset = flac_search.Preset()) -> DataFrame:
    """sid, idx and a column for each channel -> sid, block, n, frame, pcm. Samples meet
    by stream and block; places in a stream have no gaps. in_order sorts the blocks before
    they are coded, so that the sort's sampling codes nothing twice. With how.split a block
    may be several rows, numbered in their order."""
    rows = df.groupBy("sid", F.floor(F.col("idx") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", *channels))).alias("s"))
    rows = rows.select("sid", "block", *[F.col(f"s.{c}").cast("array<long>").alias(f"c{i}") for i, c in enumerate(channels)])
    rows = rows.orderBy("sid", "block") if in_order else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                out: list[tuple] = []
                for sid, k, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    x = np.array(x, np.int64)
                    if not how.split:
                        out.append((sid, k, x.shape[1], encode_frame(x, k, bits, how), pcm(x, bits)))
                        continue
                    here = 0
                    for i, (n, raw) in enumerate(encode_block(x, k * size, bits, how)):
                        out.append((sid, k << how.split | i, n, raw, pcm(x[:, here : here + n], bits)))
                        here += n
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["sid", "block", "n", "frame", "pcm"])

    return rows.mapInArrow(run, "sid long, block long, n long, frame binary, pcm binary")


def files(coded: DataFrame, *, size: int = 4096, rate: int = 44100, bits: int = 16, channels: int = 1) -> DataFrame:
    """What frames() gives -> sid, content: a file for each stream, with its digest."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        own, digest, n = t["frame"].to_pylist(), hashlib.md5(usedforsecurity=False), t["n"].to_pylist()
        for x in t["pcm"].to_pylist():
            digest.update(x)
        info = stream_info(max(size, *n), list(map(len, own)), rate, channels, bits, sum(n), digest.digest(), min(n[:-1], default=size))
        return pa.table({"sid": t["sid"].slice(0, 1), "content": pa.array([b"fLaC\x80\0\0\x22" + info + b"".join(own)], pa.binary())})

    return coded.groupBy("sid").applyInArrow(run, "sid long, content binary")


def decode(content: DataFrame) -> DataFrame:
    """sid, content -> sid, ch, idx, q, a frame at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sid, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = 0
                for x in read_frames(raw):
                    c, n = x.shape
                    yield pa.record_batch([pa.array(np.full(c * n, sid, np.int64)), pa.array(np.repeat(np.arange(c, dtype=np.int32), n)), pa.array(np.tile(np.arange(at, at + n), c)), pa.array(x.ravel())], names=["sid", "ch", "idx", "q"])
                    at += n

    return content.select("sid", "content").mapInArrow(run, "sid long, ch int, idx long, q long")
