"""MPEG audio files (layers I to III): frame scan, VBR headers, packets, seeking, writing.

Samples are not decoded here: packets carry whole frames.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tags
from .headers import BITRATES, RATES

#: kbit/s by bitrate index (0 is a free format), for MPEG-1 and for MPEG-2
#: and 2.5, of layers I, II and III; Hz by rate index of MPEG-1.
KBPS = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): BITRATES,
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}


@dataclass(frozen=True)
class Frame:
    """Fields of a frame header; `size` is 0 in a free format."""

    mpeg1: bool
    layer: int
    kbps: int
    rate: int
    pad: int
    mono: bool
    key: int  # what all frames of a stream share

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.mpeg1 or self.layer == 2 else 576

    @property
    def size(self) -> int:
        n = self.samples * self.kbps * 125 // self.rate
        return n & ~3 if self.layer == 1 else n


def header(raw: bytes, at: int = 0) -> Frame | None:
    """The header at a place; None if its sync, version, layer, bitrate or rate is invalid."""
    if at + 4 > len(raw) or raw[at] != 255 or raw[at + 1] < 0xE0:
        return None
    word = int.from_bytes(raw[at : at + 4], "big")
    version, layer, kbps, rate = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if version == 1 or layer == 4 or (version == 0 and layer != 3) or kbps == 15 or rate == 3:
        return None
    mpeg1 = version == 3
    pad = (4 if layer == 1 else 1) if word >> 9 & 1 else 0
    # frames belong together if sync, version, layer and rate agree, and both or none are free
    key = (word >> 17 & 0x7FFF) << 3 | rate << 1 | (kbps == 0)
    return Frame(mpeg1, layer, KBPS[mpeg1, layer][kbps], RATES[rate] >> (0 if mpeg1 else 1 if version == 2 else 2), pad, word >> 6 & 3 == 3, key)


class Places:
    """Where headers may stand in some data: the sync bytes are found all at once, each
    header is read once."""

    def __init__(self, data: bytes, at: int) -> None:
        b = np.frombuffer(data, np.uint8)
        self.data, self.read = data, {}
        self.marks = at + np.flatnonzero((b[at:-1] == 255) & (b[at + 1 :] >= 0xE0)) if len(b) > at + 1 else np.zeros(0, np.int64)

    def head(self, at: int) -> Frame | None:
        if at not in self.read:
            self.read[at] = header(self.data, at)
        return self.read[at]

    def joins(self, at: int, size: int, h: Frame) -> bool:
        """Whether a frame ends with the data or where another of its stream begins."""
        after = self.head(at + size)
        return at + size == len(self.data) or (after is not None and after.key == h.key)

    def unstated(self, at: int, h: Frame) -> int:
        """Bytes of a free-format frame without padding: the distance to the next header of
        its stream, if the one behind that is as far. No free rate exceeds the highest."""
        most = h.samples * max(KBPS[h.mpeg1, h.layer]) * 125 // h.rate
        k = int(np.searchsorted(self.marks, at + 4))
        for q in self.marks[k : int(np.searchsorted(self.marks, at + most + h.pad, "right"))].tolist():
            other = self.head(q)
            if other and other.key == h.key and self.joins(q, q - at - h.pad + other.pad, other):
                return q - at - h.pad
        return 0


def scan(raw: bytes, at: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, Frame]]:
    """Place, bytes and header of each whole frame.

    A frame that begins where the last one ended is taken by its header alone; the first
    one, and the next one behind damage, must join another or end with the data.
    """
    places = Places(raw[:stop], at)
    end, free, due, k = len(places.data), 0, -1, 0
    while k < len(places.marks):
        here = int(places.marks[k])
        k += 1
        h = places.head(here)
        if h is None:
            continue
        own = h.size or free or (places.unstated(here, h) if here != due else 0)
        size = own + h.pad
        if own + h.pad <= 4 or here + size > end or (here != due and not places.joins(here, size, h)):
            continue
        free = free or (0 if h.size else own)
        yield here, size, h
        due = here + size
        k = int(np.searchsorted(places.marks, due))


@dataclass
class Vbr:
    """A Xing, Info or VBRI header; `toc` in 256ths of the bytes or as places in bytes."""

    kind: str
    frames: int = 0
    bytes: int = 0
    toc: list[int] = field(default_factory=list)
    quality: int = 0
    per_entry: int = 0


def vbr(frame: bytes, h: Frame) -> Vbr | None:
    """The VBR header in the first frame; None if there is none or it is cut off."""
    number = lambda at, n=4: int.from_bytes(frame[at : at + n], "big")
    at = (21 if h.mono else 36) if h.mpeg1 else (13 if h.mono else 21)
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, out = number(at + 4), Vbr("xing")
        at += 8
        for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                if at + n > len(frame):
                    return None
                setattr(out, name, list(frame[at : at + n]) if bit == 4 else number(at))
                at += n
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        entries, scale, width, per = (number(k, 2) for k in (54, 56, 58, 60))
        if width not in (1, 2, 3, 4) or 62 + entries * width > len(frame):
            return None
        toc, total = [], 0
        for i in range(entries):
            total = (total + number(62 + i * width, width) * scale) % (1 << 32)
            toc.append(total)
        return Vbr("vbri", number(50), number(46), toc, number(44, 2), per)
    return None


@dataclass
class Info:
    start: int
    size: int
    rate: int
    channels: int
    bitrate: int
    seconds: float
    vbr: Vbr | None
    first: Frame


def analyze(raw: bytes) -> Info:
    """What the first frame says. Its duration comes from the VBR header's number of
    frames, else from the bytes behind leading tags at the first frame's bitrate."""
    start, _ = tags.bounds(raw)
    found = next(scan(raw, start), None)
    if not found:
        raise ValueError("no MPEG audio frame")
    at, size, h = found
    v = vbr(raw[at : at + size], h)
    seconds, bitrate = 0.0, h.kbps * 1000
    if v and v.frames:
        seconds = v.frames * h.samples / h.rate
        bitrate = int(v.bytes * 8 / seconds) if v.bytes else bitrate
    elif bitrate:
        seconds = (len(raw) - start) * 8 / bitrate
    return Info(start, len(raw) - start, h.rate, 1 if h.mono else 2, bitrate, seconds, v, h)


def seek(info: Info, seconds: float) -> int:
    """The byte to go on from: by Xing's table, by VBRI's, else by the bitrate."""
    v = info.vbr
    if v and v.toc and info.seconds > 0:
        if v.kind == "xing":
            percent = min(max(seconds / info.seconds * 100, 0.0), 100.0)
            i = min(int(percent), 99)
            low, high = v.toc[i], v.toc[i + 1] if i < 99 else 256
            return info.start + int((low + (high - low) * (percent - i)) / 256 * (v.bytes or info.size))
        if v.frames and v.per_entry:
            step = v.per_entry / v.frames * info.seconds
            i, part = int(seconds // step), seconds % step / step
            if i >= len(v.toc):
                i, part = len(v.toc) - 1, 1.0
            low = v.toc[i - 1] if i > 0 else 0
            return info.start + int(low + (v.toc[i] - low) * part)
    return info.start + int(seconds * info.bitrate / 8)


def frame_bytes(kbps: int, rate: int = 44100, *, pad: bool = False, mono: bool = False, body: bytes = b"", layer: int = 3) -> bytes:
    """An MPEG-1 frame: header, body, zeros. Serves tests and the writing of VBR headers."""
    word = 0xFFF80000 | (4 - layer) << 17 | 1 << 16 | KBPS[True, layer].index(kbps) << 12 | RATES.index(rate) << 10 | pad << 9 | (3 if mono else 0) << 6
    raw = word.to_bytes(4, "big")
    h = header(raw)
    return (raw + body).ljust(h.size + h.pad, b"\0")[: h.size + h.pad]


def xing_frame(frames: int, size: int, toc: list[int], kbps: int = 128, rate: int = 44100, mono: bool = False) -> bytes:
    body = bytes(17 if mono else 32) + b"Xing" + (7).to_bytes(4, "big") + frames.to_bytes(4, "big") + size.to_bytes(4, "big") + bytes(toc)
    return frame_bytes(kbps, rate, mono=mono, body=body)


def build(frames: list[bytes], bundle: tags.Bundle | None = None, version: int = 3) -> bytes:
    """A file: ID3v2 tag, the frames as they are, ID3v1 tag."""
    b = bundle or {}
    return tags.build_v2(b, version) + b"".join(frames) + tags.build_v1(b)


def packets(files: DataFrame) -> DataFrame:
    """sid, content -> sid, seq, pts (in samples), at, data, rate, layer, kbps: a row per frame.

    Damage between frames is skipped; a file without a frame, or null, gives no rows.
    """
    schema = pa.schema([("sid", pa.int64()), ("seq", pa.int64()), ("pts", pa.int64()), ("at", pa.int64()), ("data", pa.binary()), ("rate", pa.int32()), ("layer", pa.int32()), ("kbps", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # of many files, as a batch for each short one costs more than its frames
        for batch in batches:
            for k in range(batch.num_rows):
                sid, raw = (c[k].as_py() for c in batch.columns)
                start, stop = tags.bounds(raw or b"")
                pts = 0
                for seq, (at, size, h) in enumerate(scan(raw or b"", start, stop)):
                    rows.append((sid, seq, pts, at, raw[at : at + size], h.rate, h.layer, h.kbps))
                    pts += h.samples
                    if len(rows) == 4096:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.select("sid", "content").mapInArrow(run, "sid long, seq long, pts long, at long, data binary, rate int, layer int, kbps int")


def infos(files: DataFrame) -> DataFrame:
    """sid, content -> sid, start, size, rate, channels, bitrate, seconds, vbr; a file
    without a frame has nulls."""
    names = ("start", "size", "rate", "channels", "bitrate", "seconds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sid, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    i = analyze(raw or b"")
                    rows.append({"sid": sid, **{n: getattr(i, n) for n in names}, "vbr": i.vbr.kind if i.vbr else None})
                except ValueError:
                    rows.append({"sid": sid})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("sid", pa.int64()), *((n, pa.int64()) for n in names[:5]), ("seconds", pa.float64()), ("vbr", pa.string())]))

    return files.select("sid", "content").mapInArrow(run, "sid long, start long, size long, rate long, channels long, bitrate long, seconds double, vbr string")
