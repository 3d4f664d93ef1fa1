"""WAV files: header and chunk parsing, packets, and writing; RIFF and RF64."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ima_adpcm, ms_adpcm

#: Format tags of WAVE.
CODECS = {1: "lpcm", 2: "ms-adpcm", 3: "float", 6: "alaw", 7: "ulaw", 0x11: "ima-adpcm", 0x31: "gsm", 0x55: "mp3", 0xFFFE: "extensible"}
PACKET = 32768


@dataclass
class Header:
    codec: str
    channels: int
    rate: int
    align: int
    bits: int
    data_at: int
    data_size: int
    chunks: dict[str, bytes]
    extra: bytes = b""

    @property
    def block(self) -> int:
        """Samples in a block of `align` bytes; ADPCM says so behind its format."""
        if self.codec in ADPCM:
            return adpcm_parameters(self.codec, self.align, self.channels, self.extra)[0]
        return 1

    @property
    def samples(self) -> int:
        """Whole samples: those of whole blocks, or what the fact chunk states if fewer."""
        n = self.data_size // max(self.align, 1) * self.block
        fact = self.chunks.get("fact", b"")
        return min(n, int.from_bytes(fact[:4], "little")) if self.codec in ADPCM and len(fact) >= 4 else n


#: Bytes of an ADPCM block that are no codes, for each channel.
ADPCM = {"ms-adpcm": 7, "ima-adpcm": 4}


def adpcm_parameters(codec: str, align: int, channels: int, extra: bytes) -> tuple[int, list[tuple[int, int]]]:
    """Samples per block and MS predictor coefficients from what follows a format; the
    number of samples must be the one that the block's size allows."""
    module = ms_adpcm if codec == "ms-adpcm" else ima_adpcm
    size = module.samples_per_block(align, channels)
    if len(extra) >= 2 and (stated := struct.unpack("<H", extra[:2])[0]) and stated != size:
        raise ValueError(f"blocks of {align} bytes hold {size} samples, not {stated}")
    pairs: list[tuple[int, int]] = []
    if codec == "ms-adpcm" and len(extra) >= 4:
        n = struct.unpack("<H", extra[2:4])[0]
        if n < 7 or len(extra) < 4 + 4 * n:
            raise ValueError("predictor coefficients are missing")
        pairs = [struct.unpack("<hh", extra[4 + 4 * i : 8 + 4 * i]) for i in range(n)]
        if pairs[:7] != [tuple(c) for c in ms_adpcm.COEFFICIENTS.tolist()]:
            raise ValueError("the predictor coefficients are not the standard ones")
    return size, pairs


def adpcm_extra(codec: str, align: int, channels: int) -> bytes:
    """What follows the format of an ADPCM stream."""
    if codec == "ima-adpcm":
        return struct.pack("<H", ima_adpcm.samples_per_block(align, channels))
    own = ms_adpcm.COEFFICIENTS.tolist()
    return struct.pack("<HH", ms_adpcm.samples_per_block(align, channels), len(own)) + b"".join(struct.pack("<hh", *c) for c in own)


def parse(raw: bytes) -> Header:
    """Walks the chunks; odd chunks are padded, RF64 takes sizes from ds64."""
    if raw[:4] not in (b"RIFF", b"RF64") or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, wide, chunks, extra = 12, None, None, {}, b""
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4].decode("latin-1"), struct.unpack("<I", raw[at + 4 : at + 8])[0]
        body = at + 8
        if name == "ds64" and body + 24 <= len(raw):
            wide = struct.unpack("<QQQ", raw[body : body + 24])
        if name == "fmt ":
            if size < 16 or body + 16 > len(raw):
                raise ValueError("fmt chunk is cut off")
            fmt = struct.unpack("<HHIIHH", raw[body : body + 16])
            if size >= 18 and body + 18 <= len(raw):
                extra = raw[body + 18 : min(body + size, body + 18 + struct.unpack("<H", raw[body + 16 : body + 18])[0])]
            if fmt[0] == 0xFFFE and size >= 40 and body + 40 <= len(raw):
                fmt = (struct.unpack("<H", raw[body + 24 : body + 26])[0], *fmt[1:])
        elif name == "data":
            if fmt is None:
                raise ValueError("data before fmt")
            if size == 0xFFFFFFFF:
                size = wide[1] if wide else len(raw) - body
            size = min(size, len(raw) - body)
            tail = body + size + size % 2
            while tail + 8 <= len(raw):
                n = struct.unpack("<I", raw[tail + 4 : tail + 8])[0]
                chunks[raw[tail : tail + 4].decode("latin-1")] = raw[tail + 8 : tail + 8 + n]
                tail += 8 + n + n % 2
            return Header(CODECS.get(fmt[0], "unknown"), fmt[1], fmt[2], fmt[4], fmt[5], body, size, chunks, extra)
        else:
            chunks[name] = raw[body : body + size]
        at = body + size + size % 2
    raise ValueError("no data chunk")


def build(data: bytes, *, channels: int = 1, rate: int = 8000, bits: int = 16, tag: int = 1, rf64: bool = False, info: dict[str, str] | None = None, align: int | None = None, samples: int | None = None, trailer: dict[str, bytes] | None = None) -> bytes:
    """A whole file; extensible beyond two channels or 16 bits of PCM and G.711, with a
    fact chunk if the number of samples is given, LIST-INFO and further chunks (cue, smpl,
    id3) behind data. ADPCM takes the bytes of its blocks as `align`."""
    adpcm = {2: "ms-adpcm", 0x11: "ima-adpcm"}.get(tag)
    extensible = (channels > 2 or bits > 16) and not adpcm and tag != 3
    if adpcm:
        per, bits = (ms_adpcm if tag == 2 else ima_adpcm).samples_per_block(align, channels), 4
        extra = adpcm_extra(adpcm, align, channels)
        fmt = struct.pack("<HHIIHHH", tag, channels, rate, rate * align // per, align, bits, len(extra)) + extra
    else:
        align = channels * ((bits + 7) // 8)
        fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, channels, rate, rate * align, align, bits)
    if extensible:
        fmt += struct.pack("<HHIH14s", 22, bits, (1 << channels) - 1, tag, bytes.fromhex("000000001000800000aa00389b71"))
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
    tail = chunk(b"LIST", b"INFO" + b"".join(chunk(k.encode(), v.encode() + b"\0") for k, v in info.items())) if info else b""
    tail += b"".join(chunk(k.ljust(4).encode(), v) for k, v in (trailer or {}).items())
    fact = chunk(b"fact", struct.pack("<I", samples)) if samples is not None else b""
    body = data + bytes(len(data) % 2)
    total = 4 + 8 + len(fmt) + len(fact) + (36 if rf64 else 0) + 8 + len(body) + len(tail)
    head = b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + chunk(b"ds64", struct.pack("<QQQI", total, len(data), len(data) // align, 0)) if rf64 else b"RIFF" + struct.pack("<I", total) + b"WAVE"
    return head + chunk(b"fmt ", fmt) + fact + b"data" + struct.pack("<I", 0xFFFFFFFF if rf64 else len(data)) + body + tail


def mp3_packets(raw: bytes, h: Header, window: int = 8192) -> Iterator[tuple[int, bytes]]:
    """Sample position and frame of an MPEG stream inside `data`, of which a window is
    searched at a time; damage between frames is skipped."""
    from . import mpeg

    at, pts, end = h.data_at, 0, h.data_at + h.data_size
    while at < end:
        stop = min(end, at + window)
        last = at
        for place, size, f in mpeg.scan(raw, at, stop):
            yield pts, raw[place : place + size]
            pts, last = pts + f.samples, place + size
        if last == at:  # a frame longer than the window, or none in it
            if stop == end:
                return
            window *= 2
            continue
        at = last


def packets(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Sample position and bytes of each packet: whole blocks up to PACKET bytes, one block
    of ADPCM, one frame of MPEG audio."""
    h = parse(raw)
    if h.codec == "mp3":
        yield from mp3_packets(raw, h)
        return
    step = h.align if h.codec in ADPCM else max(h.align, PACKET // h.align * h.align)
    for at in range(0, h.data_size, step):
        yield at // h.align * h.block, raw[h.data_at + at : h.data_at + min(at + step, h.data_size)]


def duration(h: Header) -> float:
    return h.samples / h.rate if h.rate else 0.0


def seek(h: Header, sample: int) -> int:
    """The byte of the block that holds a sample, not behind the data."""
    whole = h.data_size // h.align
    return h.data_at + min(max(sample, 0) // h.block, whole) * h.align


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """path, codec, channels, rate, bits, seq, pts, data: block-aligned packets."""

    schema = pa.schema([("path", pa.string()), ("codec", pa.string()), ("channels", pa.int32()), ("rate", pa.int32()), ("bits", pa.int32()), ("seq", pa.int64()), ("pts", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = parse(raw)
                rows = [dict(zip(schema.names, (name, h.codec, h.channels, h.rate, h.bits, i, *p), strict=True)) for i, p in enumerate(packets(raw))]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, codec string, channels int, rate int, bits int, seq long, pts long, data binary")


def encode(df: DataFrame, rate: int = 8000) -> DataFrame:
    """sid, idx, q (16-bit integers) -> sid, content: a WAV file for each stream."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        return pa.table({"sid": t["sid"].slice(0, 1).cast(pa.int64()), "content": pa.array([build(t["q"].to_numpy().astype("<i2").tobytes(), rate=rate)], pa.binary())})

    return df.select("sid", "idx", "q").groupBy("sid").applyInArrow(run, "sid long, content binary")


def decode(files: DataFrame) -> DataFrame:
    """sid, content -> sid, idx, q."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sid, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = parse(raw)
                q = np.frombuffer(raw, "<i2", h.data_size // 2, h.data_at).astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(q), sid)), pa.array(np.arange(len(q))), pa.array(q)], names=["sid", "idx", "q"])

    return files.select("sid", "content").mapInArrow(run, "sid long, idx long, q long").select(F.col("sid"), "idx", "q")
