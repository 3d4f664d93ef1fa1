"""Probing and header fields of audio containers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: kbit/s of MPEG-1 layer III by bitrate index, and rates by rate index.
BITRATES = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
RATES = [44100, 48000, 32000]


def be(data: Column, at: int, n: int) -> Column:
    """n bytes from offset at as a big-endian number."""
    return F.conv(F.hex(F.substring(data, at + 1, n)), 16, 10).cast("long")


def probe(data: Column) -> dict[str, Column]:
    """Score of each format, 0 to 100."""
    text = lambda at, n: F.substring(data, at + 1, n)
    lit = lambda s: F.lit(s.encode())
    riff, rf64 = text(0, 4) == lit("RIFF"), text(0, 4) == lit("RF64")
    wave = (riff | rf64) & (text(8, 4) == lit("WAVE"))
    first = F.when(rf64, text(12, 4) == lit("ds64")).otherwise(text(12, 4) == lit("fmt "))
    wav = F.when(~wave, F.lit(0)).when(F.octet_length(data) < 36, F.lit(90)).when(first, F.lit(100)).otherwise(F.lit(25))
    flac = F.when(text(0, 4) == lit("fLaC"), F.lit(100)).otherwise(F.lit(0))
    sync = (be(data, 0, 1) == 255) & (be(data, 1, 1).bitwiseAND(224) == 224)
    mp3 = F.when(text(0, 3) == lit("ID3"), F.lit(40)).when(sync, F.lit(60)).otherwise(F.lit(0))
    return {"wav": wav, "flac": flac, "mp3": mp3}


def best_format(data: Column) -> Column:
    """The format of the highest score; null if all are 0."""
    found = [F.struct(score.alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, score) in enumerate(probe(data).items())]
    top = F.array_max(F.array(*found))
    return F.when(top["score"] > 0, top["name"])


def mp3_header(word: Column) -> dict[str, Column]:
    """Fields of an MPEG-1 layer III header word."""
    part = lambda shift, mask: F.shiftright(word, shift).bitwiseAND(mask)
    rate = F.get(F.array(*map(F.lit, RATES)), part(10, 3).cast("int"))
    kbps = F.get(F.array(*map(F.lit, BITRATES)), part(12, 15).cast("int"))
    size = F.expr("0") + F.floor(F.lit(144000) * kbps / rate) + part(9, 1)
    return {"version": part(19, 3), "layer": 4 - part(17, 3), "kbps": kbps, "rate": rate, "padding": part(9, 1), "mode": part(6, 3), "frame_bytes": size}


def stream_info(data: Column) -> dict[str, Column]:
    """FLAC's 34-byte STREAMINFO."""
    tail = be(data, 10, 8)
    return {
        "min_block": be(data, 0, 2), "max_block": be(data, 2, 2), "min_frame": be(data, 4, 3), "max_frame": be(data, 7, 3),
        "rate": F.shiftright(be(data, 10, 4), 12), "channels": F.shiftright(be(data, 12, 1), 1).bitwiseAND(7) + 1,
        "bits": F.shiftleft(be(data, 12, 1).bitwiseAND(1), 4) + F.shiftright(be(data, 13, 1), 4) + 1,
        "samples": F.shiftleft(be(data, 13, 1).bitwiseAND(15), 32) + be(data, 14, 4), "tail": tail,
    }
