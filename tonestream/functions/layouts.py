"""Channel layouts and sample formats as column expressions; the 64-bit FNV hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Positions in the order of their bits, and named layouts.
POSITIONS = "FL FR FC LFE BL BR FLC FRC BC SL SR TC TFL TFC TFR TBL TBC TBR".split()
NAMED = {
    "mono": "FC", "1": "FC", "1.0": "FC", "stereo": "FL FR", "2": "FL FR", "2.0": "FL FR",
    "quad": "FL FR BL BR", "4.0": "FL FR BL BR", "5.1": "FL FR FC LFE BL BR", "7.1": "FL FR FC LFE BL BR SL SR",
}
#: Bytes of a sample by format.
WIDTH = {"u8": 1, "s8": 1, "s16": 2, "s24": 3, "s32": 4, "s64": 8, "f32": 4, "f64": 8}


def mask_of(positions: str) -> int:
    return sum(1 << POSITIONS.index(p) for p in positions.split())


def parse(name: Column) -> Column:
    """The bit mask of a named layout; null for an unknown name."""
    key = F.lower(F.trim(name))
    out = F.lit(None).cast("long")
    for n, positions in NAMED.items():
        out = F.when(key == n, F.lit(mask_of(positions)).cast("long")).otherwise(out)
    return out


def count(mask: Column) -> Column:
    return F.bit_count(mask)


def contains(mask: Column, position: str) -> Column:
    return F.shiftright(mask, POSITIONS.index(position)).bitwiseAND(1) == 1


def index(mask: Column, position: str) -> Column:
    """Place of a channel in its frame: the number of lower bits; null if it is absent."""
    below = (1 << POSITIONS.index(position)) - 1
    return F.when(contains(mask, position), F.bit_count(mask.bitwiseAND(F.lit(below).cast("long"))))


def positions(mask: Column) -> Column:
    """The channels' names in order, joined by commas."""
    return F.concat_ws(",", *[F.when(contains(mask, p), F.lit(p)) for p in POSITIONS])


def known_name(mask: Column) -> Column:
    """The shortest name of a layout, or its positions; null for none."""
    out = F.when(mask > 0, positions(mask))
    for n in ("mono", "stereo", "quad", "5.1", "7.1"):
        out = F.when(mask == F.lit(mask_of(NAMED[n])).cast("long"), F.lit(n)).otherwise(out)
    return out


def problem(mask: Column, channels: Column) -> Column:
    """Why a layout doesn't go with a number of channels; empty if it does."""
    beyond = F.shiftrightunsigned(mask, len(POSITIONS)) != 0
    return F.when(mask.isNull() | (mask <= 0), F.lit("empty")).when(beyond, F.lit("unknown position")).when(F.bit_count(mask) != channels, F.lit("channel count")).otherwise(F.lit(""))


def ambisonic_order(channels: Column) -> Column:
    """The order of a full sphere of that many channels; null if there is none."""
    root = F.round(F.sqrt(channels)).cast("long")
    return F.when((channels > 0) & (root * root == channels), root - 1)


def ambisonic(order: Column) -> Column:
    """Channels of a full sphere of that order."""
    return (order + 1) * (order + 1)


def is_planar(fmt: Column) -> Column:
    return F.endswith(fmt, F.lit("p"))


def packed(fmt: Column) -> Column:
    return F.regexp_replace(fmt, "p$", "")


def planar(fmt: Column) -> Column:
    return F.concat(packed(fmt), F.lit("p"))


def is_float(fmt: Column) -> Column:
    return F.startswith(fmt, F.lit("f"))


def width(fmt: Column) -> Column:
    """Bytes of a sample; null for an unknown format."""
    out = F.lit(None).cast("int")
    for f, n in WIDTH.items():
        out = F.when(packed(fmt) == f, F.lit(n)).otherwise(out)
    return out


@F.pandas_udf(StringType())
def fnv64(data: pd.Series) -> pd.Series:
    """FNV-1a of bytes with the top bit set, as 16 hex digits; null for null. The bytes of
    one payload depend on each other, so payloads are hashed side by side."""
    raws = [raw or b"" for raw in data]
    sizes = np.array([len(r) for r in raws], np.int64)
    order = np.argsort(-sizes, kind="stable")
    h = np.full(len(raws), 0xCBF29CE484222325, np.uint64)
    starts = np.cumsum(np.r_[0, sizes[:-1]]) if len(sizes) else sizes
    flat = np.frombuffer(b"".join(raws), np.uint8)
    live = len(raws)
    for i in range(int(sizes.max(initial=0))):
        while live and sizes[order[live - 1]] <= i:
            live -= 1
        at = order[:live]
        with np.errstate(over="ignore"):
            h[at] = (h[at] ^ flat[starts[at] + i]) * np.uint64(0x100000001B3)
    return pd.Series([None if raw is None else f"{int(x) | 1 << 63:016x}" for raw, x in zip(data, h, strict=True)], dtype=object)
