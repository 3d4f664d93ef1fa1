"""Buffers of samples: bytes to floats and whole numbers, and back, checked."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a sample in a buffer by format.
WIDTHS = {"u8": 1, "s8": 1, "s16": 2, "s24": 3, "s32": 4, "s64": 8, "f32": 4, "f64": 8}


def interval(bits: int) -> tuple[int, int]:
    return -(1 << bits - 1), (1 << bits - 1) - 1


def in_range(v: Column, bits: int) -> Column:
    low, high = interval(bits)
    return v.between(low, high)


def checked(v: Column, bits: int) -> Column:
    """v, or an error if it needs more bits."""
    text = F.concat(F.lit("sample "), v.cast("string"), F.lit(f" needs more than {bits} bits"))
    return F.when(v.isNull() | in_range(v, bits), v).otherwise(F.raise_error(text).cast("long"))


def unpack(raw: bytes, fmt: str, channels: int = 1, planar: bool = False) -> np.ndarray:
    """channels by samples, as they are: whole numbers as int64, floats as float64. What
    is no whole sample of all channels is an error."""
    width = WIDTHS[fmt]
    if len(raw) % (width * channels):
        raise ValueError(f"{len(raw)} bytes are no whole samples")
    if fmt == "s24":
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        x = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = x - (x >> 23 << 24)
    else:
        kind = {"u8": "u1", "s8": "i1", "s16": "<i2", "s32": "<i4", "s64": "<i8", "f32": "<f4", "f64": "<f8"}[fmt]
        x = np.frombuffer(raw, kind).astype(np.float64 if fmt[0] == "f" else np.int64)
    return x.reshape(channels, -1) if planar else x.reshape(-1, channels).T


def pack(x: np.ndarray, fmt: str, planar: bool = False) -> bytes:
    """The other way; whole numbers out of the format's range are an error."""
    if fmt[0] != "f":
        bits = 8 * WIDTHS[fmt]
        low, high = (0, 255) if fmt == "u8" else interval(bits)
        if x.size and (x.min() < low or x.max() > high):
            raise ValueError(f"samples from {x.min()} to {x.max()} don't fit {fmt}")
    flat = np.ascontiguousarray(x if planar else x.T).ravel()
    if fmt == "s24":
        return flat.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :3].tobytes()
    return flat.astype({"u8": "u1", "s8": "i1", "s16": "<i2", "s32": "<i4", "s64": "<i8", "f32": "<f4", "f64": "<f8"}[fmt]).tobytes()


def to_float(raw: bytes, fmt: str, channels: int = 1, planar: bool = False, bits: int = 0) -> np.ndarray:
    """Amplitudes; `bits` are those that count, in the high ones of the container."""
    x = unpack(raw, fmt, channels, planar)
    if fmt[0] == "f":
        return x
    full = bits or 8 * WIDTHS[fmt]
    x = (x - 128 if fmt == "u8" else x) >> 8 * WIDTHS[fmt] - full
    return x / 2.0 ** (full - 1)


def from_float(v: np.ndarray, fmt: str, planar: bool = False, bits: int = 0) -> bytes:
    """Negatives scale by 2**(b-1), others by one less, cut toward zero; NaN becomes 0."""
    if fmt[0] == "f":
        return pack(v, fmt, planar)
    full = bits or 8 * WIDTHS[fmt]
    low, high = interval(full)
    x = np.nan_to_num(v, nan=0.0, posinf=1.0, neginf=-1.0)
    q = np.where(x <= -1, low, np.where(x >= 1, high, np.trunc(np.where(x < 0, -low, high) * x))).astype(np.int64) << 8 * WIDTHS[fmt] - full
    return pack(q + 128 if fmt == "u8" else q, fmt, planar)


def effective_bits(stated: int, fmt: str) -> int:
    """What counts of a container: what is stated, if it fits, else all; floats have the
    bits of their fraction."""
    if fmt[0] == "f":
        return 24 if fmt == "f32" else 53
    return stated if 0 < stated <= 8 * WIDTHS[fmt] else 8 * WIDTHS[fmt]
