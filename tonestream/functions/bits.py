"""Checksums and bit-level functions as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def octets(data: Column) -> Column:
    """The bytes of a binary column as an array of integers."""
    h = F.hex(data)
    return F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(h.substr(2 * i - 1, F.lit(2)), 16, 10).cast("int"))


def crc_table(width: int, poly: int) -> list[int]:
    """The remainder of each byte, top bit first."""
    out = []
    for byte in range(256):
        x = byte << (width - 8)
        for _ in range(8):
            x = (x << 1 ^ poly if x >> (width - 1) & 1 else x << 1) & (1 << width) - 1
        out.append(x)
    return out


def crc(data: Column, width: int, poly: int) -> Column:
    """CRC with the top bit first, start 0, a byte at a time by table."""
    entry = F.array(*map(F.lit, crc_table(width, poly)))

    def step(state: Column, byte: Column) -> Column:
        at = F.shiftright(state, width - 8).bitwiseXOR(byte)
        return F.shiftleft(state, 8).bitwiseAND((1 << width) - 256).bitwiseXOR(F.get(entry, at)) if width > 8 else F.get(entry, at)

    return F.when(F.octet_length(data) == 0, F.lit(0)).otherwise(F.aggregate(octets(data), F.lit(0), step))


def crc_bytes(raw: bytes, width: int, table: np.ndarray, shift: list[np.ndarray]) -> int:
    """The remainder of a payload of any length: its bytes' own remainders are folded in
    halves, where shift[k] tells what 2**k zero bytes make of each byte of a remainder."""
    x = table[np.frombuffer(raw, np.uint8)]
    for k in range(len(shift)):
        if len(x) == 1:
            return int(x[0])
        if len(x) % 2:  # a remainder of nothing in front
            x = np.r_[np.zeros(1, x.dtype), x]
        left, right = x[::2], x[1::2]
        moved = right.copy()
        for i in range(width // 8):
            moved ^= shift[k][i][left >> (8 * i) & 255]
        x = moved
    raise ValueError("the payload is too long")


def crc_shifts(width: int, poly: int) -> list[np.ndarray]:
    """For each power of two up to 2**40 the remainders that so many zero bytes behind it
    make of each single byte of a remainder."""
    table = np.array(crc_table(width, poly), np.int64)
    mask = (1 << width) - 1

    def through(x: np.ndarray, step: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for i in range(width // 8):
            out ^= step[i][x >> (8 * i) & 255]
        return out

    single = np.stack([np.arange(256) << (8 * i) for i in range(width // 8)])
    one = (single << 8 & mask) ^ table[single >> (width - 8)]
    out = [one]
    for _ in range(40):
        out.append(through(out[-1], out[-1]))
    return out


def crc_of(width: int, poly: int):  # noqa: ANN201
    """The same for long payloads: an Arrow function over whole binary values, folding
    each in halves."""
    table, shifts = np.array(crc_table(width, poly), np.int64), crc_shifts(width, poly)

    @F.pandas_udf("int")
    def run(data: pd.Series) -> pd.Series:
        return pd.Series([crc_bytes(raw, width, table, shifts) if raw else 0 for raw in data], dtype="int32")

    return run


def crc8(data: Column) -> Column:
    return crc(data, 8, 0x07)


def crc16(data: Column) -> Column:
    return crc(data, 16, 0x8005)


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2 ... to 0, 1, 2, 3 ..."""
    return F.when(v >= 0, v * 2).otherwise(v * -2 - 1)


def unzigzag(u: Column) -> Column:
    return F.when(u % 2 == 0, F.shiftright(u, 1)).otherwise(-F.shiftright(u + 1, 1))


def syncsafe(n: Column) -> Column:
    """28 bits as four groups of seven, a byte each."""
    part = lambda k: F.shiftleft(F.shiftright(n, 7 * k).bitwiseAND(127), 8 * k)
    return part(0) + part(1) + part(2) + part(3)


def unsyncsafe(n: Column) -> Column:
    part = lambda k: F.shiftleft(F.shiftright(n, 8 * k).bitwiseAND(127), 7 * k)
    return part(0) + part(1) + part(2) + part(3)


def trailing_zeros(v: Column, most: int) -> Column:
    """Common trailing zero bits, `most` for zero."""
    out = F.lit(most)
    for k in range(most - 1, -1, -1):
        out = F.when(F.shiftright(v, k).bitwiseAND(1) == 1, F.lit(k)).otherwise(out)
    return out
