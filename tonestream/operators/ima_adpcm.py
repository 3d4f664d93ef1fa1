"""IMA ADPCM: the 4-bit coder along a stream, and independent blocks of WAV files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import state

#: Index steps and step sizes of IMA ADPCM.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int64)
#: Blocks that are coded at a time.
BATCH = 1024


def samples_per_block(align: int, channels: int) -> int:
    """One sample in the header, then groups of eight codes a channel."""
    if channels not in (1, 2) or align < 4 * channels or (align - 4 * channels) % (4 * channels):
        raise ValueError("blocks have one or two channels, a whole header and whole groups")
    return (align - 4 * channels) * 2 // channels + 1


def restored(code: np.ndarray, guess: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sample that a code stands for, and the next index."""
    step = STEPS[index]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.clip(guess + np.where(code & 8, -size, size), -32768, 32767), np.clip(index + INDEX_STEP[code & 7], 0, 88)


def coded(q: np.ndarray, guess: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Three bits by comparison with the step, its half and its quarter, and the sign."""
    step, left = STEPS[index], np.abs(q - guess)
    out = np.where(q < guess, 8, 0)
    for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
        over = left >= part
        out += np.where(over, bit, 0)
        left = left - np.where(over, part, 0)
    return out


def encode_blocks(x: np.ndarray) -> np.ndarray:
    """(n, samples, channels) -> (n, align) bytes. A block stands alone: its index starts
    where the first difference asks for, so blocks are coded side by side."""
    n, size, channels = x.shape
    x = x.astype(np.int64)
    guess = x[:, 0].copy()
    index = np.searchsorted(STEPS, np.abs(x[:, min(1, size - 1)] - x[:, 0])).clip(0, 88)
    head = np.zeros((n, channels, 4), np.uint8)
    head[..., :2] = np.ascontiguousarray(guess.astype("<i2")).view(np.uint8).reshape(n, channels, 2)
    head[..., 2] = index
    codes = np.empty((size - 1, n, channels), np.uint8)
    for t in range(size - 1):
        codes[t] = coded(x[:, t + 1], guess, index)
        guess, index = restored(codes[t].astype(np.int64), guess, index)
    # groups of eight codes, the low half of a byte first, channel by channel
    pairs = np.moveaxis(codes, 0, 2).reshape(n, channels, -1, 4, 2)
    body = np.moveaxis(pairs[..., 0] | pairs[..., 1] << 4, 1, 2)
    return np.concatenate([head.reshape(n, -1), body.reshape(n, -1)], axis=1)


def decode_blocks(blocks: np.ndarray, channels: int) -> np.ndarray:
    """(n, align) bytes -> (n, samples, channels)."""
    size = samples_per_block(blocks.shape[1], channels)
    n = len(blocks)
    head = blocks[:, : 4 * channels].reshape(n, channels, 4)
    guess = np.ascontiguousarray(head[..., :2]).view("<i2")[..., 0].astype(np.int64)
    index = head[..., 2].astype(np.int64)
    if (index > 88).any():
        raise ValueError("a block starts with an index that there is not")
    body = np.moveaxis(blocks[:, 4 * channels :].reshape(n, -1, channels, 4), 2, 1).reshape(n, channels, -1)
    codes = np.stack([body & 15, body >> 4], axis=3).reshape(n, channels, -1).astype(np.int64)
    out = [guess]
    for t in range(size - 1):
        guess, index = restored(codes[..., t], guess, index)
        out.append(guess)
    return np.stack(out, axis=1)


class Coder:
    """The coder along one stream from rest: samples to codes and what they decode to."""

    def __init__(self) -> None:
        self.guess = self.index = 0

    def push(self, x: np.ndarray) -> np.ndarray:
        steps, moves, out = STEPS.tolist(), INDEX_STEP.tolist(), []
        guess, index = self.guess, self.index
        for q in x[:, 0].astype(np.int64).tolist():
            step, left = steps[index], abs(q - guess)
            code, size = 0, step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                if left >= part:
                    code, size, left = code | bit, size + part, left - part
            index = min(88, max(0, index + moves[code]))
            guess, code = (guess - size, code | 8) if q < guess else (guess + size, code)
            guess = min(32767, max(-32768, guess))
            out.append((code, guess))
        self.guess, self.index = guess, index
        return np.array(out, np.float64)

    def flush(self) -> np.ndarray:
        return state.NONE


class Decoder:
    """Codes to samples along one stream from rest."""

    def __init__(self) -> None:
        self.guess = self.index = 0

    def push(self, x: np.ndarray) -> np.ndarray:
        steps, moves, out = STEPS.tolist(), INDEX_STEP.tolist(), []
        guess, index = self.guess, self.index
        for code in x.astype(np.int64).tolist():
            step = steps[index]
            size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            guess = min(32767, max(-32768, guess - size if code & 8 else guess + size))
            index = min(88, max(0, index + moves[code & 7]))
            out.append(guess)
        self.guess, self.index = guess, index
        return np.array(out, np.float64)

    def flush(self) -> np.ndarray:
        return state.NONE


def encode(df: DataFrame) -> DataFrame:
    """sid, idx, v (16-bit integers) -> sid, idx, code, decoded."""
    pair = df.select("sid", "idx", F.col("v").cast("double").alias("code"), F.lit(0.0).alias("decoded"))
    return state.carried(pair, lambda _: Coder(), ("code", "decoded")).select("sid", "idx", F.col("code").cast("int").alias("code"), F.col("decoded").cast("int").alias("decoded"))


def decode(df: DataFrame) -> DataFrame:
    """sid, idx, code -> sid, idx, decoded."""
    out = state.carried(df.select("sid", "idx", F.col("code").cast("double").alias("decoded")), lambda _: Decoder(), ("decoded",))
    return out.select("sid", "idx", F.col("decoded").cast("int").alias("decoded"))


def to_blocks(df: DataFrame, align: int = 256, channels: tuple[str, ...] = ("q",)) -> DataFrame:
    """sid, idx and a 16-bit column per channel -> sid, block, data. Samples meet by
    stream and block, never by stream; the last block repeats its last sample."""
    size, n = samples_per_block(align, len(channels)), len(channels)
    rows = df.groupBy("sid", F.floor(F.col("idx") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", *channels))).alias("s"))
    rows = rows.select("sid", "block", *[F.col(f"s.{c}").cast("array<int>").alias(c) for c in channels])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                x = np.zeros((b.num_rows, size, n), np.int64)
                for c in range(n):
                    for row, q in zip(x, b.column(2 + c).to_pylist(), strict=True):
                        row[: len(q), c], row[len(q) :, c] = q, q[-1]
                yield pa.record_batch([b.column(0), b.column(1), pa.array([r.tobytes() for r in encode_blocks(x)], pa.binary())], names=["sid", "block", "data"])

    return rows.mapInArrow(run, "sid long, block long, data binary")


def from_blocks(df: DataFrame, channels: tuple[str, ...] = ("q",)) -> DataFrame:
    """sid, block, data -> sid, idx and a column per channel, what fills the last block
    included."""
    n = len(channels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for align in sorted({len(r[2]) for r in rows}):
                own = [r for r in rows if len(r[2]) == align]
                x = decode_blocks(np.frombuffer(b"".join(r[2] for r in own), np.uint8).reshape(-1, align), n)
                size = x.shape[1]
                sid, block = (np.repeat(np.array([r[i] for r in own], np.int64), size) for i in (0, 1))
                yield pa.record_batch([pa.array(sid), pa.array(block * size + np.tile(np.arange(size), len(own))), *[pa.array(x[..., c].ravel()) for c in range(n)]], names=["sid", "idx", *channels])

    return df.select("sid", "block", "data").mapInArrow(run, "sid long, idx long, " + ", ".join(f"{c} long" for c in channels))
