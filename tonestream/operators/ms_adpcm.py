"""MS ADPCM: independent blocks, coded and restored many at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Predictor coefficients of MS ADPCM.
COEFFICIENTS = np.array([(256, 0), (512, -256), (0, 0), (192, 64), (240, 0), (460, -208), (392, -232)], np.int64)
#: By which the step is scaled, over 256, for each code.
ADAPT = np.array([230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230], np.int64)
#: Steps stay below this, which only damaged blocks reach.
MOST_STEP = (1 << 31) // 768
#: Blocks that are coded at a time.
BATCH = 256


def samples_per_block(align: int, channels: int) -> int:
    """Two samples in the header, then a code of 4 bits for each."""
    if channels not in (1, 2) or align < 7 * channels:
        raise ValueError("blocks have one or two channels and a whole header")
    return (align - 7 * channels) * 2 // channels + 2


def toward_zero(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    return np.sign(a) * (np.abs(a) // b)


def restored(code: np.ndarray, guess: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sample that a code stands for, and the next step."""
    sample = np.clip(guess + np.where(code >= 8, code - 16, code) * step, -32768, 32767)
    return sample, np.clip(toward_zero(step * ADAPT[code], 256), 16, MOST_STEP)


def decode_blocks(blocks: np.ndarray, channels: int) -> np.ndarray:
    """(n, align) bytes -> (n, samples, channels)."""
    samples_per_block(blocks.shape[1], channels)
    which = blocks[:, :channels]
    if (which >= len(COEFFICIENTS)).any():
        raise ValueError("a block names a predictor that there is not")
    c = COEFFICIENTS[which]
    step, one, two = np.moveaxis(np.ascontiguousarray(blocks[:, channels : 7 * channels]).view("<i2").reshape(len(blocks), 3, channels).astype(np.int64), 1, 0)
    packed = blocks[:, 7 * channels :]
    codes = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(blocks), -1, channels).astype(np.int64)
    out = [two, one]
    for t in range(codes.shape[1]):
        guess = toward_zero(one * c[..., 0] + two * c[..., 1], 256)
        sample, step = restored(codes[:, t], guess, step)
        one, two = sample, one
        out.append(sample)
    return np.stack(out, axis=1)


def encode_blocks(x: np.ndarray) -> np.ndarray:
    """(n, samples, channels) -> (n, align) bytes. All predictors are tried at once; the
    one with the least sum of absolute errors stays, the first of ties."""
    n, size, channels = x.shape
    x = x.astype(np.int64)
    two, one = (np.repeat(x[:, i, :, None], len(COEFFICIENTS), axis=2) for i in (0, 1))
    first = np.maximum(16, np.abs(x[:, 1] - x[:, 0]))
    step, error = np.repeat(first[..., None], len(COEFFICIENTS), axis=2), np.zeros_like(one)
    tried = np.empty((size - 2, *one.shape), np.uint8)
    for t in range(size - 2):
        target = x[:, t + 2, :, None]
        guess = toward_zero(one * COEFFICIENTS[:, 0] + two * COEFFICIENTS[:, 1], 256)
        away = target - guess
        code = np.clip(toward_zero(away + np.where(away >= 0, 1, -1) * (step // 2), step), -8, 7) & 15
        sample, step = restored(code, guess, step)
        error += np.abs(target - sample)
        one, two, tried[t] = sample, one, code
    best = error.argmin(axis=2)
    codes = np.moveaxis(np.take_along_axis(tried, best[None, ..., None], axis=3)[..., 0], 0, 1).reshape(n, -1, 2)
    words = np.stack([first.astype(np.int16), x[:, 1].astype(np.int16), x[:, 0].astype(np.int16)], axis=1)
    head = np.ascontiguousarray(words.astype("<i2")).view(np.uint8).reshape(n, -1)
    return np.concatenate([best.astype(np.uint8), head, codes[..., 0] << 4 | codes[..., 1]], axis=1)


def encode(df: DataFrame, align: int = 256) -> DataFrame:
    """sid, idx, q (16-bit integers, one channel) -> sid, block, data, predictor.

    Samples meet by stream and block, never by stream. The last block is filled with
    zeros. Streams without samples give no blocks.
    """
    size = samples_per_block(align, 1)
    rows = df.groupBy("sid", F.floor(F.col("idx") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "q"))).alias("s"))
    rows = rows.select("sid", "block", F.col("s.q").cast("array<int>").alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                x = np.zeros((b.num_rows, size, 1), np.int64)
                for row, q in zip(x, b.column(2).to_pylist(), strict=True):
                    row[: len(q), 0] = q
                done = encode_blocks(x)
                yield pa.record_batch([b.column(0), b.column(1), pa.array([r.tobytes() for r in done], pa.binary()), pa.array(done[:, 0].astype(np.int32))], names=["sid", "block", "data", "predictor"])

    return rows.mapInArrow(run, "sid long, block long, data binary, predictor int")


def decode(df: DataFrame) -> DataFrame:
    """sid, block, data -> sid, idx, q, what fills the last block included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for size in sorted({len(r[2]) for r in rows}):
                own = [r for r in rows if len(r[2]) == size]
                x = decode_blocks(np.frombuffer(b"".join(r[2] for r in own), np.uint8).reshape(-1, size), 1)[..., 0]
                n = x.shape[1]
                sid, block = (np.repeat(np.array([r[i] for r in own], np.int64), n) for i in (0, 1))
                yield pa.record_batch([pa.array(sid), pa.array(block * n + np.tile(np.arange(n), len(own))), pa.array(x.ravel())], names=["sid", "idx", "q"])

    return df.select("sid", "block", "data").mapInArrow(run, "sid long, idx long, q long")
