"""Fourier transforms of frames: arrays of samples in rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that are transformed at a time.
ROWS = 1000


def _rows(df: DataFrame, columns: tuple[str, ...], f, schema: str) -> DataFrame:  # noqa: ANN001
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                b = whole.slice(k, ROWS)
                made = [f(*[np.array(x, np.float64) for x in row]) for row in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
                yield pa.record_batch([b.column(0), *[pa.array([m[i].tolist() for m in made], pa.list_(pa.float64())) for i in range(len(names) - 1)]], names=names)

    return df.select("sid", *columns).mapInArrow(run, schema)


def real_fft(df: DataFrame, column: str = "x") -> DataFrame:
    """sid, x (n samples) -> sid, re, im: n / 2 + 1 bins."""
    return _rows(df, (column,), lambda x: (np.fft.rfft(x).real, np.fft.rfft(x).imag), "sid long, re array<double>, im array<double>")


def real_ifft(df: DataFrame) -> DataFrame:
    """sid, re, im -> sid, x: an even number of samples, scaled by 1 / n."""
    return _rows(df, ("re", "im"), lambda re, im: (np.fft.irfft(re + 1j * im, 2 * (len(re) - 1)),), "sid long, x array<double>")


def complex_fft(df: DataFrame, inverse: bool = False) -> DataFrame:
    """sid, re, im (n a power of two) -> the same, transformed; the inverse has 1 / n."""

    def f(re: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(re) & (len(re) - 1) or not len(re):
            raise ValueError("the length must be a power of two")
        y = (np.fft.ifft if inverse else np.fft.fft)(re + 1j * im)
        return y.real, y.imag

    return _rows(df, ("re", "im"), f, "sid long, re array<double>, im array<double>")
