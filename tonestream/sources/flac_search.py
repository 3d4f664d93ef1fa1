"""What an encoder of FLAC frames tries: windows, predictors, codings, pairs and sizes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

Window = Callable[[int], np.ndarray]


@dataclass(frozen=True)
class Tukey:
    """Ones with raised cosines over int(p / 2 * n) - 1 samples at either end."""

    p: float = 0.5

    def __call__(self, n: int) -> np.ndarray:
        w = np.ones(n)
        taper = int(self.p / 2 * n) - 1
        if taper > 0:
            rise = 0.5 - 0.5 * np.cos(np.pi * np.arange(taper) / taper)
            w[:taper], w[n - taper :] = rise, rise[::-1]
        return w


@dataclass(frozen=True)
class Part:
    """A window over one of `parts` equal parts of the block, nothing elsewhere."""

    at: int
    parts: int
    inner: Window = Tukey()

    def __call__(self, n: int) -> np.ndarray:
        a, b = n * self.at // self.parts, n * (self.at + 1) // self.parts
        w = np.zeros(n)
        w[a:b] = self.inner(b - a)
        return w


def subdivided(parts: int, p: float = 0.5) -> tuple[Window, ...]:
    """The whole block, its halves, thirds and so on: parts * (parts + 1) / 2 windows."""
    if not 1 <= parts <= 7:
        raise ValueError("1 to 7 parts")
    return tuple(Part(i, k, Tukey(p)) for k in range(1, parts + 1) for i in range(k))


@dataclass(frozen=True)
class Preset:
    """fixed: orders of differences that are tried; lpc: highest order of a predictor;
    every: whether all orders are coded, or the one that the error promises most of;
    precisions of coefficients; partitions: deepest parting of residuals; stereo:
    "independent", "estimate" or "search"; split: how often a block may be halved."""

    fixed: tuple[int, ...] = (0, 1, 2, 3, 4)
    lpc: int = 8
    windows: tuple[Window, ...] = (Tukey(),)
    every: bool = False
    precisions: tuple[int, ...] = (14,)
    partitions: int = 6
    stereo: str = "search"
    split: int = 0


def preset(level: int = 12) -> Preset:
    """Levels 0 to 23: each third adds windows and orders, each level within it depth."""
    if not 0 <= level <= 23:
        raise ValueError("levels go from 0 to 23")
    return Preset(
        fixed=(2,) if level < 2 else (0, 1, 2, 3, 4),
        lpc=0 if level < 4 else min(32, 4 + 4 * ((level - 4) // 3)) if level < 18 else 32 if level > 20 else 24,
        windows=(Tukey(),) if level < 14 else subdivided(min(7, 1 + (level - 12) // 2)),
        every=level >= 20,
        precisions=(12,) if level < 8 else (14,) if level < 22 else (12, 14, 15),
        partitions=3 if level < 4 else 6 if level < 16 else 8,
        stereo="independent" if level < 1 else "estimate" if level < 8 else "search",
        split=0 if level < 15 else 1 if level < 18 else 2 if level < 21 else 3,
    )


def autocorrelation(w: np.ndarray, most: int) -> np.ndarray:
    """Sums of lagged products, by spectra for many lags."""
    n = len(w)
    if most < 12:
        return np.array([w[k:] @ w[: n - k] for k in range(most + 1)])
    size = 1 << (n + most).bit_length()
    return np.fft.irfft(np.abs(np.fft.rfft(w, size)) ** 2, size)[: most + 1]


def predictors(lags: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Coefficients and error of each order by Levinson and Durbin's recursion, until a
    reflection reaches 0.999999."""
    a, error, out = np.zeros(0), float(lags[0]), []
    for i in range(len(lags) - 1):
        if error <= 0:
            break
        k = (lags[i + 1] - a @ lags[i:0:-1]) / error
        if abs(k) >= 0.999999:
            break
        a = np.r_[a - k * a[::-1], k]
        error *= 1 - k * k
        out.append((a, error))
    return out


def promising(found: list[tuple[np.ndarray, float]], n: int, bits: int, precision: int) -> int:
    """The order whose error, as bits of residuals of that power, and header cost least."""
    cost = [(n - k) * max(0.0, 0.5 * np.log2(max(error / n, 1e-12)) + 0.25) + k * (bits + precision) for k, (_, error) in enumerate(found, 1)]
    return int(np.argmin(cost))


def whole(a: np.ndarray, precision: int) -> tuple[list[int], int] | None:
    """Coefficients as whole numbers of `precision` bits and a shift; what rounding loses
    goes to the next one. None if they are too large."""
    top = float(np.abs(a).max(initial=0.0))
    if top <= 0:
        return None
    shift = min(15, precision - 1 - int(np.frexp(top)[1]))
    if shift < 0:
        return None
    limit, out, left = 1 << precision - 1, [], 0.0
    for c in a.tolist():
        left += c * (1 << shift)
        q = max(-limit, min(limit - 1, round(left)))
        left -= q
        out.append(q)
    return out, shift


def estimate(x: np.ndarray) -> int:
    """Bits that a channel may take, by its second differences."""
    return int(np.abs(np.diff(x, min(2, len(x) - 1))).sum())


def pairing(x: np.ndarray, way: str) -> list[int]:
    """Which of the four ways to code a pair are worth coding: 1 (apart), 8 (left, side),
    9 (side, right), 10 (mean, side)."""
    if way == "independent":
        return [1]
    if way == "search":
        return [1, 8, 9, 10]
    left, right, side, mid = estimate(x[0]), estimate(x[1]), estimate(x[0] - x[1]), estimate(x[0] + x[1] >> 1)
    cost = {1: left + right, 8: left + side, 9: side + right, 10: mid + side}
    return [min(cost, key=cost.get)]


def halves(n: int, size: Callable[[int, int], int], levels: int, overhead: int = 80) -> list[tuple[int, int]]:
    """Blocks as first and last + 1: one is halved, again and again up to `levels` times,
    where the halves' bits and their overhead are fewer than its own."""

    def best(a: int, b: int, left: int) -> tuple[int, list[tuple[int, int]]]:
        own = size(a, b) + overhead
        if left and b - a >= 64:
            m = (a + b) // 2
            c1, p1 = best(a, m, left - 1)
            c2, p2 = best(m, b, left - 1)
            if c1 + c2 < own:
                return c1 + c2, p1 + p2
        return own, [(a, b)]

    return best(0, n, levels)[1]
