"""Filters with state along a stream: numpy over Arrow batches, in linear time.

A stage holds one stream's state; push() takes the next samples and gives as many, and
flush() gives what is left behind the last one. carried() deals streams over tasks, sorts
each by idx and feeds it batch by batch, so that a stream of any length needs the memory
of a batch and of its state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

NONE = np.zeros(0)


class Stage(Protocol):
    def push(self, x: np.ndarray) -> np.ndarray: ...
    def flush(self) -> np.ndarray: ...


def recursion(u: np.ndarray, a: tuple[float, ...], state: np.ndarray) -> np.ndarray:
    """y[n] = u[n] - a[0] y[n-1] - a[1] y[n-2] ..., with state = y[-1], y[-2], ...

    The samples are cut into about sqrt(n) pieces, which start from rest side by side;
    then each piece gets the response to the state that the one before it left.
    """
    n, order = len(u), len(a)
    if not n or not order:
        return u.copy()
    length = max(order, int(np.ceil(np.sqrt(n))))
    pieces = -(-n // length)
    rest = np.zeros((length + order, pieces))
    padded = np.zeros(pieces * length)
    padded[:n] = u
    feed = padded.reshape(pieces, length).T
    free = np.zeros((length + order, order))  # answers to each single state
    for k in range(order):
        free[order - 1 - k, k] = 1.0
    for i in range(length):
        past, alone = 0.0, 0.0
        for k, c in enumerate(a):
            past = past + c * rest[i + order - 1 - k]
            alone = alone + c * free[i + order - 1 - k]
        rest[i + order] = feed[i] - past
        free[i + order] = -alone
    starts = np.empty((order, pieces))
    now = np.asarray(state, np.float64)
    ends = rest[::-1][:order]  # the newest first
    turn = free[::-1][:order]
    for p in range(pieces):
        starts[:, p] = now
        now = ends[:, p] + turn @ now
    return (rest[order:] + free[order:] @ starts).T.ravel()[:n]


class Linear:
    """Direct form I: feed-forward b, feedback a (without a0 = 1)."""

    def __init__(self, b: tuple[float, ...], a: tuple[float, ...]) -> None:
        self.b, self.a = b, a
        self.x, self.y = np.zeros(len(b) - 1), np.zeros(len(a))  # oldest first, newest first

    def push(self, x: np.ndarray) -> np.ndarray:
        held = np.r_[self.x, x]
        m = len(self.b) - 1
        u = sum(c * held[m - k : m - k + len(x)] for k, c in enumerate(self.b))
        y = recursion(u, self.a, self.y)
        self.x = held[len(held) - m :]
        self.y = np.r_[y[::-1], self.y][: len(self.a)]
        return y

    def flush(self) -> np.ndarray:
        return NONE


class Delay:
    """y = dry x + wet buf[n - D], buf[n] = x + feedback buf[n - D], D samples at a time."""

    def __init__(self, steps: int, feedback: float, wet: float, dry: float) -> None:
        self.buf, self.feedback, self.wet, self.dry = np.zeros(steps), feedback, wet, dry

    def push(self, x: np.ndarray) -> np.ndarray:
        d, out = len(self.buf), np.empty(len(x))
        for k in range(0, len(x), d):
            v = x[k : k + d]
            old = self.buf[: len(v)]
            out[k : k + d] = self.dry * v + self.wet * old
            self.buf = np.r_[self.buf[len(v) :], v + self.feedback * old]
        return out

    def flush(self) -> np.ndarray:
        return NONE


class Envelope:
    """One-pole follower: `attack` towards lower values, `release` towards higher ones."""

    def __init__(self, attack: float, release: float) -> None:
        self.attack, self.release, self.env = attack, release, 0.0

    def push(self, x: np.ndarray) -> np.ndarray:
        out, env, attack, release = [], self.env, self.attack, self.release
        for v in x.tolist():
            env = v + (attack if v < env else release) * (env - v)
            out.append(env)
        self.env = env
        return np.array(out)

    def flush(self) -> np.ndarray:
        return NONE


class LowpassGate:
    """Channels share an envelope of the loudest, which opens a one-pole low pass of each
    between two cut-offs, and its level. push() takes a row per sample."""

    def __init__(self, channels: int, threshold: float, span: float, attack: float, release: float, opened: float, closed: float, rate: float) -> None:
        self.low, self.env = np.zeros(channels), 0.0
        self.threshold, self.span, self.attack, self.release = threshold, span, attack, release
        self.opened, self.closed, self.rate = opened, closed, rate

    def push(self, x: np.ndarray) -> np.ndarray:
        x = x.reshape(len(x), -1)
        peak = np.abs(x).max(axis=1)
        with np.errstate(divide="ignore"):
            level = np.maximum(-120.0, np.where(peak > 0, 20 * np.log10(peak), -120.0))
        goal = np.clip((level - (self.threshold - self.span)) / self.span, 0.0, 1.0)
        env, out = self.env, []
        for g in goal.tolist():
            env = g + (self.attack if g > env else self.release) * (env - g)
            out.append(env)
        env_, self.env = np.array(out), env
        part = 1 - np.exp(-2 * np.pi * self.closed * (self.opened / self.closed) ** env_ / self.rate)
        y = np.empty_like(x)
        for c in range(x.shape[1]):
            low = float(self.low[c])
            held = []
            for v, p in zip(x[:, c].tolist(), part.tolist(), strict=True):
                low += p * (v - low)
                held.append(low)
            self.low[c] = low
            y[:, c] = np.array(held) * env_
        return y

    def flush(self) -> np.ndarray:
        return NONE


#: Delays in samples at 44.1 kHz of the public-domain Schroeder-Moorer design.
COMBS = (1116, 1188, 1277, 1356, 1422, 1491, 1557, 1617)
ALLPASSES = (556, 441, 341, 225)
BASE, SPREAD, INPUT = 44100, 23, 0.015
#: Samples of a delay below which a loop over single ones takes less time than arrays.
SHORT = 64


class Comb:
    """buf[n] = x + feedback * low(buf[n - D]), low a one-pole low pass; gives buf[n - D]."""

    def __init__(self, steps: int, feedback: float, damping: float) -> None:
        self.buf, self.feedback = np.zeros(steps), feedback
        self.low = Linear((1 - damping,), (-damping,))
        self.damping = damping

    def push(self, x: np.ndarray) -> np.ndarray:
        if len(self.buf) < SHORT:
            return self.one_by_one(x)
        d, out = len(self.buf), np.empty(len(x))
        for k in range(0, len(x), d):
            v = x[k : k + d]
            old = self.buf[: len(v)]
            out[k : k + d] = old
            self.buf = np.r_[self.buf[len(v) :], v + self.feedback * self.low.push(old)]
        return out

    def one_by_one(self, x: np.ndarray) -> np.ndarray:
        held, low = self.buf.tolist(), float(self.low.y[0])
        part, damping, feedback = 1 - self.damping, self.damping, self.feedback
        for k, v in enumerate(x.tolist()):
            low = part * held[k] + damping * low
            held.append(v + feedback * low)
        self.buf, self.low.y = np.array(held[len(x) :]), np.array([low])
        return np.array(held[: len(x)])


class Allpass:
    """buf[n] = x + buf[n - D] / 2; gives buf[n - D] - x."""

    def __init__(self, steps: int) -> None:
        self.buf = np.zeros(steps)

    def push(self, x: np.ndarray) -> np.ndarray:
        d, out = len(self.buf), np.empty(len(x))
        if d < SHORT:
            held = self.buf.tolist()
            for k, v in enumerate(x.tolist()):
                held.append(v + held[k] * 0.5)
            self.buf = np.array(held[len(x) :])
            return np.array(held[: len(x)]) - x
        for k in range(0, len(x), d):
            v = x[k : k + d]
            old = self.buf[: len(v)]
            out[k : k + d] = old - v
            self.buf = np.r_[self.buf[len(v) :], v + old * 0.5]
        return out


class Reverb:
    """Eight parallel damped combs, then four all-passes in series."""

    def __init__(self, rate: int, room: float, damp: float, wet: float, dry: float, channel: int = 0) -> None:
        scale = lambda d: max(1, int((d + SPREAD * channel) * rate / BASE + 0.5))
        self.combs = [Comb(scale(d), room * 0.28 + 0.7, damp * 0.4) for d in COMBS]
        self.passes = [Allpass(scale(d)) for d in ALLPASSES]
        self.wet, self.dry = wet, dry

    def push(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for c in self.combs:
            out += c.push(x * INPUT)
        for p in self.passes:
            out = p.push(out)
        return out * self.wet + x * self.dry

    def flush(self) -> np.ndarray:
        return NONE


class Convolver:
    """Uniformly partitioned overlap-save: blocks of `hop` samples against the spectra of
    the response's parts, of which as many past blocks are held and no more. Samples come
    out a block late, the tail at the end."""

    def __init__(self, h: np.ndarray, hop: int, wet: float = 1.0) -> None:
        h = np.asarray(h, np.float64)
        self.spectra = [np.fft.rfft(h[i : i + hop], 2 * hop) for i in range(0, max(len(h), 1), hop)]
        self.hop, self.taps, self.wet = hop, len(h), wet
        self.past: deque[np.ndarray] = deque(maxlen=len(self.spectra))
        self.last, self.wait, self.taken, self.given = np.zeros(hop), NONE, 0, 0

    def _block(self, x: np.ndarray) -> np.ndarray:
        self.past.appendleft(np.fft.rfft(np.r_[self.last, x]))
        self.last = x
        y = np.fft.irfft(sum(p * s for p, s in zip(self.past, self.spectra, strict=False)), 2 * self.hop)[self.hop :]
        return y * self.wet + x * (1 - self.wet)

    def push(self, x: np.ndarray) -> np.ndarray:
        self.taken += len(x)
        self.wait = np.r_[self.wait, x]
        whole = len(self.wait) // self.hop * self.hop
        out = [self._block(self.wait[k : k + self.hop]) for k in range(0, whole, self.hop)]
        self.wait = self.wait[whole:]
        self.given += whole
        return np.concatenate(out) if out else NONE

    def flush(self) -> np.ndarray:
        left, out = self.taken + self.taps - 1 - self.given, []
        while self.taken and sum(map(len, out)) < left:
            x = np.r_[self.wait, np.zeros(self.hop - len(self.wait))]
            out.append(self._block(x))
            self.wait = NONE
        return np.concatenate(out)[:left] if out else NONE


def edges(column: pa.Array) -> np.ndarray:
    """Places where a value differs from the one before it, the first one included."""
    if pa.types.is_struct(column.type):
        parts = [edges(x) for x in column.flatten()]
        return np.unique(np.concatenate(parts))
    x = column.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def carried(df: DataFrame, make: Callable[[Any], Stage], columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """sid, idx and sample columns -> the same, by a stage for each sid, made from its value.

    idx numbers the samples given from the first idx on. sid may be a struct. Rows of one
    sid are sorted within their task; a lost executor starts its streams again.
    """
    schema = df.select("sid", "idx", *columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sid", "idx", *columns]
        key, stage, at, kind = None, None, 0, None

        def made(y: np.ndarray, sid: pa.Array) -> pa.RecordBatch:
            y = y.reshape(len(y), -1)
            return pa.record_batch([sid, pa.array(np.arange(at, at + len(y), dtype=np.int64)), *[pa.array(np.ascontiguousarray(y[:, c])) for c in range(len(columns))]], names=names)

        for b in batches:
            sids = b.column(0)
            kind = sids.type
            cuts = edges(sids)
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sids)], strict=True):
                own = sids[a].as_py()
                if stage is None or own != key:
                    if stage is not None and len(y := stage.flush()):
                        yield made(y, pa.array([key] * len(y), kind))
                    key, stage, at = own, make(own), b.column(1)[a].as_py()
                x = np.column_stack([b.column(2 + c).slice(a, z - a).to_numpy(zero_copy_only=False).astype(np.float64) for c in range(len(columns))])
                y = stage.push(x[:, 0] if len(columns) == 1 else x)
                if len(y):
                    yield made(y, sids.slice(a, z - a) if len(y) == z - a else pa.array([key] * len(y), kind))
                    at += len(y)
        if stage is not None and len(y := stage.flush()):
            yield made(y, pa.array([key] * len(y), kind))

    return df.select("sid", "idx", *columns).repartition("sid").sortWithinPartitions("sid", "idx").mapInArrow(run, schema)
