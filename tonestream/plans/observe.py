"""What a running plan does: metrics of edges and nodes, progress, memory, formatting."""

from __future__ import annotations

import sys
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path
from typing import IO, Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def edge_columns(payload: Column, time_: Column, samples: Column | None = None) -> list[Column]:
    """Items, bytes, samples and the latest time of what passes an edge."""
    return [F.count(F.lit(1)).alias("items"), F.sum(payload).alias("bytes"), F.sum(samples if samples is not None else F.lit(1)).alias("samples"), F.max(time_).alias("max_time")]


class Edge:
    """Counts what passes: `frame` goes on in the plan, `metrics` waits for its action."""

    def __init__(self, df: DataFrame, name: str, payload: Column, time_: Column, samples: Column | None = None) -> None:
        self.observation = Observation(name)
        self.frame = df.observe(self.observation, *edge_columns(payload, time_, samples))

    @property
    def metrics(self) -> dict[str, Any]:
        return self.observation.get


@dataclass
class Node:
    """State, times and error of a step: ready, running, completed or failed."""

    name: str
    state: str = "ready"
    started: float | None = None
    finished: float | None = None
    error: str | None = None

    @property
    def elapsed(self) -> float:
        return 0.0 if self.started is None else (self.finished or time.monotonic()) - self.started

    @contextmanager
    def running(self) -> Iterator[Node]:
        self.state, self.started = "running", time.monotonic()
        try:
            yield self
        except BaseException as e:
            self.state, self.error = "failed", str(e)
            raise
        else:
            self.state = "completed"
        finally:
            self.finished = time.monotonic()

    def snapshot(self) -> dict[str, Any]:
        return {"name": self.name, "state": self.state, "elapsed": self.elapsed, "error": self.error}


def progress(done: float, total: float | None, elapsed: float) -> dict[str, float]:
    """percent, speed (seconds of media a second) and ETA; -1 for what isn't known."""
    speed = done / elapsed if elapsed > 0 else -1.0
    known = total is not None and total > 0
    return {"percent": min(100.0, 100.0 * done / total) if known else -1.0, "speed": speed, "eta": max(0.0, (total - done) / speed) if known and speed > 0 else -1.0}


def progress_columns(done: Column, total: Column, elapsed: Column) -> dict[str, Column]:
    """The same of a table of jobs."""
    speed = F.when(elapsed > 0, done / elapsed).otherwise(F.lit(-1.0))
    return {
        "percent": F.when(total > 0, F.least(F.lit(100.0), F.lit(100.0) * done / total)).otherwise(F.lit(-1.0)),
        "speed": speed,
        "eta": F.when((total > 0) & (speed > 0), F.greatest(F.lit(0.0), (total - done) / speed)).otherwise(F.lit(-1.0)),
    }


def rollup(df: DataFrame, ok: Column, *keys: Column) -> DataFrame:
    """Runs, how many passed, and whether all did, of each package and variant."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("passed"), F.bool_and(ok).alias("ok"))


def format_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if abs(n) < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TiB"


def bytes_column(n: Column, top: int = 40) -> Column:
    """format_bytes() as an expression; 2**top is the largest unit. format_string would
    round what a double's shortest digits say, halves up; this rounds the double itself."""
    amount = lambda power, unit: F.concat(F.call_function("format_number", n / float(1 << power), F.lit("0.0")), F.lit(f" {unit}"))
    out = None
    for power, unit in ((40, "TiB"), (30, "GiB"), (20, "MiB"), (10, "KiB")):
        if power <= top:
            out = amount(power, unit) if out is None else F.when(F.abs(n) < float(1 << (power + 10)), amount(power, unit)).otherwise(out)
    return F.when(F.abs(n) < 1024, F.format_string("%.0f B", n.cast("double"))).otherwise(out)


def format_duration(seconds: float) -> str:
    if seconds < 0:
        return "unknown"
    if seconds < 1:
        return f"{seconds * 1000:.0f}ms"
    m, s = divmod(seconds, 60)
    h, m = divmod(int(m), 60)
    return f"{h}h{m:02d}m{int(s):02d}s" if h else f"{m}m{int(s):02d}s" if m else f"{s:.1f}s"


class Progress:
    """A line that is written over: "auto" on a terminal only, "always" or "never"."""

    def __init__(self, mode: str = "auto", out: IO[str] = sys.stderr, every: float = 0.2) -> None:
        if mode not in ("auto", "always", "never"):
            raise ValueError(f"no progress mode {mode!r}")
        self.on = mode == "always" or (mode == "auto" and out.isatty())
        self.out, self.every, self.last = out, every, 0.0

    def line(self, done: float, total: float | None, elapsed: float) -> str:
        p = progress(done, total, elapsed)
        known = f"{p['percent']:5.1f}% " if p["percent"] >= 0 else ""
        return f"{known}{format_duration(done)} at {p['speed']:.1f}x, {format_duration(p['eta'])} left"

    def update(self, done: float, total: float | None, elapsed: float, *, final: bool = False) -> None:
        if self.on and (final or elapsed - self.last >= self.every):
            self.last = elapsed
            self.out.write("\r" + self.line(done, total, elapsed) + ("\n" if final else ""))
            self.out.flush()


@dataclass
class Metered:
    """A binary file that counts what is read and written, and where it stands."""

    file: IO[bytes]
    read_bytes: int = 0
    written_bytes: int = 0
    position: int = field(default=0)

    def read(self, n: int = -1) -> bytes:
        raw = self.file.read(n)
        self.read_bytes += len(raw)
        self.position += len(raw)
        return raw

    def write(self, raw: bytes) -> int:
        n = self.file.write(raw)
        self.written_bytes += n
        self.position += n
        return n

    def seek(self, at: int) -> None:
        self.file.seek(at)
        self.position = at


class PeakMemory:
    """The largest resident size of this process while it runs, sampled."""

    def __init__(self, every: float = 0.05, read: Callable[[], int] | None = None) -> None:
        self.read, self.every, self.peak = read or resident, every, 0
        self._stop, self._thread = threading.Event(), threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while True:
            self.peak = max(self.peak, self.read())
            if self._stop.wait(self.every):
                return

    def __enter__(self) -> PeakMemory:
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        self._thread.join()
        self.peak = max(self.peak, self.read())


def resident() -> int:
    for line in Path("/proc/self/status").read_text().splitlines():
        if line.startswith("VmRSS:"):
            return int(line.split()[1]) * 1024
    return 0
