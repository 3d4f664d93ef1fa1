"""Extension points: engines that users write, and how they run over the cluster.

An engine holds the state of one stream. The runners deal streams over tasks, keep each
in order and feed its engine: packets to a decoder, samples to an encoder, samples of one
or several inputs to a filter with one or several outputs. What push() gives goes on,
flush() ends the stream. A repeated task begins its streams again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import state
from .diagnostics import Action, MediaError


class Decoder(Protocol):
    def push(self, packet: bytes) -> np.ndarray: ...  # channels by samples
    def flush(self) -> np.ndarray: ...


class Encoder(Protocol):
    def push(self, x: np.ndarray) -> list[bytes]: ...
    def flush(self) -> list[bytes]: ...


class Inputs(Protocol):
    """Several inputs: samples come port by port, each port's in order; end() tells that a
    port has no more. What is given back is output so far."""

    def push(self, port: str, x: np.ndarray) -> np.ndarray: ...
    def end(self, port: str) -> np.ndarray: ...


class Outputs(Protocol):
    def push(self, x: np.ndarray) -> dict[str, np.ndarray]: ...
    def flush(self) -> dict[str, np.ndarray]: ...


def groups(batches: Iterator[pa.RecordBatch], make: Callable[[Any], Any]) -> Iterator[tuple[Any, Any, pa.RecordBatch | None]]:
    """Key, engine and rows of each run of one key in the first column; rows None at its end."""
    key, engine = None, None
    for b in batches:
        cuts = state.edges(b.column(0)).tolist()
        for a, z in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
            own = b.column(0)[a].as_py()
            if engine is None or own != key:
                if engine is not None:
                    yield key, engine, None
                key, engine = own, make(own)
            yield key, engine, b.slice(a, z - a)
    if engine is not None:
        yield key, engine, None


def decoded(packets: DataFrame, make: Callable[[Any], Decoder], on_error: Action = Action.SKIP) -> DataFrame:
    """sid (long), seq, data -> sid, ch, idx, v. A packet that its decoder refuses is
    skipped or stops the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[Any, int] = {}

        def rows(key: Any, x: np.ndarray) -> pa.RecordBatch:
            c, n = x.shape
            first = at.get(key, 0)
            at.clear()
            at[key] = first + n
            return pa.record_batch([pa.array(np.full(c * n, key, np.int64)), pa.array(np.repeat(np.arange(c, dtype=np.int32), n)), pa.array(np.tile(np.arange(first, first + n), c)), pa.array(np.asarray(x, np.float64).ravel())], names=["sid", "ch", "idx", "v"])

        for key, engine, own in groups(batches, make):
            pieces = [engine.flush] if own is None else [lambda p=p: engine.push(p) for p in own.column(2).to_pylist()]  # noqa: B023
            for piece in pieces:
                try:
                    x = piece()
                except (ValueError, EOFError) as e:
                    if on_error is not Action.SKIP:
                        raise MediaError("decoder", on_error, str(e), e) from e
                    continue
                if x.size:
                    yield rows(key, x)

    return packets.select("sid", "seq", "data").repartition("sid").sortWithinPartitions("sid", "seq").mapInArrow(run, "sid long, ch int, idx long, v double")


def encoded(samples: DataFrame, make: Callable[[Any], Encoder], channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """sid (long), idx and a column per channel -> sid, seq, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq = None, 0
        for key, engine, own in groups(batches, make):
            seq = seq if key == last else 0
            last = key
            out = engine.flush() if own is None else engine.push(np.stack([own.column(2 + c).to_numpy(zero_copy_only=False) for c in range(len(channels))]))
            if out:
                yield pa.record_batch([pa.array([key] * len(out), pa.int64()), pa.array(np.arange(seq, seq + len(out))), pa.array(out, pa.binary())], names=["sid", "seq", "data"])
                seq += len(out)

    return samples.select("sid", "idx", *channels).repartition("sid").sortWithinPartitions("sid", "idx").mapInArrow(run, "sid long, seq long, data binary")


def filtered(samples: DataFrame, make: Callable[[Any], state.Stage]) -> DataFrame:
    """sid, idx, v -> the same, by a stage for each stream."""
    return state.carried(samples, make)


def joined(samples: DataFrame, make: Callable[[Any], Inputs]) -> DataFrame:
    """sid (long), port, idx, v -> sid, idx, v: ports are delivered one after the other, in
    the order of their names, so an engine may preload one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, port, last = 0, None, None

        def made(key: Any, y: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(y), key, np.int64)), pa.array(np.arange(at, at + len(y), dtype=np.int64)), pa.array(np.asarray(y, np.float64))], names=["sid", "idx", "v"])

        for key, engine, own in groups(batches, make):
            if key != last:
                at, port, last = 0, None, key
            parts: list[np.ndarray] = []
            if own is None:
                parts = [engine.end(port)]
            else:
                cuts = state.edges(own.column(1)).tolist()
                for a, z in zip(cuts, [*cuts[1:], own.num_rows], strict=True):
                    name = own.column(1)[a].as_py()
                    if port is not None and name != port:
                        parts.append(engine.end(port))
                    port = name
                    parts.append(engine.push(name, own.column(3).slice(a, z - a).to_numpy(zero_copy_only=False)))
            y = np.concatenate(parts) if parts else state.NONE
            if len(y):
                yield made(key, y)
                at += len(y)

    return samples.select("sid", "port", "idx", "v").repartition("sid").sortWithinPartitions("sid", "port", "idx").mapInArrow(run, "sid long, idx long, v double")


def split(samples: DataFrame, make: Callable[[Any], Outputs]) -> DataFrame:
    """sid (long), idx, v -> sid, port, idx, v: several outputs of one input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, int] = {}
        last = None
        for key, engine, own in groups(batches, make):
            if key != last:
                at, last = {}, key
            out = engine.flush() if own is None else engine.push(own.column(2).to_numpy(zero_copy_only=False))
            for port, y in out.items():
                if len(y):
                    first = at.get(port, 0)
                    at[port] = first + len(y)
                    yield pa.record_batch([pa.array(np.full(len(y), key, np.int64)), pa.array([port] * len(y)), pa.array(np.arange(first, first + len(y), dtype=np.int64)), pa.array(np.asarray(y, np.float64))], names=["sid", "port", "idx", "v"])

    return samples.select("sid", "idx", "v").repartition("sid").sortWithinPartitions("sid", "idx").mapInArrow(run, "sid long, port string, idx long, v double")


def with_expected(df: DataFrame, pts: str, n: str, key: str, order: str) -> DataFrame:
    """expected: where the row before it ends; null for the first."""
    return df.withColumn("expected", F.lag(F.col(pts) + F.col(n)).over(Window.partitionBy(key).orderBy(order)))


def gaps(df: DataFrame, pts: str = "pts", n: str = "n", key: str = "sid", order: str = "seq") -> DataFrame:
    """Rows whose time isn't the end of the one before."""
    return with_expected(df, pts, n, key, order).filter(F.col("expected") != F.col(pts))


def continuous(df: DataFrame, pts: str = "pts", n: str = "n", key: str = "sid", order: str = "seq") -> DataFrame:
    """The rows as they are; one whose time isn't the end of the one before is an error."""
    out = with_expected(df, pts, n, key, order)
    wrong = F.raise_error(F.concat(F.lit("expected time "), F.col("expected").cast("string"), F.lit(", got "), F.col(pts).cast("string")))
    return out.withColumn(pts, F.when(F.col("expected").isNull() | (F.col("expected") == F.col(pts)), F.col(pts)).otherwise(wrong.cast("long"))).drop("expected")
