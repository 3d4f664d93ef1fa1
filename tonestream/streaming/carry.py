"""State carried from chunk to chunk: batch, and Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters
from ..operators.state import Linear


def remove_dc(df: DataFrame, pole: float) -> DataFrame:
    """The DC filter in batch, chunk by chunk."""
    return filters.remove_dc(df, pole)


def stream_remove_dc(stream: DataFrame, pole: float) -> DataFrame:
    """The same on a stream of sid, idx, v: the state is the next idx, x and y. A gap or
    a sample that comes too late is an error, as the order of samples is meaning."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        nxt, x, y = state.get if state.exists else (0, 0.0, 0.0)
        p = pd.concat(list(parts)).sort_values("idx")
        if len(p):
            if p.idx.iloc[0] != nxt or (p.idx.diff().dropna() != 1).any():
                raise ValueError(f"stream {key[0]}: expected sample {nxt}, got {p.idx.iloc[0]}")
            v = p.v.to_numpy()
            stage = Linear((1.0, -1.0), (-pole,))
            stage.x[:], stage.y[:] = x, y
            out = stage.push(v)
            state.update((int(p.idx.iloc[-1]) + 1, float(v[-1]), float(out[-1])))
            yield pd.DataFrame({"sid": p.sid, "idx": p.idx, "v": out})

    return stream.select("sid", "idx", "v").groupBy("sid").applyInPandasWithState(run, "sid long, idx long, v double", "nxt long, x double, y double", "append", "NoTimeout")


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """Counts by type and hour; with `late` a watermark, for streams."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy("event_type", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.col("window.start").alias("start"), "n", "total")
