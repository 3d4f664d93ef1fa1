"""Stream filters over long form (sid, idx, v): expressions and windows.

Every filter that needs a whole stream partitions by sid alone and is stable in idx; none
collects to the driver. Filters without state are projections and never shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.levels import amp
from . import state


def ordered() -> WindowSpec:
    return Window.partitionBy("sid").orderBy("idx")


def gain(df: DataFrame, db: float) -> DataFrame:
    return df if db == 0 else df.withColumn("v", F.col("v") * F.lit(amp(db)))


def normalize(df: DataFrame, target_db: float = -1.0, amplify: bool = True) -> DataFrame:
    """Whole-stream peak to the target. The peaks are aggregated map-side and joined
    back, so that a long stream is never gathered in one task."""
    peak = df.groupBy("sid").agg(F.max(F.abs("v")).alias("peak"))
    factor = F.when(F.col("peak") > 0, F.lit(amp(target_db)) / F.col("peak")).otherwise(F.lit(1.0))
    factor = factor if amplify else F.least(factor, F.lit(1.0))
    return df.join(peak, "sid").withColumn("v", F.col("v") * factor).drop("peak")


def fade(df: DataFrame, fade_in: int, fade_out: int) -> DataFrame:
    """Linear gains over the first and last samples; the lesser counts. Lengths are
    aggregated map-side and joined back, so that no task holds a whole stream."""
    df = df.join(df.groupBy("sid").agg((F.max("idx") + 1).alias("total_")), "sid")
    p, total = F.col("idx"), F.col("total_")
    first = F.when(p < fade_in, p / F.lit(float(max(fade_in, 1)))).otherwise(F.lit(1.0))
    last = F.when(total - p <= fade_out, (total - p) / F.lit(float(max(fade_out, 1)))).otherwise(F.lit(1.0))
    return df.withColumn("v", F.col("v") * F.least(first, last)).drop("total_")


def trim(df: DataFrame, threshold_db: float = -60.0, side: str = "both") -> DataFrame:
    """Without the samples before the first and behind the last active one."""
    active = F.abs("v") >= F.lit(amp(threshold_db))
    ends = df.groupBy("sid").agg(F.min(F.when(active, F.col("idx"))).alias("a"), F.max(F.when(active, F.col("idx"))).alias("b"))
    keep = {"both": F.col("idx").between(F.col("a"), F.col("b")), "start": F.col("idx") >= F.col("a"), "end": F.col("idx") <= F.col("b")}[side]
    return df.join(ends, "sid").filter(keep).drop("a", "b")


def between(df: DataFrame, start: float, stop: float, rate: int) -> DataFrame:
    """The samples from one time to another, in seconds, both rounded half up to places."""
    at = lambda t: int(t * rate + 0.5)
    return df.filter((F.col("idx") >= at(start)) & (F.col("idx") < at(stop)))


def silence_tails(df: DataFrame, threshold_db: float) -> DataFrame:
    """Within each frame, what stands behind the last active sample becomes zero."""
    last = F.max(F.when(F.abs("v") >= F.lit(amp(threshold_db)), F.col("idx"))).over(Window.partitionBy("sid", "frame_no"))
    return df.withColumn("v", F.when(F.col("idx") > F.coalesce(last, F.lit(-1)), F.lit(0.0)).otherwise(F.col("v")))


def gate(df: DataFrame, threshold_db: float, channels: list[str]) -> DataFrame:
    """Zero where all channels are below the threshold."""
    loud = F.greatest(*[F.abs(c) for c in channels]) >= F.lit(amp(threshold_db))
    return df.withColumns({c: F.when(loud, F.col(c)).otherwise(F.lit(0.0)) for c in channels})


#: Fixed value: gain of a centre or surround channel that is dealt to others.
SIDE = amp(-3.010299956639812)


def mix_matrix(sources: list[str], targets: list[str]) -> dict[tuple[str, str], float]:
    """Gains by channel position: the same position 1; a centre or surround goes to mono
    or to FL and FR at half power, LFE nowhere."""
    left, right = {"FL", "SL", "BL"}, {"FR", "SR", "BR"}
    out = {}
    for s in sources:
        if s in targets:
            out[s, s] = 1.0
            continue
        g = {"LFE": 0.0, "FL": 1.0, "FR": 1.0}.get(s, SIDE)
        to = [t for t in targets if t == "FC"] if targets == ["FC"] else [t for t in targets if t in ("FL", "FR") and (s not in left or t == "FL") and (s not in right or t == "FR")]
        out |= {(s, t): g for t in to if g}
    return out


def remix(df: DataFrame, sources: dict[str, str], targets: list[str], normalize_: bool = False) -> DataFrame:
    """sources: position -> column. Output columns are the targets in lower case. With
    normalize_, a frame whose peak exceeds 1 is divided by it."""
    gains = mix_matrix(list(sources), targets)
    cols = {}
    for t in targets:
        parts = [F.col(c) * F.lit(gains[s, t]) for s, c in sources.items() if (s, t) in gains]
        cols[f"out_{t.lower()}"] = sum(parts[1:], parts[0]) if parts else F.lit(0.0)
    out = df.withColumns(cols)
    if normalize_:
        peak = F.max(F.greatest(*[F.abs(c) for c in cols])).over(Window.partitionBy("sid", "frame_no")) if len(cols) > 1 else F.max(F.abs(next(iter(cols)))).over(Window.partitionBy("sid", "frame_no"))
        out = out.withColumn("peak_", peak).withColumns({c: F.when(F.col("peak_") > 1, F.col(c) / F.col("peak_")).otherwise(F.col(c)) for c in cols}).drop("peak_")
    return out


def mixer(ports: DataFrame, weights: dict[str, float]) -> DataFrame:
    """port, k, v -> k, v: ports are aligned by ordinal; one that has ended is silent."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return ports.groupBy("k").agg(F.sum(F.col("v") * w[F.col("port")]).alias("v"))


def mixer_matrix(ports: DataFrame, weights: dict[str, dict[str, float]], normalize_: bool = False) -> DataFrame:
    """port, k, v -> port, k, v: every output is a weighted sum of the inputs, aligned by
    ordinal; weights: output -> input -> weight. With normalize_, an output whose weights
    exceed 1 in their absolute sum has them divided by it."""
    scaled = {o: {i: w / max(1.0, sum(map(abs, ws.values())) if normalize_ else 1.0) for i, w in ws.items()} for o, ws in weights.items()}
    goes = F.lit(None).cast("array<struct<out:string,w:double>>")
    for i in sorted({i for ws in scaled.values() for i in ws}):
        to = F.array(*[F.struct(F.lit(o).alias("out"), F.lit(float(ws[i])).alias("w")) for o, ws in scaled.items() if i in ws])
        goes = F.when(F.col("port") == i, to).otherwise(goes)
    each = ports.select("k", "v", F.explode(goes).alias("g"))
    return each.groupBy(F.col("g.out").alias("port"), "k").agg(F.sum(F.col("v") * F.col("g.w")).alias("v"))


def clamp_l1(values: str) -> F.Column:
    """An array whose absolute sum exceeds 1, divided by it."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return F.transform(values, lambda x: F.when(total > 1, x.cast("double") / total).otherwise(x.cast("double")))


def resample(df: DataFrame, rate_in: int, rate_out: int) -> DataFrame:
    """Linear interpolation in integer time: output k lies at k * in / out; the tail repeats
    the last sample up to the rounded length."""
    # lengths are joined back: a window over the whole stream would hold it
    s = df.select("sid", "idx", "v").join(df.groupBy("sid").agg(F.count(F.lit(1)).alias("n")), "sid")
    s = s.select("sid", "idx", "v", F.lead("v").over(ordered()).alias("nxt"), "n")
    first = F.expr(f"(idx * {rate_out}L + {rate_in - 1}L) div {rate_in}L")
    stop = F.expr(f"((idx + 1) * {rate_out}L + {rate_in - 1}L) div {rate_in}L - 1")
    last = F.expr(f"(n * {rate_out}L + {rate_in // 2}L) div {rate_in}L - 1")
    end = F.when(F.col("nxt").isNull(), last).otherwise(F.least(stop, last))
    s = s.withColumns({"a_": first, "b_": end}).filter("a_ <= b_")
    s = s.withColumn("k", F.explode(F.sequence("a_", "b_")))
    part = (F.col("k") * rate_in - F.col("idx") * rate_out) / F.lit(float(rate_out))
    v = F.when(F.col("nxt").isNull(), F.col("v")).otherwise(F.col("v") + (F.col("nxt") - F.col("v")) * part)
    return s.select("sid", F.col("k").alias("idx"), v.alias("v"))


def retime(df: DataFrame, factor: float, rate: int, relabel: bool = False) -> DataFrame:
    """Speed by interpolation (the rate's label stays) or by another label alone."""
    if factor == 1:
        return df
    if relabel:  # the same samples at another rate: places stay, durations shrink
        to = round(rate * factor)
        return df.withColumns({"rate": F.lit(to), "seconds": F.col("idx") / F.lit(float(to))})
    return resample(df, rate, round(rate / factor))


def delay(df: DataFrame, steps: int, feedback: float, wet: float, dry: float) -> DataFrame:
    """y = dry * x + wet * buf[n - D], buf[n] = x + feedback * buf[n - D]."""
    if feedback == 0:
        return df.withColumn("v", F.col("v") * dry + F.coalesce(F.lag("v", steps).over(ordered()), F.lit(0.0)) * wet)
    return state.carried(df, lambda _: state.Delay(steps, feedback, wet, dry))


def remove_dc(df: DataFrame, pole: float = 0.995) -> DataFrame:
    """y[n] = x[n] - x[n-1] + pole * y[n-1], from rest."""
    return state.carried(df, lambda _: state.Linear((1.0, -1.0), (-pole,)))


def biquad(df: DataFrame, c: dict[str, float]) -> DataFrame:
    """Direct form I with coefficients b0 b1 b2 a1 a2."""
    return state.carried(df, lambda _: state.Linear((c["b0"], c["b1"], c["b2"]), (c["a1"], c["a2"])))


def compressor(df: DataFrame, threshold: float = -18.0, ratio: float = 4.0, knee: float = 6.0, attack: float = 0.0, release: float = 0.0, makeup: float = 0.0) -> DataFrame:
    """attack, release: one-pole coefficients of the gain in dB; both 0 is the static curve."""
    from ..functions.levels import decibel, soft_knee

    curve = df.withColumn("g", soft_knee(decibel(F.abs("v")), threshold, ratio, knee))
    if attack or release:
        curve = state.carried(curve, lambda _: Pair(state.Envelope(attack, release)), ("v", "g"))
    return curve.withColumn("v", F.col("v") * F.pow(F.lit(10.0), (F.col("g") + makeup) / 20)).drop("g")


class Pair:
    """A sample as it is, and a curve beside it through a stage."""

    def __init__(self, stage: state.Stage) -> None:
        self.stage = stage

    def push(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x[:, 0], self.stage.push(x[:, 1])])

    def flush(self) -> np.ndarray:
        return state.NONE


def gate_lowpass(df: DataFrame, threshold: float, span: float, attack: float, release: float, opened: float, closed: float, rate: float, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """An envelope linked over the channel columns opens a one-pole low pass between two
    cut-offs and its level."""
    return state.carried(df, lambda _: state.LowpassGate(len(channels), threshold, span, attack, release, opened, closed, rate), channels)


#: Taps that a join with the impulse response takes; longer ones go by spectra.
FEW_TAPS = 4096


def convolve(df: DataFrame, taps: list[float]) -> DataFrame:
    """y[n] = sum of h[k] * x[n - k]: each sample meets the taps, a literal of at most
    FEW_TAPS numbers, and the sums are formed map-side first; longer responses go by
    overlap-save."""
    if len(taps) > FEW_TAPS:
        return state.carried(df, lambda _: state.Convolver(np.asarray(taps), 1 << 12))
    each = df.select("sid", "idx", "v", F.posexplode(F.lit([float(h) for h in taps])).alias("k", "h"))
    return each.groupBy("sid", (F.col("idx") + F.col("k")).alias("idx")).agg(F.sum(F.col("v") * F.col("h")).alias("v"))


def convolve_fft(df: DataFrame, taps: list[float], hop: int = 64) -> DataFrame:
    """The same by partitioned overlap-save."""
    return state.carried(df, lambda _: state.Convolver(np.asarray(taps), hop))


def reverb(df: DataFrame, rate: int, room: float = 0.5, damp: float = 0.5, wet: float = 0.3, dry: float = 1.0, channel: str | None = None) -> DataFrame:
    """`channel` names the field of a struct sid that widens the stereo image."""
    return state.carried(df, lambda sid: state.Reverb(rate, room, damp, wet, dry, sid[channel] if channel else 0))


def biquad_coefficients(kind: str, f: float, rate: float, q: float, db: float = 0.0) -> dict[str, float]:
    """The cookbook's second-order sections, divided by a0."""
    from math import cos, pi, sin, sqrt

    w, a = 2 * pi * f / rate, 10 ** (db / 40)
    alpha, c = sin(w) / (2 * q), cos(w)
    root = 2 * sqrt(a) * alpha
    b, d = {
        "peaking": ((1 + alpha * a, -2 * c, 1 - alpha * a), (1 + alpha / a, -2 * c, 1 - alpha / a)),
        "lowpass": (((1 - c) / 2, 1 - c, (1 - c) / 2), (1 + alpha, -2 * c, 1 - alpha)),
        "highpass": (((1 + c) / 2, -1 - c, (1 + c) / 2), (1 + alpha, -2 * c, 1 - alpha)),
        "lowshelf": ((a * (a + 1 - (a - 1) * c + root), 2 * a * (a - 1 - (a + 1) * c), a * (a + 1 - (a - 1) * c - root)), (a + 1 + (a - 1) * c + root, -2 * (a - 1 + (a + 1) * c), a + 1 + (a - 1) * c - root)),
        "highshelf": ((a * (a + 1 + (a - 1) * c + root), -2 * a * (a - 1 + (a + 1) * c), a * (a + 1 + (a - 1) * c - root)), (a + 1 - (a - 1) * c + root, 2 * (a - 1 - (a + 1) * c), a + 1 - (a - 1) * c - root)),
    }[kind]
    return {"b0": b[0] / d[0], "b1": b[1] / d[0], "b2": b[2] / d[0], "a1": d[1] / d[0], "a2": d[2] / d[0]}


def band_sections(bands: list[tuple[float, float]], rate: float) -> list[tuple[float, float, float]]:
    """Frequency, Q and dB of each band that changes anything, in order of frequency; a
    band's Q follows from the distance to its neighbours."""
    from math import sqrt

    bands, out = sorted((min(f, 0.999 * rate / 2), g) for f, g in bands), []
    for i, (f, g) in enumerate(bands):
        low = sqrt(f * bands[i - 1][0]) if i else (f * f / sqrt(f * bands[1][0]) if len(bands) > 1 else f / sqrt(2))
        high = sqrt(f * bands[i + 1][0]) if i + 1 < len(bands) else f * f / low
        if g:
            out.append((f, f / max(high - low, 1e-9), g))
    return out


class Cascade:
    """Stages one behind the other, in one pass over the samples."""

    def __init__(self, stages: list[state.Stage]) -> None:
        self.stages = stages

    def push(self, x: np.ndarray) -> np.ndarray:
        for s in self.stages:
            x = s.push(x)
        return x

    def flush(self) -> np.ndarray:
        return state.NONE


def equalizer(df: DataFrame, bands: list[tuple[float, float]], rate: float) -> DataFrame:
    """A cascade of peaking sections at (frequency, dB)."""
    c = [biquad_coefficients("peaking", f, rate, q, g) for f, q, g in band_sections(bands, rate)]
    return state.carried(df, lambda _: Cascade([state.Linear((x["b0"], x["b1"], x["b2"]), (x["a1"], x["a2"])) for x in c])) if c else df
