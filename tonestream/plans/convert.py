"""Conversion of files: resolve a declarative spec, build one plan, write atomically; jobs.

A file is a stream in long form (sid, ch, idx, v). Filters compile to DataFrame plans;
the samples are coded in blocks over the cluster, and the driver only strings finished
blocks together, one at a time.
"""

from __future__ import annotations

import hashlib
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import lru_cache
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import companding, levels, text
from ..operators import filters, ima_adpcm, ms_adpcm, state
from ..sources import flac, flac_meta, flac_search, mpeg, mpeg_decode, tags, wav
from . import negotiate
from .diagnostics import Problems

BLOCK = 4096
#: Channel positions of the named layouts, and of a number of channels.
LAYOUTS = {"mono": ["FC"], "stereo": ["FL", "FR"], "quad": ["FL", "FR", "BL", "BR"], "5.1": ["FL", "FR", "FC", "LFE", "BL", "BR"], "7.1": ["FL", "FR", "FC", "LFE", "BL", "BR", "SL", "SR"]}
ALIASES = {"1": "mono", "1.0": "mono", "2": "stereo", "2.0": "stereo", "4.0": "quad"}
FORMATS = {".wav": ("wav", "lpcm"), ".wave": ("wav", "lpcm"), ".flac": ("flac", "flac")}


class ConversionError(ValueError):
    """A problem with its stage, code and path."""

    def __init__(self, stage: str, code: str, message: str) -> None:
        super().__init__(f"{stage}: {message}")
        self.stage, self.code = stage, code


@dataclass(frozen=True)
class Profile:
    """What the samples of a stream are."""

    rate: int
    channels: int
    bits: int = 16
    codec: str = "lpcm"

    @property
    def positions(self) -> list[str]:
        known = [p for p in LAYOUTS.values() if len(p) == self.channels]
        return known[0] if known else [f"C{i}" for i in range(self.channels)]


def layout(name: str) -> list[str]:
    """The channel positions of a named layout."""
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in LAYOUTS:
        raise ConversionError("config", "unknown-layout", f"no layout {name!r}")
    return LAYOUTS[key]


# ---- reading


@lru_cache(4)
def mpeg_tables(path: str) -> mpeg_decode.Tables:
    return mpeg_decode.load(path)


def is_mpeg(raw: bytes) -> bool:
    """Whether a frame of MPEG audio is found, and no FLAC marker behind leading tags."""
    start, stop = tags.bounds(raw)
    return raw[start : start + 4] != b"fLaC" and next(mpeg.scan(raw, start, stop), None) is not None


def samples_of(raw: bytes, mpeg_tables_: str = "") -> Iterator[tuple[int, np.ndarray]]:
    """First place, and values as channels by samples, of each piece of a file. MPEG audio
    is decoded by the tables at a path, which the caller has."""
    if raw[:4] in (b"RIFF", b"RF64"):
        h = wav.parse(raw)
        if h.codec in wav.ADPCM:
            module, step = (ms_adpcm if h.codec == "ms-adpcm" else ima_adpcm), 256
            for k in range(0, h.data_size // h.align, step):
                piece = raw[h.data_at + k * h.align : h.data_at + min((k + step) * h.align, h.data_size // h.align * h.align)]
                x = module.decode_blocks(np.frombuffer(piece, np.uint8).reshape(-1, h.align), h.channels).reshape(-1, h.channels)
                at = k * h.block
                yield at, x[: max(0, h.samples - at)].T / 32768.0
            return
        width = h.align // max(h.channels, 1)
        kind = {("lpcm", 1): "u1", ("lpcm", 2): "<i2", ("lpcm", 4): "<i4", ("float", 4): "<f4", ("float", 8): "<f8", ("alaw", 1): "u1", ("ulaw", 1): "u1"}
        if (h.codec, width) not in kind and (h.codec, width) != ("lpcm", 3):
            raise ConversionError("decoder", "unsupported-codec", f"{h.codec} of {width} bytes")
        for at in range(0, h.data_size // h.align * h.align, BLOCK * 16 * h.align):
            piece = raw[h.data_at + at : h.data_at + min(at + BLOCK * 16 * h.align, h.data_size // h.align * h.align)]
            if width == 3:
                b = np.frombuffer(piece, "u1").reshape(-1, 3).astype(np.int64)
                x = (b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) - (b[:, 2] >> 7 << 24)
            else:
                x = np.frombuffer(piece, kind[h.codec, width])
            if h.codec == "lpcm":  # values of fewer bits stand in the high bits
                full = 8 * width
                x = (x.astype(np.float64) - (128 if width == 1 else 0)) / 2.0 ** (full - 1)
            yield at // h.align, x.astype(np.float64).reshape(-1, h.channels).T
        return
    if raw[:4] != b"fLaC" and is_mpeg(raw):
        if not mpeg_tables_:
            raise ConversionError("decoder", "no-tables", "MPEG audio needs the standard's tables, as mpeg_decode.load() describes")
        at = 0
        for x in mpeg_decode.decode(raw, mpeg_tables(mpeg_tables_)):
            yield at, x
            at += x.shape[1]
        return
    info, at = flac.parse(raw), 0
    for x in flac.read_frames(raw):
        yield at, x / 2.0 ** (info.bits - 1)
        at += x.shape[1]


def describe(raw: bytes) -> tuple[Profile, tags.Bundle]:
    """Profile and tags from a file's header."""
    if raw[:4] in (b"RIFF", b"RF64"):
        h = wav.parse(raw)
        b = tags.parse_info(h.chunks.get("LIST", b""))
        return Profile(h.rate, h.channels, 16 if h.codec in ("alaw", "ulaw", *wav.ADPCM) else min(h.bits, 24), h.codec), tags.merge(b, tags.parse(h.chunks.get("id3 ", b"")))
    if raw[:4] != b"fLaC" and is_mpeg(raw):
        i = mpeg.analyze(raw)
        return Profile(i.rate, i.channels, 16, "mp3"), tags.parse(raw)
    try:
        i = flac.parse(raw)
    except ValueError as e:
        raise ConversionError("demuxer", "unsupported-format", str(e)) from e
    return Profile(i.rate, i.channels, i.bits, "flac"), flac_meta.parse(raw)


def read(spark: SparkSession, path: str, mpeg_tables_: str = "") -> tuple[DataFrame, Profile, tags.Bundle]:
    """The samples of one file, its profile and tags. Executors read the file themselves."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for b in batches:
            for raw in b.column(0).to_pylist():
                try:
                    found: Any = describe(raw)
                except ValueError as e:
                    found = (getattr(e, "stage", "demuxer"), getattr(e, "code", "invalid-data"), str(e))
                yield pa.record_batch([pa.array([pickle.dumps(found)], pa.binary())], names=["d"])

    import pickle

    rows = files.mapInArrow(headers, "d binary").take(2)
    if len(rows) != 1:
        raise ConversionError("input", "not-one-file", f"{len(rows)} files at {path}")
    found = pickle.loads(rows[0].d)
    if len(found) == 3:
        raise ConversionError(*found)
    profile, bundle = found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                for at, x in samples_of(raw, mpeg_tables_):
                    c, n = x.shape
                    yield pa.record_batch([pa.array(np.zeros(c * n, np.int64)), pa.array(np.repeat(np.arange(c, dtype=np.int32), n)), pa.array(np.tile(np.arange(at, at + n), c)), pa.array(x.ravel())], names=["sid", "ch", "idx", "v"])

    df = files.mapInArrow(run, "sid long, ch int, idx long, v double")
    if profile.codec in ("alaw", "ulaw"):
        expand = companding.alaw_decode if profile.codec == "alaw" else companding.ulaw_decode
        df = df.withColumn("v", levels.dequantize(expand(F.col("v").cast("int")), 16))
    return df, profile, bundle


# ---- filters on the long form

Ports = dict[str, tuple[DataFrame, Profile]]
MOST_TAPS = 1 << 22


def each(df: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A filter that treats channels alone: each is a stream of its own."""
    out = f(df.select(F.struct("sid", "ch").alias("sid"), "idx", "v"))
    return out.select(F.col("sid.sid").alias("sid"), F.col("sid.ch").alias("ch"), "idx", "v")


def wide(df: DataFrame, n: int) -> DataFrame:
    """sid, idx, c0 ... of all channels."""
    return df.groupBy("sid", "idx").agg(*[F.max(F.when(F.col("ch") == i, F.col("v"))).alias(f"c{i}") for i in range(n)])


def remixed(df: DataFrame, p: Profile, o: dict[str, Any]) -> tuple[DataFrame, Profile]:
    targets = layout(o["layout"])
    if targets == p.positions:
        return df, p
    w = wide(df, p.channels).withColumn("frame_no", F.floor(F.col("idx") / BLOCK))
    made = filters.remix(w, {name: f"c{i}" for i, name in enumerate(p.positions)}, targets, o["normalize"])
    cols = F.array(*[F.col(f"out_{t.lower()}") for t in targets])
    return made.select("sid", "idx", F.posexplode(cols).alias("ch", "v")).select("sid", "ch", "idx", "v"), replace(p, channels=len(targets))


def linked(df: DataFrame) -> DataFrame:
    """The largest amplitude over channels at each place."""
    return df.groupBy("sid", "idx").agg(F.max(F.abs("v")).alias("v"))


def compressed(df: DataFrame, p: Profile, o: dict[str, Any]) -> DataFrame:
    c = levels.time_constant
    peak = linked(df)
    done = filters.compressor(peak, o["threshold-dbfs"], o["ratio"], o["knee-db"], c(o["attack-ms"], p.rate), c(o["release-ms"], p.rate), o["makeup-gain-db"])
    both = peak.withColumnRenamed("v", "p_").join(done, ["sid", "idx"]).select("sid", "idx", F.when(F.col("p_") > 0, F.col("v") / F.col("p_")).otherwise(F.lit(1.0)).alias("g_"))
    return df.join(both, ["sid", "idx"]).withColumn("v", F.col("v") * F.col("g_")).select("sid", "ch", "idx", "v")


def gated(df: DataFrame, p: Profile, o: dict[str, Any]) -> DataFrame:
    """All channels open and close together. The low pass opens between two cut-offs."""
    names = [f"c{i}" for i in range(p.channels)]
    w = wide(df, p.channels)
    if o["mode"] == "hard":
        made = filters.gate(w, o["threshold-dbfs"], names)
    elif o["mode"] == "lowpass":
        c = levels.time_constant
        made = filters.gate_lowpass(w, o["threshold-dbfs"], o["range-db"], c(o["attack-ms"], p.rate), c(o["release-ms"], p.rate), min(o["open-hz"], 0.45 * p.rate), o["closed-hz"], p.rate, tuple(names))
    else:
        raise ConversionError("config", "bad-value", f"gate.mode: {o['mode']!r}")
    return made.select("sid", "idx", F.posexplode(F.array(*names)).alias("ch", "v")).select("sid", "ch", "idx", "v")


def trimmed(df: DataFrame, p: Profile, o: dict[str, Any]) -> DataFrame:
    out = filters.trim(df, o["threshold-dbfs"], o["mode"])
    first = out.groupBy("sid").agg(F.min("idx").alias("f_"))
    return out.join(first, "sid").select("sid", "ch", (F.col("idx") - F.col("f_")).alias("idx"), "v")


def equalized(df: DataFrame, p: Profile, o: dict[str, Any]) -> DataFrame:
    if o["mode"] == "single":
        return each(df, lambda s: filters.biquad(s, filters.biquad_coefficients(o["type"], o["frequency-hz"], p.rate, o["q"], o["gain-db"])))
    gains = [float(g) for g in o["gains"].split(",")]
    low, high = o["low-hz"], min(o["high-hz"], 0.999 * p.rate / 2)
    n = o["bands"]
    freqs = [float(f) for f in o["manual-bands"].split(",")] if o["manual-bands"] else [low * (high / low) ** (i / max(n - 1, 1)) for i in range(n)]
    if len(gains) != len(freqs):
        raise ConversionError("config", "band-count", f"{len(gains)} gains for {len(freqs)} bands")
    return each(df, lambda s: filters.equalizer(s, list(zip(freqs, gains, strict=True)), p.rate))


def same(f: Callable[[DataFrame, Profile, dict[str, Any]], DataFrame]) -> Callable[..., tuple[DataFrame, Profile]]:
    return lambda df, p, o: (f(df, p, o), p)


def retimed(df: DataFrame, p: Profile, o: dict[str, Any]) -> tuple[DataFrame, Profile]:
    if o["factor"] <= 0:
        raise ConversionError("config", "positive", "factor")
    if o["mode"] == "relabel":
        return df, replace(p, rate=round(p.rate * o["factor"]))
    return (df if o["factor"] == 1 else each(df, lambda s: filters.retime(s, o["factor"], p.rate))), p


def resampled(df: DataFrame, p: Profile, o: dict[str, Any]) -> tuple[DataFrame, Profile]:
    to = o["sample-rate"]
    if to <= 0:
        raise ConversionError("config", "positive", "sample-rate")
    return (df, p) if to == p.rate else (each(df, lambda s: filters.resample(s, p.rate, to)), replace(p, rate=to))


def converted(df: DataFrame, p: Profile, o: dict[str, Any]) -> tuple[DataFrame, Profile]:
    bits = o["bits-per-sample"] or p.bits
    return (df, p) if bits == p.bits else (df.withColumn("v", levels.dequantize(levels.quantize(F.col("v"), bits), bits)), replace(p, bits=bits))


def fitted(source: tuple[DataFrame, Profile], want: Profile) -> DataFrame:
    """A stream brought to the rate and the channels of another."""
    df, p = resampled(*source, {"sample-rate": want.rate})
    if p.channels != want.channels:
        name = next((n for n, at in LAYOUTS.items() if len(at) == want.channels), None)
        if name is None:
            raise ConversionError("resolver", "no-bridge", f"no layout of {want.channels} channels")
        df, p = remixed(df, p, {"layout": name, "normalize": True})
    return df


def convolved(df: DataFrame, p: Profile, o: dict[str, Any], ports: Ports) -> tuple[DataFrame, Profile]:
    """The impulse response is preloaded: its rate is made the stream's, a mono one serves
    all channels, and it must not exceed MOST_TAPS samples, as each task holds it."""
    if "ir" not in ports:
        raise ConversionError("resolver", "unconnected-port", "convolver.ir")
    mix, size = o["wet-dry-mix"], 1 << max(1, (o["block-size"] or BLOCK) - 1).bit_length()
    ir, own = resampled(*ports["ir"], {"sample-rate": p.rate})
    if own.channels not in (1, p.channels):
        raise ConversionError("resolver", "ir-channels", f"an impulse response of {own.channels} channels for {p.channels}")
    if (length := ir.agg(F.max("idx")).first()[0]) is None or length >= MOST_TAPS:
        raise ConversionError("resolver", "ir-length", f"an impulse response must have 1 to {MOST_TAPS} samples")
    taps = np.zeros((own.channels, length + 1))
    for ch, idx, v in ir.select("ch", "idx", "v").toLocalIterator():
        taps[ch, idx] = v
    if o["normalize"]:
        taps /= np.maximum(np.abs(taps).sum(1, keepdims=True), 1.0)

    stage = lambda sid: state.Convolver(taps[sid["ch"] if own.channels > 1 else 0], size, mix)
    return each(df, lambda s: state.carried(s, stage)), p


def mixed(df: DataFrame, p: Profile, o: dict[str, Any], ports: Ports) -> tuple[DataFrame, Profile]:
    """Ports by place, each with weight 1 / ports; one that has ended is silent."""
    others = [fitted(ports[k], p) for k in sorted(ports) if k != "in0"]
    n = len(others) + 1
    out = df.select("sid", "ch", "idx", "v")
    for x in others:
        out = out.unionByName(x.select("sid", "ch", "idx", "v"))
    return out.groupBy("sid", "ch", "idx").agg((F.sum("v") / n).alias("v")), p


def seconds(value: str) -> float:
    """"500ms", "1.5s", "2m" or a number of seconds."""
    for unit, factor in (("ms", 0.001), ("us", 1e-6), ("m", 60.0), ("s", 1.0), ("h", 3600.0)):
        if value.endswith(unit):
            return float(value[: -len(unit)]) * factor
    return float(value)


#: Filters by name: their settings with defaults, and how they compile.
FILTERS: dict[str, tuple[dict[str, Any], Callable[..., tuple[DataFrame, Profile]]]] = {
    "gain": ({"decibels": 0.0}, same(lambda df, p, o: filters.gain(df, o["decibels"]))),
    "convert": ({"bits-per-sample": 0}, converted),
    "resample": ({"sample-rate": 0}, resampled),
    "retime": ({"factor": 1.0, "mode": "interpolate"}, retimed),
    "remix": ({"layout": "stereo", "normalize": True}, remixed),
    "normalize": ({"target-peak-dbfs": -1.0, "allow-amplification": True}, same(lambda df, p, o: filters.normalize(df, o["target-peak-dbfs"], o["allow-amplification"]))),
    "fade": ({"fade-in": "0s", "fade-out": "0s"}, same(lambda df, p, o: each(df, lambda s: filters.fade(s, round(seconds(o["fade-in"]) * p.rate), round(seconds(o["fade-out"]) * p.rate))))),
    "remove-dc-offset": ({"pole": 0.995}, same(lambda df, p, o: each(df, lambda s: filters.remove_dc(s, o["pole"])))),
    "trim": ({"threshold-dbfs": -60.0, "mode": "both"}, same(trimmed)),
    "gate": ({"threshold-dbfs": -60.0, "mode": "hard", "range-db": 40.0, "attack-ms": 5.0, "release-ms": 50.0, "open-hz": 20000.0, "closed-hz": 200.0}, same(gated)),
    "compressor": ({"threshold-dbfs": -18.0, "ratio": 4.0, "attack-ms": 10.0, "release-ms": 100.0, "knee-db": 6.0, "makeup-gain-db": 0.0}, same(compressed)),
    "delay": ({"delay-ms": 300.0, "feedback": 0.3, "wet-level": 0.5, "dry-level": 1.0}, same(lambda df, p, o: each(df, lambda s: filters.delay(s, max(1, round(o["delay-ms"] / 1000 * p.rate)), o["feedback"], o["wet-level"], o["dry-level"])))),
    "reverb": ({"room-size": 0.5, "damping": 0.5, "wet-level": 0.3, "dry-level": 1.0}, same(lambda df, p, o: each(df, lambda s: filters.reverb(s, p.rate, o["room-size"], o["damping"], o["wet-level"], o["dry-level"], "ch")))),
    "equalizer": ({"mode": "single", "type": "peaking", "frequency-hz": 1000.0, "gain-db": 0.0, "q": 0.7071067811865476, "bands": 10, "low-hz": 20.0, "high-hz": 20000.0, "manual-bands": "", "gains": "0,0,0,0,0,0,0,0,0,0"}, same(equalized)),
}

#: Filters that take more streams than the one before them.
JOINERS = {"convolver": ({"wet-dry-mix": 1.0, "normalize": True, "block-size": 0}, convolved), "mixer": ({}, mixed)}


def settings(spec: str) -> tuple[str, dict[str, Any]]:
    """Name and values of a filter spec, typed as their defaults are. The mixer's number
    of ports is its parameter `in`."""
    try:
        parsed = text.parse_spec(spec)
    except ValueError as e:
        raise ConversionError("config", "bad-spec", str(e)) from e
    name = parsed["name"]
    if name not in FILTERS and name not in JOINERS:
        raise ConversionError("resolver", "unknown-filter", f"no filter {name!r}")
    defaults = (FILTERS | JOINERS)[name][0]
    given: dict[str, Any] = {}
    for k, v in parsed["options"].items():
        if k not in defaults:
            raise ConversionError("config", "unknown-field", f"{name} has no {k!r}")
        try:
            given[k] = {"true": True, "false": False}[v.lower()] if isinstance(defaults[k], bool) else type(defaults[k])(v)
        except (KeyError, ValueError) as e:
            raise ConversionError("config", "bad-value", f"{name}.{k}: {v!r}") from e
        if isinstance(given[k], float) and not np.isfinite(given[k]):
            raise ConversionError("config", "finite", f"{name}.{k}")
    return name, negotiate.resolve(defaults, {}, given)[0]


# ---- specs, plans and writing


@dataclass(frozen=True)
class Spec:
    """What to do, as plain values: read `input`, apply `filters` in order, write `output`.
    `inputs` are more files by name; `wires` connect them: FILTER.PORT=NAME."""

    input: str
    output: str
    filters: tuple[str, ...] = ()
    force: bool = False
    inputs: tuple[tuple[str, str], ...] = ()
    wires: tuple[str, ...] = ()
    codec: str = ""
    level: int = 12
    mpeg_tables: str = ""

    @property
    def extension(self) -> str:
        end = Path(self.output).suffix.lower()
        if end not in FORMATS:
            raise ConversionError("resolver", "unknown-muxer", f"no format for {end or 'a name without an extension'}")
        return end

    @property
    def target(self) -> str:
        return FORMATS[self.extension][0]


@dataclass
class Plan:
    """A resolved conversion; nothing has run yet but the reading of the header."""

    spec: Spec
    data: DataFrame
    source: Profile
    result: Profile
    tags: tags.Bundle
    steps: list[str]

    def explain(self) -> str:
        line = lambda p: f"{p.codec} {p.rate} Hz, {p.channels} ch, {p.bits} bits"
        return "\n".join([f"{self.spec.input}: {line(self.source)}", *[f"  {s}" for s in self.steps], f"{self.spec.output}: {line(self.result)}"])


def wiring(spec: Spec, names: list[str]) -> dict[str, dict[str, str]]:
    """The file at each port of a filter; each input and each port is used once."""
    files, out, used = dict(spec.inputs), {}, set()
    if len(files) < len(spec.inputs):
        raise ConversionError("config", "duplicate-input", "an input is given twice")
    for wire in spec.wires:
        to, eq, source = wire.partition("=")
        name, dot, port = to.partition(".")
        source = source.partition(".")[0]
        if not eq or not dot or name not in names or name not in JOINERS:
            raise ConversionError("config", "bad-wire", wire)
        if source not in files:
            raise ConversionError("config", "unknown-input", source)
        if source in used or port in out.get(name, {}):
            raise ConversionError("config", "used-twice", wire)
        used.add(source)
        out.setdefault(name, {})[port] = files[source]
    if idle := set(files) - used:
        raise ConversionError("config", "unconnected-input", ", ".join(sorted(idle)))
    return out


def stream_of(p: Profile, codec: str = "lpcm") -> negotiate.Stream:
    return negotiate.Stream(codec, p.rate, p.channels, next(f for f, n in (("s8", 8), ("s16", 16), ("s24", 24), ("s32", 32)) if p.bits <= n), p.bits)


def build(spark: SparkSession, spec: Spec, catalog: Any = None) -> Plan:
    """Resolves names and settings first, so that mistakes show before any file is read;
    then the catalog's decoder, encoder and muxer, with the cheapest conversions that the
    encoder asks for spliced in behind the filters."""
    from . import builtin, catalog as catalogs

    registry = (catalog or builtin.catalog()).registry
    end, chain = spec.extension, [settings(f) for f in spec.filters]
    for name, _ in chain:
        registry.filter(name)
    codec = spec.codec or FORMATS[end][1]
    try:
        registry.muxer(registry.encoder(codec).codecs[0], end)
    except Problems as e:
        raise ConversionError("resolver", e.items[0].code, str(e)) from e
    wired = wiring(spec, [n for n, _ in chain])
    df, source, bundle = read(spark, spec.input, spec.mpeg_tables)
    p, steps = source, []
    for name, values in chain:
        if name in JOINERS:
            ports = {port: read(spark, path, spec.mpeg_tables)[:2] for port, path in wired.get(name, {}).items()}
            df, p = JOINERS[name][1](df, p, values, ports)
        else:
            df, p = FILTERS[name][1](df, p, values)
        steps.append(f"{name}:{','.join(f'{k}={v}' for k, v in values.items())}")
    try:
        route = catalogs.negotiate_route(registry, stream_of(source, source.codec), stream_of(p), codec, end)
    except Problems as e:
        raise ConversionError("routing", e.items[0].code, str(e)) from e
    for name, to in route.conversions:
        if name == "convert":
            df, p = converted(df, p, {"bits-per-sample": to.bits})
        elif name == "resample":
            df, p = resampled(df, p, {"sample-rate": to.rate})
        else:
            df, p = remixed(df, p, {"layout": to.layout, "normalize": True})
        steps.append(f"{name} (for {route.encoder.name}): {to.signature}")
    return Plan(spec, df, source, replace(p, codec=codec), bundle, steps)


@contextmanager
def committed(path: str, force: bool) -> Iterator[Any]:
    """A file beside the output that takes its name once all has gone well."""
    if os.path.exists(path) and not force:
        raise ConversionError("output", "exists", f"{path} exists")
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "wb") as f:
            yield f
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)


#: Bytes of an ADPCM block for each channel.
ADPCM_BLOCK = 512
#: WAVE format tags by codec.
WAVE_TAGS = {"lpcm": 1, "float": 3, "alaw": 6, "ulaw": 7, "ms-adpcm": 2, "ima-adpcm": 0x11}


def coded(plan: Plan) -> tuple[DataFrame, int]:
    """Rows of block, n (samples) and frame (bytes), in order; and the bits of a sample in
    the container."""
    p, cols = plan.result, tuple(f"c{i}" for i in range(plan.result.channels))
    if p.codec == "flac":
        q = wide(plan.data.withColumn("v", levels.quantize(F.col("v"), p.bits)), p.channels)
        return flac.frames(q, size=BLOCK, bits=p.bits, channels=cols, in_order=True, how=flac_search.preset(plan.spec.level)), p.bits
    size, container = BLOCK, (p.bits + 7) // 8 * 8
    if p.codec == "float":
        w, container = wide(plan.data, p.channels), 32
    elif p.codec == "lpcm":  # left-justified, eight bits unsigned
        w = wide(plan.data.withColumn("v", F.shiftleft(levels.quantize(F.col("v"), p.bits), container - p.bits) + (128 if container == 8 else 0)), p.channels)
    else:
        w, container = wide(plan.data.withColumn("v", levels.quantize(F.col("v"), 16)), p.channels), 8
        if p.codec in wav.ADPCM:
            size = (ms_adpcm if p.codec == "ms-adpcm" else ima_adpcm).samples_per_block(ADPCM_BLOCK * p.channels, p.channels)
        else:
            law = companding.alaw_encode if p.codec == "alaw" else companding.ulaw_encode
            w = w.select("sid", "idx", *[law(F.col(c).cast("int")).alias(c) for c in cols])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, raw = [], []
            for row in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                x = np.array(row).T
                sizes.append(len(x))
                if p.codec == "float":
                    raw.append(x.astype("<f4").tobytes())
                elif p.codec in wav.ADPCM:
                    x = np.pad(x.astype(np.int64), ((0, size - len(x)), (0, 0)), mode="edge")[None]
                    raw.append((ms_adpcm if p.codec == "ms-adpcm" else ima_adpcm).encode_blocks(x).tobytes())
                elif container == 8:
                    raw.append(x.astype("u1").tobytes())
                else:
                    raw.append(np.ascontiguousarray(x.astype("<i4")).view("u1").reshape(-1, 4)[:, : container // 8].tobytes())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary())], names=["sid", "block", "n", "frame"])

    rows = w.groupBy("sid", F.floor(F.col("idx") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", *cols))).alias("s"))
    kind = "array<double>" if p.codec == "float" else "array<long>"
    rows = rows.select("sid", "block", *[F.col(f"s.{c}").cast(kind).alias(c) for c in cols]).orderBy("block")
    return rows.mapInArrow(pack, "sid long, block long, n long, frame binary"), container


def write(plan: Plan, seen: Callable[[int, int], None] = lambda n, size: None) -> None:
    """Codes blocks over the cluster and strings them together in order. Sizes, the
    digest and the number of samples go into the header at the end; beyond 4 GiB a WAV
    file becomes RF64, for which room is kept."""
    p = plan.result
    rows, container = coded(plan)
    is_flac, least = p.codec == "flac", BLOCK
    with committed(plan.spec.output, plan.spec.force) as f:
        info = lambda sizes, n, md5: flac.stream_info(BLOCK, sizes or [0], p.rate, p.channels, p.bits, n, md5, least)
        head = lambda sizes, n, md5: flac_meta.build(info(sizes, n, md5), plan.tags)
        listed = tags.build_info(plan.tags) if plan.tags else b""
        tail = b"LIST" + len(listed).to_bytes(4, "little") + listed if len(listed) > 4 else b""
        tag, align = WAVE_TAGS.get(p.codec, 1), ADPCM_BLOCK * p.channels if p.codec in wav.ADPCM else None
        wave = lambda n: wav.build(b"", channels=p.channels, rate=p.rate, bits=container, tag=tag, align=align, samples=None if p.codec == "lpcm" else n)
        junk = b"JUNK" + (28).to_bytes(4, "little") + bytes(28)
        blank = head([], 0, bytes(16)) if is_flac else wave(0)
        f.write(blank if is_flac else blank[:12] + junk + blank[12:])
        digest, n, size, extremes, before = hashlib.md5(usedforsecurity=False), 0, 0, [], BLOCK
        for row in rows.toLocalIterator(prefetchPartitions=True):
            raw = bytes(row.frame)
            f.write(raw)
            if is_flac:
                digest.update(bytes(row.pcm))
                extremes = [min([len(raw), *extremes]), max([len(raw), *extremes])]
                least, before = min(least, before), row.n  # the last block doesn't count
            n, size = n + row.n, size + len(raw)
            seen(n, size)
        if is_flac:
            f.seek(0)
            f.write(head(extremes, n, digest.digest()))
            return
        f.write(bytes(size % 2) + tail)
        f.seek(0)
        done = wave(n)
        whole = len(done) + len(junk) - 8 + size + size % 2 + len(tail)
        if whole < 0xFFFFFFFF:
            f.write(done[:4] + whole.to_bytes(4, "little") + done[8:12] + junk + done[12:-4] + size.to_bytes(4, "little"))
        else:
            wide_ = whole.to_bytes(8, "little") + size.to_bytes(8, "little") + n.to_bytes(8, "little") + bytes(4)
            f.write(b"RF64" + b"\xff" * 4 + done[8:12] + b"ds64" + (28).to_bytes(4, "little") + wide_ + done[12:-4] + b"\xff" * 4)


class Job:
    """A conversion in the background: running, completed, failed or canceled."""

    def __init__(self, spark: SparkSession, spec: Spec) -> None:
        self.spark, self.spec, self.group = spark, spec, f"convert-{uuid.uuid4().hex}"
        self.status, self.error, self.samples, self.bytes = "running", None, 0, 0
        self.started, self.finished, self.rate = time.time(), None, None
        self._cancel, self._lock = threading.Event(), threading.Lock()
        self._thread = InheritableThread(target=self._run, daemon=True)
        self._thread.start()

    def _seen(self, n: int, size: int) -> None:
        self.samples, self.bytes = n, size
        if self._cancel.is_set():
            raise InterruptedError

    def _run(self) -> None:
        status, error = "completed", None
        try:
            self.spark.sparkContext.setJobGroup(self.group, f"convert {self.spec.input}", interruptOnCancel=True)
            plan = build(self.spark, self.spec)
            self.rate = plan.result.rate
            self._seen(0, 0)
            write(plan, self._seen)
        except BaseException as e:  # noqa: BLE001 - reported by result()
            status, error = "failed", e
        with self._lock:
            self.status = "canceled" if error and self._cancel.is_set() else status
            self.error, self.finished = error, time.time()

    def cancel(self) -> None:
        with self._lock:
            if self.status != "running":
                return
            self._cancel.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    def snapshot(self) -> dict[str, Any]:
        elapsed = (self.finished or time.time()) - self.started
        rate = self.rate or 0
        return {"seconds": self.samples / rate if rate else 0.0, "speed": self.samples / rate / elapsed if rate and elapsed > 0 else -1.0, "status": self.status, "samples": self.samples, "bytes": self.bytes, "elapsed": elapsed, "error": str(self.error) if self.error else None}

    def result(self, timeout: float | None = None) -> None:
        """Waits; raises what went wrong."""
        self._thread.join(timeout)
        if self._thread.is_alive():
            raise TimeoutError
        if self.error:
            raise self.error


def convert(spark: SparkSession, input: str, output: str, *specs: str, force: bool = False) -> Plan:
    plan = build(spark, Spec(input, output, specs, force))
    write(plan)
    return plan
