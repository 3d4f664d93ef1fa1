"""The engine's own plugins as a catalog: what conversion resolves names against."""

from __future__ import annotations

from functools import lru_cache

from ..sources import mpeg
from . import catalog as c
from . import config, convert
from .negotiate import Capability, Range

ANY = Capability()
#: What the encoders take: 4 to 24 bits go into FLAC frames, WAV holds up to 32.
FLAC_IN = Capability(("lpcm",), Range(low=1, high=655_350), Range(low=1, high=8), ("s8", "s16", "s24"))
WAV_IN = Capability(("lpcm",), Range(low=1), Range(low=1, high=65_535), ("s8", "s16", "s24", "s32"))
ADPCM_IN = Capability(("lpcm",), Range(low=1), Range((1, 2)), ("s16",))
G711_IN = Capability(("lpcm",), Range(low=1), Range(low=1), ("s16",))
#: Bits of a sample that FLAC takes in each format.
FLAC_BITS = {"s8": (4, 8), "s16": (4, 16), "s24": (17, 24), "s32": (17, 32)}


def wav_probe(head: bytes) -> int:
    """100 for a whole header, 90 for one that is cut off, 25 for another first chunk."""
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        return 0
    if len(head) < 36:
        return 90
    return 100 if head[12:16] == (b"ds64" if head[:4] == b"RF64" else b"fmt ") else 25


def flac_probe(head: bytes) -> int:
    """100 for the marker, 90 for the beginning of one, 40 behind an ID3v2 tag."""
    if head[:4] == b"fLaC":
        return 100
    if 0 < len(head) < 4 and b"fLaC".startswith(head):
        return 90
    return 10 if head[:3] == b"ID3" else 0


def mp3_probe(head: bytes) -> int:
    """80 for two frames that follow each other, 60 for a header, 40 for a tag."""
    frames = []
    for found in mpeg.scan(head):
        frames.append(found)
        if len(frames) > 1:
            return 80
    if frames or mpeg.header(head):
        return 60
    return 40 if head[:3] == b"ID3" else 0


def nothing(*_: object) -> None:
    """Made by convert itself."""


def filters() -> tuple[c.Component, ...]:
    made = [c.Component("filter", n, f, config.schema_of(d)) for n, (d, f) in convert.FILTERS.items()]
    ports = {
        "mixer": lambda p: (tuple(c.Port(f"in{i}", matches_main=i > 0) for i in range(p["in"])), tuple(c.Port(f"out{i}") for i in range(p["out"]))),
        "convolver": lambda p: ((c.Port("main"), c.Port("ir", matches_main=True)), (c.Port("out"),)),
    }
    sizes = config.Schema((config.Field("in", config.INT.range(1, 256), 2), config.Field("out", config.INT.range(1, 256), 1)))
    return (*made, *(c.Component("filter", n, f, config.schema_of(d), parameters=sizes if n == "mixer" else None, ports=ports[n]) for n, (d, f) in convert.JOINERS.items()))


@lru_cache(1)
def plugins() -> tuple[c.Plugin, ...]:
    @c.plugin("wave", c.Component("prober", "wav", nothing, probe=wav_probe), c.Component("demuxer", "wav", convert.read), c.Component("muxer", "wav", convert.write, codecs=tuple(convert.WAVE_TAGS), extensions=(".wav", ".wave")))
    class Wave: ...

    @c.plugin("flac", c.Component("prober", "flac", nothing, probe=flac_probe), c.Component("demuxer", "flac", convert.read), c.Component("decoder", "flac", convert.read, codecs=("flac",)), c.Component("encoder", "flac", convert.coded, capability=FLAC_IN, codecs=("flac",)), c.Component("muxer", "flac", convert.write, codecs=("flac",), extensions=(".flac",)))
    class Flac: ...

    @c.plugin("mpeg", c.Component("prober", "mp3", nothing, probe=mp3_probe), c.Component("demuxer", "mp3", mpeg.packets), c.Component("decoder", "mp3", convert.read, codecs=("mp3",)))
    class Mpeg: ...

    pcm = [c.Component("decoder", n, convert.read, codecs=(n,)) for n in convert.WAVE_TAGS]
    takes = {"lpcm": WAV_IN, "float": WAV_IN, "alaw": G711_IN, "ulaw": G711_IN, "ms-adpcm": ADPCM_IN, "ima-adpcm": ADPCM_IN}
    pcm += [c.Component("encoder", n, convert.coded, capability=t, codecs=(n,)) for n, t in takes.items()]

    @c.plugin("pcm", *pcm)
    class Pcm: ...

    @c.plugin("audio", *filters())
    class Audio: ...

    return Wave, Flac, Mpeg, Pcm, Audio


@lru_cache(1)
def catalog() -> c.Catalog:
    return c.Catalog.build(plugins())
