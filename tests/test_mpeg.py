"""MPEG frames: sizes, resynchronisation, free format, VBR headers, seeking, round trip."""

import random

import numpy as np
import pytest
from tonestream.sources import mpeg, mpeg_decode, tags

ONE = mpeg.frame_bytes(128)


def places(raw, **kw):
    return [(at, n) for at, n, _ in mpeg.scan(raw, **kw)]


def test_sizes_by_layer():
    assert len(ONE) == 417 and len(mpeg.frame_bytes(128, pad=True)) == 418
    assert len(mpeg.frame_bytes(384, 48000, layer=1)) == 384 and len(mpeg.frame_bytes(192, 48000, layer=2)) == 576
    low = mpeg.header(bytes.fromhex("fff35000"))  # MPEG-2, layer III, 40 kbit/s, 22050 Hz
    assert (low.rate, low.samples, low.kbps, low.size) == (22050, 576, 40, 130)
    for bad in ("00000000", "fffb9c00", "fffbf000", "fff99000"[:2] + "e99000", "ffe19000"):
        assert mpeg.header(bytes.fromhex(bad)) is None


def test_resynchronises_behind_noise_and_keeps_the_last_frame():
    raw = b"junk\xff\xfb\x90junk" + ONE * 3 + b"damage" + ONE * 2
    first, second = 11, 11 + 3 * 417 + 6
    assert places(raw) == [(first + k * 417, 417) for k in range(3)] + [(second + k * 417, 417) for k in range(2)]
    assert places(ONE) == [(0, 417)] and places(ONE[:-1]) == [] and places(b"") == []
    assert places(ONE + ONE[:200]) == [(0, 417)]  # the next header confirms a frame, even if that one is cut
    assert places(ONE + bytes(200)) == []


def test_free_format():
    body = bytes.fromhex("fffb0000").ljust(300, b"\1")
    assert places(body * 4) == [(k * 300, 300) for k in range(4)]


def test_xing_duration_and_seek():
    toc = [min(255, i * 256 // 100) for i in range(100)]
    raw = mpeg.build([mpeg.xing_frame(100, 41700, toc), *[ONE] * 100], {"title": "t"})
    i = mpeg.analyze(raw)
    assert (i.vbr.kind, i.vbr.frames, i.rate, i.channels) == ("xing", 100, 44100, 2)
    assert i.seconds == pytest.approx(100 * 1152 / 44100)
    assert i.start == len(tags.build_v2({"title": "t"}))
    assert mpeg.seek(i, 0) == i.start and mpeg.seek(i, i.seconds * 2) == i.start + 41700
    assert mpeg.seek(i, i.seconds / 2) == pytest.approx(i.start + 20850, abs=200)


def test_vbri_and_bitrate_seek():
    number = lambda v, n: v.to_bytes(n, "big")
    v = b"VBRI" + number(1, 2) + number(0, 2) + number(75, 2) + number(4000, 4) + number(10, 4) + number(2, 2) + number(1, 2) + number(2, 2) + number(5, 2) + number(1500, 2) + number(2500, 2)
    i = mpeg.analyze(mpeg.frame_bytes(128, body=bytes(32) + v) + ONE * 10)
    assert (i.vbr.kind, i.vbr.toc, i.vbr.quality) == ("vbri", [1500, 4000], 75)
    assert mpeg.seek(i, i.seconds * 0.25) == 750 and mpeg.seek(i, i.seconds * 9) == 4000
    plain = mpeg.analyze(ONE * 10)
    assert plain.vbr is None and plain.seconds == pytest.approx(4170 * 8 / 128000) and mpeg.seek(plain, 0.1) == 1600
    with pytest.raises(ValueError):
        mpeg.analyze(b"nothing")


def test_noise_never_raises():
    rng = random.Random(1)
    for _ in range(200):
        raw = bytearray(ONE * 4)
        for _ in range(40):
            raw[rng.randrange(len(raw))] = rng.choice((0, 255, 251, 0x90))
        end = 0
        for at, n, _ in mpeg.scan(bytes(raw[: rng.randrange(len(raw))])):
            assert at >= end
            end = at + n


def test_packets_round_trip(spark):
    frames = [mpeg.frame_bytes(k, pad=bool(i % 2), body=bytes([i] * 20)) for i, k in enumerate((128, 64, 320, 96, 128))]
    raw = mpeg.build(frames, {"title": "t", "artist": ["a"]}, 4)
    files = spark.createDataFrame([(1, raw), (2, None), (3, b"\xff\xfb"), (4, raw[:-200])], "sid long, content binary")
    got = sorted(mpeg.packets(files).collect(), key=lambda r: (r.sid, r.seq))
    assert [bytes(r.data) for r in got if r.sid == 1] == frames and [r.pts for r in got if r.sid == 1] == [1152 * k for k in range(5)]
    assert {r.sid for r in got} == {1, 4}
    info = {r.sid: r for r in mpeg.infos(files).collect()}
    assert info[1].rate == 44100 and info[2].rate is None and info[3].seconds is None


# ---- decoding


def window():
    """A smooth prototype in the synthesis window's order, for tests."""
    n = np.arange(512)
    return np.sin(np.pi * (n + 0.5) / 512) ** 2 * np.cos(np.pi * (n + 16) / 64) / 8


def bits_of(values):
    return "".join(format(v, f"0{n}b") for v, n in values)


def as_frame(kbps, body, **more):
    raw = bytes(int(body[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(body), 8))
    return mpeg.frame_bytes(kbps, body=raw, **more)


def test_layer_one_decodes_its_levels():
    tables = mpeg_decode.Tables(window())
    body = bits_of([(3, 4) if b < 2 else (0, 4) for b in range(32)]) + bits_of([(3, 6), (0, 6)])  # bands 0 and 1: 4 bits, scales 1 and 2
    codes = [(t % 15, 14 - t % 15) for t in range(12)]
    body += "".join(bits_of([(a, 4), (b, 4)]) for a, b in codes)
    frame = as_frame(384, body, mono=True, layer=1)
    h = mpeg.header(frame)
    got = mpeg_decode.layer1(mpeg_decode.Reader(frame[4:]), h, 32, 1)
    assert np.allclose(got[0, :, 0], [(2 * a - 14) / 15 for a, _ in codes]) and np.allclose(got[0, :, 1], [2 * (2 * b - 14) / 15 for _, b in codes])
    d = mpeg_decode.Decoder(tables)
    x = np.concatenate([d.push(frame)[0] for _ in range(3)])
    want, past = plain_synthesis(np.concatenate([got[0]] * 3), window())
    assert x.shape == (3 * 384,) and np.allclose(x, want)


def plain_synthesis(bands, d):
    """The flow chart of the standard, value by value."""
    v, out = np.zeros(1024), []
    for s in bands:
        v = np.r_[[sum(np.cos((16 + i) * (2 * k + 1) * np.pi / 64) * s[k] for k in range(32)) for i in range(64)], v[:-64]]
        u = np.concatenate([np.r_[v[128 * i : 128 * i + 32], v[128 * i + 96 : 128 * i + 128]] for i in range(8)])
        w = u * d
        out += [sum(w[j + 32 * i] for i in range(16)) for j in range(32)]
    return np.array(out), v


def test_layer_two_groups_codes():
    own = {"kbps": [64], "rates": [44100], "bands": [[0, 3, 5, 9, 15, 31, 63, 127]] * 3}
    tables = mpeg_decode.Tables(window(), allocations=[own])
    body = bits_of([(1, 3), (3, 3), (4, 3)]) + bits_of([(2, 2)] * 3) + bits_of([(3, 6)] * 3)
    for _ in range(12):
        body += bits_of([(0 + 3 * 1 + 9 * 2, 5), (8 + 9 * 4 + 81 * 0, 10), (14, 4), (7, 4), (0, 4)])
    frame = as_frame(64, body, mono=True, layer=2)
    got = mpeg_decode.layer2(mpeg_decode.Reader(frame[4:]), mpeg.header(frame), 32, 1, tables)
    assert np.allclose(got[0, :3, 0], [-2 / 3, 0, 2 / 3]) and np.allclose(got[0, :3, 1], [8 / 9, 0, -8 / 9]) and np.allclose(got[0, :3, 2], [14 / 15, 0, -14 / 15])
    assert mpeg_decode.Decoder(tables).push(frame).shape == (1, 1152)


def test_transforms_reconstruct():
    """Windowed blocks of any legal order, transformed and overlapped, give the samples."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=18 * 8)
    blocks = [0, 0, 1, 2, 2, 3, 0]
    got, held = np.zeros(18 * 8), np.zeros(18)
    for k, block in enumerate(blocks):
        piece = x[18 * k : 18 * k + 36]
        if block != 2:
            lines = mpeg_decode.transform(36).T @ (piece * mpeg_decode.shape(block)) / 9
        else:
            lines = np.zeros(18)
            for w in range(3):
                lines[w::3] = mpeg_decode.transform(12).T @ (piece[6 + 6 * w : 18 + 6 * w] * mpeg_decode.shape(2)) / 3
        y = mpeg_decode.imdct(lines, block)
        got[18 * k : 18 * k + 18], held = y[:18] + held, y[18:]
    assert np.allclose(got[18 : 18 * 7], x[18 : 18 * 7])


def layer_three(values, kbps=64, begin=0, data=None):
    """A mono frame whose first lines are the pairs given, by a codebook of fixed length."""
    coded = "".join(format(abs(a), "04b") + format(abs(b), "04b") + "".join(str(int(v < 0)) for v in (a, b) if v) for a, b in values)
    granule = lambda n, big: bits_of([(n, 12), (big, 9), (210, 8), (0, 4), (0, 1), (1, 5), (1, 5), (1, 5), (7, 4), (7, 3), (0, 1), (0, 1), (0, 1)])
    side = bits_of([(begin, 9), (0, 5)]) + "0" * 4 + granule(len(coded), len(values)) + granule(0, 0)
    raw = side.ljust(17 * 8, "0")
    return as_frame(kbps, raw + (coded if data is None else data), mono=True), coded


def test_layer_three_by_hand():
    edges = [0, *range(4, 88, 4), 576]
    book = mpeg_decode.Codebook({format(a, "04b") + format(b, "04b"): (a, b) for a in range(15) for b in range(15)})
    tables = mpeg_decode.Tables(window(), {1: book}, {}, {44100: edges}, {44100: [0, *range(4, 52, 4), 192]})
    values = [(3, -2), (0, 1), (-7, 8)]
    frame, coded = layer_three(values)
    d = mpeg_decode.Decoder(tables)
    x = d.push(frame)
    assert x.shape == (1, 1152) and np.abs(x).max() > 0
    lines = np.zeros(576)
    lines[:6] = [np.sign(v) * abs(v) ** (4 / 3) for p in values for v in p]
    g = mpeg_decode.Granule(0, 0, 210, 0)
    assert np.allclose(mpeg_decode.requantized(np.array([v for p in values for v in p] + [0] * 570), g, np.zeros(22, np.int64), edges, tables.short[44100]), lines)
    slots, held = mpeg_decode.hybrid(mpeg_decode.antialiased(lines, g), g, np.zeros((32, 18)))
    more, _ = mpeg_decode.hybrid(np.zeros(576), g, held)
    assert np.allclose(x[0], mpeg_decode.synthesize(np.concatenate([slots, more]), window(), np.zeros((15, 64)))[0])
    # the same main data, at the end of the frame before
    first = mpeg.frame_bytes(64, mono=True, body=bytes(17) + bytes(200))
    stored = int(coded.ljust(-(-len(coded) // 8) * 8, "0"), 2).to_bytes(-(-len(coded) // 8), "big")
    first = first[: -len(stored)] + stored
    second, _ = layer_three(values, begin=len(stored), data="")
    d = mpeg_decode.Decoder(tables)
    assert not d.push(first).any() and np.allclose(d.push(second), x)
    with pytest.raises(ValueError, match="missing"):
        mpeg_decode.Decoder(tables).push(second)
    raw = second + frame + frame  # the first refers to data that there is not
    assert [y.shape for y in mpeg_decode.decode(raw, tables)] == [(1, 1152)] * 2


def test_layer_three_stereo_and_order():
    l, r, place = np.ones(576), np.full(576, 0.5), np.arange(576) // 30
    a, b = mpeg_decode.stereo(l, r, 2, np.full(22, 7), place, 576)
    assert np.allclose(a, 1.5 / np.sqrt(2)) and np.allclose(b, 0.5 / np.sqrt(2))
    a, b = mpeg_decode.stereo(l, np.zeros(576), 1, np.full(22, 3), place, 100)
    assert np.allclose(a[100:], 0.5) and np.allclose(b[100:], 0.5) and (a[:100] == 1).all()
    short = [0, *range(4, 52, 4), 192]
    g = mpeg_decode.Granule(0, 0, 0, 0, block=2)
    x = mpeg_decode.reordered(np.arange(576.0), g, short)
    assert x[:6].tolist() == [0, 4, 8, 1, 5, 9] and sorted(x) == list(range(576))
    y = mpeg_decode.antialiased(np.ones(576), mpeg_decode.Granule(0, 0, 0, 0))
    assert np.isclose((y**2).sum(), 576) and np.allclose(y[9], 1)
