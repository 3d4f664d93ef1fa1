"""The data source, FLAC's search and recovery, ADPCM blocks and WAV variants."""

import numpy as np
import pytest
from tonestream.functions import bits
from tonestream.operators import ima_adpcm, ms_adpcm
from tonestream.sources import datasource, flac, flac_search, mpeg, wav

RNG = np.random.default_rng(11)


def tone(n, channels=1, scale=9000):
    t = np.arange(n)
    return np.stack([np.round(scale * np.sin(t / (17 + 3 * c)) + RNG.normal(0, 30, n)) for c in range(channels)]).astype(np.int64)


def test_data_source_reads_and_writes(spark, tmp_path):
    datasource.register(spark)
    rows = [(s, i, float(np.sin(i / 9) / 2), float(s) / 10) for s in (1, 2, 3) for i in range(50 * s)]
    df = spark.createDataFrame(rows, "sid long, idx long, l double, r double")
    df.repartition("sid").sortWithinPartitions("sid", "idx").write.format("audio").mode("append").option("rate", 8000).save(str(tmp_path / "out"))
    got = spark.read.format("audio").option("view", "samples").load(str(tmp_path / "out"))
    found = {(int(r.path.rsplit("/", 1)[1][:-4]), r.ch, r.idx): r.v for r in got.collect()}
    assert len(found) == 2 * len(rows) and not list((tmp_path / "out").glob(".*"))
    assert all(abs(found[s, 0, i] - a) < 1e-4 and abs(found[s, 1, i] - b) < 1e-4 for s, i, a, b in rows)
    streams = spark.read.format("audio").option("view", "streams").load(str(tmp_path / "out")).orderBy("path").collect()
    assert [(r.codec, r.rate, r.channels, r.bits, r.samples) for r in streams] == [("lpcm", 8000, 2, 16, 50 * s) for s in (1, 2, 3)]
    packets = spark.read.format("audio").option("view", "packets").load(str(tmp_path / "out")).collect()
    assert sorted(len(r.data) for r in packets) == [200, 400, 600]
    with pytest.raises(Exception, match="no view"):
        spark.read.format("audio").option("view", "x").load(str(tmp_path / "out"))


@pytest.mark.parametrize("level", [0, 3, 7, 12, 16, 19, 21, 23])
def test_presets_are_lossless(level):
    how = flac_search.preset(level)
    n = 600 if level < 20 else 130
    x = tone(n, 2)
    x[1] = x[0] // 2 + RNG.integers(-4, 5, n)
    raw = b"".join(r for _, r in flac.encode_block(x, 0, 16, how)) if how.split else flac.encode_frame(x, 0, 16, how)
    at, parts = 0, []
    while at < len(raw):
        y, n = flac.read_frame(raw[at:], 16)
        parts.append(y)
        at += n
    assert (np.concatenate(parts, 1) == x).all()


def test_search_pays():
    x = np.concatenate([tone(512)[0], RNG.integers(-20000, 20000, 512)])[None]
    plain = len(flac.encode_frame(x, 0, 16, flac_search.preset(12)))
    halved = sum(len(r) for _, r in flac.encode_block(x, 0, 16, flac_search.preset(18)))
    assert halved < plain and len(flac.encode_frame(x, 0, 16, flac_search.preset(0))) >= plain
    assert len(flac_search.subdivided(3)) == 6 and all(len(w(100)) == 100 for w in flac_search.subdivided(3))
    with pytest.raises(ValueError, match="levels"):
        flac_search.preset(24)


def test_residuals_may_be_plain_numbers():
    r = np.r_[np.zeros(32, np.int64), RNG.integers(-(1 << 20), 1 << 20, 32)]
    coded = flac.rice(r, 64, 0)
    raw = flac.pack(np.concatenate([v for v, _ in coded.parts]), np.concatenate([w for _, w in coded.parts]))
    assert (flac.read_residual(flac.Reader(raw + bytes(8)), 64, 0) == r).all()


def whole_file(x, size=64):
    blocks = [x[:, k : k + size] for k in range(0, x.shape[1], size)]
    frames = [flac.encode_frame(b, i, 16) for i, b in enumerate(blocks)]
    return b"fLaC\x80\0\0\x22" + flac.stream_info(size, list(map(len, frames)), 8000, len(x), 16, x.shape[1], bytes(16)) + b"".join(frames), frames


def test_damage_is_skipped_or_an_error():
    x = tone(640)
    raw, frames = whole_file(x)
    first = len(raw) - sum(map(len, frames))
    assert [n for _, _, n in flac.frame_places(raw)] == [64] * 10
    at = first + sum(map(len, frames[:3])) + 20
    bad = raw[:at] + bytes([raw[at] ^ 255]) + raw[at + 1 :]
    got = np.concatenate(list(flac.read_frames(bad, strict=False)), 1)
    assert (got == np.concatenate([x[:, :192], x[:, 256:]], 1)).all()
    with pytest.raises(ValueError):
        list(flac.read_frames(bad))
    with pytest.raises(ValueError, match="damaged"):
        list(flac.frame_places(bad, strict=True))
    assert sum(y.shape[1] for y in flac.read_frames(raw[:-5], strict=False)) == 576
    bare = b"junk" + b"".join(frames)  # no marker, no STREAMINFO
    assert (np.concatenate(list(flac.read_frames(bare, strict=False)), 1) == x).all()
    with pytest.raises(ValueError, match="not a FLAC"):
        list(flac.read_frames(b"nothing at all" * 50, strict=False))


def test_strict_headers():
    raw, _ = whole_file(tone(64))
    assert flac.parse(raw, strict=True).rate == 8000
    with pytest.raises(ValueError, match="not a FLAC"):
        flac.parse(b"ID3\4\0\0\0\0\0\0" + raw, strict=True)
    with pytest.raises(ValueError, match="does not belong"):
        flac.parse(b"fLaC\x04\0\0\0" + raw[4:], strict=True)


@pytest.mark.parametrize("channels", [1, 2])
def test_ima_blocks(channels):
    size = ima_adpcm.samples_per_block(256 * channels, channels)
    x = np.stack([tone(size, channels).T for _ in range(5)])
    raw = ima_adpcm.encode_blocks(x)
    assert raw.shape == (5, 256 * channels)
    y = ima_adpcm.decode_blocks(raw, channels)
    assert y.shape == x.shape and np.abs(y - x).max() < 0.15 * 32768 and np.sqrt(((y - x) ** 2).mean()) < 0.004 * 32768 * 4
    # by hand: predictor 0, index 0, codes 4 (step 7: 7 >> 3 + 7 = 7) and 12 (step 9: -(1 + 9))
    assert ima_adpcm.decode_blocks(np.array([[0, 0, 0, 0, 0xC4, 0, 0, 0]], np.uint8), 1)[0, :3, 0].tolist() == [0, 7, -3]
    with pytest.raises(ValueError, match="index"):
        ima_adpcm.decode_blocks(np.array([[0, 0, 89, 0, 0, 0, 0, 0]], np.uint8), 1)


def test_ima_blocks_of_streams(spark):
    x = tone(700, 2)
    df = spark.createDataFrame([(1, i, int(x[0, i]), int(x[1, i])) for i in range(700)], "sid long, idx long, l long, r long")
    back = ima_adpcm.from_blocks(ima_adpcm.to_blocks(df, 512, ("l", "r")), ("l", "r")).filter("idx < 700").orderBy("idx").collect()
    got = np.array([(r.l, r.r) for r in back]).T
    assert got.shape == x.shape and np.abs(got - x)[:, 20:].max() < 2000


def test_adpcm_wav_headers():
    raw = wav.build(bytes(1024), channels=2, rate=8000, tag=2, align=512, samples=700, trailer={"cue ": b"\0" * 4, "id3": b"ID3"})
    h = wav.parse(raw)
    assert (h.codec, h.align, h.block, h.samples) == ("ms-adpcm", 512, ms_adpcm.samples_per_block(512, 2), 700)
    assert h.chunks["cue "] == b"\0" * 4 and h.chunks["id3 "] == b"ID3"
    assert [(p, len(b)) for p, b in wav.packets(raw)] == [(0, 512), (h.block, 512)]
    with pytest.raises(ValueError, match="hold"):
        wav.adpcm_parameters("ima-adpcm", 256, 1, (7).to_bytes(2, "little"))
    with pytest.raises(ValueError, match="coefficients"):
        wav.adpcm_parameters("ms-adpcm", 256, 1, wav.adpcm_extra("ms-adpcm", 256, 1)[:10])


def test_mpeg_inside_wav():
    frames = [mpeg.frame_bytes(64, body=bytes([k + 1] * 20)) for k in range(60)]
    raw = wav.build(b"".join(frames[:30]) + b"\0" * 77 + b"".join(frames[30:]), channels=2, rate=44100, tag=0x55, bits=16)
    got = list(wav.packets(raw))
    assert [b for _, b in got] == frames and [p for p, _ in got][:3] == [0, 1152, 2304]


def test_long_sums_equal_short_ones():
    raw = RNG.integers(0, 256, 5000, dtype=np.uint8).tobytes()
    for width, poly, table in ((8, 7, flac.CRC8), (16, 0x8005, flac.CRC16)):
        x = 0
        for b in raw:
            x = x << 8 & (1 << width) - 1 ^ table[x >> (width - 8) ^ b]
        assert flac.crc(raw, table, width) == x
        assert bits.crc_bytes(raw, width, np.array(table, np.int64), bits.crc_shifts(width, poly)) == x
