import numpy as np
import pytest
from pyspark.sql import functions as F
from tonestream.operators import ms_adpcm
from tonestream.sources import flac

RNG = np.random.default_rng(7)
SHAPES = {
    "noise": RNG.integers(-32768, 32768, (2, 1000)),
    "tone": (20000 * np.sin(np.arange(4096) / 9)).astype(np.int64).reshape(1, -1),
    "stereo": np.stack([(9000 * np.sin(np.arange(4096) / 30)).astype(np.int64), (9000 * np.sin(np.arange(4096) / 30)).astype(np.int64) + RNG.integers(-3, 4, 4096)]),
    "silence": np.zeros((3, 64), np.int64),
    "one": np.array([[25588], [10416]]),
    "extremes": np.tile([-32768, 32767], 300).reshape(1, -1),
    "wasted": RNG.integers(-100, 100, (1, 333)) * 64,
    "spike": np.r_[np.zeros(500, np.int64), 32767, np.zeros(523, np.int64)].reshape(1, -1),
}


@pytest.mark.parametrize("name", SHAPES)
def test_flac_frames(name):
    x = SHAPES[name]
    for number in (0, 127, 128, 70000, 1 << 30):
        raw = flac.encode_frame(x, number, 16)
        back, size = flac.read_frame(raw, 16)
        assert size == len(raw) and (back == x).all()


def test_flac_takes_fewer_bits_where_it_can():
    assert len(flac.encode_frame(SHAPES["tone"], 0, 16)) < 4096
    assert len(flac.encode_frame(SHAPES["stereo"], 0, 16)) < 2 * 4096 * 2 * 0.3


def test_flac_24_bits():
    x = RNG.integers(-(1 << 23), 1 << 23, (2, 512))
    assert (flac.read_frame(flac.encode_frame(x, 3, 24), 24)[0] == x).all()


def test_flac_reads_a_published_file():
    """A file of one stereo sample whose sums and digest were made elsewhere."""
    raw = bytes.fromhex("664c6143800000221000100000000f00000f0ac442f0000000013e84b41807dc690307586a3dad1a2e0ffff869180000bf0358fd03128baa9a")
    assert [x.tolist() for x in flac.read_frames(raw)] == [[[25588], [10416]]]
    info = flac.parse(raw)
    assert (info.rate, info.channels, info.bits, info.samples) == (44100, 2, 16, 1)
    tagged = b"ID3\x04\0\0\0\0\0\x05hello" + raw
    assert flac.parse(tagged).first == info.first + 15
    for end in range(len(raw)):
        with pytest.raises(ValueError, match=r"\w"):
            list(flac.read_frames(raw[:end]))
    for at in range(42, len(raw)):
        bad = bytearray(raw)
        bad[at] ^= 4
        with pytest.raises(ValueError, match=r"\w"):
            list(flac.read_frames(bytes(bad)))


def test_flac_files(spark):
    rows = [(s, i, int(9000 * np.sin(i / (s + 3))), int(RNG.integers(-500, 500))) for s in (1, 2) for i in range(700 * s)]
    df = spark.createDataFrame(rows, "sid long, idx long, l long, r long")
    out = flac.files(flac.frames(df, size=256, channels=("l", "r")), size=256, channels=2)
    got = flac.decode(out).groupBy("sid", "idx").agg(F.max(F.when(F.col("ch") == 0, F.col("q"))).alias("l"), F.max(F.when(F.col("ch") == 1, F.col("q"))).alias("r"))
    assert sorted(map(tuple, got.collect())) == rows
    assert flac.decode(flac.files(flac.frames(df.limit(0), channels=("l", "r")), channels=2)).count() == 0


def by_hand(block: bytes) -> list[int]:
    """A block of one channel restored a code at a time."""
    signed = lambda at: int.from_bytes(block[at : at + 2], "little", signed=True)
    a, b = ms_adpcm.COEFFICIENTS[block[0]].tolist()
    step, one, two = signed(1), signed(3), signed(5)
    out = [two, one]
    for code in (c for byte in block[7:] for c in (byte >> 4, byte & 15)):
        s = int((one * a + two * b) / 256) + (code - 16 if code > 7 else code) * step
        one, two = max(-32768, min(32767, s)), one
        step = max(16, int(step * ms_adpcm.ADAPT[code] / 256))
        out.append(one)
    return out


@pytest.mark.parametrize("channels", [1, 2])
def test_ms_adpcm_blocks(channels):
    n = ms_adpcm.samples_per_block(256 * channels, channels)
    t = np.arange(40 * n)
    x = np.stack([(12000 * np.sin(t / (17 + c))).astype(np.int64) for c in range(channels)], axis=1).reshape(40, n, channels)
    blocks = ms_adpcm.encode_blocks(x)
    assert blocks.shape == (40, 256 * channels)
    back = ms_adpcm.decode_blocks(blocks, channels)
    error = back - x
    assert 10 * np.log10((x**2).sum() / (error**2).sum()) > 35
    if channels == 1:
        assert [by_hand(b.tobytes()) for b in blocks] == back[..., 0].tolist()


def test_ms_adpcm_takes_the_first_of_the_best_predictors():
    flat = ms_adpcm.encode_blocks(np.zeros((1, ms_adpcm.samples_per_block(64, 1), 1), np.int64))
    assert flat[0, 0] == 0
    x = RNG.integers(-9000, 9000, (1, ms_adpcm.samples_per_block(64, 1), 1))
    best = ms_adpcm.encode_blocks(x)
    error = np.abs(ms_adpcm.decode_blocks(best, 1) - x).sum()
    for k in range(7):
        kept, ms_adpcm.COEFFICIENTS = ms_adpcm.COEFFICIENTS, np.repeat(ms_adpcm.COEFFICIENTS[k : k + 1], 7, axis=0)
        try:
            assert np.abs(ms_adpcm.decode_blocks(ms_adpcm.encode_blocks(x), 1) - x).sum() >= error
        finally:
            ms_adpcm.COEFFICIENTS = kept


def test_ms_adpcm_refuses_damage():
    with pytest.raises(ValueError, match="predictor"):
        ms_adpcm.decode_blocks(np.full((1, 16), 9, np.uint8), 1)
    for align, channels in ((6, 1), (13, 2), (64, 3)):
        with pytest.raises(ValueError, match="channels"):
            ms_adpcm.samples_per_block(align, channels)


def test_ms_adpcm_streams(spark):
    df = spark.createDataFrame([(1, i, int(5000 * np.sin(i / 20))) for i in range(120)], "sid long, idx long, q long")
    blocks = ms_adpcm.encode(df, 64)
    assert blocks.count() == 2
    got = {r.idx: r.q for r in ms_adpcm.decode(blocks).collect()}
    assert len(got) == 2 * ms_adpcm.samples_per_block(64, 1)
    assert max(abs(got[r.idx] - r.q) for r in df.collect()) < 600
