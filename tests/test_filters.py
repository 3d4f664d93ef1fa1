"""Hand vectors: known inputs and outputs of the filters."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tonestream.operators import codecs, filters, ima_adpcm, state


def stream(spark, values, frame=100):
    return spark.createDataFrame([(1, i, float(v), i // frame) for i, v in enumerate(values)], "sid long, idx long, v double, frame_no long")


def got(df):
    return [round(r.v, 9) for r in df.orderBy("idx").collect()]


def test_resample_doubles_with_a_repeated_tail(spark):
    assert got(filters.resample(stream(spark, [0, 1]), 2, 4)) == [0, 0.5, 1, 1]


def test_retime_by_two(spark):
    assert got(filters.retime(stream(spark, [0, 2, 4, 6]), 2.0, 4)) == [0, 4]


def test_fade(spark):
    assert got(filters.fade(stream(spark, [1, 1, 1, 1]), 2, 2)) == [0, 0.5, 1, 0.5]


@pytest.mark.parametrize(("side", "idx"), [("both", [1]), ("start", [1, 2, 3]), ("end", [0, 1])])
def test_trim(spark, side, idx):
    assert [r.idx for r in filters.trim(stream(spark, [0, 0.1, 0, 0]), -20.0, side).orderBy("idx").collect()] == idx


def test_trim_of_silence_is_empty(spark):
    assert got(filters.trim(stream(spark, [0, 0, 0]), -20.0)) == []


def test_delay(spark):
    assert got(filters.delay(stream(spark, [1, 0, 0, 0, 0]), 2, 0.0, 1.0, 0.0)) == [0, 0, 1, 0, 0]
    assert got(filters.delay(stream(spark, [1, 0, 0, 0, 0, 0]), 2, 0.5, 1.0, 0.0)) == [0, 0, 1, 0, 0.5, 0]


def test_mixer_pads_with_silence(spark):
    ports = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), *[("b", k, 1.0) for k in range(4)]], "port string, k long, v double")
    assert [r.v for r in filters.mixer(ports, {"a": 1.0, "b": 1.0}).orderBy("k").collect()] == [2, 2, 1, 1]


def test_normalize_leaves_silence_alone(spark):
    assert got(filters.normalize(stream(spark, [0, 0]))) == [0, 0]


def test_convolutions_agree(spark):
    rng = np.random.default_rng(7)
    x, h = rng.uniform(-1, 1, 50), [0.5, -0.25, 0.125]
    want = np.convolve(x, h)
    assert np.allclose(got(filters.convolve(stream(spark, x), h)), want, atol=1e-8)
    assert np.allclose(got(filters.convolve_fft(stream(spark, x), h, hop=8)), want, atol=1e-8)


def test_recurrences_match_a_loop(spark):
    x = np.sin(np.arange(30) / 3)
    c = filters.biquad_coefficients("peaking", 1000, 8000, 0.7, 6)
    y, x1, x2, y1, y2 = [], 0, 0, 0, 0
    for v in x:
        o = c["b0"] * v + c["b1"] * x1 + c["b2"] * x2 - c["a1"] * y1 - c["a2"] * y2
        x1, x2, y1, y2 = v, x1, o, y1
        y.append(o)
    assert np.allclose(got(filters.biquad(stream(spark, x), c)), y, atol=1e-8)


def test_adpcm_decodes_what_it_encoded(spark):
    df = spark.createDataFrame([(1, i, int(8000 * np.sin(i / 9))) for i in range(200)], "sid long, idx long, v long")
    coded = ima_adpcm.encode(df)
    back = ima_adpcm.decode(coded.select("sid", "idx", "code")).join(coded.select("idx", F.col("decoded").alias("want")), "idx").join(df, "idx")
    rows = back.orderBy("idx").collect()
    assert all(r.decoded == r.want for r in rows) and 0 <= min(r.code for r in coded.collect()) and max(r.code for r in coded.collect()) <= 15
    assert max(abs(r.decoded - r.v) for r in rows[40:]) < 1500


def test_levinson_recovers_a_first_order_process():
    assert np.allclose(codecs.levinson([1.0, 0.9, 0.81], 2), [0.9, 0.0])


def test_reverb_levels():
    """Dry alone is the input; an impulse comes back from the shortest comb, twice
    through an even number of inverting all-passes, at the fixed gain times wet."""
    x = np.r_[1.0, np.zeros(3000)]
    assert (state.Reverb(44100, 0.5, 0.5, 0.0, 1.0).push(x) == x).all()
    y = state.Reverb(44100, 0.5, 0.5, 0.3, 0.0).push(x)
    assert not y[:1116].any() and np.isclose(y[1116], 0.015 * 0.3)
    spread = state.Reverb(44100, 0.5, 0.5, 0.3, 0.0, channel=1).push(x)
    assert not spread[: 1116 + 23].any() and spread[1116 + 23]


def one_by_one(make, x):
    """A stage fed with single samples gives what it gives for all at once."""
    whole, single = make(), make()
    a = np.concatenate([whole.push(x), whole.flush()])
    b = np.concatenate([*[single.push(x[k : k + 1]) for k in range(len(x))], single.flush()])
    assert a.shape == b.shape and np.allclose(a, b, atol=1e-10)
    return a


def test_stages_carry_their_state():
    x = np.random.default_rng(3).uniform(-1, 1, 700)
    c = filters.biquad_coefficients("lowshelf", 500, 8000, 0.9, 5)
    one_by_one(lambda: state.Linear((c["b0"], c["b1"], c["b2"]), (c["a1"], c["a2"])), x)
    one_by_one(lambda: state.Delay(13, 0.4, 0.5, 0.9), x)
    one_by_one(lambda: state.Envelope(0.9, 0.99), x)
    one_by_one(lambda: state.Reverb(2000, 0.6, 0.4, 0.5, 0.5), x)
    h = np.random.default_rng(4).uniform(-1, 1, 90)
    y = one_by_one(lambda: state.Convolver(h, 16, 0.75), x)
    want = np.convolve(x, h) * 0.75
    want[: len(x)] += x * 0.25
    assert np.allclose(y, want)
    for n in (1, 2, 3, 50):
        y, s = state.Linear((1.0, -1.0), (-0.995,)).push(x[:n]), []
        for k in range(n):
            s.append(x[k] - (x[k - 1] if k else 0) + 0.995 * (s[-1] if s else 0))
        assert np.allclose(y, s)


def test_recursion_takes_linear_time():
    import time

    took = []
    for n in (1_000_000, 8_000_000):
        t = time.time()
        state.Linear((0.2, 0.3, 0.1), (-1.2, 0.5)).push(np.ones(n))
        took.append(time.time() - t)
    assert took[1] < 40 * took[0] + 1


def test_streams_end_where_another_begins(spark):
    rows = [(s, c, i, float(i + s + c)) for s in range(3) for c in range(2) for i in range(5 + s)]
    df = spark.createDataFrame(rows, "sid long, ch int, idx long, v double").selectExpr("struct(sid, ch) as sid", "idx", "v")
    out = state.carried(df, lambda sid: state.Convolver(np.array([0.0, 1.0 + sid["ch"]]), 4)).selectExpr("sid.sid", "sid.ch", "idx", "v").collect()
    want = {(s, c, i + 1): (1.0 + c) * v for s, c, i, v in rows}
    got = {(r.sid, r.ch, r.idx): r.v for r in out}
    assert len(out) == len(got) and all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and len(got) == len(want) + 6


def test_linked_lowpass_gate(spark):
    loud, quiet = [0.5] * 20, [0.0] * 20
    both = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(zip(loud, quiet))], "sid long, idx long, l double, r double")
    out = filters.gate_lowpass(both, -20.0, 40.0, 0.0, 0.0, 3500.0, 200.0, 8000, ("l", "r")).orderBy("idx").collect()
    assert out[-1].l > 0.45 and all(r.r == 0 for r in out)
