"""Planner, catalog, configuration, engines and observation, with SQL and by hand."""

import io
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tonestream.functions import pcm, timebase
from tonestream.plans import builtin, catalog, config, convert, engines, negotiate, observe, system
from tonestream.plans.diagnostics import Action, Item, MediaError, Problems, items_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(system.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = system.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = duck.execute(system.SQL[name])
    at = [[c[0] for c in r.description].index(c) for c in cols]
    want = sorted(str(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
    assert sorted(str(tuple(plain(x[c]) for c in cols)) for x in df.collect()) == want and want


# ---- configuration


def codes(f):
    with pytest.raises(Problems) as e:
        f()
    return [(".".join(i.path), i.code) for i in e.value.items]


def test_codecs():
    assert config.INT.parse(" 7 ") == 7 and config.FLOAT.units("dB").parse("-3.5 dB") == -3.5 and config.BOOL.parse("On") is True
    assert config.Duration().parse("1m30s") == 90 and config.Duration().parse("-250ms") == -0.25
    assert codes(lambda: config.Duration().parse("5 parsecs")) == [("", "bad-value")]
    assert [i.code for i in config.FLOAT.range(0, 1).steps(0.25).check(1.1)] == ["above-range", "off-step"]
    assert [i.code for i in config.FLOAT.check(float("nan"))] == ["not-finite"]
    assert config.List(config.INT).parse("1,2") == (1, 2) and codes(lambda: config.List(config.INT).parse("1,x,y")) == [("1", "bad-value"), ("2", "bad-value")]
    assert config.Table(config.FLOAT).parse("a=1,b=2") == {"a": 1.0, "b": 2.0}
    assert config.Choice(("low", "high"), (("hi", "high"),)).parse("HI") == "high"


def test_schemas():
    s = config.Schema((config.Field("a", config.INT, 1), config.Field("b", config.INT.range(high=9), lambda v: v["a"] * 2, needs=("a",)), config.Field("c", config.TEXT, active=lambda v: v["a"] > 1)), (("big", (("a", 4),)),))
    r = s.resolve({}, "big")
    assert r.values == {"a": 4, "b": 8} and r.origin == {"a": "preset", "b": "default"} and r.fingerprint == s.resolve({"a": 4, "b": 8}).fingerprint
    assert codes(lambda: s.resolve({"a": 5, "z": 1})) == [("z", "unknown-field"), ("b", "above-range")]
    assert codes(lambda: s.resolve({"a": 1, "c": "x"})) == [("c", "inactive")]
    assert codes(lambda: config.Schema((config.Field("a", config.INT, needs=("b",)), config.Field("b", config.INT, needs=("a",))))) == [("a", "cycle")]
    assert codes(lambda: config.Schema((config.Field("a", config.INT, "x"), config.Field("a", config.INT)))) == [("a", "duplicate-field"), ("a", "bad-type")]
    assert s.from_json('{"a": 2.0}').values["a"] == 2 and codes(lambda: s.from_json("[")) == [("", "bad-json")]


def test_dataclasses_bind_to_flags():
    from dataclasses import dataclass, field

    @dataclass
    class Options:
        rate: int
        gain_db: float = field(default=0.0, metadata={"check": (-60, 20), "help": "level"})
        loud: bool = False

    o = config.decode(Options, {"rate": "8000", "gain-db": "-3"})
    assert o == Options(8000, -3.0) and config.flags(o) == ["--rate=8000", "--gain-db=-3.0"]
    assert codes(lambda: config.decode(Options, {"gain-db": "30"})) == [("rate", "missing"), ("gain-db", "above-range")]


# ---- catalog


def test_sets_and_catalogs():
    one = lambda name, *parts: catalog.Plugin(catalog.Descriptor(name, name), tuple(catalog.Component("filter", p, print) for p in parts))
    s = catalog.PluginSet().add(one("x", "gain", "fade")).add(one("y", "trim"))
    assert codes(lambda: s.add(one("z", "gain")))[0][1] == "duplicate-component" and codes(lambda: s.add(one("x", "new")))[0][1] == "duplicate-plugin"
    assert [p.identity for p in s.remove_component("filter", "trim").plugins] == ["x"]
    assert codes(lambda: s.override(one("z", "a"))) == [("", "missing-plugin")] and codes(lambda: s.override(one("y", "gain")))[0][1] == "duplicate-component"
    assert [c.name for p in s.override(one("y", "new")).plugins for c in p.components] == ["gain", "fade", "new"]
    assert {i for _, i in codes(lambda: catalog.Catalog.build([one("x", "gain"), one("x", "a"), catalog.Plugin(catalog.Descriptor("q", "Bad Alias"), ())]))} == {"duplicate-plugin", "bad-alias"}
    c = catalog.Catalog.build(s.plugins)
    assert c.describe("filter", "gain")["plugin"] == "x" and codes(lambda: c.registry.lookup("filter", "none")) == [("", "unknown-filter")]

    @catalog.plugin("own", catalog.Component("filter", "own", print))
    class Own: ...

    assert Own.identity.endswith("test_sets_and_catalogs.<locals>.Own")


def test_registry_and_routes():
    r = builtin.catalog().registry
    assert r.demuxer(b"fLaC").name == "flac" and r.demuxer(b"RIFF\0\0\0\0WAVEfmt " + bytes(30)).name == "wav"
    assert codes(lambda: r.demuxer(b"nothing")) == [("", "unsupported-format")]
    assert codes(lambda: r.muxer("flac", ".wav")) == [("", "nothing-fits")]
    s = negotiate.Stream("lpcm", 8000, 2, "s32", 32)
    route = catalog.negotiate_route(r, s, s, "ima-adpcm", ".wav")
    assert route.result.fmt == "s16" and [n for n, _ in route.conversions] == ["convert"]
    assert codes(lambda: catalog.negotiate_route(r, negotiate.Stream("opus"), s, "flac", ".flac")) == [("", "nothing-fits")]
    assert negotiate.Range(low=8, high=10).preferred(12) == 10 and negotiate.Range((3, 5)).preferred(4) == 5


def test_diagnostics():
    e = Problems([Item("a", "first", ("x",)), Item("b", "second")])
    try:
        try:
            raise e
        except Problems as p:
            raise MediaError("decoder", Action.SKIP, "bad") from p
    except MediaError as m:
        assert [i.code for i in items_of(m)] == ["MediaError", "a", "b"] and m.action is Action.SKIP
    assert [i.code for i in items_of(ExceptionGroup("g", [e, ValueError("v")]))] == ["a", "b", "ValueError"]
    assert str(Item("a", "m", ("x",)).under("y")) == "y.x: m"


# ---- engines, observation, buffers


def test_damaged_packets_are_skipped_or_stop(spark):
    class Picky:
        def push(self, packet):
            if packet == b"bad":
                raise ValueError("damaged")
            return np.frombuffer(packet, "<i2").astype(float)[None]

        def flush(self):
            return np.zeros((1, 0))

    df = spark.createDataFrame([(1, 0, b"\1\0"), (1, 1, b"bad"), (1, 2, b"\2\0")], "sid long, seq long, data binary")
    assert [(r.idx, r.v) for r in engines.decoded(df, lambda _: Picky()).orderBy("idx").collect()] == [(0, 1.0), (1, 2.0)]
    with pytest.raises(Exception, match="damaged"):
        engines.decoded(df, lambda _: Picky(), Action.STOP).collect()


def test_gaps_are_errors(spark):
    df = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 5, 5), (1, 2, 11, 5)], "sid long, seq long, pts long, n long")
    assert engines.gaps(df).select("pts", "expected").collect() == [(11, 10)]
    with pytest.raises(Exception, match="expected time 10, got 11"):
        engines.continuous(df).collect()
    assert engines.continuous(df.filter("seq < 2")).count() == 2


def test_observation():
    assert observe.progress(30, 120, 10) == {"percent": 25.0, "speed": 3.0, "eta": 30.0} and observe.progress(1, None, 0) == {"percent": -1.0, "speed": -1.0, "eta": -1.0}
    assert [observe.format_bytes(n) for n in (0, 1023, 1536, 5 << 30)] == ["0 B", "1023 B", "1.5 KiB", "5.0 GiB"]
    assert [observe.format_duration(s) for s in (-1, 0.25, 5, 75, 3700)] == ["unknown", "250ms", "5.0s", "1m15s", "1h01m40s"]
    out = io.StringIO()
    p = observe.Progress("always", out)
    p.update(30, 120, 10, final=True)
    assert out.getvalue() == "\r 25.0% 30.0s at 3.0x, 30.0s left\n"
    observe.Progress("auto", out).update(1, 2, 3)
    assert out.getvalue().count("left") == 1
    n = observe.Node("x")
    with pytest.raises(KeyError), n.running():
        raise KeyError("k")
    assert n.snapshot()["state"] == "failed" and n.elapsed >= 0
    with observe.PeakMemory(0.01) as m:
        held = bytearray(1 << 20)
        time.sleep(0.03)
    assert m.peak > len(held)
    f = observe.Metered(io.BytesIO())
    f.write(b"abc")
    f.seek(1)
    assert f.read() == b"bc" and (f.read_bytes, f.written_bytes, f.position) == (2, 3, 3)


@pytest.mark.parametrize("fmt", ["u8", "s8", "s16", "s24", "s32", "s64", "f32", "f64"])
@pytest.mark.parametrize("planar", [False, True])
def test_buffers(fmt, planar):
    x = np.array([[0, 1, 100], [5, 127, 3]], float if fmt[0] == "f" else np.int64)
    raw = pcm.pack(x, fmt, planar)
    assert len(raw) == 6 * pcm.WIDTHS[fmt] and (pcm.unpack(raw, fmt, 2, planar) == x).all()
    if fmt[0] != "f" and fmt != "s64":
        with pytest.raises(ValueError, match="don't fit"):
            pcm.pack(np.array([[1 << 40]]), fmt)
    if fmt[0] == "s" and fmt not in ("s8", "s64"):
        v = pcm.to_float(pcm.from_float(np.array([[-1.0, 0.5, np.nan, 2.0]]), fmt, bits=12), fmt, bits=12)
        assert np.allclose(v, [[-1, 0.5, 0, 1]], atol=1e-3)
    with pytest.raises(ValueError, match="whole samples"):
        pcm.unpack(b"\0" * 7, "s16")
    assert (pcm.effective_bits(12, "s16"), pcm.effective_bits(20, "s16"), pcm.effective_bits(0, "f32")) == (12, 16, 24)


def test_samples_out_of_range(spark):
    df = spark.createDataFrame([(1,), (5000,)], "q long")
    with pytest.raises(Exception, match="needs more than 12 bits"):
        df.select(pcm.checked(F.col("q"), 12)).collect()


def test_rationals():
    r = timebase.Rational(2, -4)
    assert (r.num, r.den) == (-1, 2) and timebase.Rational(1, 3) < timebase.Rational(1, 2) and timebase.Rational(1, 48000).seconds(24000) == 0.5
    assert [timebase.Rational(1, 2).rescaled(n, timebase.Rational(1)) for n in (1, 2, 3, -1)] == [1, 1, 2, 0]
    with pytest.raises(ValueError, match="denominator"):
        timebase.Rational(1, 0)


def test_conversion_to_every_codec(spark, tmp_path):
    from tonestream.sources import wav

    t = np.arange(5000)
    data = np.stack([9000 * np.sin(t / 17), 4000 * np.cos(t / 29)], 1).round().astype("<i2")
    (tmp_path / "a.wav").write_bytes(wav.build(data.tobytes(), channels=2, rate=8000))
    tolerance = {"lpcm": 1e-4, "float": 1e-4, "alaw": 0.032, "ulaw": 0.032, "ms-adpcm": 0.15, "ima-adpcm": 0.15, "flac": 1e-4}
    for codec, most in tolerance.items():
        out = tmp_path / f"{codec}.{'flac' if codec == 'flac' else 'wav'}"
        convert.write(convert.build(spark, convert.Spec(str(tmp_path / "a.wav"), str(out), codec=codec, level=17)))
        back, p, _ = convert.read(spark, str(out))
        got = np.array([r.v for r in back.orderBy("ch", "idx").collect()]).reshape(2, -1)
        assert got.shape == (2, 5000) and p.rate == 8000, codec
        assert np.abs(got - data.T / 32768).max() < most, codec
    with pytest.raises(convert.ConversionError):
        convert.build(spark, convert.Spec(str(tmp_path / "a.wav"), str(tmp_path / "x.wav"), codec="flac"))
