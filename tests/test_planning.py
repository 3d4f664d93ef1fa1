import pytest
from pyspark.sql import functions as F
from tonestream.functions import bits, text
from tonestream.plans import negotiate as n
from tonestream.sources import headers, wav


def test_bridge_prefers_no_conversion_and_least_loss():
    want = n.Capability(("lpcm",), n.Range((44100,)), n.Range((2,)), ("s16", "f32"))
    assert n.bridge(n.Stream(), [want]) == []
    assert n.bridge(n.Stream(fmt="s24", bits=24), [want]) == ["convert"]
    assert n.bridge(n.Stream(codec="mp3"), [want]) is None


def test_capability_reports_the_first_reason():
    c = n.Capability(("lpcm",), n.Range(low=8000, high=48000), n.Range(high=2))
    assert c.reason(n.Stream(rate=96000, channels=6)) == "rate"
    assert c.reason(n.Stream(channels=6)) == "channels"
    assert c.reason(n.Stream()) == ""


def test_graph():
    g = n.Graph().add("a", lambda x: x + 1).add("b", lambda x: x * 2)
    assert g.run(3) == 8
    with pytest.raises(ValueError, match="cycle"):
        n.topological(["a", "b"], [("a", "b"), ("b", "a")])
    with pytest.raises(ValueError, match="twice"):
        n.Graph().add("a", abs).add("b", abs, "a").add("c", abs, "a").run(1)


def test_plugin_sets():
    s = n.PluginSet().add("x", "gain", "fade").add("y", "trim")
    with pytest.raises(ValueError, match="duplicate"):
        s.add("z", "gain")
    assert dict(s.remove("trim").plugins) == {"x": ("gain", "fade")}
    with pytest.raises(KeyError):
        s.remove("nothing")


def test_configuration():
    values, origin, mark = n.resolve({"a": 1, "b": 2, "c": 3}, {"b": 5}, {"c": 7})
    assert values == {"a": 1, "b": 5, "c": 7} and origin == {"a": "default", "b": "preset", "c": "explicit"}
    assert mark == n.resolve({"c": 7, "a": 1, "b": 5}, {}, {})[2]
    with pytest.raises(ValueError, match="unknown"):
        n.resolve({"a": 1}, {}, {"z": 1})


def test_specs():
    assert text.parse_spec(r"mix[in=2]:gain=-3,name=a\,b") == {"name": "mix", "parameters": {"in": "2"}, "options": {"gain": "-3", "name": "a,b"}}
    assert text.parse_spec("gain")["parameters"] is None and text.parse_spec("gain[]")["parameters"] == {}
    with pytest.raises(ValueError, match="twice"):
        text.parse_spec("a:b=1,b=2")


def test_partial_dates(spark):
    cases = {"2024-05-06T07:08:09Z": "2024-05-06T07:08:09", "2024-05": "2024-05", "1999": "1999", "12/31/2001": "", "nonsense": ""}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.i for r in df.select("s", text.iso_date(text.partial_date(F.col("s"))).alias("i")).collect()} == cases


def test_crc_forms_agree(spark):
    df = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(b""),)], "b binary")
    rows = df.select(bits.crc8(F.col("b")).alias("a"), bits.crc16(F.col("b")).alias("c"), bits.crc_of(8, 7)(F.col("b")).alias("d"), bits.crc_of(16, 0x8005)(F.col("b")).alias("e")).collect()
    assert tuple(rows[0]) == (0xF4, 0xFEE8, 0xF4, 0xFEE8) and tuple(rows[1]) == (0, 0, 0, 0)


@pytest.mark.parametrize(("channels", "bits_", "rf64"), [(1, 16, False), (2, 16, True), (6, 24, False), (1, 8, False)])
def test_wav_headers(channels, bits_, rf64):
    data = bytes(range(18)) + b"\0" * (channels * bits_ // 8 * 3)
    data = data[: len(data) // (channels * bits_ // 8) * (channels * bits_ // 8)]
    raw = wav.build(data, channels=channels, rate=48000, bits=bits_, rf64=rf64, info={"INAM": "t"})
    h = wav.parse(raw)
    assert (h.codec, h.channels, h.rate, h.bits, raw[h.data_at : h.data_at + h.data_size]) == ("lpcm", channels, 48000, bits_, data)
    assert h.chunks["LIST"].startswith(b"INFOINAM")
    for n_ in (0, 11, 20, 40):
        with pytest.raises(ValueError, match=r"\w"):
            wav.parse(raw[:n_])


def test_packets_from_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.build(bytes(70000), channels=2))
    rows = wav.read_packets(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.pts, len(r.data)) for r in rows] == [(0, 0, 32768), (1, 8192, 32768), (2, 16384, 4464)]


def test_probe(spark):
    df = spark.createDataFrame([(bytearray(b"fLaC1234"),), (bytearray(b"RIFF0000WAVEfmt " + bytes(20)),), (bytearray(b"\xff\xfb\x90\x00"),), (bytearray(b"x"),)], "b binary")
    assert [r.f for r in df.select(headers.best_format(F.col("b")).alias("f")).collect()] == ["flac", "wav", "mp3", None]
