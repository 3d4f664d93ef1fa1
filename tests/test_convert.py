"""File conversion end to end, specs, jobs and the command line."""

import hashlib

import numpy as np
import pytest
from tonestream import __main__ as cli
from tonestream.plans import convert
from tonestream.sources import flac, flac_meta, tags, wav

N = 9000


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    t = np.arange(N)
    left, right = np.round(9000 * np.sin(t / 17)), np.round(4000 * np.cos(t / 29))
    data = np.stack([left, right], 1).astype("<i2")
    path = tmp_path_factory.mktemp("in") / "a.wav"
    path.write_bytes(wav.build(data.tobytes(), channels=2, rate=8000, info={"INAM": "Song", "IART": "Someone"}))
    return path, data.astype(np.int64)


def pcm(path):
    raw = path.read_bytes()
    if raw[:4] == b"fLaC":
        return np.concatenate(list(flac.read_frames(raw)), 1).T
    h = wav.parse(raw)
    return np.frombuffer(raw, "<i2", h.data_size // 2, h.data_at).reshape(-1, h.channels).astype(np.int64)


def scaled(x, factor=1.0):
    v = x / 32768 * factor
    return np.where(v < 0, np.trunc(v * 32768), np.trunc(v * 32767)).astype(np.int64)


def test_wav_to_flac_and_back(spark, source, tmp_path):
    path, data = source
    convert.convert(spark, str(path), str(tmp_path / "b.flac"))
    raw = (tmp_path / "b.flac").read_bytes()
    assert (pcm(tmp_path / "b.flac") == scaled(data)).all()
    info = flac.parse(raw)
    assert (info.samples, info.channels, info.rate) == (N, 2, 8000) and info.md5 == hashlib.md5(scaled(data).astype("<i2").tobytes()).digest()
    assert flac_meta.parse(raw) == {"title": "Song", "artist": ["Someone"]}
    convert.convert(spark, str(tmp_path / "b.flac"), str(tmp_path / "c.wav"), "gain:decibels=-6")
    assert (pcm(tmp_path / "c.wav") == scaled(scaled(data), 10 ** (-6 / 20))).all()
    assert tags.parse_info(wav.parse((tmp_path / "c.wav").read_bytes()).chunks["LIST"])["title"] == "Song"


def test_linked_filters_and_layouts(spark, source, tmp_path):
    path, data = source
    convert.convert(spark, str(path), str(tmp_path / "n.wav"), "normalize:target-peak-dbfs=0")
    assert np.allclose(pcm(tmp_path / "n.wav"), data * (32767 / abs(data).max()), atol=3)
    convert.convert(spark, str(path), str(tmp_path / "m.wav"), "remix:layout=mono,normalize=false", "trim:threshold-dbfs=-15")
    v = data.sum(1) / 32768  # front channels go to mono at full level
    on = np.flatnonzero(abs(v) >= 10 ** (-15 / 20))
    assert np.allclose(pcm(tmp_path / "m.wav")[:, 0], (v * 32767)[on[0] : on[-1] + 1], atol=2)
    plan = convert.convert(spark, str(path), str(tmp_path / "r.wav"), "resample:sample-rate=4000", "fade:fade-in=100ms")
    assert len(pcm(tmp_path / "r.wav")) == N // 2 and plan.result.rate == 4000 and "resample" in plan.explain()
    out = pcm(tmp_path / "r.wav")
    assert (out[0] == 0).all() and np.allclose(out[400:], data[800::2], atol=2)


def test_other_filters_run(spark, source, tmp_path):
    path, _ = source
    out = tmp_path / "o.flac"
    convert.convert(spark, str(path), str(out), "gate:threshold-dbfs=-30", "compressor", "delay:delay-ms=20", "retime:factor=2,mode=relabel", "convert:bits-per-sample=12")
    assert flac.parse(out.read_bytes()).bits == 12 and pcm(out).shape == (N, 2) and flac.parse(out.read_bytes()).rate == 16000


def test_streams_that_join(spark, source, tmp_path):
    path, data = source
    ir = np.zeros(50)
    ir[[0, 20, 49]] = 0.5, 0.25, -0.125
    (tmp_path / "ir.wav").write_bytes(wav.build(np.round(ir * 32768).astype("<i2").tobytes(), rate=8000))
    spec = convert.Spec(str(path), str(tmp_path / "c.wav"), ("convolver",), inputs=(("room", str(tmp_path / "ir.wav")),), wires=("convolver.ir=room",))
    convert.write(convert.build(spark, spec))
    want = np.stack([np.convolve(data[:, i], ir) for i in (0, 1)], 1)
    assert np.allclose(pcm(tmp_path / "c.wav"), want, atol=2) and len(want) == N + 49
    short = data[:100, :1].astype("<i2")
    (tmp_path / "s.wav").write_bytes(wav.build(short.tobytes(), rate=8000))
    spec = convert.Spec(str(tmp_path / "s.wav"), str(tmp_path / "m.wav"), ("mixer[in=2]", "reverb:wet-level=0"), inputs=(("b", str(path)),), wires=("mixer.in1=b",))
    plan = convert.build(spark, spec)
    convert.write(plan)
    got = pcm(tmp_path / "m.wav")
    assert got.shape == (N, 1)  # the shorter port is silent behind its end
    peak = np.abs(data.sum(1) / 32768).reshape(-1)
    mono = data.sum(1) / np.concatenate([np.full(4096, max(1, peak[i : i + 4096].max())) for i in range(0, N, 4096)])[:N]
    mono[:100] += short[:, 0]
    assert np.allclose(got[:, 0], mono / 2, atol=2)
    for inputs, wires, code in (((), (), "unconnected-port"), ((("a", "x"),), (), "unconnected-input"), ((("a", "x"),), ("convolver.ir=b",), "unknown-input"), ((("a", "x"),), ("gain.ir=a",), "bad-wire")):
        with pytest.raises(convert.ConversionError) as e:
            convert.build(spark, convert.Spec(str(path), "y.wav", ("convolver",), inputs=inputs, wires=wires))
        assert e.value.code == code


def test_problems(spark, source, tmp_path):
    path, _ = source
    out = tmp_path / "x.wav"
    for spec, code in (("nope", "unknown-filter"), ("gain:x=1", "unknown-field"), ("gain:decibels=a", "bad-value"), ("gain:decibels=inf", "finite"), ("remix:layout=9.9", "unknown-layout"), ("resample", "positive")):
        with pytest.raises(convert.ConversionError) as e:
            convert.convert(spark, str(path), str(out), spec)
        assert e.value.code == code
    with pytest.raises(convert.ConversionError, match="no format"):
        convert.convert(spark, str(path), str(tmp_path / "x.ogg"))
    bad = tmp_path / "bad.wav"
    bad.write_bytes(b"RIFF....")
    with pytest.raises(convert.ConversionError):
        convert.convert(spark, str(bad), str(out))
    assert [p.name for p in tmp_path.iterdir()] == ["bad.wav"]  # nothing half-written
    out.write_bytes(b"old")
    with pytest.raises(convert.ConversionError, match="exists"):
        convert.convert(spark, str(path), str(out))
    assert out.read_bytes() == b"old"


def test_jobs(spark, source, tmp_path):
    path, _ = source
    job = convert.Job(spark, convert.Spec(str(path), str(tmp_path / "j.flac")))
    job.result(120)
    assert job.snapshot()["status"] == "completed" and job.samples == N
    failed = convert.Job(spark, convert.Spec(str(path), str(tmp_path / "k.flac"), ("nope",)))
    with pytest.raises(convert.ConversionError):
        failed.result(60)
    assert failed.status == "failed"
    gone = convert.Job(spark, convert.Spec(str(path), str(tmp_path / "l.flac"), ("delay:delay-ms=1",) * 3))
    gone.cancel()
    with pytest.raises(BaseException):  # noqa: B017
        gone.result(120)
    assert gone.status == "canceled" and not (tmp_path / "l.flac").exists()


def test_command_line(spark, source, tmp_path, capsys):
    path, _ = source
    assert cli.main(["list"]) == 0 and "normalize" in capsys.readouterr().out
    assert cli.main(["describe", "trim"]) == 0 and "threshold-dbfs" in capsys.readouterr().out
    assert cli.main(["describe", "none"]) == 1
    assert cli.main(["convert", str(path), str(tmp_path / "z.flac"), "-e", "gain:decibels=-3", "--dry-run"]) == 0
    assert not (tmp_path / "z.flac").exists()
    assert cli.main(["convert", str(path), str(tmp_path / "z.flac"), "-e", "gain:decibels=-3"]) == 0
    assert len(pcm(tmp_path / "z.flac")) == N
    assert cli.main(["convert", str(path), str(tmp_path / "z.flac")]) == 1


def test_flac_metadata_blocks():
    b = {"title": "T", "artist": ["A", "B"], "track": 2, "track_total": 5, "raw": {"MOOD": [b"calm"]}}
    assert flac_meta.parse_comments(flac_meta.build_comments(b)) == b
    points = [(0, 0, 4096), (8192, 900, 4096)]
    raw = flac_meta.build_seek_table(points, 2)
    assert flac_meta.parse_seek_table(raw) == points
    assert [flac_meta.seek(points, t, 9000, 1000) for t in (0, 8191, 8192, 9999)] == [0, 0, 900, 900]
    assert flac_meta.seek([], 4500, 9000, 1000) == 500
    kinds = [k for k, _ in flac_meta.blocks(flac_meta.build(bytes(34), b | {"picture": [{"mime": "image/png", "type": 3, "description": "", "data": b"x"}]}, points))]
    assert kinds == [0, 3, 4, 6]
    with pytest.raises(ValueError):
        list(flac_meta.blocks(b"fLaC\x00\0\0\x22"))
