"""Tags: round trips in every version, hand-made frames, damage."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tonestream.sources import tags

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 40, 30) + b"\x08\x02\0\0\0"
FULL = {"title": "Über", "artist": ["A", "B"], "album": "Alb", "date": "2001-02-03", "track": 3, "track_total": 9, "disc": 1, "genre": "Rock", "composer": "C", "copyright": "R", "encoder": "E", "comment": "note", "lyrics": "la\nla", "website": ["http://x.org"], "picture": [{"mime": "image/png", "type": 3, "description": "d", "data": PNG}]}


@pytest.mark.parametrize("version", [2, 3, 4])
def test_round_trip(version):
    got = tags.parse_v2(tags.build_v2(FULL, version))
    assert {k: v for k, v in got.items() if k != "raw"} == FULL
    assert list(got["raw"]) == (["PIC"] if version == 2 else ["APIC"])


@pytest.mark.parametrize("version", [2, 3, 4])
def test_text_beyond_latin(version):
    b = {"title": "日本", "comment": "😀 x", "artist": ["я", "z"]}
    assert tags.parse_v2(tags.build_v2(b, version)) == b


word = st.text(st.characters(min_codepoint=33, max_codepoint=0x2FFF, exclude_categories=["Cs", "Cc", "Zs", "Zl", "Zp"]), min_size=1, max_size=20)


@settings(max_examples=60, deadline=None)
@given(word, word, st.integers(1, 999), st.sampled_from([2, 3, 4]))
def test_any_text(title, album, track, version):
    b = {"title": title, "album": album, "track": track}
    assert tags.parse_v2(tags.build_v2(b, version)) == b


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 400))
def test_damage_never_raises(noise, at):
    raw = tags.build_v2(FULL, 3)
    for x in (raw[:at], raw[:at] + noise + raw[at + len(noise) :], b"ID3\x03\0\0\0\0\x02\0" + noise):
        tags.parse(x)


def test_v1():
    b = {"title": "T", "artist": ["A"], "album": "L", "date": "1999", "comment": "c", "track": 7, "genre": "Jazz"}
    raw = b"audio" + tags.build_v1(b)
    assert len(raw) == 5 + 128 and tags.parse_v1(raw) == b and tags.bounds(raw) == (0, 5)
    assert tags.parse_v1(tags.build_v1({"comment": "x" * 40})) == {"comment": "x" * 30}
    assert tags.build_v1({}) == b"" and tags.parse_v1(b"TAG") == {}


def test_v2_goes_over_v1_and_bounds_skip_every_tag():
    raw = tags.build_v2({"title": "long"}, 4) + tags.build_v2({"artist": ["B"]}, 3) + b"payload" + tags.build_v1({"title": "short", "artist": ["A"], "album": "L"})
    assert tags.parse(raw) == {"title": "long", "artist": ["A", "B"], "album": "L"}
    start, stop = tags.bounds(raw)
    assert raw[start:stop] == b"payload"


def test_unsynchronised_compressed_and_dated_frames():
    frame = lambda n, body, flags=b"\0\0": n + len(body).to_bytes(4, "big") + flags + body
    body = frame(b"TIT2", b"\0a") + frame(b"TALB", b"\0z", b"\0\x80") + frame(b"TYER", b"\x002004") + frame(b"TDAT", b"\x003112") + frame(b"TIME", b"\x002359") + frame(b"PRIV", b"\xff\0\0q") + bytes(20)
    raw = b"ID3\x03\0\x80" + tags.to_syncsafe(len(body)) + body
    got = tags.parse_v2(raw)
    assert (got["title"], got.get("album"), got["date"]) == ("a", None, "2004-12-31T23:59")


def test_pictures_and_info():
    p = tags.parse_picture(tags.build_picture(FULL["picture"][0]))
    assert (p["mime"], p["width"], p["height"], p["type"], p["data"]) == ("image/png", 40, 30, 3, PNG)
    assert tags.image_size(b"GIF89a" + struct.pack("<HH", 5, 6)) == ("image/gif", 5, 6)
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 9, 8) + b"\x03"
    assert tags.image_size(jpeg) == ("image/jpeg", 8, 9)
    for bad in (b"", b"\xff\xd8\xff", b"text"):
        with pytest.raises(ValueError):
            tags.image_size(bad)
    with pytest.raises(ValueError):
        tags.parse_picture(tags.build_picture(FULL["picture"][0])[:-1])
    b = {k: FULL[k] for k in ("title", "album", "date", "genre", "comment")} | {"artist": ["A"]}
    assert tags.parse_info(tags.build_info(b)) == b


def test_read_tags(spark):
    rows = [(1, tags.build_v2(FULL, 4) + b"data"), (2, None), (3, b"")]
    got = {r.sid: r for r in tags.read_tags(spark.createDataFrame(rows, "sid long, content binary")).collect()}
    assert (got[1].title, got[1].artist, got[1].track_total, got[1].pictures, got[1].stop - got[1].start) == ("Über", ["A", "B"], 9, 1, 4)
    assert got[2].title is None and got[3].artist == [] and got[2].stop == 0
