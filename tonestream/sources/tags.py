"""Tags of audio files: ID3v1, ID3v2.2 to 2.4, RIFF INFO, pictures; as plain dicts.

A bundle maps field names to text or numbers, `artist` and `website` to lists,
`picture` to a list of dicts and `raw` to a dict of lists of bytes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

Bundle = dict[str, Any]
LISTS = ("artist", "website", "picture")

#: The genres of ID3v1 by number.
GENRES = [
    "Blues", "Classic Rock", "Country", "Dance", "Disco", "Funk", "Grunge", "Hip-Hop",
    "Jazz", "Metal", "New Age", "Oldies", "Other", "Pop", "R&B", "Rap",
    "Reggae", "Rock", "Techno", "Industrial", "Alternative", "Ska", "Death Metal", "Pranks",
    "Soundtrack", "Euro-Techno", "Ambient", "Trip-Hop", "Vocal", "Jazz+Funk", "Fusion", "Trance",
    "Classical", "Instrumental", "Acid", "House", "Game", "Sound Clip", "Gospel", "Noise",
    "AlternRock", "Bass", "Soul", "Punk", "Space", "Meditative", "Instrumental Pop", "Instrumental Rock",
    "Ethnic", "Gothic", "Darkwave", "Techno-Industrial", "Electronic", "Pop-Folk", "Eurodance", "Dream",
    "Southern Rock", "Comedy", "Cult", "Gangsta", "Top 40", "Christian Rap", "Pop/Funk", "Jungle",
    "Native American", "Cabaret", "New Wave", "Psychadelic", "Rave", "Showtunes", "Trailer", "Lo-Fi",
    "Tribal", "Acid Punk", "Acid Jazz", "Polka", "Retro", "Musical", "Rock & Roll", "Hard Rock",
    "Folk", "Folk/Rock", "National Folk", "Swing", "Fast Fusion", "Bebob", "Latin", "Revival",
    "Celtic", "Bluegrass", "Avantgarde", "Gothic Rock", "Progressive Rock", "Psychedelic Rock", "Symphonic Rock", "Slow Rock",
    "Big Band", "Chorus", "Easy Listening", "Acoustic", "Humour", "Speech", "Chanson", "Opera",
    "Chamber Music", "Sonata", "Symphony", "Booty Bass", "Primus", "Porn Groove", "Satire", "Slow Jam",
    "Club", "Tango", "Samba", "Folklore", "Ballad", "Power Ballad", "Rhythmic Soul", "Freestyle",
    "Duet", "Punk Rock", "Drum Solo", "A capella", "Euro-House", "Dance Hall",
]
#: Frames of ID3v2.3 with their names in 2.2, by the field they hold.
TEXT = {"title": "TIT2 TT2", "composer": "TCOM TCM", "album": "TALB TAL", "genre": "TCON TCO", "copyright": "TCOP TCR", "encoder": "TENC TEN"}
ARTIST = "TPE1 TP1 TPE2 TP2 TPE3 TP3 TPE4 TP4".split()
PAIRS = {"track": "TRCK TRK", "disc": "TPOS TPA"}
DATES = {"year": "TYER TYE", "full": "TDRC", "day": "TDAT TDA", "time": "TIME TIM"}
LINKS = "WOAF WAF WOAR WAR WOAS WAS".split()
LONG = {"comment": "COMM COM", "lyrics": "USLT ULT"}
SHORT = {"TIT2": "TT2", "TPE1": "TP1", "TALB": "TAL", "TYER": "TYE", "TDAT": "TDA", "TRCK": "TRK", "TPOS": "TPA", "TCON": "TCO", "TCOM": "TCM", "TCOP": "TCR", "TENC": "TEN", "COMM": "COM", "USLT": "ULT", "WXXX": "WXX", "APIC": "PIC"}
#: Chunks of RIFF INFO.
INFO = {"INAM": "title", "IART": "artist", "ICRD": "date", "ICMT": "comment", "IGNR": "genre", "IPRD": "album", "ISFT": "encoder", "ICOP": "copyright"}
FRAME_FIELD = {frame: (kind, field) for kind, group in (("text", TEXT), ("pair", PAIRS), ("date", DATES), ("long", LONG)) for field, frames in group.items() for frame in frames.split()}


def put(b: Bundle, key: str, value: Any, *, over: bool = True) -> None:
    """A non-zero single value; an older one stays unless `over`."""
    if value and (over or not b.get(key)):
        b[key] = value


def push(b: Bundle, key: str, value: Any) -> None:
    b.setdefault(key, []).append(value)


def merge(b: Bundle, other: Bundle) -> Bundle:
    """Raw tags are appended, lists joined as ordered sets, singles overwritten if not zero."""
    out = {k: (list(v) if k in LISTS else {r: list(x) for r, x in v.items()} if k == "raw" else v) for k, v in b.items()}
    for k, v in other.items():
        if k == "raw":
            for name, values in v.items():
                out.setdefault("raw", {}).setdefault(name, []).extend(values)
        elif k in LISTS:
            have = out.setdefault(k, [])
            have += [x for i, x in enumerate(v) if x not in have and x not in v[:i]]
        else:
            put(out, k, v)
    return out


def latin(raw: bytes) -> str:
    return raw.rstrip(b"\0").decode("latin-1").strip("\0 \t\r\n")


def parse_v1(raw: bytes) -> Bundle:
    """The 128 bytes at the end, if they are a tag; a zero before the last byte of the
    comment makes that byte the track number."""
    b: Bundle = {}
    if len(raw) < 128 or raw[-128:-125] != b"TAG":
        return b
    title, artist, album, year, comment, genre = struct.unpack("30s30s30s4s30sB", raw[-125:])
    put(b, "title", latin(title))
    if latin(artist):
        push(b, "artist", latin(artist))
    put(b, "album", latin(album))
    put(b, "date", latin(year) if re.fullmatch(r"\d{4}", latin(year)) else "")
    if comment[28] == 0 and comment[29]:
        b["track"], comment = comment[29], comment[:28]
    put(b, "comment", latin(comment))
    put(b, "genre", GENRES[genre] if genre < len(GENRES) else "")
    return b


def build_v1(b: Bundle) -> bytes:
    """128 bytes; characters beyond Latin-1 become question marks, long values are cut.
    Empty if the tag would hold nothing."""
    cell = lambda text, n: str(text).encode("latin-1", "replace")[:n].ljust(n, b"\0")
    get = lambda k: b.get(k) or ""
    track = b.get("track") or 0
    artist, year = (get("artist") or [""])[0], get("date")[:4]
    folded = [g.casefold() for g in GENRES]
    genre = folded.index(get("genre").casefold()) if get("genre").casefold() in folded else 255
    if not any((get("title"), artist, get("album"), year, get("comment"), track, genre != 255)):
        return b""
    note = cell(get("comment"), 28) + bytes((0, track)) if 0 < track < 256 else cell(get("comment"), 30)
    return b"TAG" + cell(get("title"), 30) + cell(artist, 30) + cell(get("album"), 30) + cell(year, 4) + note + bytes((genre,))


def from_syncsafe(raw: bytes) -> int:
    return sum((x & 127) << 7 * (3 - i) for i, x in enumerate(raw))


def to_syncsafe(n: int) -> bytes:
    return bytes(n >> 7 * k & 127 for k in (3, 2, 1, 0))


def head(raw: bytes, at: int = 0) -> tuple[int, int, int, int] | None:
    """Version, flags, end of the frames and end of an ID3v2 tag; None if there is none."""
    h = raw[at : at + 10]
    if len(h) < 10 or h[:3] != b"ID3" or h[3] not in (2, 3, 4) or h[4] == 255 or h[5] & 15 or max(h[6:]) > 127:
        return None
    stop = at + 10 + from_syncsafe(h[6:])
    return h[3], h[5], stop, stop + (10 if h[3] == 4 and h[5] & 16 else 0)


def bounds(raw: bytes) -> tuple[int, int]:
    """Where the payload lies: behind all leading ID3v2 tags, before a trailing ID3v1 tag."""
    at = 0
    while at < len(raw) and (h := head(raw, at)):
        at = h[3]
    if at >= len(raw):
        return len(raw), len(raw)
    tagged = len(raw) >= 128 and raw[-128:-125] == b"TAG"
    return at, max(at, len(raw) - 128 * tagged)


def unit(encoding: int) -> int:
    return 2 if encoding in (1, 2) else 1


def cut(raw: bytes, encoding: int) -> tuple[bytes, bytes | None]:
    """What stands before the terminator, and behind it; None without a terminator."""
    n = unit(encoding)
    for i in range(0, len(raw) - n + 1, n):
        if not any(raw[i : i + n]):
            return raw[:i], raw[i + n :]
    return raw, None


def decoded(encoding: int, raw: bytes) -> str:
    """Latin-1, UTF-16 with a mark, UTF-16 big-endian or UTF-8, trimmed."""
    if encoding == 1 and raw[:2] == b"\xff\xfe":
        text = raw[2 : len(raw) // 2 * 2].decode("utf-16-le", "replace")
    elif encoding in (1, 2):
        text = raw[2 if encoding == 1 and raw[:2] == b"\xfe\xff" else 0 : len(raw) // 2 * 2].decode("utf-16-be", "replace")
    else:
        text = raw.decode("utf-8" if encoding == 3 else "latin-1", "replace")
    return text.strip("\0 \t\r\n")


def texts(body: bytes) -> list[str]:
    return [t for t in (x.strip() for x in decoded(body[0], body[1:]).split("\0")) if t] if body else []


def number(text: str) -> int:
    return int(text) if re.fullmatch(r"[+-]?\d{1,18}", text) else 0


def picture_frame(name: str, body: bytes) -> Bundle | None:
    """APIC has a MIME type that ends with a zero, PIC three letters of a format."""
    if len(body) < 4:
        return None
    if name == "PIC":
        letters = body[1:4].decode("latin-1")
        mime, rest = {"PNG": "image/png", "JPG": "image/jpeg"}.get(letters.upper(), letters.strip("\0 ")), body[4:]
    else:
        kind, tail = cut(body[1:], 0)
        mime, rest = kind.decode("latin-1").strip(), tail or b""
    if not rest:
        return None
    note, data = cut(rest[1:], body[0])
    return {"mime": mime, "type": rest[0], "description": decoded(body[0], note), "data": data} if data else None


def apply(b: Bundle, dates: dict[str, str], name: str, body: bytes) -> None:
    first = lambda: (decoded(body[0], body[1:]).split("\0")[0].strip() if body else "")
    kind, field = FRAME_FIELD.get(name, ("", ""))
    if kind == "text":
        put(b, field, first())
    elif name in ARTIST:
        for t in texts(body):
            push(b, "artist", t)
    elif kind == "pair":
        n, _, total = first().partition("/")
        put(b, field, number(n))
        put(b, field + "_total", number(total))
    elif kind == "date":
        dates[field] = first()
    elif kind == "long":
        put(b, field, decoded(body[0], cut(body[4:], body[0])[1] or b"") if len(body) >= 4 else "")
    elif name in ("WXXX", "WXX"):
        b["website"] = [(cut(body[1:], body[0])[1] or b"").strip(b"\0").decode("utf-8", "replace").strip()] if len(body) > 1 else [""]
    elif name in LINKS:
        push(b, "website", body.strip(b"\0").decode("utf-8", "replace").strip())
    else:
        if name in ("APIC", "PIC") and (p := picture_frame(name, body)):
            push(b, "picture", p)
        b.setdefault("raw", {}).setdefault(name, []).append(body)


def frames(version: int, raw: bytes) -> Iterator[tuple[str, bytes]]:
    """Names and bodies, freed of unsynchronisation, up to padding or damage; compressed
    frames are left out, the bytes before an encrypted or counted body are skipped."""
    at, wide = 0, 6 if version == 2 else 10
    while at + wide <= len(raw):
        name = raw[at : at + (3 if version == 2 else 4)]
        size = int.from_bytes(raw[at + 3 : at + 6], "big") if version == 2 else from_syncsafe(raw[at + 4 : at + 8]) if version == 4 else int.from_bytes(raw[at + 4 : at + 8], "big")
        body = raw[at + wide : at + wide + size]
        if not name.strip(b"\0") or size <= 0 or len(body) < size:
            return
        flags = raw[at + 9] if wide == 10 else 0
        at += wide + size
        packed, secret, counted = (flags & 0x80, flags & 0x40, 0) if version == 3 else (flags & 8, flags & 4, flags & 1)
        if packed:
            continue
        body = body[4 if counted and len(body) >= 4 else 0 :][1 if secret else 0 :]
        yield name.decode("latin-1"), body.replace(b"\xff\0", b"\xff") if version == 4 and flags & 2 else body


def parse_v2(raw: bytes) -> Bundle:
    """All leading tags; a cut one ends the walk."""
    b: Bundle = {}
    dates: dict[str, str] = {}
    at = 0
    while (h := head(raw, at)) and h[3] <= len(raw):
        body = raw[at + 10 : h[2]]
        for name, value in frames(h[0], body.replace(b"\xff\0", b"\xff") if h[1] & 0x80 else body):
            apply(b, dates, name, value)
        at = h[3]
    when, day, time = dates.get("full", ""), dates.get("day", ""), dates.get("time", "")
    if not when and dates.get("year"):
        when = dates["year"] + (f"-{day[2:]}-{day[:2]}" + (f"T{time[:2]}:{time[2:]}" if len(time) == 4 else "") if len(day) == 4 else "")
    put(b, "date", when if re.match(r"\d{4}", when) else "")
    return b


def parse(raw: bytes) -> Bundle:
    """ID3v1, with what ID3v2 says merged over it."""
    return merge(parse_v1(raw), parse_v2(raw))


def build_v2(b: Bundle, version: int = 3) -> bytes:
    """A tag of version 2, 3 or 4: UTF-8 in 2.4; before, Latin-1 or UTF-16 with a mark."""
    out: list[bytes] = []

    def frame(name: str, body: bytes) -> None:
        if version == 2:
            out.append(SHORT.get(name, name)[:3].encode().ljust(3) + len(body).to_bytes(3, "big") + body)
        else:
            out.append(name.encode().ljust(4)[:4] + (to_syncsafe(len(body)) if version == 4 else len(body).to_bytes(4, "big")) + b"\0\0" + body)

    def coded(*parts: str) -> tuple[int, list[bytes]]:
        if version == 4:
            return 3, [p.encode() for p in parts]
        if all(ord(c) < 256 for p in parts for c in p):
            return 0, [p.encode("latin-1") for p in parts]
        return 1, [b"\xff\xfe" + p.encode("utf-16-le") for p in parts]

    def text(name: str, value: str) -> None:
        if value:
            e, (body,) = coded(value)
            frame(name, bytes((e,)) + body)

    text("TIT2", b.get("title", ""))
    text("TPE1", "\0".join(b.get("artist", ())))
    text("TALB", b.get("album", ""))
    date = b.get("date", "")
    if version == 4:
        text("TDRC", date)
    else:
        text("TYER", date[:4])
        text("TDAT", date[8:10] + date[5:7] if re.match(r"\d{4}-\d\d-\d\d", date) else "")
    for name, key in (("TRCK", "track"), ("TPOS", "disc")):
        n, total = b.get(key) or 0, b.get(key + "_total") or 0
        text(name, f"{n}/{total}" if total else str(n) if n else "")
    for name, key in (("TCON", "genre"), ("TCOM", "composer"), ("TCOP", "copyright"), ("TENC", "encoder")):
        text(name, b.get(key, ""))
    for name, key in (("COMM", "comment"), ("USLT", "lyrics")):
        if b.get(key):
            e, (none, body) = coded("", b[key])
            frame(name, bytes((e,)) + b"eng" + none + bytes(unit(e)) + body)
    for link in b.get("website", ())[:1]:
        frame("WXXX", b"\0\0" + link.encode())
    for p in b.get("picture", ()):
        e, (note,) = coded(p["description"])
        kind = {"image/png": b"PNG", "image/jpeg": b"JPG"}.get(p["mime"], p["mime"].encode()[:3].ljust(3)) if version == 2 else p["mime"].encode("latin-1") + b"\0"
        frame("APIC", bytes((e,)) + kind + bytes((p["type"],)) + note + bytes(unit(e)) + p["data"])
    for name, bodies in b.get("raw", {}).items():
        for body in bodies if name not in ("APIC", "PIC") else ():
            frame(name, body)
    body = b"".join(out)
    return b"ID3" + bytes((version, 0, 0)) + to_syncsafe(len(body)) + body if body else b""


def image_size(data: bytes) -> tuple[str, int, int]:
    """MIME type, width and height from the header of a PNG, GIF or JPEG image."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "image/png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "image/gif", *struct.unpack("<HH", data[6:10])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 255:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return "image/jpeg", width, height
        at += 1 if data[at + 1] == 255 else 2 if data[at + 1] in (1, *range(0xD0, 0xD9)) else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    raise ValueError("not a known image")


def build_picture(p: Bundle, depth: int = 24) -> bytes:
    """A FLAC picture block; sizes come from the image, 0 if it is unknown."""
    try:
        mime, width, height = image_size(p["data"])
    except ValueError:
        mime, width, height = "", 0, 0
    kind, note = (p["mime"] or mime).encode(), p["description"].encode()
    sized = lambda x: len(x).to_bytes(4, "big") + x
    return p["type"].to_bytes(4, "big") + sized(kind) + sized(note) + struct.pack(">IIII", width, height, depth if width else 0, 0) + sized(p["data"])


def parse_picture(raw: bytes) -> Bundle:
    at = 4

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise ValueError("picture block is cut off")
        at += n
        return raw[at - n : at]

    mime = take(int.from_bytes(take(4), "big")).decode("latin-1")
    note = take(int.from_bytes(take(4), "big")).decode("utf-8", "replace")
    width, height, depth, colors = struct.unpack(">IIII", take(16))
    return {"type": int.from_bytes(raw[:4], "big"), "mime": mime, "description": note, "width": width, "height": height, "depth": depth, "colors": colors, "data": take(int.from_bytes(take(4), "big"))}


def parse_info(raw: bytes) -> Bundle:
    """The body of a RIFF LIST chunk of kind INFO."""
    b: Bundle = {}
    at = 4
    while raw[:4] == b"INFO" and at + 8 <= len(raw):
        size = int.from_bytes(raw[at + 4 : at + 8], "little")
        name, value = raw[at : at + 4].decode("latin-1"), raw[at + 8 : at + 8 + size].rstrip(b"\0").decode("utf-8", "replace").strip()
        if INFO.get(name) == "artist" and value:
            push(b, "artist", value)
        elif name in INFO:
            put(b, INFO[name], value)
        else:
            b.setdefault("raw", {}).setdefault(name, []).append(raw[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return b


def build_info(b: Bundle) -> bytes:
    chunk = lambda name, body: name.encode() + len(body).to_bytes(4, "little") + body + bytes(len(body) % 2)
    values = {name: "; ".join(b.get(key) or ()) if key == "artist" else b.get(key) or "" for name, key in INFO.items()}
    return b"INFO" + b"".join(chunk(n, v.encode() + b"\0") for n, v in values.items() if v)


FIELDS = ("title", "album", "date", "genre", "comment", "composer", "copyright", "encoder", "lyrics")


def read_tags(files: DataFrame) -> DataFrame:
    """sid, content -> sid, the text fields, artist, track and disc numbers, pictures (a
    count) and the bounds of the payload. Files are parsed each in an Arrow batch."""
    schema = "sid long, " + ", ".join(f"{f} string" for f in FIELDS) + ", artist array<string>, track long, track_total long, disc long, disc_total long, pictures long, start long, stop long"
    arrow = pa.schema([("sid", pa.int64()), *((f, pa.string()) for f in FIELDS), ("artist", pa.list_(pa.string())), *((f, pa.int64()) for f in ("track", "track_total", "disc", "disc_total", "pictures", "start", "stop"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sid, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = parse(raw or b"")
                start, stop = bounds(raw or b"")
                rows.append({"sid": sid, **{f: b.get(f) for f in FIELDS}, "artist": b.get("artist", []), **{f: b.get(f) for f in ("track", "track_total", "disc", "disc_total")}, "pictures": len(b.get("picture", ())), "start": start, "stop": stop})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("sid", "content").mapInArrow(run, schema)
