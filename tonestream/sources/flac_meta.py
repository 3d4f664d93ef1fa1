"""Metadata blocks of FLAC files: comments, pictures, seek tables; and seeking by them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from . import tags

STREAMINFO, PADDING, APPLICATION, SEEKTABLE, COMMENT, CUESHEET, PICTURE = range(7)
#: Comment names by field; the first is written, all are read.
NAMES = {
    "title": ["TITLE"], "artist": ["ARTIST"], "album": ["ALBUM"], "date": ["DATE", "YEAR"], "genre": ["GENRE"],
    "comment": ["COMMENT", "DESCRIPTION"], "composer": ["COMPOSER"], "copyright": ["COPYRIGHT"], "encoder": ["ENCODER"],
    "lyrics": ["LYRICS"], "track": ["TRACKNUMBER"], "track_total": ["TRACKTOTAL", "TOTALTRACKS"],
    "disc": ["DISCNUMBER"], "disc_total": ["DISCTOTAL", "TOTALDISCS"], "website": ["WEBSITE", "CONTACT"],
}
FIELD = {n: f for f, ns in NAMES.items() for n in ns}
NUMBERS = ("track", "track_total", "disc", "disc_total")
PLACEHOLDER = (1 << 64) - 1


def blocks(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Kind and body of each metadata block; ID3v2 tags before the marker are skipped."""
    at, last = 0, False
    while h := tags.head(raw, at):
        at = h[3]
    if raw[at : at + 4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at += 4
    while not last:
        size = int.from_bytes(raw[at + 1 : at + 4], "big")
        if at + 4 + size > len(raw) or at + 4 > len(raw):
            raise ValueError("metadata is cut off")
        last = raw[at] > 127
        yield raw[at] & 127, raw[at + 4 : at + 4 + size]
        at += 4 + size


def join(parts: list[tuple[int, bytes]]) -> bytes:
    """The marker and the blocks, the last one marked as such."""
    return b"fLaC" + b"".join(bytes((kind | 128 * (i == len(parts) - 1),)) + len(body).to_bytes(3, "big") + body for i, (kind, body) in enumerate(parts))


def parse_comments(raw: bytes) -> tags.Bundle:
    """Cut at the first equals sign; names are case-blind, unknown ones become raw tags."""
    b: tags.Bundle = {}
    at = 4 + int.from_bytes(raw[:4], "little")
    count = int.from_bytes(raw[at : at + 4], "little")
    at += 4
    for _ in range(count):
        size = int.from_bytes(raw[at : at + 4], "little")
        if at + 4 + size > len(raw) or at + 4 > len(raw):
            raise ValueError("comments are cut off")
        name, eq, value = raw[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        at += 4 + size
        f = FIELD.get(name.upper())
        if not eq:
            continue
        if f in tags.LISTS:
            tags.push(b, f, value)
        elif f in NUMBERS:
            n, _, total = value.partition("/")
            tags.put(b, f, tags.number(n.strip()))
            if not f.endswith("total"):
                tags.put(b, f + "_total", tags.number(total.strip()))
        elif f:
            tags.put(b, f, value)
        else:
            b.setdefault("raw", {}).setdefault(name.upper(), []).append(value.encode())
    return b


def build_comments(b: tags.Bundle, vendor: str = "tonestream") -> bytes:
    own = [f"{NAMES[f][0]}={v}".encode() for f in NAMES for v in (b.get(f, []) if f in tags.LISTS else [b[f]] if b.get(f) else [])]
    own += [name.encode() + b"=" + v for name, vs in b.get("raw", {}).items() for v in vs]
    sized = lambda x: len(x).to_bytes(4, "little") + x
    return sized(vendor.encode()) + len(own).to_bytes(4, "little") + b"".join(map(sized, own))


def parse_seek_table(raw: bytes) -> list[tuple[int, int, int]]:
    """Sample, byte behind the first frame's start, samples in that frame; placeholders go."""
    return [p for p in struct.iter_unpack(">QQH", raw[: len(raw) // 18 * 18]) if p[0] != PLACEHOLDER]


def build_seek_table(points: list[tuple[int, int, int]], placeholders: int = 0) -> bytes:
    return b"".join(struct.pack(">QQH", *p) for p in sorted(points)) + struct.pack(">QQH", PLACEHOLDER, 0, 0) * placeholders


def seek(points: list[tuple[int, int, int]], target: int, total: int, size: int) -> int:
    """Byte behind the first frame's start from which to scan on: the last seek point not
    past the target, else in proportion to the samples."""
    below = [p for p in points if p[0] <= target]
    if below:
        return max(below)[1]
    return min(size, size * max(target, 0) // total) if total else 0


def parse(raw: bytes) -> tags.Bundle:
    """Comments and pictures of a file."""
    b: tags.Bundle = {}
    for kind, body in blocks(raw):
        if kind == COMMENT:
            b = tags.merge(b, parse_comments(body))
        elif kind == PICTURE:
            p = tags.parse_picture(body)
            tags.push(b, "picture", {k: p[k] for k in ("mime", "type", "description", "data")})
    return b


def build(info: bytes, b: tags.Bundle, points: list[tuple[int, int, int]] = ()) -> bytes:
    """Everything in front of the frames."""
    parts = [(STREAMINFO, info)]
    if points:
        parts.append((SEEKTABLE, build_seek_table(points)))
    if b:
        parts.append((COMMENT, build_comments(b)))
    return join(parts + [(PICTURE, tags.build_picture(p)) for p in b.get("picture", ())])
