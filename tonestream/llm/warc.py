"""Operator 5: WARC archives in ZIP packages, read by ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, join_skewed, saved, shared_dir

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload in a package, and bytes that one range read fetches at most unless a
#: record is longer.
PACKAGE, RANGE = 16 << 20, 4 << 20
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: int | None, date: str) -> bytes:
    """One record; a revisit has the HTTP header but not the payload."""
    revisit = revisits is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(revisits))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def fields(raw: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, header fields by lower-case name, and what follows the empty line."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def package(records: list[bytes], *, zip64: bool = False) -> bytes:
    """A ZIP file with the gzipped records and an index of their places, both stored."""
    archive, lines = io.BytesIO(), []
    for r in records:
        packed = gzip.compress(r, 1, mtime=0)
        lines.append(f"{archive.tell()} {len(packed)}\n")
        archive.write(packed)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((ARCHIVE, archive.getvalue()), (INDEX, "".join(lines).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(data)
    return out.getvalue()


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


class Package:
    """A ZIP file of which only ranges are read; `read(offset, n)` fetches one."""

    def __init__(self, read, size: int) -> None:  # noqa: ANN001
        self.read, self.size = read, size
        self.members = {m.name: m for m in self._directory()}

    def _directory(self) -> Iterator[Member]:
        tail = self.read(max(0, self.size - 66_000), min(self.size, 66_000))
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            place = tail.rfind(b"PK\x06\x07", 0, at)
            if place < 0:
                raise ValueError("no ZIP64 locator")
            (end64,) = struct.unpack("<Q", tail[place + 8 : place + 16])
            end = self.read(end64, 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack("<QQQ", end[32:56])
        raw, at = self.read(start, length), 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, size, n, extra, comment, header = struct.unpack("<10xH8xIIHHH8xI", raw[at : at + 46])
            name = raw[at + 46 : at + 46 + n].decode()
            own = raw[at + 46 + n : at + 46 + n + extra]
            # ZIP64 extra field: the values that don't fit, in the order size, packed, header
            while len(own) >= 4:
                kind, m = struct.unpack("<HH", own[:4])
                if kind == 1:
                    wide = iter(struct.unpack(f"<{m // 8}Q", own[4 : 4 + m // 8 * 8]))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                own = own[4 + m :]
            yield Member(name, method, packed, header)
            at += 46 + n + extra + comment

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} isn't stored")
        head = self.read(m.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no local header")
        n, extra = struct.unpack("<HH", head[26:30])
        return m.header + 30 + n + extra

    def records(self) -> Iterator[bytes]:
        """Every record by the index, neighbours in one range read."""
        index = self.read(self.start(INDEX), self.members[INDEX].size).decode().split("\n")
        places = [tuple(map(int, x.split())) for x in index if x]
        base, k = self.start(ARCHIVE), 0
        while k < len(places):
            first, end, j = places[k][0], places[k][0], k
            while j < len(places) and places[j][0] == end and (j == k or end + places[j][1] - first <= RANGE):
                end += places[j][1]
                j += 1
            raw = self.read(base + first, end - first)
            for at, n in places[k:j]:
                yield gzip.decompress(raw[at - first : at - first + n])
            k = j


def parsed(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A record's row; a response's digest is checked against its payload."""
    version, head, block = fields(raw)
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    _, http, payload = fields(block[: int(head["content-length"])])
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind, refers = head["warc-type"], head.get("warc-refers-to")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"digest of {head['warc-record-id']} differs")
    return page_of(head["warc-record-id"]), int(http["content-length"]), digest, kind, page_of(refers) if refers else None


def write_packages(records: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """records: page_id, url, payload, digest, revisits -> path of each package written,
    of PACKAGE bytes each, so that reading them back takes as many tasks.

    A file's name holds the task's attempt, so a repeated task never touches files of
    another, and only files of attempts that ended well are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        task, k, held, size = TaskContext.get(), 0, [], 0
        fs.create_dir(root, recursive=True)

        def flush() -> pa.RecordBatch:
            nonlocal k, held, size
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.wacz"
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(package(held))
            k, held, size = k + 1, [], 0
            return pa.record_batch([pa.array([f"{folder}/{name}"])], names=["path"])

        for b in batches:
            for i in range(0, b.num_rows, 500):
                for row in zip(*(c.to_pylist() for c in b.slice(i, 500).columns), strict=True):
                    held.append(record(*row, date))
                    size += len(held[-1])
                    if size >= PACKAGE:
                        yield flush()
        if held:
            yield flush()

    return records.select("page_id", "url", "payload", "digest", "revisits").mapInArrow(run, "path string")


def read_packages(paths: DataFrame) -> DataFrame:
    """path -> a row per record, by range reads in parallel over the packages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, own = FileSystem.from_uri(path)
                with fs.open_input_file(own) as f:
                    rows = []
                    for raw in Package(lambda at, n: f.read_at(n, at), f.size()).records():  # noqa: B023
                        rows.append(parsed(raw))
                        if len(rows) >= 10_000:
                            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
                            rows = []
                    yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    # a number given keeps the packages apart: one that is left to Spark may be made one task
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(run, SCHEMA)


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, revisits: of equal payloads of `least` bytes or more
    the one with the largest page_id, and rows that share that id, is a response."""
    html = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    same = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = F.when((F.octet_length("payload") >= least) & F.coalesce(F.col("page_id") != F.col("last"), F.col("last").isNotNull()), F.col("last"))
    same = saved(same)
    return join_skewed(rows, same, ["digest"], "n", max(1, rows.count()), how="left").withColumn("revisits", revisits)


def round_trip(pages: DataFrame, *, least: int = 1000) -> DataFrame:
    """Writes a record for each page into packages in the shared folder and reads them
    back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, a null url leaves out the target, a null page_id an
    empty id; among equal payloads null ids revisit the largest id. Rows that repeat the
    largest page_id with its payload are all responses. Payloads under `least` bytes
    are never revisits. An empty table writes nothing and gives no rows.
    """
    folder = shared_dir(pages.sparkSession)
    paths = saved(write_packages(with_revisits(pages, least), folder))
    freed(pages.sparkSession)
    return read_packages(paths)
