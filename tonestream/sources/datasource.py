"""Audio files as a Spark data source, read by files and written by streams.

    audio.register(spark)
    spark.read.format("audio").option("view", "samples").load("/media")
    df.write.format("audio").option("rate", 44100).save("/out")

Views: "samples" (path, ch, idx, v), "packets" (path, seq, pts, codec, data) and "streams"
(path, codec, rate, channels, bits, samples). Paths are local, or URIs of file systems
that pyarrow knows; executors open them themselves.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

VIEWS = {
    "samples": "path string, ch int, idx long, v double",
    "packets": "path string, seq long, pts long, codec string, data binary",
    "streams": "path string, codec string, rate int, channels int, bits int, samples long",
}
ENDINGS = (".wav", ".wave", ".flac", ".mp3")


def opened(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (FileSystem.from_uri("file:///")[0], path)


def listed(path: str) -> list[tuple[str, int]]:
    """Files below a folder, or the file itself, with their sizes."""
    fs, own = opened(path)
    root = path[: len(path) - len(own)] if path.endswith(own) else ""
    info = fs.get_file_info(own)
    found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(own, recursive=True))
    return sorted((root + f.path, f.size) for f in found if f.type == FileType.File and f.path.lower().endswith(ENDINGS))


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], view: str) -> None:
        self.path, self.view = options["path"], view
        self.bytes = int(options.get("bytespertask", 64 << 20))

    def partitions(self) -> list[Files]:
        """Small files together, up to a number of bytes; a large one alone."""
        out: list[list[str]] = []
        size = 0
        for path, n in listed(self.path):
            if not out or size + n > self.bytes:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [Files(tuple(p)) for p in out] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            fs, own = opened(path)
            with fs.open_input_file(own) as f:
                raw = f.read()
            yield from getattr(self, f"_{self.view}")(path, raw)

    def _samples(self, path: str, raw: bytes) -> Iterator[pa.RecordBatch]:
        from ..plans.convert import samples_of

        for at, x in samples_of(raw):
            c, n = x.shape
            yield pa.record_batch([pa.array([path] * (c * n)), pa.array(np.repeat(np.arange(c, dtype=np.int32), n)), pa.array(np.tile(np.arange(at, at + n), c)), pa.array(x.ravel().astype(np.float64))], names=["path", "ch", "idx", "v"])

    def _packets(self, path: str, raw: bytes) -> Iterator[pa.RecordBatch]:
        from . import flac, mpeg, tags, wav

        if raw[:4] in (b"RIFF", b"RF64"):
            codec, rows = wav.parse(raw).codec, list(wav.packets(raw))
        elif path.lower().endswith(".mp3"):
            codec, rows, pts = "mp3", [], 0
            for at, size, h in mpeg.scan(raw, *tags.bounds(raw)):
                rows.append((pts, raw[at : at + size]))
                pts += h.samples
        else:
            codec, rows, pts = "flac", [], 0
            for at, size, n in flac.frame_places(raw):
                rows.append((pts, raw[at : at + size]))
                pts += n
        for k in range(0, len(rows), 4096):
            own = rows[k : k + 4096]
            yield pa.record_batch([pa.array([path] * len(own)), pa.array(np.arange(k, k + len(own))), pa.array([r[0] for r in own], pa.int64()), pa.array([codec] * len(own)), pa.array([r[1] for r in own], pa.binary())], names=["path", "seq", "pts", "codec", "data"])

    def _streams(self, path: str, raw: bytes) -> Iterator[pa.RecordBatch]:
        from . import flac, mpeg, wav

        if raw[:4] in (b"RIFF", b"RF64"):
            h = wav.parse(raw)
            row = (h.codec, h.rate, h.channels, h.bits, h.samples)
        elif path.lower().endswith(".mp3"):
            i = mpeg.analyze(raw)
            row = ("mp3", i.rate, i.channels, 16, int(i.seconds * i.rate + 0.5))
        else:
            i = flac.parse(raw)
            row = ("flac", i.rate, i.channels, i.bits, i.samples)
        yield pa.record_batch([pa.array([path]), pa.array([row[0]]), *[pa.array([x], t) for x, t in zip(row[1:], (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)]], names=["path", "codec", "rate", "channels", "bits", "samples"])


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]


class Writer(DataSourceArrowWriter):
    """sid, idx and a column per channel (amplitudes), each stream in one task and in
    order: `df.repartition("sid").sortWithinPartitions("sid", "idx")`. A file per stream
    under a name of the attempt; the commit gives all files their names, an abort deletes
    them, so no half-written file is ever seen."""

    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.path = options["path"].rstrip("/")
        self.rate, self.bits = int(options.get("rate", 44100)), int(options.get("bits", 16))
        self.channels = [c for c in columns if c not in ("sid", "idx")]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from ..functions import pcm
        from ..operators.state import edges
        from . import wav

        fs, own = opened(self.path)
        fs.create_dir(own, recursive=True)
        mark, done, key, out, part, size = uuid.uuid4().hex, [], None, None, "", 0
        fmt = "u8" if self.bits <= 8 else f"s{(self.bits + 7) // 8 * 8}"
        head = lambda n: wav.build(b"", channels=len(self.channels), rate=self.rate, bits=(self.bits + 7) // 8 * 8)[:-4] + n.to_bytes(4, "little")

        def close() -> None:
            if out is None:
                return
            body = out.getvalue()
            first = head(len(body))
            total = len(first) - 8 + len(body) + len(body) % 2
            with fs.open_output_stream(part) as f:
                f.write(first[:4] + total.to_bytes(4, "little") + first[8:] + body + bytes(len(body) % 2))

        for b in iterator:
            sids = b.column(b.schema.get_field_index("sid"))
            cuts = edges(sids).tolist()
            for a, z in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                own_key = sids[a].as_py()
                if out is None or own_key != key:
                    close()
                    key, out, size = own_key, io.BytesIO(), 0
                    part = f"{own}/.{key}.{mark}.part"
                    done.append((part, f"{own}/{key}.wav"))
                x = np.stack([b.column(b.schema.get_field_index(c)).slice(a, z - a).to_numpy(zero_copy_only=False) for c in self.channels])
                size += out.write(pcm.from_float(x, fmt, bits=self.bits))
        close()
        return Written(tuple(done))

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.path)
        for m in messages:
            for part, final in m.files if m else ():
                fs.move(part, final)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.path)
        for m in messages:
            for part, _ in m.files if m else ():
                if fs.get_file_info(part).type == FileType.File:
                    fs.delete_file(part)


class Audio(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audio"

    @property
    def view(self) -> str:
        view = self.options.get("view", "samples")
        if view not in VIEWS:
            raise ValueError(f"no view {view!r}; there are {', '.join(VIEWS)}")
        return view

    def schema(self) -> str:
        return VIEWS[self.view]

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(dict(self.options), self.view)

    def writer(self, schema, overwrite: bool) -> Writer:  # noqa: ANN001
        return Writer(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Audio)
