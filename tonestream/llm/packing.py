"""Operator 1: packing documents into sequences by power-of-two decomposition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import Chunks

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def piece_lengths(n: int, longest: int) -> list[int]:
    """n as full sequences and the binary digits of the rest, longest first.

    >>> piece_lengths(21, 8)
    [8, 8, 4, 1]
    """
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, *, longest: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; every piece is a sequence of its own.

    Each document's ids, then end_id, are cut into pieces of power-of-two lengths up to
    `longest`, so a sequence never crosses documents and needs no padding. `bucket` is
    log2 of the length: sequences of one bucket stack into batches, and sequence_id
    orders by bucket, then by input partition and place there, so that a bucket's
    sequences have neighbouring ids. Ids repeat between runs that read the same splits.

    Null and empty texts become the piece that holds end_id alone. Null ids are kept.
    Repeated rows are packed each for itself. An empty table gives an empty result.
    Other columns are ignored. Memory: one Arrow batch and its largest text.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = SCHEMA + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part = Chunks(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        made = [0] * longest.bit_length()
        for batch in batches:
            cols: list[list] = [[] for _ in range(8 + with_ids)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(chunks.ids(text or "") + end)
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, longest):
                    b = length.bit_length() - 1
                    own = ids[4 * start : 4 * (start + length)]
                    row = (doc, start, length, zlib.crc32(own), n, b << 58 | part << 34 | made[b], 0, b)
                    for c, v in zip(cols, (*row, bytes(own)) if with_ids else row, strict=True):
                        c.append(v)
                    made[b] += 1
                    start += length
                if len(cols[0]) >= 50_000:
                    yield _batch(cols, with_ids)
                    cols = [[] for _ in cols]
            yield _batch(cols, with_ids)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def _batch(cols: list[list], with_ids: bool) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64()] * 7 + [pa.int32()] + [pa.binary()] * with_ids
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
