"""Operator 4: token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .tokens import MOST, Memory, byte_symbols, cut, spec

#: The split of tokens.PATTERN, with white space spelt out as the tokenizer takes it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class ArrayMerger:
    """Byte-level BPE over many pre-tokens at once.

    All sequences lie in one flat array of symbols with a sequence number and the rank
    of the pair that starts at each. A round takes each sequence's lowest rank by a
    segmented minimum, joins that pair wherever it stands in the sequence, left to right
    without overlap, and looks up the ranks of the pairs that changed. Sequences without
    a pair to join leave the arrays; the rounds end when none is left.
    """

    def __init__(self, path: str) -> None:
        own = spec(path)
        vocab = own["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in own["model"]["merges"]]
        self.special = [t["content"] for t in own["added_tokens"]]
        self.base = len(vocab) + len(self.special)
        self.of_byte = np.array([vocab[s] for s in byte_symbols()], np.int64)
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.result = np.array([vocab[a + b] for a, b in merges], np.int64)

    def rank(self, symbols: np.ndarray, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the pairs that start at these places; the number of merges if none."""
        none = len(self.result)
        after = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] * self.base + symbols[after]
        found = np.minimum(np.searchsorted(self.keys, key), none - 1)
        fits = (self.keys[found] == key) & (seq[at] == seq[after]) & (after > at)
        return np.where(fits, self.ranks[found], none)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """The number of symbols each pre-token ends with."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        out, none = lengths.copy(), len(self.result)
        symbols = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        seq = np.repeat(np.arange(len(tokens), dtype=np.int32), lengths)
        rank = self.rank(symbols, seq, np.arange(len(symbols)))
        while len(symbols):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, first)
            here = np.repeat(low, np.diff(np.r_[first, len(seq)]))
            pos = np.flatnonzero((rank == here) & (rank < none))
            # in runs of overlapping pairs (aaa) every other one counts, from the left
            fresh = np.r_[True, np.diff(pos) > 1] if len(pos) else np.zeros(0, bool)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0)) if len(pos) else pos
            pos = pos[(np.arange(len(pos)) - run) % 2 == 0]
            symbols[pos] = self.result[rank[pos]]
            out -= np.bincount(seq[pos], minlength=len(out))
            keep = here < none
            keep[pos + 1] = False
            new = (np.cumsum(keep) - 1)[pos]
            symbols, seq, rank = symbols[keep], seq[keep], rank[keep]
            if len(new):
                stale = np.unique(np.r_[new, np.maximum(new - 1, 0)])
                rank[stale] = self.rank(symbols, seq, stale)
        return out


class Counting:
    """Token counts of texts; each distinct chunk and pre-token is merged once."""

    def __init__(self, path: str) -> None:
        self.merger, self.pattern = ArrayMerger(path), regex.compile(PATTERN)
        self.split = re.compile("|".join(map(re.escape, self.merger.special))) if self.merger.special else None
        self.seen = Memory()

    def learn(self, names: list[str | bytes]) -> None:
        found = [self.pattern.findall(c.decode() if isinstance(c, bytes) else " " + c) for c in names]
        words = list({w for ws in found for w in ws})
        n = dict(zip(words, self.merger.counts([w.encode() for w in words]).tolist(), strict=True))
        self.seen.update((c, sum(map(n.__getitem__, ws))) for c, ws in zip(names, found, strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        tallies: list[Counter] = []
        out: list[int] = []
        size = 0

        def flush() -> None:
            new = self.seen.missing(set().union(*tallies) - {0})
            for i in range(0, len(new), 50_000):
                self.learn(new[i : i + 50_000])
            known = self.seen
            out.extend(sum([known[c] * k for c, k in t.items() if c != 0]) + t[0] for t in tallies)
            tallies.clear()

        for t in texts:
            special = self.split is not None and any(s in t for s in self.merger.special)
            pieces = self.split.split(t) if special else [t]
            tally: Counter = Counter()  # at 0: special strings
            for p in pieces:
                if p:
                    head, *rest = cut(p)
                    tally.update(rest)
                    tally[head.encode()] += 1  # bytes: a chunk without a space before it
            size += len(tally)
            if tallies and size > MOST // 2:
                flush()
                size = len(tally)
            if len(pieces) > 1:
                tally[0] = len(pieces) - 1
            tallies.append(tally)
        flush()
        return out


@lru_cache(2)
def counting(path: str) -> Counting:
    return Counting(path)


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, UTF-8 bytes, tokens, and whether these exceed limit.

    Special strings inside a text count as one token each, as the tokenizer's library
    has it by default. Null texts count as empty: 0 bytes, 0 tokens. Null ids are kept,
    repeated rows counted each, other columns ignored; an empty table gives no rows.
    Memory: an Arrow batch, its largest text, and a bounded memory of chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counting(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = c.counts(texts)
            yield pa.record_batch([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
