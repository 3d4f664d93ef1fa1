"""Operator 2: quality rules with suffix-array repetition."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
#: Fixed value: the symbols that are counted.
SYMBOL = re.compile(r"[#*$%&|<>]")
#: Words that are sorted together, unless one text has more.
BLOCK = 300_000


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and rank arrays: two suffixes share a rank at level k if and
    only if their first 2**k codes are equal. Prefix doubling, in which suffixes that
    differ from all others drop out."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.r_[True, codes[order][1:] != codes[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h = [rank.astype(np.int32)], 1
    while True:
        ranked = rank[order]
        tied = np.flatnonzero(np.r_[ranked[1:] == ranked[:-1], False] | np.r_[False, ranked[1:] == ranked[:-1]])
        if not len(tied):
            return order, levels
        at = order[tied]
        after = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at  # ties of one rank are neighbours, so each group keeps its places
        new = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        levels.append(rank.astype(np.int32))
        h *= 2


def repeats(codes: np.ndarray) -> np.ndarray:
    """For each suffix the length of its longest prefix that starts elsewhere too: the
    larger of the common prefixes with its neighbours in the suffix array."""
    n = len(codes)
    if n < 2:
        return np.zeros(n, np.int64)
    order, levels = suffix_order(codes)
    pair = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[pair].copy(), order[pair + 1].copy()
    lcp = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = np.flatnonzero((a < n) & (b < n))
        ok = ok[levels[k][a[ok]] == levels[k][b[ok]]]
        lcp[ok] += 1 << k
        a[ok] += 1 << k
        b[ok] += 1 << k
    best = np.zeros(n, np.int64)
    best[order[pair]] = lcp
    best[order[pair + 1]] = np.maximum(best[order[pair + 1]], lcp)
    return best


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Whether each place lies in a span."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def judge_block(docs: list[list[bytes]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words in 3-word windows that recur, words covered by maximal repeats of
    at least `least` words, and words in the longest repeat. Repeats within a text only:
    every text has words of its own, and ends with a word that is found nowhere else."""
    sizes = np.array([len(d) + 1 for d in docs])
    codes = np.empty(sizes.sum(), np.int64)
    base = at = 0
    for d in docs:
        own: defaultdict[bytes, int] = defaultdict()
        own.default_factory = own.__len__
        codes[at : at + len(d)] = np.fromiter(map(own.__getitem__, d), np.int64, len(d))
        codes[at : at + len(d)] += base
        at += len(d) + 1
        base += len(own) + 1
        codes[at - 1] = base - 1
    best = repeats(codes)
    first = np.cumsum(sizes) - sizes
    n = len(codes)
    three = np.flatnonzero(best >= 3)
    repeated = covered(three, np.full(len(three), 3), n)
    left = np.r_[0, best[:-1]]
    maximal = np.flatnonzero((best >= least) & (left <= best))  # else it goes on to the left
    spans = covered(maximal, best[maximal], n)
    return np.add.reduceat(repeated, first, dtype=np.int64), np.add.reduceat(spans, first, dtype=np.int64), np.maximum.reduceat(best, first)


def quality(docs: DataFrame, *, least_repeat: int = 5, most_covered: float = 0.2, longest_repeat: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its base figures and the verdict on repetition.

    A suffix array over the text's words gives longest common prefixes; its intervals
    of `least_repeat` words or more are the maximal repeats. A text is kept unless a base
    rule fails (fewer than 50 words, or over half of them in 3-word windows that recur),
    the union of those repeats covers over `most_covered` of its words, or its longest
    repeat has over `longest_repeat` words.

    Null and empty texts have no words and fail the base rules. Null ids are kept,
    repeated rows judged each, other columns ignored; an empty table gives no rows.
    Memory: an Arrow batch, and the suffix array of BLOCK words or of the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            cols: list[list] = [[] for _ in range(7)]
            block: list[list[bytes]] = []
            size = 0
            for i, t in enumerate(texts):
                raw = t.encode()
                words = raw.split()
                lines = [x for x in raw.split(b"\n") if x.strip()]
                for c, v in zip(cols, (len(words), len(t) - sum(map(t.count, SPACE)), len(SYMBOL.findall(t)), len(lines) - len(set(lines))), strict=False):
                    c.append(v)
                block.append(words)
                size += len(words)
                if size >= BLOCK or i == len(texts) - 1:
                    for c, v in zip(cols[4:], judge_block(block, least_repeat), strict=True):
                        c.extend(v.tolist())
                    block, size = [], 0
            n, chars, symbols, dup, rep, cov, longest = (np.array(c, np.int64) for c in cols)
            failed = (n < 50) | (100 * rep > 50 * n)
            kept = ~failed & (cov <= most_covered * n) & (longest <= longest_repeat)
            yield pa.record_batch([batch.column(0), *map(pa.array, (n, chars, symbols, dup, rep, failed, kept, cov, longest))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
