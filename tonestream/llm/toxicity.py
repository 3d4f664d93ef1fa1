"""Operator 10: toxicity by maximum-scoring segments of token log-odds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import copysign, exp, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved

EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Bits of a feature's bucket, and independent hashings: the tables broadcast have
#: ROWS * 2**BITS places, whatever the vocabulary.
BITS, ROWS = 20, 2
PREFIX = 4
#: Texts that a prior counts for, and what a word's log-odds must exceed to score above 0.
PRIOR, DRIFT = 1.0, 1.5
#: Bins of word scores, and of the texts' evidence, on either side of 0.
STEP, BINS = 0.05, 400
#: Words whose scores a worker keeps, for each class; and texts that it holds at a time.
MOST_KNOWN, TEXTS = 250_000, 500


def features(word: str) -> tuple[str, ...]:
    """A word's beginning, if it is longer, and the word, stripped and in lower case."""
    w = word.strip(EDGE)
    return ("^" + w[:PREFIX], w) if len(w) > PREFIX else (w,) if w else ()


def places(found: list[str]) -> np.ndarray:
    """A row for each feature: its place in each hashing, halves of one digest."""
    raw = b"".join([xxhash.xxh3_128_digest(f.encode()) for f in found])
    return (np.frombuffer(raw, "<u8").reshape(-1, ROWS) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first, last + 1, score), in linear time.

    Only places with a positive score can begin or end one; each is a candidate with the
    sums before and after it. Candidates are kept on a stack, and joined while an earlier
    one starts lower and ends lower.
    """
    sums = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    stack: list[tuple[int, int, float, float]] = []
    for place, before, after in zip(at.tolist(), (sums[at] - scores[at]).tolist(), sums[at].tolist(), strict=True):
        new = (place, place + 1, before, after)
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= new[2]:
                k -= 1
            if k < 0 or stack[k][3] >= new[3]:
                break
            new = (stack[k][0], new[1], stack[k][2], new[3])
            del stack[k:]
        stack.append(new)
    return [(a, b, right - left) for a, b, left, right in stack]


@dataclass
class Model:
    """counts: for toxic and for clean texts, and for each hashing, how many texts have a
    feature of each place; texts: how many of each there are; rate and starts: lambda and
    K of the chance extreme; fit: intercept and slope of the calibration."""

    counts: np.ndarray
    texts: tuple[int, int]
    rate: float = 1.0
    starts: float = 1.0
    fit: tuple[float, float] = (-1000.0, 0.0)

    def __post_init__(self) -> None:
        self.known: dict[int, dict[str, float]] = {-1: {}, 0: {}, 1: {}}
        self.begun: dict[int, dict[str, float]] = {-1: {}, 0: {}, 1: {}}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "begun")}

    def __setstate__(self, own: dict) -> None:
        self.__dict__.update(own)
        self.__post_init__()

    def shares(self, found: list[str], parent: np.ndarray | float, own: int) -> np.ndarray:
        """The share of toxic texts among those with each feature, with a Dirichlet prior of
        PRIOR texts with the parent's share; of several hashings the least count holds."""
        at = places(found)
        t, c = (np.minimum.reduce([self.counts[k, row, at[:, row]] for row in range(ROWS)]) for k in (0, 1))
        t, c = np.maximum(t - (own == 1), 0), np.maximum(c - (own == 0), 0)
        return (t + PRIOR * parent) / (t + c + PRIOR)

    def learn(self, words: list[str], own: int) -> None:
        """Log-odds of new words less DRIFT: a word's share has a prior from its beginning,
        whose prior is the share of all texts. A text that was counted itself, as class
        `own`, is left out."""
        base = self.texts[0] / sum(self.texts)
        begun, plain = self.begun[own], [w.strip(EDGE) for w in words]
        heads = [w[:PREFIX] if len(w) > PREFIX else "" for w in plain]
        if len(begun) > MOST_KNOWN:
            begun.clear()
        begun[""] = base
        if new := list(set(heads).difference(begun)):
            begun.update(zip(new, self.shares(["^" + h for h in new], base, own).tolist(), strict=True))
        share = self.shares(plain, np.fromiter(map(begun.__getitem__, heads), np.float64, len(heads)), own)
        share = np.where([not w for w in plain], base, share)
        odds = np.log(share / (1 - share) * (1 - base) / base) - DRIFT
        self.known[own].update(zip(words, odds.tolist(), strict=True))

    def scan(self, text: str, own: int = -1) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
        """Word scores and maximal segments; without a positive score the best word."""
        words, known = WORDS.findall(text.lower()), self.known[own]
        if len(known) > MOST_KNOWN:
            known.clear()
        if new := list(set(words).difference(known)):
            self.learn(new, own)
        scores = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        found = segments(scores)
        if not found and len(scores):
            at = int(np.argmax(scores))
            found = [(at, at + 1, float(scores[at]))]
        return scores, found

    def chance(self, n: int) -> float:
        """The extreme that a clean text of n words is expected to exceed once."""
        return log(self.starts * max(1, n))

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """Significant passages: first word, last word + 1, excess over the chance extreme."""
        scores, found = self.scan(text)
        limit = self.chance(len(scores))
        return [(a, b, self.rate * s - limit) for a, b, s in found if self.rate * s > limit]

    def judge(self, text: str) -> tuple[float, int]:
        """Probability, and the number of significant passages. The evidence is the best
        segment's excess, which may be below zero, and those of all other significant ones."""
        scores, found = self.scan(text)
        if not found:
            return self.score(-float(BINS)), 0
        limit = self.chance(len(scores))
        excess = [self.rate * s - limit for *_, s in found]
        top, more = max(excess), [x for x in excess if x > 0]
        return self.score(top + sum(more) - max(top, 0.0)), len(more)

    def score(self, evidence: float) -> float:
        z = self.fit[0] + self.fit[1] * damped(evidence)
        return 1 / (1 + exp(-z)) if z > -700 else 0.0


def damped(x: float) -> float:
    return copysign(log1p(abs(x)), x)


def held_out(ident: Column) -> Column:
    return F.crc32(ident.cast("string").cast("binary")) % 3 == 1


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, TEXTS):
            yield b.slice(k, TEXTS)


def train(docs: DataFrame, labels: DataFrame, *, most_rows: int = 40_000) -> Model | None:
    """docs: doc_id, text; labels: doc_id, toxic.

    Fits on at most `most_rows` labelled rows, those with the smallest hash of their id,
    and never on held-out ids. Distinct texts count once, under the label that most of
    their rows have (toxic if they tie), so reruns agree. Each training text is scored
    with its own counts left out, and from these scores come lambda, the root of
    E[exp(lambda s)] = 1 over the words of clean texts, K, so that their best segments
    have the mean of the extreme-value distribution, and the calibration. Without
    labels of both classes there is no model.
    """
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.join(F.broadcast(known), "doc_id").filter("text is not null")
    # copies are counted before the shuffle
    rows = saved(rows.groupBy("text").agg((2 * F.count_if(F.col("toxic") > 0) >= F.count(F.lit(1))).cast("int").alias("toxic")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, n = np.zeros((2, ROWS << BITS), np.int32), [0, 0]
        for b in sliced(batches):
            for text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n[toxic] += 1
                found = {f for w in set(WORDS.findall(text.lower())) for f in features(w)}
                if found:
                    np.add.at(tables[toxic], (places(list(found)) + (np.arange(ROWS) << BITS)).ravel(), 1)
        at = np.flatnonzero(tables.any(axis=0))
        yield pa.record_batch([pa.array(np.r_[at, -1]), pa.array(np.r_[tables[1][at], n[1]].astype(np.int64)), pa.array(np.r_[tables[0][at], n[0]].astype(np.int64))], names=["place", "toxic", "clean"])

    counts = rows.select("text", "toxic").mapInArrow(count, "place long, toxic long, clean long").groupBy("place").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    found = counts.filter((F.col("place") < 0) | (F.col("t") + F.col("c") > 0)).toArrow()  # ROWS << BITS rows at most
    place, t, c = (x.to_numpy() for x in found.columns)
    size = np.flatnonzero(place < 0)
    if not len(size) or not t[size[0]] or not c[size[0]]:
        dropped(rows)
        return None
    table = np.zeros((2, ROWS << BITS), np.int32)
    table[0, place[place >= 0]], table[1, place[place >= 0]] = t[place >= 0], c[place >= 0]
    model = Model(table.reshape(2, ROWS, 1 << BITS), (int(t[size[0]]), int(c[size[0]])))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, histogram = shared.value, np.zeros(2 * BINS + 1, np.int64)
        names, lists = ["toxic", "n", "best", "found", "words"], pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()), lists]
        for b in sliced(batches):
            out: list[tuple] = []
            for text, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                scores, found = own.scan(text, toxic)
                if not toxic and len(scores):
                    histogram += np.bincount(np.clip(np.rint(scores / STEP), -BINS, BINS).astype(int) + BINS, minlength=2 * BINS + 1)
                each = [s for *_, s in found]
                out.append((toxic, len(scores), max(each, default=None), each, None))
            yield pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)
        yield pa.record_batch([pa.array([x], k) for x, k in zip((None, None, None, None, histogram.tolist()), kinds, strict=True)], names=names)

    scanned = saved(rows.select("text", "toxic").mapInArrow(scan, "toxic int, n long, best double, found array<double>, words array<long>"))
    sums = scanned.filter("words is not null").select(F.posexplode("words").alias("i", "m")).groupBy("i").agg(F.sum("m").alias("m")).collect()
    histogram = np.zeros(2 * BINS + 1)
    for r in sums:
        histogram[r.i] = r.m
    model.rate = _rate(histogram)
    texts = scanned.filter("toxic is not null")
    gap = texts.filter("toxic = 0 and n > 0").agg(F.avg(F.lit(model.rate) * F.col("best") - F.log("n"))).first()[0]
    model.starts = exp((gap or 0.0) - float(np.euler_gamma))
    limit = F.log(F.lit(model.starts) * F.greatest("n", F.lit(1)))
    excess = F.transform("found", lambda s: F.lit(model.rate) * s - limit)
    top = F.array_max(excess)
    x = F.when(F.size("found") == 0, F.lit(-float(BINS))).otherwise(top + F.aggregate(excess, F.lit(0.0), lambda a, e: a + F.greatest(e, F.lit(0.0))) - F.greatest(top, F.lit(0.0)))
    x = F.signum(x) * F.log1p(F.abs(x))
    bins = texts.groupBy(F.round(x / STEP).alias("bin")).agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    model.fit = _logistic(np.array([r["bin"] for r in bins]) * STEP, np.array([r["t"] for r in bins], float), np.array([r["n"] - r["t"] for r in bins], float))
    for df in (rows, scanned):
        dropped(df)
    return model


def _rate(histogram: np.ndarray) -> float:
    """Lambda: the positive root of E[exp(lambda * score)] = 1 over words of clean texts."""
    p, s = histogram / max(1.0, histogram.sum()), (np.arange(2 * BINS + 1) - BINS) * STEP
    if not p[s > 0].sum():
        return 1.0
    low, high = 0.05, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, t: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method on binned counts, with a weak ridge."""
    a = b = 0.0
    t, c = t / max(1.0, t.sum()), c / max(1.0, c.sum())  # both classes weigh alike
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(t * (1 - p) - c * p).sum() - 1e-3 * a, ((t * (1 - p) - c * p) * x).sum() - 1e-3 * b])
        w = (t + c) * p * (1 - p)
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def toxicity(docs: DataFrame, labels: DataFrame, *, most_rows: int = 40_000, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_passages.

    Trains on labelled rows that are not held out and scores every whole text: a
    linear-time scan finds all maximal segments of word log-odds, for and against; the
    best one's excess over the extreme value expected by chance and those of all other
    significant ones are summed, and a logistic curve maps the sum to a probability.
    n_passages counts the significant ones.

    Null and empty texts have the least evidence. Null ids are never held out. Repeated
    rows are scored alike; equal scores are possible and mean nothing. Empty documents
    give no rows; without labels of both classes all scores are 0. Other columns are
    ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(slim, labels, most_rows=most_rows)
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    if model is None:
        return slim.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).alias("n_passages"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in sliced(batches):
            found = [own.judge(t or "") for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= threshold) for s, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int32())], names=["doc_id", "score", "predicted", "n_passages"])

    return slim.mapInArrow(run, "doc_id long, score double, predicted int, n_passages int").select("doc_id", held, "score", "predicted", "n_passages")


def kept(docs: DataFrame, labels: DataFrame, *, most_rows: int = 40_000, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text is not predicted to be toxic. Columns may
    have any names."""
    model = train(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), labels, most_rows=most_rows)
    if model is None:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in sliced(batches):
            yield b.filter(pa.array([own.judge("" if t is None else str(t))[0] < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
