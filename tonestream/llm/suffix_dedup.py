"""Operator 8: removing repeated byte strings by blockwise suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, freed, join_skewed, saved

#: Bytes of a hashed gram; a power of two.
GRAM = 32
#: Bytes whose grams are hashed at a time, unless one text is longer.
BLOCK = 1 << 18
#: Period of the difference cover, a square and a multiple of 8.
PERIOD = 64
#: Suffixes that are sorted at a time.
BUCKET = 200_000
#: Bytes of stretches whose suffixes are ordered together, unless one key has more.
TEXT = 1_000_000
#: Distinct stretches under one key that one task sorts; keys with more are split.
CROWD = 4_000
MULT = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit polynomial hash of each gram, by doubling."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * MULT
        power, n = MULT, 1
        while n < GRAM:
            h = h[: len(h) - n] * power + h[n:]
            power, n = power * power, 2 * n
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    out, n = h, 1
    while 2 * n <= width:
        out = np.minimum(out[: len(out) - n], out[n:])
        n *= 2
    return np.minimum(out[: len(h) - width + 1], out[width - n : width - n + len(h) - width + 1])


def stretches(data: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first window, number of windows, key: runs of windows of `width` bytes with one
    leftmost least gram, over texts laid end to end. Equal windows have equal keys and
    are never in one run."""
    if len(data) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(data)
    key = window_minima(grams, width - GRAM + 1)
    ends = np.cumsum(lengths)
    long = lengths >= width
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, (ends - lengths)[long], 1)
    np.add.at(mark, (ends - width + 1)[long], -1)
    inside = np.cumsum(mark)[: len(key)] > 0
    starts = np.zeros(len(key), bool)
    starts[(ends - lengths)[long]] = True
    # behind a window that starts with its least gram, the next least one is another
    change = np.r_[True, (key[1:] != key[:-1]) | (grams[: len(key) - 1] == key[:-1])] | starts | np.r_[True, inside[1:] & ~inside[:-1]]
    first = np.flatnonzero(change & inside)
    stop = np.flatnonzero(np.r_[change | ~inside, True])
    size = stop[np.searchsorted(stop, first, "right")] - first
    return first, size, key[first]


def find_stretches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """u, v, text -> u, v, ar, h, c: stretches, with first window and number of windows in ar and
    the digest c of their bytes."""
    for batch in batches:
        us, vs = (batch.column(i).to_numpy() for i in (0, 1))
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < BLOCK or end == at):
                size += len(texts[end])
                end += 1
            raw = b"".join(texts[at:end])
            lengths = np.fromiter(map(len, texts[at:end]), np.int64, end - at)
            first, count, key = stretches(np.frombuffer(raw, np.uint8), lengths, width)
            begins = np.cumsum(lengths) - lengths
            doc = np.searchsorted(begins, first, "right") - 1
            digest = xxhash.xxh3_64_intdigest
            c = np.fromiter((digest(raw[a:b]) for a, b in zip(first.tolist(), (first + count + width - 1).tolist(), strict=True)), np.uint64, len(first))
            yield pa.record_batch([pa.array(us[at:end][doc]), pa.array(vs[at:end][doc]), pa.array((first - begins[doc] << 16 | count).astype(np.int64)), pa.array(key.view(np.int64)), pa.array(c.view(np.int64))], names=["u", "v", "ar", "h", "c"])
            at = end


def words_at(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each place on as rows of big-endian 64-bit words."""
    view = np.lib.stride_tricks.sliding_window_view(data, n)
    return view[at].view(">u8").astype(np.uint64)


def by_words(words: np.ndarray) -> np.ndarray:
    """Order of rows of words, as strings of bytes."""
    rows = np.ascontiguousarray(words.astype(">u8")).view(f"S{8 * words.shape[1]}").ravel()
    return np.argsort(rows, kind="stable")


def difference_cover(period: int) -> np.ndarray:
    """0..r-1 and the multiples of r = sqrt(period): any difference modulo the period is
    one of a multiple of r and a number below r."""
    r = int(period**0.5)
    return np.unique(np.r_[np.arange(r), np.arange(0, period, r)])


@lru_cache(1)
def cover_steps() -> np.ndarray:
    """For residues i and j the least step that takes both into the cover."""
    inside = np.isin(np.arange(PERIOD), difference_cover(PERIOD))
    place = np.arange(PERIOD)
    both = [[inside[(i + place) % PERIOD] & inside[(j + place) % PERIOD] for j in range(PERIOD)] for i in range(PERIOD)]
    return np.argmax(np.array(both), axis=2)


class CoverRanks:
    """Ranks of the suffixes at a difference cover's places, for comparing any two
    suffixes that agree in PERIOD bytes."""

    def __init__(self, text: bytes) -> None:
        self.data = np.frombuffer(text + bytes(2 * PERIOD), np.uint8)
        n = len(text)
        self.inside = np.zeros(PERIOD, bool)
        self.inside[difference_cover(PERIOD)] = True
        sample = np.flatnonzero(np.tile(self.inside, n // PERIOD + 1)[:n])
        self.rank = np.full(n + 4 * PERIOD, -1, np.int64)
        # names by PERIOD bytes; the end of the text counts as less than any byte
        left = np.minimum(n - sample, PERIOD)
        words = words_at(self.data, sample, PERIOD)
        order = by_words(np.column_stack([words, left.astype(np.uint64)]))
        same = (words[order[1:]] == words[order[:-1]]).all(axis=1) & (left[order[1:]] == left[order[:-1]])
        name = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0)) if len(order) else order
        self.rank[sample[order]] = name
        h = PERIOD
        ranked = sample[order]
        while len(ranked):  # doubling: the place h further on is in the sample too
            tied = np.flatnonzero(np.r_[name[1:] == name[:-1], False] | np.r_[False, name[1:] == name[:-1]])
            if not len(tied):
                break
            at = ranked[tied]
            after = self.rank[np.minimum(at + h, n + PERIOD)]
            by = np.lexsort((after, name[tied]))
            at, after, was = at[by], after[by], name[tied][by]
            ranked[tied] = at
            fresh = np.r_[True, (was[1:] != was[:-1]) | (after[1:] != after[:-1])]
            name = name.copy()
            name[tied] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            self.rank[at] = name[tied]
            h *= 2
        self.step = cover_steps()

    def ordered(self, ties: np.ndarray) -> np.ndarray:
        """Suffixes that agree in PERIOD bytes, in order. Of one residue they have the
        same step into the cover; lists of several residues are merged pair by pair."""
        lists = [ties[ties % PERIOD == r] for r in np.unique(ties % PERIOD)]
        lists = [x[np.argsort(self.rank[x + self.step[x[0] % PERIOD, x[0] % PERIOD]], kind="stable")] for x in lists]
        while len(lists) > 1:
            lists = [self.merged(*lists[k : k + 2]) if k + 1 < len(lists) else lists[k] for k in range(0, len(lists), 2)]
        return lists[0]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Two ordered lists as one. Each list has few residues: a binary search for each
        pair of residues places b's members in a, vectorised over the members."""
        low, high = np.zeros(len(b), np.int64), np.full(len(b), len(a), np.int64)
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high) // 2, 0)
            x, d = a[mid], self.step[a[mid] % PERIOD, b % PERIOD]
            less = self.rank[x + d] < self.rank[b + d]
            low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
        out = np.empty(len(a) + len(b), np.int64)
        place = low + np.arange(len(b))
        rest = np.ones(len(out), bool)
        rest[place] = False
        out[place], out[rest] = b, a
        return out


def suffix_buckets(text: bytes, starts: np.ndarray, keys: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The suffixes at `starts` in order, one bucket at a time: suffixes are dealt out by
    splitters of 8 bytes, each bucket is sorted by its first PERIOD bytes, and ties go by
    the ranks of the cover. Beyond the text, memory is a bucket and the cover's ranks.
    With keys, a number for each start, suffixes are in order within each key."""
    if not len(starts):
        return
    cover = CoverRanks(text)
    lead = words_at(cover.data, starts, 8)[:, 0] if keys is None else keys
    n = max(1, len(starts) // BUCKET)
    cuts = np.unique(np.sort(lead[:: max(1, len(lead) // (64 * n))])[64 // 2 :: 64]) if n > 1 else np.zeros(0, np.uint64)
    bucket = np.searchsorted(cuts, lead, "right")
    for k in range(len(cuts) + 1):
        own = starts[bucket == k]
        if not len(own):
            continue
        words = words_at(cover.data, own, PERIOD)
        if keys is not None:
            words = np.column_stack([keys[bucket == k], words])
        order = by_words(words)
        words, own = words[order], own[order]
        same = (words[1:] == words[:-1]).all(axis=1)
        first = np.flatnonzero(np.r_[True, ~same])
        group = np.cumsum(np.r_[0, ~same])
        left = own % PERIOD
        mixed = np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)
        # ties of one residue take the same step into the cover: all groups at once
        plain = np.flatnonzero((np.r_[same, False] | np.r_[False, same]) & ~mixed[group])
        ties = own[plain]
        by = np.lexsort((cover.rank[ties + cover.step[ties % PERIOD, ties % PERIOD]], group[plain]))
        own[plain] = ties[by]
        ends = np.r_[first[1:], len(own)]
        for a, b in zip(first[mixed].tolist(), ends[mixed].tolist(), strict=True):
            own[a:b] = cover.ordered(own[a:b])
        yield own


def repeated_windows(text: bytes, starts: np.ndarray, width: int, keys: np.ndarray | None = None) -> np.ndarray:
    """Those of `starts` whose `width` bytes are also at another of them (of its key).
    Equal windows are neighbours in suffix order, so each is compared with the one
    before it."""
    data, found, last = np.frombuffer(text, np.uint8), [], np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(data, width) if len(data) >= width else data
    for own in suffix_buckets(text, starts, keys):
        own = np.r_[last, own]
        for k in range(0, len(own) - 1, 20_000):
            a, b = own[k : k + 20_000], own[k + 1 : k + 20_001]
            same = (view[a[: len(b)]] == view[b]).all(axis=1)
            found += [a[: len(b)][same], b[same]]
        last = own[-1:]
    return np.unique(np.concatenate(found)) if found else last[:0]


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive numbers as starts and lengths."""
    cut = np.flatnonzero(np.diff(places) > 1) + 1
    first = np.r_[places[:1], places[cut]]
    return first, np.diff(np.r_[0, cut, len(places)]) if len(places) else first


def sort_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """h, c, r, data, sorted by h -> h, c, i, k: window i and k - 1 after it recur in
    another stretch or another place of one key. Small keys are sorted many at a time."""
    rest: list[tuple] = []
    size = 0
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            new = list(zip(*(x.to_pylist() for x in batch.slice(k, 500).columns), strict=True))
            rest += new
            size += sum(len(x[3]) for x in new)
            if size > TEXT:
                last = next((k for k in range(len(rest) - 1, 0, -1) if rest[k - 1][0] != rest[-1][0]), 0)
                if last:
                    yield _sorted(rest[:last], width)
                    rest = rest[last:]
                    size = sum(len(x[3]) for x in rest)
    yield _sorted(rest, width)


def _sorted(rows: list[tuple], width: int) -> pa.RecordBatch:
    # the least gram of each stretch is put at a multiple of the period, so that equal
    # windows share a residue
    text, begins = bytearray(), []
    lengths = np.array([len(x[3]) for x in rows], np.int64)
    flat = np.frombuffer(b"".join(x[3] for x in rows), np.uint8)
    keys = np.repeat(np.array([x[0] for x in rows], np.int64).view(np.uint64), lengths)
    ends = np.cumsum(lengths)
    hits = np.flatnonzero(gram_hashes(flat) == keys[: max(0, len(flat) - GRAM + 1)]) if len(flat) >= GRAM else ends[:0]
    at = hits[np.searchsorted(hits, ends - lengths)] - (ends - lengths) if len(hits) else ends[:0]
    for (*_, data), p in zip(rows, at.tolist(), strict=True):
        text += bytes(-(len(text) + p) % PERIOD)
        begins.append(len(text))
        text += data
    begin = np.array(begins, np.int64)
    starts = np.concatenate([b + np.arange(r) for b, (_, _, r, _) in zip(begins, rows, strict=True)]) if rows else begin
    counts = np.array([x[2] for x in rows], np.int64)
    number = np.cumsum(np.r_[0, np.diff(np.array([x[0] for x in rows], np.int64)) != 0])[: len(rows)]
    first, size = runs(repeated_windows(bytes(text), starts, width, np.repeat(number, counts).astype(np.uint64)))
    row = np.searchsorted(begin, first, "right") - 1
    h, c = (np.array([x[i] for x in rows], np.int64) for i in (0, 1))
    return pa.record_batch([pa.array(x) for x in (h[row], c[row], first - begin[row], size)], names=["h", "c", "i", "k"])


def cut_bytes(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """text, need (structs of ar, h, c) -> h, c, r, data."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            out: list[tuple] = []
            for text, need in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                out += [(x["h"], x["c"], x["ar"] & 65535, raw[x["ar"] >> 16 : (x["ar"] >> 16) + (x["ar"] & 65535) + width - 1]) for x in need]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["h", "c", "r", "data"])


def hash_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """h, c, r, data -> h, c, i, w1, w2: 128 bits of each window."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            cols: list[list] = [[], [], [], [], []]
            for h, c, r, data in zip(*(x.to_pylist() for x in batch.slice(k, 1000).columns), strict=True):
                for i in range(r):
                    w = xxhash.xxh3_128_intdigest(data[i : i + width])
                    for col, v in zip(cols, (h, c, i, (w >> 64) - (1 << 63), (w & (1 << 64) - 1) - (1 << 63)), strict=True):
                        col.append(v)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in cols], names=["h", "c", "i", "w1", "w2"])


def finish(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text, spans (structs of at, n: windows) -> the result's rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            cols: list[list] = [[] for _ in range(4)]
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                removed = spans_removed = 0
                left, at = hashlib.sha256(), 0
                if spans:
                    edge = np.zeros(len(raw) + 1, np.int32)
                    a = np.array([x["at"] for x in spans])
                    np.add.at(edge, a, 1)
                    np.add.at(edge, a + np.array([x["n"] for x in spans]) + width - 1, -1)
                    first, size = runs(np.flatnonzero(np.cumsum(edge)[:-1] > 0))
                    removed, spans_removed = int(size.sum()), len(first)
                    for b, n in zip(first.tolist(), size.tolist(), strict=True):
                        left.update(raw[at:b])
                        at = b + n
                left.update(raw[at:])
                for c, v in zip(cols, (len(raw), removed, spans_removed, left.hexdigest()), strict=True):
                    c.append(v)
            yield pa.record_batch([part.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, *, width: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removes each byte that lies in a string of `width` bytes that also starts anywhere
    else in the documents, overlaps included.

    Every window of `width` bytes is keyed by the least hash of its grams, so equal
    windows meet under a key, and windows under keys found once drop out. Runs of windows
    with one least gram are stretches; equal stretches are counted, not gathered, so groups of
    copies stay small. Under keys with several different stretches their windows are put
    in suffix order, block by block with difference-cover ranks for ties, and equal
    neighbours recur. A key with over CROWD different stretches is not gathered: its
    windows are counted by 128-bit hashes. Stretches are identified by 128 bits as well.

    Null and empty texts have no bytes and keep the digest of nothing. Null ids are kept;
    repeated rows repeat each other's bytes. An empty table gives no rows. Other columns
    are ignored.
    """
    if width < 2 * GRAM:
        raise ValueError(f"width must be {2 * GRAM} or more")
    spark = docs.sparkSession
    # u and v name a row by its content: numbers given to rows could change on a rerun
    ident, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    slim = docs.select(F.xxhash64(text).alias("u"), F.coalesce(ident, F.lit(-1)).alias("v"), ident.alias("doc_id"), text.alias("text"))
    found = saved(slim.select("u", "v", "text").mapInArrow(lambda it: find_stretches(it, width), "u long, v long, ar long, h long, c long"))

    # per distinct stretch: how often, and one place to read it from. Copies are counted before
    # anything is joined, so that what is joined on h is one row of each
    total = max(1, found.count())
    every = saved(found.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("u", "v", "ar")).alias("at")))
    freed(spark)
    keys = every.groupBy("h").agg(F.count(F.lit(1)).alias("differ"), F.sum("n").alias("total"))
    hot = saved(keys.filter(F.col("differ") * 1000 > every.count()))  # 1000 keys at most
    freed(spark)
    under = Window.partitionBy("h")
    kinds = every.join(F.broadcast(hot), "h", "left_anti").select("*", F.count(F.lit(1)).over(under).alias("differ"), F.sum("n").over(under).alias("total"))
    if not hot.isEmpty():  # their stretches are counted in parts, and never meet in one task
        kinds = kinds.unionByName(every.join(F.broadcast(hot), "h"))
    kinds = saved(kinds.filter("total > 1").drop("total"))
    dropped(every)
    freed(spark)

    # the bytes of one of each, under keys with several
    need = kinds.filter("differ > 1").groupBy(F.col("at.u").alias("u"), F.col("at.v").alias("v")).agg(F.collect_list(F.struct(F.col("at.ar").alias("ar"), "h", "c")).alias("need"))
    need = saved(need)
    # rows that share id and text are read once
    data = slim.select("u", "v", "text").join(need.select("u", "v"), ["u", "v"], "left_semi").dropDuplicates(["u", "v"]).join(need, ["u", "v"]).select("text", "need").mapInArrow(lambda it: cut_bytes(it, width), "h long, c long, r long, data binary")
    data = saved(data)
    freed(spark)
    crowded = saved(kinds.filter(F.col("differ") > CROWD).select("h").distinct())
    small, large = data, None
    if crowded.take(1):
        small, large = data.join(crowded, "h", "left_anti"), data.join(crowded, "h", "left_semi")
    again = small.select("h", "c", "r", "data").repartition("h").sortWithinPartitions("h").mapInArrow(lambda it: sort_groups(it, width), "h long, c long, i long, k long")
    if large is not None:
        windows = saved(large.repartition("h", "c").mapInArrow(lambda it: hash_windows(it, width), "h long, c long, i long, w1 long, w2 long"))
        twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        again = again.unionByName(windows.join(twice, ["w1", "w2"]).select("h", "c", "i", F.lit(1).cast("long").alias("k")))
    parts = again.groupBy("h", "c").agg(F.collect_list(F.struct("i", "k")).alias("parts"))
    whole = kinds.filter("n > 1").select("h", "c", F.array(F.struct(F.lit(0).cast("long").alias("i"), F.expr("at.ar & 65535L").alias("k"))).alias("parts"), "n")
    once = kinds.filter("n = 1 and differ > 1").select("h", "c")
    marked = saved(whole.unionByName(parts.join(once, ["h", "c"], "left_semi").withColumn("n", F.lit(1).cast("long"))))
    freed(spark)

    spans = join_skewed(found, marked, ["h", "c"], "n", total).select("u", "v", F.explode(F.transform("parts", lambda p: F.struct((F.shiftright("ar", 16) + p["i"]).alias("at"), p["k"].alias("n")))).alias("s"))
    spans = saved(spans.groupBy("u", "v").agg(F.collect_list("s").alias("spans")))
    for x in (found, kinds, need, data, marked):
        dropped(x)
    freed(spark)
    return slim.join(spans, ["u", "v"], "left").select("doc_id", "text", "spans").mapInArrow(lambda it: finish(it, width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
