"""Operator 9: SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, freed, join_skewed, saved

#: Shingles whose bits are counted at a time.
BLOCK = 200_000
#: Distinct fingerprints under one key beyond which it is split by further bits.
CROWD = 20_000


def shingle_hashes(text: str, width: int, seed: int) -> list[int]:
    """XXH64 of each run of `width` words, repeats included; of the whole if shorter."""
    words = text.encode().lower().split()  # bytes: A-Z and the six white-space characters only
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """One fingerprint per list: the bits set in over half of its hashes; 0 for none."""
    out = np.zeros(len(hashes), np.uint64)
    at = 0
    while at < len(hashes):
        end, size = at, 0
        while end < len(hashes) and (size < BLOCK or end == at):
            size += len(hashes[end])
            end += 1
        own = [h for h in hashes[at:end] if h]
        votes = np.zeros((len(own), 64), np.int64)
        flat = np.fromiter((x for h in own for x in h), np.uint64, size)
        first = np.cumsum([0, *map(len, own)])
        for k in range(0, size, BLOCK):  # a text of any length in bounded memory
            bits = np.unpackbits(flat[k : k + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lo, hi = np.searchsorted(first, k, "right") - 1, np.searchsorted(first, min(size, k + BLOCK), "left")
            cuts = np.maximum(first[lo:hi], k) - k
            votes[lo:hi] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        set_ = 2 * votes > np.array([len(h) for h in own], np.int64).reshape(-1, 1)
        here = np.array([bool(h) for h in hashes[at:end]], bool)
        if len(own):
            out[at:end][here] = np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()
        at = end
    return out


def fingerprints(docs: DataFrame, *, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the 64-bit SimHash as a signed long; null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                fp = majority([shingle_hashes(t or "", width, seed) for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def forest(fps: np.ndarray, stored: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that connect what the links between `stored` ones and all connect, at most
    one per member. Distances are taken in blocks, so memory stays linear."""
    bits = fps.view(np.uint64)  # of signed numbers numpy counts the bits of the magnitude
    label, edges = np.arange(len(fps)), []
    table = np.flatnonzero(stored)
    step = max(1, 2_000_000 // len(fps))
    for k in range(0, len(table), step):
        near = np.bitwise_count(bits[table[k : k + step], None] ^ bits[None, :]) <= most
        for row in near:
            groups = np.unique(label[row])
            if len(groups) > 1:
                edges += [(int(fps[groups[0]]), int(fps[g])) for g in groups[1:]]
                label[np.isin(label, groups)] = groups[0]
    return edges


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """a, b: edges whose connected components are those of all pairs of distinct
    fingerprints at `most` (3 at most) or fewer differing bits.

    Two 32-bit segments: at 3 or fewer bits, one segment differs in 1 bit or none. Each
    fingerprint is stored under both segments and looks up the Hamming ball of radius 1
    around them; of two neighbours only the one with the bit set has to look, by clearing
    it. Under a key the complete distances are verified and a spanning forest goes on. A
    key's group holds distinct fingerprints that agree in 31 bits, not documents: copies
    don't enlarge it. Keys with over CROWD of them are split by bytes of the other segment.
    """
    if not 0 <= most <= 3:
        raise ValueError("two segments with balls of radius 1 find up to 3 bits")
    low, high = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"
    ball = "transform(filter(sequence(0, 31), i -> shiftright({0}, i) & 1L = 1L), i -> ({0}) ^ shiftleft(1L, i))"
    keys = [f"transform({ball.format(f'({s})')}, k -> struct(k + {n}L * 4294967296L as key, false as stored))" for n, s in enumerate((low, high))]
    own = [f"struct(({s}) + {n}L * 4294967296L as key, true as stored)" for n, s in enumerate((low, high))]
    probes = fps.select("fp", F.explode(F.expr(f"concat(array({', '.join(own)}), {', '.join(keys)})")).alias("p")).select(F.col("p.key"), F.col("p.stored"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]

        def done(key: np.ndarray, stored: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.r_[first, len(key)])
            some = np.add.reduceat(stored, first, dtype=np.int64) > 0 if len(first) else size > 0
            edges: list[tuple[int, int]] = []
            for a, n in zip(first[some & (size > 1)].tolist(), size[some & (size > 1)].tolist(), strict=True):
                edges += forest(fp[a : a + n], stored[a : a + n], most)
            return pa.record_batch([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            cols = [np.r_[r, c.to_numpy(zero_copy_only=False)] for r, c in zip(rest, b.columns, strict=True)]
            end = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last key may go on
            yield done(*(c[:end] for c in cols))
            rest = [c[end:] for c in cols]
        yield done(*rest)

    by_key = lambda rows: rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    large = saved(probes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("key"))
    if large.isEmpty():
        return by_key(probes)
    # a link under a key differs in 3 bits at most of the other segment, so one of its
    # four bytes is equal: a large key is split by each of them, and no link is lost
    other = f"if(shiftright(key, 32) = 0, {high}, {low})"
    split = f"transform(sequence(0, 3), j -> xxhash64(key, j, shiftright({other}, 8 * j) & 255L))"
    parts = probes.join(large, "key", "left_semi").select(F.explode(F.expr(split)).alias("key"), "stored", "fp")
    return by_key(probes.join(large, "key", "left_anti")).unionByName(by_key(parts))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of an edge.

    Alternating large-star and small-star contraction; each round is a written table, so
    a lost executor never reaches back beyond it. Ends when a round changes nothing.
    """
    spark = edges.sparkSession
    edges = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        total = max(1, 2 * now[0])
        large = join_skewed(both, least, ["a"], "n", total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = saved(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_skewed(large, least, ["a"], "n", total)
        small = small.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = saved(small)
        dropped(edges)
        dropped(large)
        edges = small
        freed(spark)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, width: int = 3, seed: int = 42, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked when their fingerprints differ in `most` or fewer bits;
    component_id is the smallest doc_id in the document's connected component. Documents
    with one fingerprint count once from then on, so copies never form pairs.

    Null, empty and wordless texts have fingerprint 0 and are linked like any other.
    Rows with a null id get their component's smallest id; it is null if the component
    has none. Repeated rows share a component. An empty table gives no rows. Other
    columns are ignored.
    """
    rows = saved(fingerprints(docs, width=width, seed=seed, id_col=id_col, text_col=text_col))
    fps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    total = max(1, rows.count())
    found = saved(components(links(fps.select("fp"), most)).withColumnRenamed("node", "fp"))
    least = fps.join(found, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named = saved(join_skewed(found, least, ["root"], "m", total).select("fp", "component_id"))
    every = fps.join(named, "fp", "left").select("fp", "n", F.when(F.col("component_id").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    every = saved(every)
    for x in (fps, found, named):
        dropped(x)
    freed(docs.sparkSession)
    out = join_skewed(rows, every, ["fp"], "n", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
