"""Queries on tags, MPEG and FLAC files, layouts, stream choice and encoder decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layouts
from ..model import samples, spread, table
from ..operators import codecs
from ..sources import flac_meta, mpeg, tags
from . import registry
from .registry import Q16, S

QUERIES: dict[str, registry.Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[registry.Query], registry.Query]:
    def add(f: registry.Query) -> registry.Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def made(df: DataFrame, build: Callable[..., bytes]) -> DataFrame:
    """A file for each row: sid (the first column), content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                raw = [build(*row) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield pa.record_batch([b.column(0), pa.array(raw, pa.binary())], names=["sid", "content"])

    return spread(df).mapInArrow(run, "sid long, content binary")


# ---- tags


@query("id3v2_round_trip", "SELECT doc_id AS sid, concat('Nº ', doc_id, ' ', source) AS title, concat(lang, '|', source) AS artists, lang AS comment, '2011-03-09' AS date, 1 + doc_id % 99 AS track, CAST(99 AS BIGINT) AS track_total FROM documents")
def id3v2_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Tags of all three versions, written and parsed again."""

    def build(sid: int, lang: str, source: str) -> bytes:
        return tags.build_v2({"title": f"Nº {sid} {source}", "artist": [lang, source], "comment": lang, "date": "2011-03-09", "track": 1 + sid % 99, "track_total": 99}, 2 + sid % 3) + b"audio"

    t = tags.read_tags(made(table(spark, d, "documents").select("doc_id", "lang", "source"), build))
    return t.select("sid", "title", F.array_join("artist", "|").alias("artists"), "comment", "date", "track", "track_total")


@query("id3v1_round_trip", "SELECT c_custkey AS sid, left(concat('Customer Number ', c_name), 30) AS title, c_mktsegment AS album, '1999' AS date, 1 + c_custkey % 200 AS track, CAST(5 AS BIGINT) AS stop FROM customer")
def id3v1_round_trip(spark: SparkSession, d: str) -> DataFrame:
    def build(sid: int, name: str, segment: str) -> bytes:
        return b"audio" + tags.build_v1({"title": f"Customer Number {name}", "album": segment, "date": "1999", "track": 1 + sid % 200})

    t = tags.read_tags(made(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), build))
    return t.select("sid", "title", "album", "date", "track", "stop")


@query("id3_merge", "SELECT c_custkey AS sid, CASE WHEN c_custkey % 2 = 0 THEN concat('long ', c_name) ELSE 'short' END AS title, CASE WHEN c_custkey % 2 = 0 THEN 'old|new' ELSE 'old' END AS artists, 'kept' AS album FROM customer")
def id3_merge(spark: SparkSession, d: str) -> DataFrame:
    """What ID3v2 says goes over ID3v1; artists become an ordered union."""

    def build(sid: int, name: str) -> bytes:
        front = tags.build_v2({"title": f"long {name}", "artist": ["new", "old"][: 1 + sid % 3]}, 4) if sid % 2 == 0 else b""
        return front + tags.build_v1({"title": "short", "artist": ["old"], "album": "kept"})

    t = tags.read_tags(made(table(spark, d, "customer").select("c_custkey", "c_name"), build))
    return t.select("sid", "title", F.array_join("artist", "|").alias("artists"), "album")


def fields(df: DataFrame, parse: Callable[[bytes], tags.Bundle], names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse(x) for x in b.column(1).to_pylist()]
            text = lambda v: "|".join(v) if isinstance(v, list) else None if v is None else str(v)
            yield pa.record_batch([b.column(0), *[pa.array([text(x.get(n)) for x in found], pa.string()) for n in names]], names=["sid", *names])

    return df.mapInArrow(run, "sid long, " + ", ".join(f"{n} string" for n in names))


@query("riff_info_round_trip", "SELECT p_partkey AS sid, p_name AS title, p_brand AS artist, p_type AS genre FROM part")
def riff_info_round_trip(spark: SparkSession, d: str) -> DataFrame:
    files = made(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), lambda sid, n, b, t: tags.build_info({"title": n, "artist": [b], "genre": t}))
    return fields(files, tags.parse_info, ["title", "artist", "genre"])


@query("vorbis_block_round_trip", "SELECT p_partkey AS sid, p_name AS title, concat(p_brand, '|', p_type) AS artist, CAST(1 + p_size AS VARCHAR) AS track FROM part")
def vorbis_block_round_trip(spark: SparkSession, d: str) -> DataFrame:
    files = made(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), lambda sid, n, b, t, k: flac_meta.build_comments({"title": n, "artist": [b, t], "track": 1 + k}))
    return fields(files, flac_meta.parse_comments, ["title", "artist", "track"])


@query("picture_size", "SELECT page_id AS sid, CAST(1 + page_id % 500 AS VARCHAR) AS width, CAST(1 + page_id % 300 AS VARCHAR) AS height, CASE WHEN page_id % 2 = 0 THEN 'image/png' ELSE 'image/gif' END AS mime FROM pages")
def picture_size(spark: SparkSession, d: str) -> DataFrame:
    """Pictures in FLAC blocks; type and size come from the image's own header."""

    def build(sid: int) -> bytes:
        w, h = 1 + sid % 500, 1 + sid % 300
        png = b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")
        gif = b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little")
        return tags.build_picture({"mime": "", "type": 3, "description": "", "data": gif if sid % 2 else png})

    return fields(made(table(spark, d, "pages").select("page_id"), build), tags.parse_picture, ["width", "height", "mime"])


# ---- files


_MP3 = "f AS (SELECT c_custkey AS sid, k, [64, 128, 192, 256, 320][CAST(1 + (c_custkey + k) % 5 AS BIGINT)] AS kbps FROM customer, (SELECT unnest(range(0, 6)) AS k) WHERE k <= c_custkey % 6)"


def mp3_files(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's one to six frames of changing bitrate between two tags, with noise."""
    rates = (64, 128, 192, 256, 320)

    def build(sid: int, name: str) -> bytes:
        frames = [mpeg.frame_bytes(rates[(sid + k) % 5], body=name.encode()) for k in range(sid % 6 + 1)]
        return mpeg.build(frames, {"title": name}, 3 + sid % 2)

    return made(table(spark, d, "customer").select("c_custkey", "c_name"), build)


@query("mp3_frame_scan", f"WITH {_MP3} SELECT sid, count(*) AS frames, CAST(sum(144000 * kbps // 44100) AS BIGINT) AS bytes, (count(*) - 1) * 1152 AS last_pts FROM f GROUP BY sid")
def mp3_frame_scan(spark: SparkSession, d: str) -> DataFrame:
    p = mpeg.packets(mp3_files(spark, d))
    return p.groupBy("sid").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.octet_length("data").cast("long")).alias("bytes"), F.max("pts").alias("last_pts"))


@query("mp3_xing_seek", "SELECT c_custkey AS sid, round((100 + c_custkey) * 1152 / 44100.0::DOUBLE, 6) AS seconds, 'xing' AS vbr, (c_custkey % 100 * 2 * (100 + c_custkey) * 417) // 256 AS place FROM customer")
def mp3_xing_seek(spark: SparkSession, d: str) -> DataFrame:
    """Duration by the VBR header; the byte of a percentage by its table (entry i is 2 i)."""

    def build(sid: int) -> bytes:
        return mpeg.xing_frame(100 + sid, (100 + sid) * 417, [2 * i for i in range(100)]) + mpeg.frame_bytes(128) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [mpeg.analyze(raw) for raw in b.column(1).to_pylist()]
            # half a byte past the entry, so that rounding of seconds can't fall below it
            place = [mpeg.seek(i, sid % 100 / 100 * i.seconds + 1e-9) for sid, i in zip(b.column(0).to_pylist(), found, strict=True)]
            yield pa.record_batch([b.column(0), pa.array([round(i.seconds, 6) for i in found], pa.float64()), pa.array([i.vbr.kind for i in found], pa.string()), pa.array(place, pa.int64())], names=["sid", "seconds", "vbr", "place"])

    return made(table(spark, d, "customer").select("c_custkey"), build).mapInArrow(run, "sid long, seconds double, vbr string, place long")


@query("flac_seek_table", "SELECT p_partkey AS sid, CAST(1 + p_size AS BIGINT) AS points, CAST(p_size // 2 * 500 AS BIGINT) AS place FROM part")
def flac_seek_table(spark: SparkSession, d: str) -> DataFrame:
    """1 + size points of 4096 samples and 500 bytes and two placeholders; a seek to the middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [flac_meta.parse_seek_table(x) for x in b.column(1).to_pylist()]
            place = [flac_meta.seek(p, (len(p) - 1) // 2 * 4096 + 5, 0, 0) for p in found]
            yield pa.record_batch([b.column(0), pa.array([len(p) for p in found], pa.int64()), pa.array(place, pa.int64())], names=["sid", "points", "place"])

    files = made(table(spark, d, "part").select("p_partkey", "p_size"), lambda sid, n: flac_meta.build_seek_table([(k * 4096, k * 500, 4096) for k in range(n + 1)], 2))
    return files.mapInArrow(run, "sid long, points long, place long")


@query("flac_frame_sizes", "WITH b AS (SELECT page_id, octet_length(encode(html)) AS n FROM pages) SELECT page_id, CASE WHEN n > 700 THEN CAST(700 AS BIGINT) END AS min_block, least(n, 700) AS max_block, n AS samples FROM b WHERE n > 0")
def flac_frame_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Of blocks of 700: the smallest one but for the last, the largest, and the total."""
    p = table(spark, d, "pages").select("page_id", F.octet_length(F.col("html").cast("binary")).cast("long").alias("n")).filter("n > 0")
    blocks = p.withColumn("k", F.explode(F.expr("sequence(0L, (n - 1) div 700)"))).withColumn("size", F.least(F.lit(700), F.col("n") - F.col("k") * 700))
    last = F.col("k") == F.expr("(n - 1) div 700")
    return blocks.groupBy("page_id").agg(F.min(F.when(~last, F.col("size"))).cast("long").alias("min_block"), F.max("size").cast("long").alias("max_block"), F.sum("size").alias("samples"))


@query("byte_compare", "WITH c AS (SELECT page_id, html AS a, CASE WHEN page_id % 3 = 0 THEN html WHEN page_id % 3 = 1 THEN left(html, 100) ELSE concat(left(html, 50), chr(1), substr(html, 52)) END AS b FROM pages) SELECT page_id, CASE WHEN a = b THEN NULL WHEN page_id % 3 = 1 THEN octet_length(encode(left(a, 100))) ELSE octet_length(encode(left(a, 50))) END AS mismatch, octet_length(encode(a)) = octet_length(encode(b)) AS same_length FROM c")
def byte_compare(spark: SparkSession, d: str) -> DataFrame:
    """Byte streams by offset: the first mismatch, where the shorter one ends at the latest."""
    html, k = F.col("html"), F.col("page_id") % 3
    other = F.when(k == 0, html).when(k == 1, F.left(html, F.lit(100))).otherwise(F.concat(F.left(html, F.lit(50)), F.lit("\x01"), F.substring(html, F.lit(52), F.length(html))))
    c = table(spark, d, "pages").select("page_id", html.cast("binary").alias("a"), other.cast("binary").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                low, high = 0, min(len(x), len(y))
                while low < high:  # the longest common prefix by halving
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid - 1)
                out.append(None if x == y else low)
            yield pa.record_batch([b.column(0), pa.array(out, pa.int64()), pa.array([len(x.as_py()) == len(y.as_py()) for x, y in zip(b.column(1), b.column(2), strict=True)], pa.bool_())], names=["page_id", "mismatch", "same_length"])

    return c.mapInArrow(run, "page_id long, mismatch long, same_length boolean")


# ---- layouts, formats, choices

_L = "['mono', ' Stereo', '2.0', 'quad', '5.1', '7.1', '9.9'][CAST(1 + event_id % 7 AS BIGINT)]"
_MASK = "[4, 3, 3, 51, 63, 1599, NULL][CAST(1 + event_id % 7 AS BIGINT)]"
_NAMES = "['FC', 'FL,FR', 'FL,FR', 'FL,FR,BL,BR', 'FL,FR,FC,LFE,BL,BR', 'FL,FR,FC,LFE,BL,BR,SL,SR', ''][CAST(1 + event_id % 7 AS BIGINT)]"


@query("layout_parse", f"SELECT event_id, CAST({_MASK} AS BIGINT) AS mask, CAST([1, 2, 2, 4, 6, 8, NULL][CAST(1 + event_id % 7 AS BIGINT)] AS INTEGER) AS n, CAST([NULL, NULL, NULL, 2, 4, 4, NULL][CAST(1 + event_id % 7 AS BIGINT)] AS INTEGER) AS bl, {_NAMES} AS names, (event_id % 5 + 1) * (event_id % 5 + 1) AS ambisonic FROM events")
def layout_parse(spark: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, ["mono", " Stereo", "2.0", "quad", "5.1", "7.1", "9.9"])), (F.col("event_id") % 7).cast("int"))
    e = table(spark, d, "events").select("event_id", layouts.parse(name).alias("mask"))
    m = F.col("mask")
    return e.select("event_id", "mask", layouts.count(m).alias("n"), layouts.index(m, "BL").alias("bl"), layouts.positions(m).alias("names"), layouts.ambisonic(F.col("event_id") % 5).alias("ambisonic"))


@query("format_algebra", "WITH f AS (SELECT event_id, ['u8', 's16p', 's24', 'f32p', 'f64', 'x'][CAST(1 + event_id % 6 AS BIGINT)] AS f, CAST([1, 2, 3, 4, 8, NULL][CAST(1 + event_id % 6 AS BIGINT)] AS INTEGER) AS bytes FROM events) SELECT event_id, rtrim(f, 'p') AS packed, rtrim(f, 'p') || 'p' AS planar, f LIKE '%p' AS is_planar, f LIKE 'f%' AS is_float, bytes FROM f")
def format_algebra(spark: SparkSession, d: str) -> DataFrame:
    fmt = F.get(F.array(*map(F.lit, ["u8", "s16p", "s24", "f32p", "f64", "x"])), (F.col("event_id") % 6).cast("int"))
    f = F.col("f")
    return table(spark, d, "events").select("event_id", fmt.alias("f")).select("event_id", layouts.packed(f).alias("packed"), layouts.planar(f).alias("planar"), layouts.is_planar(f).alias("is_planar"), layouts.is_float(f).alias("is_float"), layouts.width(f).alias("bytes"))


query(
    "fnv64",
    "WITH RECURSIVE d AS MATERIALIZED (SELECT page_id, hex(encode(url)) AS x, octet_length(encode(url)) AS n FROM pages), r AS (SELECT page_id, CAST(0 AS BIGINT) AS i, CAST(14695981039346656037 AS HUGEINT) AS h FROM d UNION ALL SELECT d.page_id, r.i + 1, CAST((CAST(xor(CAST(h AS UBIGINT), CAST(('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2)) AS UBIGINT)) AS HUGEINT) * 1099511628211) % CAST(18446744073709551616 AS HUGEINT) AS HUGEINT) FROM r JOIN d USING (page_id) WHERE r.i < d.n) SELECT page_id, lower(printf('%016x', CAST(h AS UBIGINT) | CAST(9223372036854775808 AS UBIGINT))) AS fnv FROM r JOIN d USING (page_id) WHERE r.i = d.n",
)(lambda s, d: table(s, d, "pages").select("page_id", layouts.fnv64(F.col("url").cast("binary")).alias("fnv")))


# ---- encoder decisions

_R = "lags AS (SELECT a.sid, sum(a.v * a.v) AS r0, sum(a.v * b.v) AS r1, sum(a.v * c.v) AS r2 FROM s a LEFT JOIN s b ON b.sid = a.sid AND b.idx = a.idx - 1 LEFT JOIN s c ON c.sid = a.sid AND c.idx = a.idx - 2 GROUP BY a.sid)"


@query("levinson_order_2", f"WITH {S}, {_R}, k AS (SELECT sid, r0, r1, r2, r1 / r0 AS k1 FROM lags WHERE r0 > 0 AND r2 IS NOT NULL AND abs(r1 / r0) < 0.99), t AS (SELECT sid, k1, (r2 - k1 * r1) / (r0 * (1 - k1 * k1)) AS k2 FROM k) SELECT sid, round(k1 - k2 * k1, 6) + 0 AS a1, round(k2, 6) + 0 AS a2 FROM t WHERE abs(k2) < 0.99")
def levinson_order_2(spark: SparkSession, d: str) -> DataFrame:
    """Second-order predictors by the recursion, of streams whose reflections stay below 0.99."""
    lags = codecs.autocorrelation(samples(spark, d), 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for sid, *r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[2] is not None and r[0] > 0 and abs(r[1] / r[0]) < 0.99:
                    a = codecs.levinson(r, 2)
                    if len(a) == 2 and abs(a[1]) < 0.99:
                        rows.append((sid, round(a[0], 6) + 0.0, round(a[1], 6) + 0.0))
            yield pa.record_batch([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64()))], names=["sid", "a1", "a2"])

    return lags.select("sid", "lag0", "lag1", "lag2").mapInArrow(run, "sid long, a1 double, a2 double")


_COST = """r AS (SELECT sid, idx, CASE WHEN q >= 0 THEN 2 * q ELSE -2 * q - 1 END AS u FROM q),
 c AS (SELECT sid, idx // 32 AS block, lev, (idx % 32) // (32 // (1 << lev)) AS part, k, 80 + 4 + count(*) * (k + 1) + sum(u >> k) AS bits FROM r, (SELECT unnest([0, 1]) AS lev), (SELECT unnest(range(0, 15)) AS k) GROUP BY sid, idx // 32, lev, (idx % 32) // (32 // (1 << lev)), k),
 m AS (SELECT sid, block, lev, part, min(bits) AS bits FROM c GROUP BY ALL), w AS (SELECT sid, block, sum(bits) FILTER (WHERE lev = 0) AS parent, sum(bits) FILTER (WHERE lev = 1) AS halves FROM m GROUP BY ALL)"""


@query("block_split", f"WITH {Q16}, {_COST} SELECT sid, block, CAST(parent AS BIGINT) AS parent, CAST(halves AS BIGINT) AS halves, halves < parent AS split FROM w")
def block_split(spark: SparkSession, d: str) -> DataFrame:
    """Whether two halves with their own overhead and Rice parameters cost less than the whole."""
    q = registry.quantized(spark, d).withColumn("u", F.when(F.col("q") >= 0, F.col("q") * 2).otherwise(F.col("q") * -2 - 1))
    rows = q.withColumns({"block": F.floor(F.col("idx") / 32), "lev": F.explode(F.array(F.lit(0), F.lit(1)))}).withColumn("part", F.expr("(idx % 32) div (32 div shiftleft(1, lev))"))
    # every parameter is an aggregate of its own: one shuffle, no row per parameter
    costs = [(F.lit(84) + F.count(F.lit(1)) * (k + 1) + F.sum(F.shiftright("u", k))).alias(f"k{k}") for k in range(15)]
    best = rows.groupBy("sid", "block", "lev", "part").agg(*costs).withColumn("bits", F.least(*[f"k{k}" for k in range(15)]))
    w = best.groupBy("sid", "block").agg(F.sum(F.when(F.col("lev") == 0, F.col("bits"))).alias("parent"), F.sum(F.when(F.col("lev") == 1, F.col("bits"))).alias("halves"))
    return w.select("sid", "block", "parent", "halves", (F.col("halves") < F.col("parent")).alias("split"))


_STEREO = "p AS (SELECT a.sid, a.frame_no, a.idx, CAST(trunc(a.v * 1000) AS BIGINT) AS l, CAST(trunc(a.v * 500) AS BIGINT) AS r FROM s a), e AS (SELECT sid, frame_no, CAST(sum(abs(l)) AS BIGINT) AS l, CAST(sum(abs(r)) AS BIGINT) AS r, CAST(sum(abs((l + r) >> 1)) AS BIGINT) AS m, CAST(sum(abs(l - r)) AS BIGINT) AS d FROM p GROUP BY ALL)"


@query("stereo_assignment", f"WITH {S}, {_STEREO}, b AS (SELECT sid, frame_no, least(l + r, l + d, d + r, m + d) AS cost, l, r, m, d FROM e) SELECT sid, frame_no, cost, CASE cost WHEN l + r THEN 'independent' WHEN l + d THEN 'left_side' WHEN d + r THEN 'side_right' ELSE 'mid_side' END AS choice FROM b")
def stereo_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Of four ways to code a pair the one with the least sum of amplitudes; the first of ties."""
    left, right = (F.col("v") * 1000).cast("long"), (F.col("v") * 500).cast("long")
    e = samples(spark, d).select("sid", "frame_no", left.alias("l"), right.alias("r"))
    total = lambda c: F.sum(F.abs(c))
    e = e.groupBy("sid", "frame_no").agg(total(F.col("l")).alias("l"), total(F.col("r")).alias("r"), total(F.shiftright(F.col("l") + F.col("r"), 1)).alias("m"), total(F.col("l") - F.col("r")).alias("d"))
    ways = {"independent": "lr", "left_side": "ld", "side_right": "dr", "mid_side": "md"}
    found = [F.struct((F.col(w[0]) + F.col(w[1])).alias("cost"), F.lit(i).alias("i"), F.lit(n).alias("choice")) for i, (n, w) in enumerate(ways.items())]
    best = F.array_min(F.array(*found))
    return e.select("sid", "frame_no", best["cost"].alias("cost"), best["choice"].alias("choice"))
