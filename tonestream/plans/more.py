"""Queries on headers, tags, dates, joins, planning and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels, text
from ..model import samples, table
from ..operators import ms_adpcm
from ..sources import flac, headers, wav
from ..streaming import carry
from . import negotiate, registry
from .registry import S

QUERIES: dict[str, registry.Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f: registry.Query) -> registry.Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.replace(", 6)", f" + {registry.SHIFT!r}::DOUBLE, 6)")
        return f

    return add


@query("probe_best_format", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'wav' WHEN 1 THEN 'flac' WHEN 2 THEN 'mp3' END AS format FROM documents")
def probe_best_format(spark: SparkSession, d: str) -> DataFrame:
    heads = F.array(F.lit(b"RIFF\0\0\0\0WAVEfmt "), F.lit(b"fLaC"), F.lit(b"ID3\x04\0\0\0\0\0\0"), F.lit(b"    "))
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.get(heads, (F.col("doc_id") % 4).cast("int")), F.col("text").cast("binary")).alias("data"))
    return docs.select("doc_id", headers.best_format(F.col("data")).alias("format"))


_W = "w AS (SELECT event_id, CAST(4294639616 + (1 + event_id % 14) * 4096 + (event_id % 3) * 1024 + (event_id % 2) * 512 + (event_id % 4) * 64 AS BIGINT) AS w FROM events)"


@query("mp3_header_fields", f"WITH {_W}, p AS (SELECT event_id, (w >> 17) & 3 AS l, [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][CAST(((w >> 12) & 15) + 1 AS BIGINT)] AS kbps, [44100, 48000, 32000][CAST(((w >> 10) & 3) + 1 AS BIGINT)] AS rate, (w >> 9) & 1 AS padding, (w >> 6) & 3 AS mode FROM w) SELECT event_id, 4 - l AS layer, kbps, rate, padding, mode, 144000 * kbps // rate + padding AS frame_bytes FROM p")
def mp3_header_fields(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    word = F.lit(0xFFFB0000) + (1 + i % 14) * 4096 + (i % 3) * 1024 + (i % 2) * 512 + (i % 4) * 64
    fields = headers.mp3_header(F.col("w"))
    return table(spark, d, "events").select("event_id", word.alias("w")).select("event_id", *[c.cast("long").alias(n) for n, c in fields.items() if n != "version"])


@query("stream_info_fields", "SELECT doc_id, CAST(4096 AS BIGINT) AS max_block, CAST(44100 AS BIGINT) AS rate, CAST(2 AS BIGINT) AS channels, CAST(16 AS BIGINT) AS bits, n_chars AS samples FROM documents")
def stream_info_fields(spark: SparkSession, d: str) -> DataFrame:
    packed = F.lit((44100 << 44) - (1 << 64) if 44100 << 44 >= 1 << 63 else 44100 << 44) + F.lit(1 << 41) + F.lit(15 << 36) + F.col("n_chars")
    block = F.concat(F.lit(bytes.fromhex("10001000000000000000")), F.unhex(F.lpad(F.hex(packed), 16, "0")), F.lit(bytes(16)))
    f = headers.stream_info(F.col("b"))
    return table(spark, d, "documents").select("doc_id", block.alias("b")).select("doc_id", *[f[n].alias(n) for n in ("max_block", "rate", "channels", "bits", "samples")])


@query("toc_interpolate", f"WITH {S}, t AS (SELECT sid, idx, 100.0::DOUBLE * idx / count(*) OVER (PARTITION BY sid) AS pct FROM s), k AS (SELECT *, floor(pct) AS lo FROM t) SELECT sid, idx, CAST(floor((lo * lo * 0.0256 + (pct - lo) * ((lo + 1) * (lo + 1) * 0.0256 - lo * lo * 0.0256)) / 256 * 1000000) AS BIGINT) AS place FROM k")
def toc_interpolate(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = samples(spark, d).withColumn("pct", F.lit(100.0) * F.col("idx") / F.count(F.lit(1)).over(Window.partitionBy("sid"))).withColumn("lo", F.floor("pct"))
    at = lambda k: k * k * F.lit(0.0256)
    lo = F.col("lo")
    return s.select("sid", "idx", F.floor((at(lo) + (F.col("pct") - lo) * (at(lo + 1) - at(lo))) / 256 * 1000000).alias("place"))


@query("graph_gain_fade", f"WITH {S}, t AS (SELECT *, v * {levels.amp(-6.0)!r}::DOUBLE AS g FROM s) SELECT sid, idx, round(g * CASE WHEN idx < 5 THEN idx / 5.0::DOUBLE ELSE 1 END, 6) + 0 AS v FROM t")
def graph_gain_fade(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import filters

    g = negotiate.Graph().add("quiet", lambda x: filters.gain(x, -6.0)).add("fade", lambda x: filters.fade(x, 5, 0), "quiet")
    return registry.out(g.run(samples(spark, d)))


@query("partial_date_parse", "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 5 THEN strftime(o_orderdate, '%Y-%m') WHEN 6 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M') ELSE '' END AS iso FROM orders")
def partial_date_parse(spark: SparkSession, d: str) -> DataFrame:
    """Dates of seven layouts, and one that no layout has (month first, in digits)."""
    shapes = ["yyyy/MM/dd", "yyyy-MM", "yyyy", "EEE, dd MMM yyyy HH:mm:ss", "MMMM d, yyyy", "MMM yy", "dd MMM yyyy HH:mm 'GMT'", "MM/dd/yyyy"]
    raw = F.get(F.array(*[F.date_format("o_orderdate", s) for s in shapes]), (F.col("o_orderkey") % 8).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", text.iso_date(text.partial_date(F.col("raw"))).alias("iso"))


@query("wav_round_trip", registry.SQL["quantize_s16"])
def wav_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return wav.decode(wav.encode(registry.quantized(spark, d)))


@query("flac_round_trip", registry.SQL["quantize_s16"])
def flac_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return flac.decode(flac.files(flac.frames(registry.quantized(spark, d)))).select("sid", "idx", "q")


@query("flac_stereo_round_trip", registry.SQL["decorrelate"])
def flac_stereo_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """In 24 bits: amplitudes beyond full scale, and their squares, need more than 16."""
    coded = flac.frames(registry.stereo(spark, d), size=64, bits=24, channels=("l", "r"))
    both = flac.decode(flac.files(coded, size=64, bits=24, channels=2))
    side = lambda ch: F.max(F.when(F.col("ch") == ch, F.col("q")))
    return both.groupBy("sid", "idx").agg(side(0).alias("l"), side(1).alias("r"))


@query("ms_adpcm_encode")
def ms_adpcm_encode(spark: SparkSession, d: str) -> DataFrame:
    return ms_adpcm.encode(registry.quantized(spark, d)).select("sid", "block", "predictor", F.hex("data").alias("data"))


@query("ms_adpcm_decode")
def ms_adpcm_decode(spark: SparkSession, d: str) -> DataFrame:
    return ms_adpcm.decode(ms_adpcm.encode(registry.quantized(spark, d)))


@query("chunked_dc_offset", registry.SQL["dc_offset"].replace(f" + {registry.SHIFT!r}::DOUBLE", ""))
def chunked_dc_offset(spark: SparkSession, d: str) -> DataFrame:
    return registry.out(carry.remove_dc(samples(spark, d), 0.995))


@query("time_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def time_windows(spark: SparkSession, d: str) -> DataFrame:
    return carry.hourly(table(spark, d, "events"))
