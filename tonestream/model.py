"""Streams of samples: long form (sid, ch, idx, v), one row per sample.

Row order within a stream is meaning, not storage: it is always the column idx.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores: where each takes long, a task for every 128 MB of a
    file, which may be millions of rows, leaves most of them idle."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a mono stream: sid, idx, v in (-1, 1), frame_no, kind."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    idx = (F.row_number().over(order) - 1).cast("long")
    return e.select(F.col("user_id").alias("sid"), idx.alias("idx"), ((F.col("value") - 50.0) / 512.0).alias("v"), F.col("event_type").alias("kind")).withColumn("frame_no", F.floor(F.col("idx") / FRAME))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of one plane each: sid, idx, v."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sid"), F.posexplode("embedding").alias("idx", "v")).select("sid", F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("v"))


def multichannel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as one sample of four channels: FL, FR, FC and LFE."""
    s = samples(spark, sf_dir)
    return s.select("sid", "idx", "frame_no", F.col("v").alias("fl"), (F.col("v") * 0.5).alias("fr"), (-F.col("v") * 0.25).alias("fc"), (F.col("v") * 0.125).alias("lfe"))
