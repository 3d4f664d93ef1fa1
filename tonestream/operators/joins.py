"""Joins by time and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(targets: DataFrame, points: DataFrame, key: str, target: str, at: str, values: list[str]) -> DataFrame:
    """Each target with the last point of its key that isn't past it, as values of that
    point; nulls where there is none. Both sides are one sorted stream by key: no pairs."""
    kept = [c for c in targets.columns if c not in (key, target)]
    rows = targets.select(F.col(key).alias("k_"), F.col(target).alias("t_"), F.lit(1).alias("side_"), F.struct(*([F.col(c) for c in kept] or [F.lit(0).alias("none_")])).alias("row_"))
    marks = points.select(F.col(key).alias("k_"), F.col(at).alias("t_"), F.lit(0).alias("side_"), F.struct(F.col(at).alias("at_"), *values).alias("p_"))
    typed = marks.withColumn("row_", F.lit(None).cast(rows.schema["row_"].dataType)).unionByName(rows.withColumn("p_", F.lit(None).cast(marks.schema["p_"].dataType)))
    last = F.last("p_", ignorenulls=True).over(Window.partitionBy("k_").orderBy("t_", "side_").rowsBetween(Window.unboundedPreceding, 0))
    out = typed.withColumn("last_", last).filter("side_ = 1")
    return out.select(F.col("k_").alias(key), F.col("t_").alias(target), *[F.col(f"row_.{c}").alias(c) for c in kept], F.col("last_.at_").alias(at), *[F.col(f"last_.{v}").alias(v) for v in values])


def side_by_side(a: DataFrame, b: DataFrame, key: str = "sid", at: str = "idx", v: str = "v") -> DataFrame:
    """Two streams by place over what both have: key, at, and the samples a and b."""
    return a.select(key, at, F.col(v).alias("a")).join(b.select(key, at, F.col(v).alias("b")), [key, at])


def compared(pairs: DataFrame, key: str = "sid", at: str = "idx") -> DataFrame:
    """max_abs, the first place of it, RMSE and SNR in dB of each stream of pairs."""
    d = F.abs(F.col("a") - F.col("b"))
    noise, power = F.sum(d * d), F.sum(F.col("a") * F.col("a"))
    return pairs.groupBy(key).agg(F.max(d).alias("max_abs"), F.max_by(at, F.struct(d.alias("d"), (-F.col(at)).alias("n"))).alias("at"), F.sqrt(F.avg(d * d)).alias("rmse"), F.when(noise > 0, 10 * (F.log10(power) - F.log10(noise))).alias("snr_db"))
