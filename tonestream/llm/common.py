"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words and that exact deduplication ignores.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. What is
    not dropped before goes when the driver's JVM ends.

    Only a local master may go without that setting; it gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tonestream-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tonestream-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, *, sort: list[str] | None = None) -> DataFrame:
    """df as a written table in the shared folder: its lineage ends there, so a lost
    executor costs a reread and never a recomputation of what came before."""
    spark = df.sparkSession
    path = shared_dir(spark)
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what saved() wrote, once nothing reads it any more."""
    path = getattr(df, "saved_path", None)
    if path:
        remove_path(df.sparkSession, path)


def freed(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows that a single task may well hold, so that none of their keys can be hot.
SMALL = 10_000


def join_skewed(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int, most: int = 1000, how: str = "inner") -> DataFrame:
    """Inner or left join of rows with groups, which has one row per key and the key's
    number of rows in `size`.

    Keys that hold more than 1/most of all `total` rows are at most `most` in number, a
    proven bound; those groups are broadcast, so their rows never meet in one task. The
    other keys go through an ordinary shuffled join, in which no key is hot. So do all keys
    of up to SMALL rows.
    """
    if total <= SMALL:
        return rows.join(groups, key, how)
    hot = F.col(size) * F.lit(most) > F.lit(total)
    head = groups.filter(hot)
    if head.isEmpty():
        return rows.join(groups, key, how)
    rest = rows.join(F.broadcast(head.select(*key)), key, "left_anti").join(groups.filter(~hot), key, how)
    return rows.join(F.broadcast(head), key).unionByName(rest)
